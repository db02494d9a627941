"""Queries of ordered, graph and extended operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels, ring, score
from ..operators import choice, graph, ordered, spatial
from ..sources.fixtures import CELLS_SQL, FOLLOW_SQL, POINTS_SQL, cells_embed, followers, points_parts
from . import enrich
from .queries_geometry import KNN_SQL, r, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_H = lambda k: "+".join(f"CASE WHEN sum(CASE WHEN b={i} THEN 1 ELSE 0 END) OVER w{k}>0 THEN -(sum(CASE WHEN b={i} THEN 1 ELSE 0 END) OVER w{k}/count(*) OVER w{k})*ln(sum(CASE WHEN b={i} THEN 1 ELSE 0 END) OVER w{k}/count(*) OVER w{k}) ELSE 0 END" for i in range(4))


@query(
    "path_entropy",
    f"""WITH e AS (SELECT user_id, event_id, value, least(3,floor((abs(value)-floor(abs(value)))*4)) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    h AS (SELECT user_id, event_id, value, CASE WHEN n<2 THEN 0 WHEN n<4 THEN {_H(1)} ELSE {_H(2)} END AS h, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM e
    WINDOW w1 AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), w2 AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT user_id, event_id, {r('h')} AS entropy, {r('lead(h) OVER w-h')} AS entropy_delta, {r('CASE WHEN lead(value) OVER w IS NULL THEN NULL WHEN abs(value)>1e-18 THEN lead(value) OVER w/value ELSE 1 END',3)} AS ratio, {r('c',4)} AS cumulative FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def _(spark, d):
    """O165: windows of entropy along ordered paths (events of a user)."""
    out = ordered.path_entropy(_table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").drop("value")
    return rounded(rounded(rounded(out, "entropy", "entropy_delta"), "ratio", digits=3), "cumulative", digits=4)


@query(
    "harmonic_gradient",
    f"""WITH {POINTS_SQL}, s AS (SELECT slide_id, cell_id, centroid_x-min(centroid_x) OVER (PARTITION BY slide_id) AS s, ln(area) AS l FROM pts), f AS (SELECT slide_id, avg(s) md, avg(l) ml, -regr_slope(l,s) AS lam FROM s GROUP BY ALL),
    u AS (SELECT slide_id, cell_id, (l-ml+lam*s>=0) AS up FROM s JOIN f USING (slide_id)), t AS (SELECT slide_id, up<>lag(up) OVER (PARTITION BY slide_id ORDER BY cell_id) AS t FROM u), k AS (SELECT slide_id, count(*) FILTER (t) AS k FROM t GROUP BY ALL), z AS (SELECT slide_id, arg_max(s,cell_id) AS z FROM s GROUP BY ALL)
    SELECT slide_id, {r('greatest(exp(ml+lam*md),1e-18)')} AS amplitude, {r('greatest(lam,0)')} AS decay, {r('k/(2*greatest(z,1e-9))')} AS frequency FROM f JOIN k USING (slide_id) JOIN z USING (slide_id)""",
)
def _(spark, d):
    """O166: log-linear fit and sign changes along an axis."""
    out = ordered.harmonic_gradient(points_parts(spark, d), "slide_id", "cell_id", "centroid_x", "centroid_y", "area")
    return rounded(out, "amplitude", "decay", "frequency")


@query("path_integral", f"WITH {POINTS_SQL}, l AS (SELECT slide_id, centroid_x x, centroid_y y, lead(centroid_x) OVER w nx, lead(centroid_y) OVER w ny FROM pts WINDOW w AS (PARTITION BY slide_id ORDER BY cell_id)) SELECT slide_id, {r('coalesce(sum(exp(-((x+nx)*(x+nx)+(y+ny)*(y+ny))/4e6)*sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))),0)',4)} AS integral FROM l GROUP BY slide_id")
def _(spark, d):
    """O167: line integral of a Gaussian field."""
    out = ordered.path_integral(points_parts(spark, d), "slide_id", "cell_id", "centroid_x", "centroid_y", lambda x, y: F.exp(-(x * x + y * y) / 1e6))
    return rounded(out, "integral", digits=4)


@query(
    "radial_walk",
    f"""WITH RECURSIVE {POINTS_SQL}, w AS (SELECT slide_id, 0 AS step, min(cell_id) AS cell_id, [min(cell_id)] AS seen FROM pts GROUP BY slide_id
    UNION ALL SELECT w.slide_id, w.step+1, n.c, list_append(w.seen, n.c) FROM w JOIN pts a ON a.slide_id=w.slide_id AND a.cell_id=w.cell_id, LATERAL (SELECT arg_min(b.cell_id, (b.centroid_x-a.centroid_x)*(b.centroid_x-a.centroid_x)+(b.centroid_y-a.centroid_y)*(b.centroid_y-a.centroid_y) + b.cell_id*1e-9) AS c FROM pts b WHERE b.slide_id=w.slide_id AND NOT list_contains(w.seen, b.cell_id)) n WHERE w.step<50 AND n.c IS NOT NULL)
    SELECT slide_id, step, cell_id FROM w""",
)
def _(spark, d):
    """O168: greedy walk to the nearest unvisited cell."""
    return ordered.radial_walk(points_parts(spark, d), 50)


@query("laplacian_loss", f"WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=4)} SELECT e.slide_id, {r('sum(0.5*((a.area-b.area)*(a.area-b.area)/1e4+(a.centroid_x-b.centroid_x)*(a.centroid_x-b.centroid_x)/1e4)+0.01*0.25)',4)} AS loss FROM edges e JOIN pts a ON a.slide_id=e.slide_id AND a.cell_id=src JOIN pts b ON b.slide_id=e.slide_id AND b.cell_id=dst GROUP BY e.slide_id")
def _(spark, d):
    """O169: smoothness loss of weighted edges."""
    p = points_parts(spark, d)
    feats = p.select("slide_id", "cell_id", (F.col("area") / 100).alias("f1"), (F.col("centroid_x") / 100).alias("f2"))
    return rounded(graph.laplacian_loss(spatial.knn(p, 4).withColumn("weight", F.lit(0.5)), feats, ["f1", "f2"]), "loss", digits=4)


@query(
    "constrained_weights",
    f"""WITH RECURSIVE {POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)}, few AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY cell_id)<=30),
    g AS (SELECT e.slide_id, list(pow((a.area-b.area)/100,2)+pow((a.centroid_x-b.centroid_x)/100,2) ORDER BY src, dst) AS g FROM edges e JOIN few a ON a.slide_id=e.slide_id AND a.cell_id=src JOIN few b ON b.slide_id=e.slide_id AND b.cell_id=dst GROUP BY e.slide_id),
    s AS (SELECT slide_id, g, list_transform(g, lambda x: 1.0::double) AS w, 'inf'::double AS prev, 0 AS i, false AS done FROM g
      UNION ALL SELECT slide_id, g, CASE WHEN done THEN w WHEN t>1e6 THEN list_transform(n, lambda x: x*1e6/t) WHEN t<0.1 THEN list_transform(n, lambda x: x*0.1/greatest(t,1e-18)) ELSE n END, loss, i+1, done FROM
        (SELECT *, list_sum(n) AS t FROM (SELECT *, abs(prev-loss)<1e-6 AS done, list_transform(list_zip(w,g), lambda z: least(10,greatest(0,z[1]-0.001*(z[2]+0.02*z[1])))) AS n FROM
          (SELECT slide_id, g, w, prev, i, list_sum(list_transform(list_zip(w,g), lambda z: z[1]*z[2]+0.01*z[1]*z[1])) AS loss FROM s WHERE NOT done AND i<200)))),
    z AS (SELECT slide_id, arg_max(done,i) AS done, max(i) AS i, arg_max(prev,i) AS prev, arg_max(w,i) AS w, any_value(g) AS g FROM s GROUP BY slide_id)
    SELECT slide_id, {r('CASE WHEN done THEN prev ELSE list_sum(list_transform(list_zip(w,g), lambda z: z[1]*z[2]+0.01*z[1]*z[1])) END',4)} AS loss, i::bigint AS rounds FROM z""",
)
def _(spark, d):
    """O183-O185: projected gradient descent on the first cells of each slide."""
    p = points_parts(spark, d).withColumns({"f1": F.col("area") / 100, "f2": F.col("centroid_x") / 100})
    return rounded(graph.constrained_weights(spatial.knn(p), p, ["f1", "f2"]), "loss", digits=4)


@query(
    "equilibrium_patches",
    f"""WITH RECURSIVE {POINTS_SQL}, {KNN_SQL.format(t='pts', k=3)}, q AS (SELECT e.slide_id, src, dst FROM edges e JOIN pts a ON a.slide_id=e.slide_id AND a.cell_id=src JOIN pts b ON b.slide_id=e.slide_id AND b.cell_id=dst WHERE abs(a.area-b.area)<=200),
    u AS (SELECT slide_id, src, dst FROM q UNION SELECT slide_id, dst, src FROM q), c AS (SELECT slide_id, src AS cell_id, src AS m FROM u UNION SELECT u.slide_id, u.dst, c.m FROM c JOIN u ON c.slide_id=u.slide_id AND c.cell_id=u.src)
    SELECT slide_id, min(m) AS patch, cell_id FROM c GROUP BY slide_id, cell_id""",
)
def _(spark, d):
    """O180: components over calm edges."""
    p = points_parts(spark, d)
    return graph.equilibrium_patches(p, spatial.knn(p, 3), "area", 200.0)


#: DuckDB: groups of ``pts`` (ph: by the rank of their least cell) merged pair by pair, a step for each.
_MERGED = f"""{POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)}, no AS (SELECT slide_id, cell_id, row_number() OVER (PARTITION BY slide_id ORDER BY cell_id) AS k FROM pts),
un AS (SELECT e.slide_id, a.k AS x, b.k AS y FROM edges e JOIN no a ON a.slide_id=e.slide_id AND a.cell_id=src JOIN no b ON b.slide_id=e.slide_id AND b.cell_id=dst),
ta AS (SELECT slide_id, least(greatest(cast(floor(sqrt(count(*))) AS bigint),4), count(*)//2) AS target FROM no GROUP BY slide_id HAVING count(*)>=4),
lab AS (SELECT slide_id, 0 AS i, k, k AS g FROM no SEMI JOIN ta USING (slide_id) UNION ALL
  SELECT l.slide_id, l.i+1, l.k, CASE WHEN l.g=b.hi THEN b.lo ELSE l.g END FROM lab l
  JOIN (SELECT slide_id, lo, hi FROM (SELECT u.slide_id, least(p.g,q.g) AS lo, greatest(p.g,q.g) AS hi, count(*) AS w FROM un u JOIN lab p ON p.slide_id=u.slide_id AND p.k=x JOIN lab q ON q.slide_id=u.slide_id AND q.k=y WHERE p.g<>q.g GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY w DESC, lo, hi)=1) b ON b.slide_id=l.slide_id
  JOIN (SELECT slide_id FROM lab JOIN ta USING (slide_id) GROUP BY slide_id, target HAVING count(DISTINCT g)>target) c ON c.slide_id=l.slide_id),
mo AS (SELECT slide_id, cast(dense_rank() OVER (PARTITION BY slide_id ORDER BY g)-1 AS integer) AS module, cell_id FROM (SELECT * FROM lab QUALIFY i=max(i) OVER (PARTITION BY slide_id)) JOIN no USING (slide_id, k))"""


@query("communities", f"WITH RECURSIVE {_MERGED} SELECT slide_id, module, cell_id FROM mo")
def _(spark, d):
    """O181: greedy communities of the neighbour graph."""
    p = points_parts(spark, d)
    return graph.communities(p, spatial.knn(p))


@query(
    "tissue_iq_pipeline",
    f"""WITH RECURSIVE {_MERGED}, m AS (SELECT slide_id, module, count(DISTINCT area>1)/avg(greatest(area,1e-12)) AS iq FROM mo JOIN pts USING (slide_id, cell_id) GROUP BY ALL), a AS (SELECT slide_id, count(*) n, avg(iq) mu, stddev_pop(iq) sd FROM m GROUP BY ALL)
    SELECT slide_id, any_value(n) AS n_modules, {r('any_value(mu)')} AS mean_iq, {r('any_value(sd)')} AS std_iq, {r('any_value(sd)/any_value(mu)')} AS cv_iq, count(*) FILTER (iq>mu+sd) AS heterogeneous FROM m JOIN a USING (slide_id) GROUP BY slide_id""",
)
def _(spark, d):
    """O182: neighbours, communities and their scores."""
    p = points_parts(spark, d).withColumn("phenotype", (F.col("area") > 1.0).cast("int"))
    return rounded(graph.tissue_iq(p, graph.communities(p, spatial.knn(p)), "phenotype"), "mean_iq", "std_iq", "cv_iq")


@query(
    "tissue_iq",
    f"""WITH {POINTS_SQL}, m AS (SELECT slide_id, cell_id%6 AS module, count(DISTINCT cell_id%5)/avg(greatest(area,1e-12)) AS iq FROM pts GROUP BY ALL), a AS (SELECT slide_id, count(*) n, avg(iq) mu, stddev_pop(iq) sd FROM m GROUP BY ALL)
    SELECT slide_id, any_value(n) AS n_modules, {r('any_value(mu)',9)} AS mean_iq, {r('any_value(sd)',9)} AS std_iq, {r('any_value(sd)/any_value(mu)')} AS cv_iq, count(*) FILTER (iq>mu+sd) AS heterogeneous FROM m JOIN a USING (slide_id) GROUP BY slide_id""",
)
def _(spark, d):
    """O145: module scores for given modules."""
    p = points_parts(spark, d).withColumn("phenotype", F.col("cell_id") % 5)
    m = p.select("slide_id", (F.col("cell_id") % 6).alias("module"), "cell_id")
    return rounded(rounded(graph.tissue_iq(p, m, "phenotype"), "cv_iq"), "mean_iq", "std_iq", digits=9)


#: Eigenvalues e1 >= e2 >= e3 of the slides' matrices of products (a..f), by the closed form for three columns.
_EIGEN = f"""WITH {CELLS_SQL}, m AS (SELECT slide_id, sum(area*area/100) a, sum(circularity*circularity) b, sum(eccentricity*eccentricity) c, sum(area/10*circularity) d, sum(circularity*eccentricity) e, sum(area/10*eccentricity) f FROM g GROUP BY ALL),
q AS (SELECT *, (a+b+c)/3 AS q FROM m), p AS (SELECT *, sqrt((pow(a-q,2)+pow(b-q,2)+pow(c-q,2)+2*(d*d+e*e+f*f))/6) AS p FROM q),
t AS (SELECT *, acos(greatest(-1,least(1,((a-q)*((b-q)*(c-q)-e*e)-d*(d*(c-q)-e*f)+f*(d*e-(b-q)*f))/(2*p*p*p))))/3 AS t FROM p),
ev AS (SELECT *, q+2*p*cos(t) AS e1, q+2*p*cos(t+2*pi()/3) AS e3, 3*q-(q+2*p*cos(t))-(q+2*p*cos(t+2*pi()/3)) AS e2 FROM t),
rk AS (SELECT *, CASE WHEN e1>=0.9*(e1+e2+e3) THEN 1 WHEN e1+e2>=0.9*(e1+e2+e3) THEN 2 ELSE 3 END AS rank90 FROM ev)"""


@query("spectral_embedding", _EIGEN + f" SELECT slide_id, {r('e1+e2+e3', 3)} AS energy, {r('sqrt(e1)', 4)} AS s1, {r('sqrt(e2)', 4)} AS s2, {r('sqrt(e3)', 4)} AS s3, rank90 FROM rk")
def _(spark, d):
    """O186-O189, O198: singular values and rank by slide."""
    c = enrich.shape(cells_embed(spark, d)).select("slide_id", "cell_id", "circularity", "eccentricity", (F.col("area") / 10).alias("a10"))
    slides, _ = graph.spectral(c, ["a10", "circularity", "eccentricity"])
    out = slides.select("slide_id", (F.round(F.expr("aggregate(singular_values, 0D, (t, s) -> t + s * s)"), 3) + 0.0).alias("energy"), *[F.col("singular_values")[i].alias(f"s{i + 1}") for i in range(3)], F.col("rank90"))
    return rounded(out, "s1", "s2", "s3", digits=4)


@query("spectral_energy", f"WITH {CELLS_SQL} SELECT slide_id, {r('sum(area*area/100+circularity*circularity+eccentricity*eccentricity)',3)} AS energy FROM g GROUP BY slide_id")
def _(spark, d):
    """O186: the squared singular values add up to the trace."""
    return QUERIES["spectral_embedding"](spark, d).select("slide_id", "energy")


@query(
    "orthogonal_pairs",
    # the projection on an eigenvector is the product of (M - other values) over the differences; M (a, d, f; d, b, e; f, e, c)
    _EIGEN + f""", w AS (SELECT g.slide_id, cell_id, area/10 AS x, circularity AS y, eccentricity AS z, rk.* EXCLUDE (slide_id) FROM g JOIN rk USING (slide_id)),
    mw AS (SELECT *, a*x+d*y+f*z AS mx, d*x+b*y+e*z AS my, f*x+e*y+c*z AS mz FROM w),
    u AS (SELECT *, mx-e1*x AS x1, my-e1*y AS y1, mz-e1*z AS z1, mx-e2*x AS x2, my-e2*y AS y2, mz-e2*z AS z2, mx-e3*x AS x3, my-e3*y AS y3, mz-e3*z AS z3 FROM mw),
    dt AS (SELECT s.slide_id, s.cell_id AS a, t.cell_id AS b, (s.x2*t.x3+s.y2*t.y3+s.z2*t.z3)/((s.e1-s.e2)*(s.e1-s.e3)*s.e1)
      + CASE WHEN s.rank90>1 THEN (s.x1*t.x3+s.y1*t.y3+s.z1*t.z3)/((s.e2-s.e1)*(s.e2-s.e3)*s.e2) ELSE 0 END + CASE WHEN s.rank90>2 THEN (s.x1*t.x2+s.y1*t.y2+s.z1*t.z2)/((s.e3-s.e1)*(s.e3-s.e2)*s.e3) ELSE 0 END AS dot
      FROM u s JOIN u t ON s.slide_id=t.slide_id AND s.cell_id<t.cell_id)
    SELECT slide_id, a, b, {r('dot')} AS dot FROM dt WHERE abs(dot)<=0.01""",
)
def _(spark, d):
    """O133, O188: nearly orthogonal pairs and quadrants."""
    c = enrich.shape(cells_embed(spark, d)).select("slide_id", "cell_id", "circularity", "eccentricity", (F.col("area") / 10).alias("a10"))
    _, cells = graph.spectral(c, ["a10", "circularity", "eccentricity"])
    dot = F.signum("dot") * (F.floor(F.abs("dot") * 1e6 + 0.5) / 1e6) + 0.0  # at most 10,000 millionths: no decimals for each pair
    return graph.orthogonal_pairs(cells, 0.01, 3).withColumn("dot", dot)


_Q = f"""q0 AS (SELECT slide_id, cell_id, centroid_x, centroid_y, (1-least(1,greatest(0,eccentricity)))*circularity AS w, cos(2*pi()*0.25*(cell_id%4))*eccentricity AS x, sin(2*pi()*0.25*(cell_id%4))*eccentricity AS y, greatest(-1,least(1,area/10)) AS z FROM g),
q AS (SELECT slide_id, cell_id, centroid_x, centroid_y, w/s AS w, x/s AS x, y/s AS y, z/s AS z FROM (SELECT *, greatest(sqrt(w*w+x*x+y*y+z*z),1e-18) AS s FROM q0))"""


def _states(spark, d):
    c = enrich.shape(cells_embed(spark, d))
    k = (F.col("cell_id") % 4) * 0.25
    return c.select("slide_id", "cell_id", "centroid_x", "centroid_y", score.quaternion(F.col("eccentricity"), F.col("circularity"), k, F.col("area")).alias("q"))


@query("quaternion_states", f"WITH {CELLS_SQL}, {_Q} SELECT slide_id, cell_id, {r('w')} AS w, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM q")
def _(spark, d):
    """O203: orientation of each cell."""
    return rounded(_states(spark, d).select("slide_id", "cell_id", "q.*"), "w", "x", "y", "z")


@query("configuration_entropy", f"WITH {CELLS_SQL}, {_Q} SELECT a.slide_id, {r('avg(acos(least(1,abs(a.w*b.w+a.x*b.x+a.y*b.y+a.z*b.z))))')} AS entropy FROM q a JOIN q b ON a.slide_id=b.slide_id AND a.cell_id<b.cell_id GROUP BY a.slide_id")
def _(spark, d):
    """O134, O204: mean geodesic distance over all pairs."""
    s = _states(spark, d)
    a, b = s.select("slide_id", F.col("cell_id").alias("a"), F.col("q").alias("qa")), s.select("slide_id", F.col("cell_id").alias("b"), F.col("q").alias("qb"))
    return rounded(a.join(b, "slide_id").where("a < b").groupBy("slide_id").agg(F.avg(score.geodesic("qa", "qb")).alias("entropy")), "entropy")


@query("orientation_coherence", f"WITH {CELLS_SQL}, {_Q}, {KNN_SQL.format(t='q', k=8)}, m AS (SELECT e.slide_id, src, avg(acos(least(1,abs(a.w*b.w+a.x*b.x+a.y*b.y+a.z*b.z)))) AS m FROM edges e JOIN q a ON a.cell_id=src JOIN q b ON b.cell_id=dst GROUP BY ALL) SELECT slide_id, {r('avg(m)')} AS coherence FROM m GROUP BY slide_id")
def _(spark, d):
    """O135: mean geodesic distance to spatial neighbours."""
    s = _states(spark, d)
    a, b = s.select("slide_id", F.col("cell_id").alias("src"), F.col("q").alias("qa")), s.select("slide_id", F.col("cell_id").alias("dst"), F.col("q").alias("qb"))
    e = spatial.knn(s).join(a, ["slide_id", "src"]).join(b, ["slide_id", "dst"]).groupBy("slide_id", "src").agg(F.avg(score.geodesic("qa", "qb")).alias("m"))
    return rounded(e.groupBy("slide_id").agg(F.avg("m").alias("coherence")), "coherence")


@query(
    "best_axis",
    f"""WITH {POINTS_SQL}, m AS (SELECT slide_id, cell_id%3=0 AS f, count(*) n, avg(centroid_x/100) ma, avg(area/100) mb, var_pop(centroid_x/100) va, var_pop(area/100) vb, covar_pop(centroid_x/100,area/100) cab FROM pts GROUP BY ALL),
    b AS (SELECT p.slide_id, -3+6.0*i/6 AS alpha, -3+6.0*j/6 AS beta, pi()*t/6 AS theta, i, j, t, p.ma-q.ma AS da, p.mb-q.mb AS db, p.va+q.va AS va, p.vb+q.vb AS vb, p.cab+q.cab AS cab FROM m p JOIN m q ON p.slide_id=q.slide_id AND p.f AND NOT q.f AND p.n>=2 AND q.n>=2, (SELECT unnest(range(7)) i), (SELECT unnest(range(7)) j), (SELECT unnest(range(7)) t)),
    s AS (SELECT *, CASE WHEN sqrt(greatest((alpha*alpha*va+beta*beta*vb+2*alpha*beta*cab)*cos(theta)*cos(theta),0))>1e-12 THEN round(abs(alpha*da+beta*db)*abs(cos(theta))/sqrt(greatest((alpha*alpha*va+beta*beta*vb+2*alpha*beta*cab)*cos(theta)*cos(theta),0)),9) ELSE 0 END AS s FROM b)
    SELECT slide_id, {r('alpha')} AS alpha, {r('beta')} AS beta, {r('theta')} AS theta, {r('s',6)} AS separation FROM s QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY s DESC, i, j, t)=1""",
)
def _(spark, d):
    """O173: grid search for the best projection."""
    p = points_parts(spark, d).withColumns({"a": F.col("centroid_x") / 100, "b": F.col("area") / 100, "f": F.col("cell_id") % 3 == 0})
    return rounded(graph.best_axis(p, "a", "b", "f"), "alpha", "beta", "theta", "separation")


@query(
    "sliding_counter",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    c AS (SELECT user_id, 0::bigint AS i, 0::bigint AS event_id, []::double[] AS held, false AS allowed, 0::double AS t FROM e GROUP BY user_id
    UNION ALL SELECT user_id, i, event_id, CASE WHEN len(live)<3 THEN list_append(live, t) ELSE live END, len(live)<3, t FROM (SELECT e.user_id, e.i, e.event_id, e.t, list_filter(c.held, lambda h: h>=e.t-86400) AS live FROM c JOIN e ON e.user_id=c.user_id AND e.i=c.i+1))
    SELECT event_id, len(held)::bigint AS calls, allowed, {r('greatest(1,86400-(t-held[1]))',3)} AS retry_after FROM c WHERE i>0""",
)
def _(spark, d):
    """O250, O251: allowed calls of a key in a sliding window, and when the oldest leaves it."""
    out = ordered.sliding_count(_table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 86400, 3)
    return rounded(out.select("event_id", "calls", "allowed", "retry_after"), "retry_after", digits=3)


_IMG = "img AS (SELECT p_partkey AS id, 300+p_partkey*37%1500 AS width, 200+p_partkey*53%1200 AS height FROM part)"
_S = "list_distinct(list_append(list_filter(range(0, {n}, 448), lambda v: v<=greatest(0,{n}-512)), greatest(0,{n}-512)))"


def _images(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.lit(300) + F.col("p_partkey") * 37 % 1500).alias("width"), (F.lit(200) + F.col("p_partkey") * 53 % 1200).alias("height"))


@query("overlapping_tiles", f"WITH {_IMG}, y AS (SELECT *, unnest({_S.format(n='height')}) AS y0 FROM img), x AS (SELECT *, unnest({_S.format(n='width')}) AS x0 FROM y) SELECT id, x0, y0, least(512,width-x0) AS w, least(512,height-y0) AS h FROM x")
def _(spark, d):
    """O025: overlapping tiles of images."""
    return ordered.tiles(_images(spark, d))


@query("plain_tiles", f"WITH {_IMG}, y AS (SELECT *, unnest(range(0,height,256)) AS y0 FROM img), x AS (SELECT *, unnest(range(0,width,256)) AS x0 FROM y) SELECT id, x0, y0, least(256,width-x0) AS w, least(256,height-y0) AS h FROM x")
def _(spark, d):
    """O024: tiles without overlap."""
    return ordered.plain_tiles(_images(spark, d), 256)


@query("norm_uint8", f"WITH {POINTS_SQL}, e AS (SELECT slide_id, min(centroid_x) lo, max(centroid_x) hi FROM pts GROUP BY ALL) SELECT slide_id, cell_id, cast(CASE WHEN hi=lo THEN 128 ELSE floor((centroid_x-lo)/(hi-lo)*255) END AS integer) AS u8 FROM pts JOIN e USING (slide_id)")
def _(spark, d):
    """O089: scaling to bytes within a slide."""
    return ordered.to_uint8(points_parts(spark, d), "slide_id", "centroid_x").select("slide_id", "cell_id", "u8")


#: One row for each step of a greedy choice: ``ok`` says whether candidate i joins what is held.
_GREEDY = """c AS (SELECT slide_id, cell_id, x, y, h, row_number() OVER (PARTITION BY slide_id ORDER BY area DESC, cell_id) AS i FROM (SELECT slide_id, cell_id, area, centroid_x AS x, centroid_y AS y, sqrt(area/pi()) AS h FROM pts)),
    s AS (SELECT slide_id, 0::bigint AS i, []::struct(x double, y double, h double)[] AS held, false AS kept, 0::bigint AS cell_id FROM pts GROUP BY slide_id
      UNION ALL SELECT slide_id, i, CASE WHEN ok THEN list_append(held, struct_pack(x:=x, y:=y, h:=h)) ELSE held END, ok, cell_id FROM
        (SELECT c.slide_id, c.i, c.cell_id, c.x, c.y, c.h, s.held, len(list_filter(s.held, lambda k: {clash}))=0 AS ok FROM s JOIN c ON c.slide_id=s.slide_id AND c.i=s.i+1))"""
_BOTH = "(greatest(0,least(c.x+c.h,k.x+k.h)-greatest(c.x-c.h,k.x-k.h))*greatest(0,least(c.y+c.h,k.y+k.h)-greatest(c.y-c.h,k.y-k.h)))"


@query("nms", f"""WITH RECURSIVE {POINTS_SQL}, {_GREEDY.format(clash=f'{_BOTH}>0.3*(4*c.h*c.h+4*k.h*k.h-{_BOTH})')} SELECT slide_id AS "group", cell_id AS id FROM s WHERE kept""")
def _(spark, d):
    """O138: greedy suppression of overlapping boxes."""
    p = points_parts(spark, d)
    half = F.sqrt(F.col("area") / F.pi())
    b = p.select(F.col("slide_id").alias("group"), F.col("cell_id").alias("id"), (F.col("centroid_x") - half).alias("x0"), (F.col("centroid_y") - half).alias("y0"), (F.col("centroid_x") + half).alias("x1"), (F.col("centroid_y") + half).alias("y1"), F.col("area").alias("score"))
    return choice.suppress(b)


@query("dedupe_by_distance", f"WITH RECURSIVE {POINTS_SQL}, {_GREEDY.format(clash='(c.x-k.x)*(c.x-k.x)+(c.y-k.y)*(c.y-k.y)<1600')} SELECT slide_id, cell_id FROM s WHERE kept")
def _(spark, d):
    """O137: cells kept by area whose centroids are apart."""
    return choice.dedupe_by_distance(points_parts(spark, d), 40.0)


#: Power of each frequency, by an explicit transform, in single precision.
SPECTRUM_SQL = f"""WITH {CELLS_SQL}, sp AS (SELECT slide_id, cell_id, k, cast(cast(pow(sum(x*cos(2*pi()*i*k/32)+y*sin(2*pi()*i*k/32)),2)+pow(sum(y*cos(2*pi()*i*k/32)-x*sin(2*pi()*i*k/32)),2) AS float) AS double) AS power FROM v, (SELECT unnest(range(32)) AS k) GROUP BY ALL)"""


@query("fft_energy", SPECTRUM_SQL + f" SELECT slide_id, cell_id, k, {r('power', 3)} AS power FROM sp")
def _(spark, d):
    """O092, O101, O271: the power of each frequency of a ring."""
    c = cells_embed(spark, d).select("slide_id", "cell_id", F.posexplode(kernels.spectrum_udf("ring")).alias("k", "power"))
    return rounded(c, "power", digits=3)


@query("low_pass_mean", f"WITH {CELLS_SQL} SELECT a.slide_id, a.cell_id, a.i, {r('sum(b.x*w)')} AS x, {r('sum(b.y*w)')} AS y FROM v a JOIN v b ON a.cell_id=b.cell_id, LATERAL (SELECT (1+2*(cos(t)+cos(2*t)+cos(3*t)+cos(4*t)+cos(5*t)))/32 AS w FROM (SELECT 2*pi()*(a.i-b.i)/32 AS t)) GROUP BY ALL")
def _(spark, d):
    """O091, O093, O104: every vertex of a ring without its frequencies from six on."""
    c = cells_embed(spark, d).select("slide_id", "cell_id", F.posexplode(kernels.low_pass(6)("ring")).alias("i", "p"))
    return rounded(c.select("slide_id", "cell_id", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "x", "y")


@query(
    "cyclic_convolution",
    f"""WITH {CELLS_SQL}, {FOLLOW_SQL}, n AS (SELECT unnest(range(32)) AS i)
    SELECT fo.a, fo.b, n.i, {r('sum(p.x*q.x-p.y*q.y)')} AS x, {r('sum(p.x*q.y+p.y*q.x)')} AS y FROM fo JOIN v p ON p.cell_id=fo.a JOIN v q ON q.cell_id=fo.b JOIN n ON n.i=(p.i+q.i)%32 GROUP BY ALL""",
)
def _(spark, d):
    """O103, O105: cyclic convolution of the rings of each cell and the next one of its slide."""
    out = followers(cells_embed(spark, d)).select("a", "b", F.posexplode(kernels.convolve_udf("ra", "rb")).alias("i", "p"))
    return rounded(out.select("a", "b", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y")), "x", "y")


#: kappa of each ring, by an explicit transform.
KAPPA_SQL = f"""WITH {CELLS_SQL}, k AS (SELECT slide_id, cell_id, i, x-mx AS x, y-my AS y FROM v JOIN s USING (slide_id, cell_id)), f AS (SELECT a.slide_id, a.cell_id, a.i, sum(b.x*w) AS x, sum(b.y*w) AS y FROM k a JOIN (SELECT *, unnest(range(32)) AS j FROM k) b ON a.cell_id=b.cell_id AND a.i=b.j,
LATERAL (SELECT (1+2*cos(2*pi()*(a.i-b.i)/32)+2*cos(4*pi()*(a.i-b.i)/32)+2*cos(6*pi()*(a.i-b.i)/32))/32 AS w) GROUP BY ALL),
c2 AS (SELECT slide_id, cell_id, sum(x*x)/31 xx, sum(y*y)/31 yy, sum(x*y)/31 xy FROM f GROUP BY ALL),
kk AS (SELECT slide_id, cell_id, round(least(1,greatest(0,1-((xx+yy)/2+sqrt(greatest((xx+yy)*(xx+yy)/4-(xx*yy-xy*xy),0)))/(xx+yy))),3)+0.0 AS kappa FROM c2)"""


@query("kappa", KAPPA_SQL + " SELECT slide_id, cell_id, kappa FROM kk")
def _(spark, d):
    """O090, O096, O097: kappa of rings (low-pass below frequency 4), against an explicit transform."""
    return cells_embed(spark, d).select("slide_id", "cell_id", (F.round(kernels.kappa_of(4)("ring"), 3) + 0.0).alias("kappa"))


@query("kappa_turning", f"""WITH {CELLS_SQL}, t AS (SELECT a.slide_id, a.cell_id, (a.nx-a.x)*(b.ny-b.y)-(a.ny-a.y)*(b.nx-b.x) AS c FROM v a JOIN v b ON a.cell_id=b.cell_id AND b.i=a.i+1 AND a.i<30)
SELECT slide_id, cell_id, {r('sqrt(sum(c*c))')} AS kappa, CASE WHEN sqrt(sum(c*c))>5 THEN 'Malignant' ELSE 'Normal' END AS clinical FROM t GROUP BY ALL""")
def _(spark, d):
    """O100: the other kappa, from cross products along the open line."""
    cross = "(ring[i + 1].x - ring[i].x) * (ring[i + 2].y - ring[i + 1].y) - (ring[i + 1].y - ring[i].y) * (ring[i + 2].x - ring[i + 1].x)"
    k = F.sqrt(F.expr(f"aggregate(transform(sequence(0, size(ring) - 3), i -> {cross}), 0D, (t, c) -> t + c * c)"))
    return rounded(cells_embed(spark, d).select("slide_id", "cell_id", k.alias("kappa")).withColumn("clinical", score.label(F.col("kappa") > 5)), "kappa")


@query("dot_and_axpy", f"SELECT vec_id, {r('list_inner_product(cast(embedding AS double[]), cast(list_reverse(embedding) AS double[]))')} AS dot, {r('list_sum(list_transform(embedding, lambda x: cast(x AS double)*2.5+1))')} AS axpy FROM embeddings")
def _(spark, d):
    """O094, O095: dot product and scaled addition of vectors."""
    e = _table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    dot = F.expr("aggregate(zip_with(e, reverse(e), (a, b) -> a * b), 0D, (t, x) -> t + x)")
    axpy = F.expr("aggregate(transform(e, x -> x * 2.5D + 1), 0D, (t, x) -> t + x)")
    return rounded(e.select("vec_id", dot.alias("dot"), axpy.alias("axpy")), "dot", "axpy")
