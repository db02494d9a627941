"""Queries of slide aggregates, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score
from ..operators import spatial, stats
from ..sources.fixtures import CELLS_SQL, POINTS_SQL, cells_embed, points_parts
from . import enrich
from .queries_geometry import KNN_SQL, SCORE_SQL, r, rounded

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


@query("median_area", f"WITH {CELLS_SQL} SELECT slide_id, {r('quantile_cont(area,0.5)')} AS median, {r('quantile_cont(area,0.5)*1.5')} AS threshold FROM g GROUP BY slide_id")
def _(spark, d):
    """O032, O140, O141: slide median and the gate at 1.5 times it."""
    s = enrich.shape(cells_embed(spark, d)).groupBy("slide_id").agg(stats.median(F.col("area")).alias("median"))
    return rounded(s.withColumn("threshold", F.col("median") * 1.5), "median", "threshold")


@query("distribution_summary", f"WITH {CELLS_SQL} SELECT slide_id, count(*) AS n, {r('avg(area)')} AS mean, {r('stddev_pop(area)')} AS std, {r('min(area)')} AS least, {r('max(area)')} AS most, {r('quantile_cont(area,0.25)')} AS q1, {r('quantile_cont(area,0.5)')} AS q2, {r('quantile_cont(area,0.75)')} AS q3, {r('quantile_cont(area,0.75)-quantile_cont(area,0.25)')} AS iqr FROM g GROUP BY slide_id")
def _(spark, d):
    """O149, O150, O151: moments and quartiles."""
    return rounded(stats.distribution(enrich.shape(cells_embed(spark, d)), "area"), "mean", "std", "least", "most", "q1", "q2", "q3", "iqr")


@query("upper_median", f"WITH {POINTS_SQL}, o AS (SELECT slide_id, centroid_x, row_number() OVER (PARTITION BY slide_id ORDER BY centroid_x) AS i, count(*) OVER (PARTITION BY slide_id) AS n FROM pts) SELECT slide_id, centroid_x AS upper_median FROM o WHERE i=n//2+1")
def _(spark, d):
    """O159: the upper median."""
    return stats.upper_median(points_parts(spark, d), "centroid_x")


@query(
    "histogram_entropy",
    f"""WITH {CELLS_SQL}, e AS (SELECT slide_id, min(area) lo, max(area) hi, count(*) n FROM g GROUP BY ALL), b AS (SELECT slide_id, least(19,floor((area-lo)/(hi-lo)*20)) AS b, count(*)/any_value(n) AS p FROM g JOIN e USING (slide_id) GROUP BY ALL)
    SELECT slide_id, {r('-sum(p*ln(p))')} AS entropy FROM b GROUP BY slide_id""",
)
def _(spark, d):
    """O147: histogram entropy."""
    return rounded(stats.entropy(enrich.shape(cells_embed(spark, d)), "area"), "entropy")


@query("gini", f"WITH {CELLS_SQL}, o AS (SELECT slide_id, eccentricity AS x, row_number() OVER (PARTITION BY slide_id ORDER BY eccentricity) AS i FROM g) SELECT slide_id, {r('2*sum(i*x)/(count(*)*sum(x))-(count(*)+1)/count(*)')} AS gini FROM o GROUP BY slide_id")
def _(spark, d):
    """O148: Gini coefficient."""
    return rounded(stats.gini(enrich.shape(cells_embed(spark, d)), "eccentricity"), "gini")


@query("skewness", f"WITH {CELLS_SQL}, m AS (SELECT slide_id, avg(area) a, stddev_pop(area) s FROM g GROUP BY ALL) SELECT slide_id, {r('avg(pow((area-a)/s,3))')} AS skew FROM g JOIN m USING (slide_id) GROUP BY slide_id")
def _(spark, d):
    """The population skewness of O146."""
    return rounded(stats.skewness(enrich.shape(cells_embed(spark, d)), "area"), "skew")


@query("class_counts", "SELECT cast(user_id%7 AS varchar) AS slide_id, count(*) AS n, count(*) FILTER (event_type='click') AS malignant, count(*) FILTER (event_type='view') AS immune, count(*) FILTER (event_type NOT IN ('click','view')) AS normal FROM events GROUP BY ALL")
def _(spark, d):
    """O153: counts by label, trimmed and without case."""
    e = spark.read.parquet(f"{d}/events.parquet")
    label = F.when(F.col("event_type") == "click", " Malignant ").when(F.col("event_type") == "view", "IMMUNE").otherwise("other")
    return stats.class_counts(e.select((F.col("user_id") % 7).cast("string").alias("slide_id"), label.alias("clinical"))).select("slide_id", "n", "malignant", "immune", "normal")


_BIO = SCORE_SQL + f""", t AS (SELECT *, 0.5*(1-circularity)+0.5*eccentricity AS atyp, score>0.35 OR gate AS bad FROM sc),
en0 AS (SELECT slide_id, min(rbf) lo, max(rbf) hi, count(*) n FROM t GROUP BY ALL), en1 AS (SELECT slide_id, least(19,floor((rbf-lo)/(hi-lo)*20)) AS b, count(*)/any_value(n) AS p FROM t JOIN en0 USING (slide_id) GROUP BY ALL),
en AS (SELECT slide_id, -sum(p*ln(p)) AS tads FROM en1 GROUP BY ALL), sk0 AS (SELECT slide_id, avg(knn_density) a, stddev_pop(knn_density) s FROM t GROUP BY ALL), sk AS (SELECT slide_id, avg(pow((knn_density-a)/s,3)) AS skew FROM t JOIN sk0 USING (slide_id) GROUP BY ALL),
o AS (SELECT slide_id, eccentricity AS x, row_number() OVER (PARTITION BY slide_id ORDER BY eccentricity) AS i FROM t), gi AS (SELECT slide_id, 2*sum(i*x)/(count(*)*sum(x))-(count(*)+1)/count(*) AS ths FROM o GROUP BY ALL),
m AS (SELECT slide_id, count(*) AS n, count(*) FILTER (bad) AS malignant, avg(atyp) AS nai, stddev_pop(atyp) AS nai_std FROM t GROUP BY ALL)
SELECT slide_id, n, malignant, {r('nai')} AS nai, {r('nai_std')} AS nai_std, {r('tads')} AS tads, {r('skew')} AS skew, {r('ths')} AS ths,
CASE WHEN nai<0.2 THEN 'low' WHEN nai<0.4 THEN 'mild' WHEN nai<0.6 THEN 'moderate' ELSE 'high' END AS nai_reading, CASE WHEN tads<1.5 THEN 'organized' WHEN tads<2.5 THEN 'mild' WHEN tads<3.5 THEN 'moderate' ELSE 'severe' END AS tads_reading
FROM m JOIN en USING (slide_id) JOIN sk USING (slide_id) JOIN gi USING (slide_id)"""


@query("biomarkers", _BIO)
def _(spark, d):
    """O146, O209-O212: the slide report."""
    out = stats.biomarkers(enrich.scored(cells_embed(spark, d)))
    return rounded(out.select("slide_id", "n", "malignant", "nai", "nai_std", "tads", "skew", "ths", "nai_reading", "tads_reading"), "nai", "nai_std", "tads", "skew", "ths")


@query("slide_summary", SCORE_SQL + f"SELECT slide_id, count(*) AS total, count(*) FILTER (score>0.35 OR gate) AS malignant, count(*) FILTER (NOT (score>0.35 OR gate)) AS normal, {r('avg(rbf)')} AS mean_rbf, {r('avg(eccentricity)')} AS mean_ecc, {r('stddev_pop(eccentricity)')} AS std_ecc FROM sc GROUP BY slide_id")
def _(spark, d):
    """O152: counts and moments."""
    return rounded(stats.slide_summary(enrich.scored(cells_embed(spark, d))), "mean_rbf", "mean_ecc", "std_ecc")


_LABEL = "CASE cell_id%4 WHEN 0 THEN 'Epithelial_Malignant' WHEN 1 THEN 'Lymphocyte' WHEN 2 THEN 'Inflammatory' ELSE 'Stromal' END"


@query(
    "clustering_and_mixing",
    f"""WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=1)}, b AS (SELECT slide_id, count(*) n, greatest((max(centroid_x)-min(centroid_x))*(max(centroid_y)-min(centroid_y)),1e-9) a FROM pts GROUP BY ALL),
    k AS (SELECT e.slide_id, d, src%4 AS x, dst%4 AS y FROM edges e) SELECT slide_id, {r('avg(d)/(0.5*sqrt(any_value(a)/any_value(n)))')} AS global_ci, count(*) FILTER ((x IN (1,2) AND y=0) OR (y IN (1,2) AND x=0)) AS immune_tumor_edges,
    greatest(1,count(*) FILTER (x<3 OR y<3)) AS eligible_edges FROM k JOIN b USING (slide_id) GROUP BY slide_id""",
)
def _(spark, d):
    """O155: clustering index and immune-tumour mixing."""
    p = points_parts(spark, d).withColumn("label", F.expr(_LABEL))
    return rounded(stats.clustering(p, spatial.knn(p, 1)).drop("mixing"), "global_ci")


@query("confusion_metrics", f"""WITH c AS (SELECT count(*) FILTER (quality=1 AND toxic=1) tp, count(*) FILTER (quality<>1 AND toxic=1) fp, count(*) FILTER (quality<>1 AND toxic<>1) tn, count(*) FILTER (quality=1 AND toxic<>1) fn FROM labels), m AS (SELECT *, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, tn/(tn+fp) AS specificity FROM c)
SELECT tp, fp, tn, fn, {r('precision')} AS precision, {r('recall')} AS recall, {r('specificity')} AS specificity, {r('2*precision*recall/(precision+recall)')} AS f1, {r('(tp+tn)/(tp+tn+fp+fn)')} AS accuracy FROM m""")
def _(spark, d):
    """O157: confusion matrix and what follows from it."""
    return rounded(stats.confusion(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic"), "precision", "recall", "specificity", "f1", "accuracy")


@query(
    "auc_trapezoid",
    f"""WITH x AS (SELECT quality AS t, (doc_id%101)/100.0 AS s FROM labels), g AS (SELECT unnest(range(101)) AS k), c AS (SELECT k, count(*) FILTER (t=1 AND floor(s*100+1e-9)>=k)/(SELECT count(*) FROM x WHERE t=1) AS tpr, count(*) FILTER (t<>1 AND floor(s*100+1e-9)>=k)/(SELECT count(*) FROM x WHERE t<>1) AS fpr FROM x, g GROUP BY k),
    l AS (SELECT tpr, fpr, coalesce(lag(tpr) OVER (ORDER BY k DESC),0) pt, coalesce(lag(fpr) OVER (ORDER BY k DESC),0) pf FROM c) SELECT {r('sum((fpr-pf)*(tpr+pt)/2)')} AS auc FROM l""",
)
def _(spark, d):
    """O157: area under the curve over 101 thresholds."""
    rows = spark.read.parquet(f"{d}/labels.parquet").select("quality", (F.col("doc_id") % 101 / 100.0).alias("s"))
    return rounded(stats.auc(rows, "quality", "s"), "auc")


@query("tolerance_report", f"WITH t AS (SELECT p_size/50.0 AS s, 0.97+p_size/1000.0 AS a FROM part) SELECT count(*) AS n, {r('quantile_cont(s,0.5)')} AS shift_median, {r('quantile_cont(s,0.95)')} AS shift_p95, {r('quantile_cont(a,0.5)')} AS ratio_median, {r('quantile_cont(a,0.95)')} AS ratio_p95, CASE WHEN quantile_cont(s,0.95)<=1 AND quantile_cont(a,0.5) BETWEEN 0.95 AND 1.05 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM t")
def _(spark, d):
    """O158: geometry tolerance."""
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") / 50.0).alias("s"), (F.col("p_size") / 1000.0 + 0.97).alias("a"))
    return rounded(stats.tolerance(p, "s", "a"), "shift_median", "shift_p95", "ratio_median", "ratio_p95")


@query("two_scale_bridge", f"WITH {CELLS_SQL}, b AS (SELECT slide_id, avg(greatest(area,1e-18)) macro, quantile_cont(greatest(area,1e-18),0.5) micro FROM g GROUP BY ALL) SELECT slide_id, {r('macro')} AS macro, {r('micro')} AS micro, {r('macro/micro')} AS ratio, {r('ln(macro/micro)')} AS lambda, {r('sqrt(macro*micro)')} AS geometric_mean FROM b")
def _(spark, d):
    """O144: mean against median area."""
    return rounded(stats.bridge(enrich.shape(cells_embed(spark, d))), "macro", "micro", "ratio", "lambda", "geometric_mean")


@query("bridge_normalised", f"WITH {CELLS_SQL}, b AS (SELECT slide_id, sqrt(avg(greatest(area,1e-18))*quantile_cont(greatest(area,1e-18),0.5)) gm FROM g GROUP BY ALL) SELECT slide_id, cell_id, {r('area/greatest(gm,1e-18)')} AS area_norm FROM g JOIN b USING (slide_id)")
def _(spark, d):
    """O199: a feature over the bridge's geometric mean."""
    c = enrich.shape(cells_embed(spark, d))
    out = c.join(stats.bridge(c).select("slide_id", "geometric_mean"), "slide_id")
    return rounded(out.select("slide_id", "cell_id", (F.col("area") / F.greatest("geometric_mean", F.lit(1e-18))).alias("area_norm")), "area_norm")


@query("scale_tiers", "SELECT p_partkey AS cell_id, round(p_size*1e-6/1e-3,9)+0.0 AS to_macro, round(p_size*1e-3/1e-6,3)+0.0 AS to_micro, round(1e-6/1e-3,9)+0.0 AS ratio, 4 AS tiers FROM part")
def _(spark, d):
    """O200, O201, O202, O272: values at the four tiers and ratios of scales."""
    tiers = F.array(*[F.lit(v) for v in (1e-6, 1e-5, 1e-4, 1e-3)])
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("tiers", tiers)
    at = lambda i, j: F.col("p_size") * F.col("tiers")[i] / F.greatest(F.col("tiers")[j], F.lit(1e-30))
    ratio = F.when(F.abs(F.col("tiers")[3]) < 1e-30, 1.0).otherwise(F.col("tiers")[0] / F.col("tiers")[3])
    return p.select(F.col("p_partkey").alias("cell_id"), (F.round(at(0, 3), 9) + 0.0).alias("to_macro"), (F.round(at(3, 0), 3) + 0.0).alias("to_micro"), (F.round(ratio, 9) + 0.0).alias("ratio"), F.size("tiers").alias("tiers"))


@query("gram_matrix", f"WITH {CELLS_SQL} SELECT slide_id, {r('sum(area*area)',4)} AS area_area, {r('sum(area*circularity)',5)} AS area_circularity, {r('sum(area*eccentricity)',4)} AS area_eccentricity, {r('sum(circularity*circularity)')} AS circularity_circularity, {r('sum(circularity*eccentricity)')} AS circularity_eccentricity, {r('sum(eccentricity*eccentricity)')} AS eccentricity_eccentricity FROM g GROUP BY slide_id")
def _(spark, d):
    """O156: Gram matrix."""
    out = stats.gram(enrich.shape(cells_embed(spark, d)), ["area", "circularity", "eccentricity"])
    out = rounded(rounded(out, "area_area", "area_eccentricity", digits=4), "area_circularity", digits=5)
    return rounded(out, "circularity_circularity", "circularity_eccentricity", "eccentricity_eccentricity")


@query("incoming_attention", f"SELECT user_id AS target_node, {r('avg(value)')} AS attention FROM events WHERE event_type='click' GROUP BY user_id")
def _(spark, d):
    """O154: mean incoming weight of the second layer."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("target_node"), F.col("value").alias("alpha_weight"), F.when(F.col("event_type") == "click", "layer2").otherwise("layer1").alias("layer"))
    return rounded(stats.incoming_attention(e), "attention")


@query(
    "density_ratio_edges",
    f"""WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=8)}, q AS (SELECT e.slide_id, src, dst, greatest(a.area,1e-12)/greatest(b.area,1e-12) AS ratio FROM edges e JOIN pts a ON a.slide_id=e.slide_id AND a.cell_id=src JOIN pts b ON b.slide_id=e.slide_id AND b.cell_id=dst)
    SELECT slide_id, src, dst, {r('ratio')} AS ratio, {r('ln(ratio)')} AS log_ratio, CASE WHEN abs(ratio-1)<0.02 THEN 'Balanced' WHEN abs(ratio-1.618033988749895)<0.05 OR abs(ratio/1.618033988749895-1)<0.05 THEN 'PhiLike' WHEN abs(ratio-pi())<0.05 OR abs(ratio/pi()-1)<0.05 THEN 'PiLike' ELSE 'None' END AS alignment FROM q""",
)
def _(spark, d):
    """O131, O206: edge ratios and their alignment."""
    p = points_parts(spark, d)
    return rounded(spatial.density_ratios(p, spatial.knn(p)), "ratio", "log_ratio")


@query("density_ratio_summary", f"WITH q AS ({ORACLES['density_ratio_edges']}) SELECT slide_id, count(*) AS n_edges, {r('avg(ratio)',4)} AS mean_ratio, {r('stddev_pop(ratio)',4)} AS std_ratio, count(*) FILTER (alignment='PhiLike') AS phi_like, count(*) FILTER (alignment='PiLike') AS pi_like, count(*) FILTER (alignment='Balanced') AS balanced, {r(chr(99)+'ount(*) FILTER (alignment<>' + chr(39) + 'None' + chr(39) + ')/count(*)')} AS alignment_fraction FROM q GROUP BY slide_id")
def _(spark, d):
    """O143: summary of edge ratios."""
    p = points_parts(spark, d)
    return rounded(rounded(spatial.ratio_summary(spatial.density_ratios(p, spatial.knn(p))), "alignment_fraction"), "mean_ratio", "std_ratio", digits=4)


@query("feature_table", f"""WITH {CELLS_SQL}, m AS (SELECT slide_id, quantile_cont(area,0.5) md, stddev_pop(area) sd FROM g GROUP BY ALL), f AS (SELECT *, 1-sqrt(greatest(0,l2)/l1) AS e, least(0.9999,greatest(0,pow(1-sqrt(greatest(0,l2)/l1),2))) AS e2, 4*pi()*area/(perimeter*perimeter) AS cc FROM g JOIN m USING (slide_id))
SELECT slide_id, cell_id, {r('(area-md)/greatest(sd,1e-12)')} AS area_zscore, {r('1-cc')} AS circularity_penalty, {r('perimeter/greatest(area,1e-12)',3)} AS perimeter_area_ratio, {r('sqrt(greatest(1e-12,area/(pi()*sqrt(1-e2))))')} AS major_axis_length, {r('sqrt(greatest(1e-12,area/(pi()*sqrt(1-e2))))*sqrt(1-e2)')} AS minor_axis_length, {r('least(1,area/greatest(1e-12,(x1-x0)*(y1-y0)))')} AS extent, {r('2*sqrt(area/pi())')} AS equivalent_diameter, {r('e')} AS eccentricity FROM f""")
def _(spark, d):
    """O082, O046: the row-local and slide-relative columns of the feature table."""
    from .features import features

    cols = ["area_zscore", "circularity_penalty", "major_axis_length", "minor_axis_length", "extent", "equivalent_diameter", "eccentricity"]
    out = features(cells_embed(spark, d), spatial_columns=False).select("slide_id", "cell_id", *cols, "perimeter_area_ratio")
    return rounded(rounded(out, *cols), "perimeter_area_ratio", digits=3)


@query("feature_spatial", f"""WITH {POINTS_SQL}, {KNN_SQL.format(t='pts', k=5)}, r5 AS (SELECT slide_id, src AS cell_id, max(rank) AS k, max(d) AS d FROM edges GROUP BY ALL), few AS (SELECT slide_id, cell_id FROM pts QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY md5(cast(cell_id AS varchar)))<=200),
hp AS (SELECT p.slide_id, quantile_cont(sqrt(d2),0.5)/2 AS s FROM pairs p JOIN few a ON a.slide_id=p.slide_id AND a.cell_id=src JOIN few b ON b.slide_id=p.slide_id AND b.cell_id=dst WHERE src<dst GROUP BY ALL),
rb AS (SELECT p.slide_id, src AS cell_id, (sum(exp(-d2/(2*s*s)))+1)/(count(*)+1) AS rbf FROM pairs p JOIN hp USING (slide_id) GROUP BY ALL)
SELECT slide_id, cell_id, {r('CASE WHEN d<1e-12 THEN 0 ELSE k/(pi()*d*d) END')} AS knn_density_k5, {r('rbf')} AS rbf_risk_score FROM r5 JOIN rb USING (slide_id, cell_id)""")
def _(spark, d):
    """O220, O221: neighbour density and mean field by the definitions of the feature table."""
    from .features import neighbour_density, mean_field

    p = points_parts(spark, d)
    return rounded(neighbour_density(p).join(mean_field(p), ["slide_id", "cell_id"]), "knn_density_k5", "rbf_risk_score")


@query("mappings", "SELECT p_partkey AS id, CASE p_partkey%4 WHEN 0 THEN 'Malignant' WHEN 1 THEN 'Immune' WHEN 2 THEN 'Immune' ELSE 'Normal' END AS clinical, CASE WHEN p_partkey%4=0 THEN 'Epithelial_Malignant' ELSE 'Stromal' END AS biology, CASE WHEN p_size>10 THEN 1 ELSE 0 END AS phenotype FROM part")
def _(spark, d):
    """O205, O207, O208: label mappings."""
    from .features import biology_label, clinical_label

    p = spark.read.parquet(f"{d}/part.parquet").withColumn("cell_id", F.col("p_partkey")).withColumn("gnn", F.expr(_LABEL))
    clinical = clinical_label(F.col("gnn"))
    return p.select(F.col("p_partkey").alias("id"), clinical.alias("clinical"), biology_label(clinical).alias("biology"), (F.col("p_size") / 10 > 1.0).cast("int").alias("phenotype"))


@query("alignment_classes", "SELECT p_partkey AS id, CASE WHEN abs(x-1)<0.02 THEN 'Balanced' WHEN abs(x-1.618033988749895)<0.05 OR abs(x/1.618033988749895-1)<0.05 THEN 'PhiLike' WHEN abs(x-pi())<0.05 OR abs(x/pi()-1)<0.05 THEN 'PiLike' ELSE 'None' END AS alignment FROM (SELECT p_partkey, p_size/13.0 AS x FROM part)")
def _(spark, d):
    """The alignment classes of O131 over a grid of ratios."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), score.alignment(F.col("p_size") / 13.0).alias("alignment"))
