"""Queries of sources, sinks, joins with predictions, and service operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ring
from ..operators import spatial
from ..operators.checkpoints import cut
from ..sources import annotations, exports
from ..sources.fixtures import CELLS_SQL, HULL_SQL, PARTS_SQL, POINTS_SQL, cells_embed, cells_parts, points_parts
from ..streaming import service
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


def _ranked(spark, d):
    return service.numbered(points_parts(spark, d), "slide_id", "cell_id")


_RANK = "rk AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY cell_id)-1 AS position FROM pts)"


@query("segment_json", f"WITH {CELLS_SQL}, n AS (SELECT slide_id, row_number() OVER (PARTITION BY slide_id ORDER BY cell_id)-1 AS cell_id, area FROM g) SELECT slide_id, cell_id, round(area,2)+0.0 AS area FROM n")
def _(spark, d):
    """O002, O031-O033: envelopes written and read again."""
    back = annotations.segment_cells(exports.envelopes(cells_embed(spark, d)))
    return back.select("slide_id", F.col("cell_id").cast("long").alias("cell_id"), (F.round(ring.area(), 2) + 0.0).alias("area"))


def _back(rows):
    x, y = ring.vertex_mean()
    out = rows.select(F.regexp_extract("path", r"^(.*)\.\w+$", 1).alias("slide_id"), F.col("source_index").cast("long").alias("position"), F.size("ring").cast("long").alias("vertices"), x.alias("x"), y.alias("y"), "source_class")
    return rounded(out, "x", "y", digits=3)


@query("geojson_polygons", f"WITH {POINTS_SQL}, {_RANK} SELECT slide_id, position, 33 AS vertices, centroid_x AS x, centroid_y AS y, CASE WHEN cell_id%2=0 THEN 'Malignant' ELSE 'Normal' END AS source_class FROM rk")
def _(spark, d):
    """O009-O011, O037, O050: feature collections written and read again."""
    c = cells_parts(spark, d).withColumn("clinical", F.when(F.col("cell_id") % 2 == 0, "Malignant").otherwise("other"))
    back = annotations.parse(exports.feature_pieces(c, _named(".geojson"))).withColumn("closed", F.col("ring")).withColumn("ring", F.slice("ring", 1, F.size("ring") - 1))
    return _back(back).withColumn("vertices", F.col("vertices") + 1)


def _named(suffix):
    return F.concat("slide_id", F.lit(suffix))


def _xml(spark, d, region, vertex):
    pts = F.expr(f"array_join(transform(ring, p -> concat('<{vertex} X=\"', p.x, '\" Y=\"', p.y, '\"/>')), '')")
    one = F.concat(F.lit(f"<{region} Id=\""), F.col("cell_id").cast("string"), F.lit('">'), pts, F.lit(f"</{region}>"))
    return exports.pieces(cells_parts(spark, d), _named(".xml"), "cell_id", one, "<Root>", "</Root>")


_BACK = f"WITH {POINTS_SQL}, {_RANK} SELECT slide_id, position, {{n}} AS vertices, centroid_x AS x, centroid_y AS y FROM rk"


@query("aperio_xml", _BACK.format(n=32))
def _(spark, d):
    """O004-O006, O008: regions of vertices in document order."""
    return _back(annotations.parse(_xml(spark, d, "Region", "Vertex"))).drop("source_class")


@query("asap_xml", _BACK.format(n=32))
def _(spark, d):
    """O007, O014: annotations of coordinates."""
    return _back(annotations.parse(_xml(spark, d, "Annotation", "Coordinate"))).drop("source_class")


def _lines(spark, d, suffix, head, line, wrap=("", "")):
    return exports.pieces(points_parts(spark, d), _named(suffix), "cell_id", line, wrap[0] + head, wrap[1])


@query("csv_centroids", _BACK.format(n=128))
def _(spark, d):
    """O017, O021, O022: tables of centroids as circles."""
    line = F.concat_ws(",", "cell_id", "centroid_x", "centroid_y", F.lit("7\n"))
    return _back(annotations.parse(_lines(spark, d, ".csv", "id,cx,cy,radius\n", line))).drop("source_class")


@query("csv_vertices", f"WITH {POINTS_SQL}, {_RANK} SELECT slide_id, position, 3 AS vertices, round(centroid_x+1,3)+0.0 AS x, round(centroid_y+1,3)+0.0 AS y FROM rk")
def _(spark, d):
    """O003: tables of vertices by polygon."""
    row = lambda dx, dy: F.concat(F.col("cell_id").cast("string"), F.lit(","), (F.col("centroid_x") + dx).cast("string"), F.lit(","), (F.col("centroid_y") + dy).cast("string"), F.lit("\n"))
    line = F.concat(row(0, 0), row(3, 0), row(0, 3), F.concat(F.col("cell_id").cast("string"), F.lit(",bad,1\n")))
    return _back(annotations.parse(_lines(spark, d, ".csv", "polygon_id,x,y\n", line))).drop("source_class")


@query("html_tables", _BACK.format(n=128))
def _(spark, d):
    """O018: tables of centroids in pages."""
    line = F.concat(F.lit("<tr><td>"), F.col("centroid_x").cast("string"), F.lit("</td><td>"), F.col("centroid_y").cast("string"), F.lit("</td></tr>"))
    docs = _lines(spark, d, ".html", "<tr><th>x</th><th>y</th></tr>", line, ("<html><p>cells</p><table>", "</table></html>"))
    return _back(annotations.parse(docs)).drop("source_class")


@query("pages_without_tables", "SELECT count(*) FILTER (contains(html,'<table')) AS n FROM pages")
def _(spark, d):
    """O018 over real pages: none of them has a table of cells."""
    p = _table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return annotations.parse(p).where("error IS NULL").agg(F.count("*").alias("n"))


@query("detect_format", "SELECT page_id, CASE page_id%5 WHEN 0 THEN 'aperio_xml' WHEN 1 THEN 'asap_xml' WHEN 2 THEN 'geojson' WHEN 3 THEN 'json' ELSE 'unknown' END AS format FROM pages")
def _(spark, d):
    """O013, O015: format by name and content."""
    k = F.col("page_id") % 5
    name = F.when(k < 2, "a.xml").when(k < 4, "a.JSON").otherwise("a.tif")
    text = F.when(k == 0, '<A><Region><Vertex X="1" Y="2"/></Region></A>').when(k == 1, "<A><Coordinate/></A>").when(k == 2, '{"type": "FeatureCollection"}').otherwise('{"cells": []}')
    return _table(spark, d, "pages").select("page_id", annotations.detect(name, text).alias("format"))


@query("artifact_manifest", "SELECT cast(page_id AS varchar) AS path, sha256(html) AS sha256, cast(strlen(html) AS bigint) AS bytes FROM pages")
def _(spark, d):
    """O041, O115: digest and size of files."""
    return exports.artifacts(_table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content")))


@query("output_paths", "SELECT p_partkey AS id, CASE WHEN p_partkey%2=0 THEN 'a/'||p_partkey||'_enriched.json' ELSE 'b.c/'||p_partkey||'_enriched.json' END AS out FROM part")
def _(spark, d):
    """O049: place of results."""
    path = F.concat(F.lit("/in/"), F.when(F.col("p_partkey") % 2 == 0, "a/").otherwise("b.c/"), F.col("p_partkey").cast("string"), F.lit(".json"))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), exports.output_path(path, "/in").alias("out"))


@query("centroid_parity", f"WITH {POINTS_SQL}, m AS (SELECT * FROM pts WHERE cell_id%11<>0), p AS (SELECT cell_id, centroid_x+(cell_id%4)*0.2 AS x, centroid_y AS y FROM pts WHERE cell_id%13<>0) SELECT coalesce(m.cell_id,p.cell_id) AS cell_id, {r('abs(m.centroid_x-p.x)')} AS drift, coalesce(sqrt(pow(m.centroid_x-p.x,2)+pow(m.centroid_y-p.y,2))<=0.5,false) AS ok FROM m FULL JOIN p ON m.cell_id=p.cell_id")
def _(spark, d):
    """O114: parity of ids and centroids."""
    p = points_parts(spark, d)
    moved = p.where("cell_id % 13 <> 0").withColumn("centroid_x", F.col("centroid_x") + (F.col("cell_id") % 4) * 0.2)
    return rounded(exports.parity(p.where("cell_id % 11 <> 0"), moved), "drift")


@query("prediction_rows", f"WITH {POINTS_SQL} SELECT cell_id, CASE WHEN cell_id%3=0 THEN 'Malignant' ELSE 'Normal' END AS clinical, CASE WHEN cell_id%3=0 THEN 0.5 ELSE 0.85 END AS confidence, CASE WHEN cell_id%3=0 THEN centroid_x+1 ELSE centroid_x END AS centroid_x, centroid_y FROM pts")
def _(spark, d):
    """O136: predictions with their defaults."""
    p = points_parts(spark, d)
    e = p.where("cell_id % 3 = 0").select("cell_id", F.lit("Malignant").alias("clinical"), F.lit(0.5).alias("confidence"), (F.col("centroid_x") + 1).alias("centroid_x"), "centroid_y")
    return exports.predictions(p, e)


@query("biostat_table", f"WITH {POINTS_SQL}, a AS (SELECT user_id AS cell_id, avg(value) AS attention FROM events GROUP BY 1) SELECT p.cell_id, {r('area')} AS area, CASE WHEN p.cell_id%2=0 THEN 'Stromal' END AS predicted_class, {r('coalesce(attention,-1)')} AS attention FROM pts p LEFT JOIN a USING (cell_id)")
def _(spark, d):
    """O039, O040, O154: the per-cell table."""
    p = points_parts(spark, d)
    a = _table(spark, d, "events").groupBy(F.col("user_id").alias("target_node")).agg(F.avg("value").alias("attention"))
    t = exports.biostat(p.select("cell_id", "area"), p.where("cell_id % 2 = 0").select("cell_id", F.lit("Stromal").alias("predicted_class")), a)
    return rounded(t.select("cell_id", "area", "predicted_class", F.when(F.isnan("attention"), -1.0).otherwise(F.col("attention")).alias("attention")), "area", "attention")


_SIXTHS = ["perimeter", "circularity", "eccentricity", "knn_density", "rbf_risk_score"]
_NODE = [r("cast(cast(area AS float) AS double)", 3), *(f"{k}.5" for k in range(5)), "centroid_x", "centroid_y", *(f"CASE WHEN cell_id%4={k} THEN 1.0 ELSE 0.0 END" for k in range(4))]


@query("node_features", f"WITH {POINTS_SQL} SELECT cell_id, {', '.join(f'cast({e} AS double) AS x{i}' for i, e in enumerate(_NODE))} FROM pts")
def _(spark, d):
    """O048: the twelve node features of the graph export."""
    p = points_parts(spark, d).withColumns({c: F.lit(k + 0.5) for k, c in enumerate(_SIXTHS)})
    p = p.withColumn("clinical", F.element_at(F.array(*map(F.lit, exports.LABELS)), (F.col("cell_id") % 4 + 1).cast("int")))
    out = exports.node_features(p).select("cell_id", *[F.col("x")[i].cast("double").alias(f"x{i}") for i in range(12)])
    return rounded(out, "x0", digits=3)


@query(
    "project_instances",
    f"""WITH {POINTS_SQL}, i AS (SELECT slide_id, cell_id AS inst_id, centroid_x+cell_id%90 AS x, centroid_y AS y, (cell_id%10)/10.0 AS confidence, 'L'||cell_id%3 AS label FROM pts WHERE cell_id%5=0),
    n AS (SELECT i.slide_id, inst_id, arg_min(p.cell_id, (x-centroid_x)*(x-centroid_x)+(y-centroid_y)*(y-centroid_y)+p.cell_id*1e-9) AS cell_id, min((x-centroid_x)*(x-centroid_x)+(y-centroid_y)*(y-centroid_y)) AS d2 FROM i JOIN pts p ON p.slide_id=i.slide_id GROUP BY ALL),
    o0 AS (SELECT i.slide_id, i.inst_id, p.cell_id, greatest(0,least(x+90,centroid_x+30)-greatest(x-10,centroid_x-30))*greatest(0,least(y+90,centroid_y+30)-greatest(y-10,centroid_y-30)) AS both FROM i JOIN n ON n.slide_id=i.slide_id AND n.inst_id=i.inst_id AND d2>900 JOIN pts p ON p.slide_id=i.slide_id),
    o AS (SELECT slide_id, inst_id, cell_id FROM o0 WHERE both/(13600-both)>=0.05 QUALIFY row_number() OVER (PARTITION BY slide_id, inst_id ORDER BY both DESC, cell_id)=1),
    h AS (SELECT slide_id, inst_id, cell_id FROM n WHERE d2<=900 UNION ALL FROM o),
    b AS (SELECT slide_id, cell_id, arg_max(label, confidence*1e7+inst_id) AS label, max(confidence) AS confidence FROM h JOIN i USING (slide_id, inst_id) GROUP BY ALL)
    SELECT p.slide_id, p.cell_id, coalesce(label,'Stromal') AS label, coalesce(confidence,0) AS confidence FROM pts p LEFT JOIN b USING (slide_id, cell_id)""".replace("both", "shared"),
)
def _(spark, d):
    """O132: instances on cells by nearest centroid, else by the overlap of boxes."""
    p = points_parts(spark, d)
    box = lambda x, y, before, after: F.struct((x - before).alias("x0"), (y - before).alias("y0"), (x + after).alias("x1"), (y + after).alias("y1"))
    cells = p.withColumn("box", box(F.col("centroid_x"), F.col("centroid_y"), 30, 30))
    i = p.where("cell_id % 5 = 0").select("slide_id", F.col("cell_id").alias("inst_id"), (F.col("centroid_x") + F.col("cell_id") % 90).alias("x"), F.col("centroid_y").alias("y"), (F.col("cell_id") % 10 / 10.0).alias("confidence"), F.concat(F.lit("L"), (F.col("cell_id") % 3).cast("string")).alias("label"))
    return spatial.project(cells, i.withColumn("box", box(F.col("x"), F.col("y"), 10, 90)), most=30.0)


@query("job_summary", "WITH j AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type<>'error') AS done, count(*) FILTER (event_type='error') AS failed FROM events GROUP BY ALL) SELECT user_id, total, done, failed, round(100.0*(done+failed)/total,1) AS progress, CASE WHEN failed=total THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM j")
def _(spark, d):
    """O252, O287: counters and status of jobs."""
    return service.jobs(_table(spark, d, "events")).drop("created_at")


@query("job_list", "SELECT user_id FROM (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id) WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 86400 SECONDS")
def _(spark, d):
    """O170, O174: jobs within their time to live, newest first."""
    return service.newest(service.unexpired(service.jobs(_table(spark, d, "events")), "2024-01-02 00:00:00", 86400)).select("user_id")


@query("batch_checks", "SELECT p_brand AS batch, count(*) AS files, sum(p_size-1) AS bytes, count(*) FILTER (p_size=1) AS empty, count(*)<=85 AND sum(p_size-1)<=2200 AND count(*) FILTER (p_size=1)=0 AS ok FROM part GROUP BY ALL")
def _(spark, d):
    """O120: limits of an upload."""
    p = _table(spark, d, "part").select(F.col("p_brand").alias("batch"), (F.col("p_size") - 1).cast("long").alias("bytes"))
    return service.batch_checks(p, 85, 2200)


@query("fresh_artifacts", "SELECT p_partkey AS name, coalesce(p_size>=25,false) AND p_partkey%7<>0 AS fresh FROM part")
def _(spark, d):
    """O121: artifacts as new as their inputs."""
    p = _table(spark, d, "part")
    return service.fresh(p.select(F.col("p_partkey").alias("name"), F.col("p_size").alias("at")), p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("name"), F.lit(25).alias("at"))).select("name", "fresh")


@query("sessions_batch", f"WITH g AS (SELECT user_id, ts, value, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<=INTERVAL 12 HOURS AND ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<INTERVAL 12 HOURS THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(*) AS events, {r('sum(value)',3)} AS value FROM s GROUP BY user_id, s")
def _(spark, d):
    """Session windows over events, as the stream makes them."""
    return rounded(service.sessions(_table(spark, d, "events")).select("user_id", "events", "value"), "value", digits=3)


@query("windowed_calls", "SELECT user_id, count(*) AS calls, cast(epoch(time_bucket(INTERVAL 3600 SECONDS, ts)) AS bigint) AS start FROM events GROUP BY user_id, time_bucket(INTERVAL 3600 SECONDS, ts)")
def _(spark, d):
    """Tumbling counts by key, as the stream makes them."""
    return service.windowed_counts(_table(spark, d, "events"), 3600).select("user_id", "calls", F.unix_timestamp(F.col("window.start").cast("timestamp")).alias("start"))


@query("coordinate_digests", f"""WITH {CELLS_SQL} SELECT slide_id, sha256(string_agg(format('{{:.6f}},{{:.6f}};', x, y), '' ORDER BY cell_id, i)) AS digest FROM v GROUP BY slide_id""")
def _(spark, d):
    """O116-O118: digest of all coordinates of a document."""
    return exports.coordinate_digests(cells_embed(spark, d), "slide_id", "cell_id")


@query("geometry_unchanged", "SELECT DISTINCT p_brand AS slide_id, p_brand<>'Brand#11' AS same FROM part")
def _(spark, d):
    """O116: exports leave coordinates alone; one slide here is moved."""
    c = cells_parts(spark, d).withColumn("source_index", F.col("cell_id"))
    moved = c.withColumn("ring", F.when(F.col("slide_id") == "Brand#11", ring.shift("ring", "1D", "0D")).otherwise(F.col("ring")))
    return exports.unchanged(c, moved, "slide_id")


@query("stage_defaults", "SELECT p_brand AS slide_id, count(*) AS cell_count, count(*) FILTER (p_brand='Brand#11') AS malignant FROM part GROUP BY p_brand")
def _(spark, d):
    """O035, O036: defaults of a stage document; labels of the wrong length become Normal."""
    n = points_parts(spark, d).groupBy("slide_id").agg(F.count("*").cast("int").alias("cell_count"))
    n = n.withColumn("clinical", F.when(F.col("slide_id") == "Brand#11", F.expr("array_repeat('Malignant', cell_count)")).otherwise(F.array(F.lit("Malignant"))))
    out = exports.with_defaults(n)
    return out.select("slide_id", F.col("cell_count").cast("long").alias("cell_count"), F.size(F.expr("filter(biology, b -> b = 'Epithelial_Malignant')")).cast("long").alias("malignant"))


@query("json_polygons", _BACK.format(n=32))
def _(spark, d):
    """O012, O016, O274, O279, O281, O282, O295: polygons in any JSON layout, by name of the file."""
    one = F.to_json(F.struct(exports.coordinates().alias("boundary")))
    return _back(annotations.parse(exports.pieces(cells_parts(spark, d), _named(".json"), "cell_id", one, '{"nuclei":[', "]}", ","))).drop("source_class")


@query("annotation_manifest", f"WITH {POINTS_SQL}, {_RANK}, n AS (SELECT slide_id, count(*) AS c FROM pts GROUP BY ALL) SELECT slide_id, position, centroid_x, centroid_y, c AS record_count FROM rk JOIN n USING (slide_id)")
def _(spark, d):
    """O034: the manifest that joins exports to their sources."""
    files = _xml(spark, d, "Region", "Vertex").withColumn("modificationTime", F.lit("2024-01-01").cast("timestamp"))
    m = exports.manifest(annotations.parse(files), files)
    m = m.select(F.regexp_extract("path", r"^(.*)\.\w+$", 1).alias("slide_id"), F.col("cell_id").cast("long").alias("position"), "centroid_x", "centroid_y", "record_count")
    return rounded(m, "centroid_x", "centroid_y", digits=3)


@query("incomplete_labels", "SELECT p_brand AS slide_id, CASE WHEN count(*)<80 THEN 'labels for 80 of '||count(*)||' cells' WHEN count(*)>80 THEN 'labels for 80 of '||count(*)||' cells' END AS message FROM part GROUP BY p_brand")
def _(spark, d):
    """O119: slides whose labels do not fit their cells."""
    n = points_parts(spark, d).groupBy("slide_id").agg(F.count("*").alias("n"))
    return n.select("slide_id", F.when(F.col("n") != 80, F.concat(F.lit("labels for 80 of "), F.col("n").cast("string"), F.lit(" cells"))).alias("message"))


@query("prediction_files", "SELECT p_brand AS slide_id, p_partkey AS cell_id, CASE WHEN p_partkey%2=0 THEN 'Stromal' ELSE 'Lymphocyte' END AS predicted_class FROM part")
def _(spark, d):
    """O026, O280: prediction rows from a list or from records; an empty file is an error."""
    kind = F.when(F.col("cell_id") % 2 == 0, "Stromal").otherwise("Lymphocyte")
    p = points_parts(spark, d).groupBy("slide_id").agg(F.collect_list(F.struct("cell_id", kind.alias("predicted_class"))).alias("r"))
    text = p.withColumn("json", F.when(F.substring("slide_id", -1, 1) == "1", F.to_json("r")).otherwise(F.to_json(F.struct(F.col("r").alias("records")))))
    return exports.prediction_records(text)


@query("round_trip_export", "SELECT p_brand AS slide_id, count(*) AS regions, true AS same FROM part GROUP BY p_brand")
def _(spark, d):
    """O043, O259, O283, O284: regions labelled in their XML, read again, with the geometry as it was."""
    files = _xml(spark, d, "Region", "Vertex")
    before = cut(annotations.parse(files))  # read by two plans below, as is what comes after
    rows = before.select("path", F.col("source_index").alias("position"), F.col("source_index").alias("cell_id"), F.lit("Normal").alias("clinical"), F.lit(0.85).alias("confidence"))
    after = cut(annotations.parse(exports.labelled_xml(files, rows)))
    n = after.groupBy("path").agg(F.count("*").alias("regions")).join(exports.unchanged(before, after), "path")
    return n.select(F.regexp_extract("path", r"^(.*)\.\w+$", 1).alias("slide_id"), "regions", "same")


@query("cell_points", f"WITH {POINTS_SQL} SELECT slide_id, count(*) AS cells, count(*) FILTER (cell_id%3=0) AS cancer FROM pts GROUP BY slide_id")
def _(spark, d):
    """O289: cells as points with a flag, and their counts."""
    p = points_parts(spark, d).select("slide_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), (F.col("cell_id") % 3 == 0).alias("is_cancer"))
    return p.groupBy("slide_id").agg(F.count("*").alias("cells"), F.count_if("is_cancer").alias("cancer"))


_FULL = {
    "area_px2": "area", "perimeter_px": "perimeter", "circularity": "cc", "eccentricity": "CASE WHEN e<1e-6 THEN 0 ELSE e END", "centroid_x": "mx", "centroid_y": "my", "knn_density_k5": "CASE WHEN d5<1e-12 THEN 0 ELSE k5/(pi()*d5*d5) END", "rbf_risk_score": "rbf", "distance_to_tumor_edge": "dist",
    "area_zscore": "(area-md)/greatest(sd,1e-12)", "circularity_penalty": "1-cc", "perimeter_area_ratio": "perimeter/greatest(area,1e-12)", "major_axis_length": "mj", "minor_axis_length": "mj*sqrt(1-e2)", "solidity": "1.0", "convex_hull_area": "area", "extent": "least(1,area/greatest(1e-12,(x1-x0)*(y1-y0)))",
    "equivalent_diameter": "2*sqrt(area/pi())", "form_factor": "cc",
}


@query(
    "feature_table_full",
    f"""WITH {PARTS_SQL}, pts AS (SELECT slide_id, cell_id, mx AS centroid_x, my AS centroid_y FROM g), {KNN_SQL.format(t='pts', k=5)}, r5 AS (SELECT slide_id, src AS cell_id, max(rank) AS k5, max(d) AS d5 FROM edges GROUP BY ALL),
    few AS (SELECT slide_id, cell_id FROM pts QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY md5(cast(cell_id AS varchar)))<=200),
    hp AS (SELECT p.slide_id, quantile_cont(sqrt(d2),0.5)/2 AS s FROM pairs p JOIN few a ON a.slide_id=p.slide_id AND a.cell_id=src JOIN few b ON b.slide_id=p.slide_id AND b.cell_id=dst WHERE src<dst GROUP BY ALL), rb AS (SELECT p.slide_id, src AS cell_id, (sum(exp(-d2/(2*s*s)))+1)/(count(*)+1) AS rbf FROM pairs p JOIN hp USING (slide_id) GROUP BY ALL),
    pp AS (SELECT slide_id AS k, round(mx,6) AS x, round(my,6) AS y FROM g), {HULL_SQL.format(t='pp', out='hh')},
    far AS (SELECT slide_id, cell_id, sqrt(min(pow(mx-ax-t*(bx-ax),2)+pow(my-ay-t*(byy-ay),2))) AS dist FROM (SELECT *, greatest(0,least(1,((mx-ax)*(bx-ax)+(my-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)))) AS t FROM g JOIN hh ON k=slide_id) GROUP BY ALL),
    m AS (SELECT slide_id, quantile_cont(area,0.5) md, stddev_pop(area) sd FROM g GROUP BY ALL), f0 AS (SELECT *, 1-sqrt(greatest(0,l2)/l1) AS e, 4*pi()*area/(perimeter*perimeter) AS cc FROM g JOIN m USING (slide_id)),
    f1 AS (SELECT *, least(0.9999,greatest(0,e*e)) AS e2 FROM f0), f AS (SELECT *, sqrt(greatest(1e-12,area/(pi()*sqrt(1-e2)))) AS mj FROM f1)
    SELECT slide_id, cell_id, {', '.join(f'{r(e, 4)} AS {n}' for n, e in _FULL.items())} FROM f JOIN r5 USING (slide_id, cell_id) JOIN rb USING (slide_id, cell_id) JOIN far USING (slide_id, cell_id)""",
)
def _(spark, d):
    """O045, O082, O223: all 19 columns, with the distance to the hull of all cells."""
    from .features import NAMES, features

    out = features(cells_parts(spark, d))
    return rounded(out, *NAMES, digits=4)
