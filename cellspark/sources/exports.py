"""Rows to files and documents: envelopes, manifests, feature collections, tables, bundles."""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import annotations
from .fixtures import spread

#: Colours by class.
COLORS = {"Malignant": (200, 40, 40), "Immune": (40, 90, 200), "Normal": (60, 160, 60)}
#: Colours by predicted class, and of any other.
CLASS_COLORS = {"Epithelial_Malignant": (229, 57, 53), "Inflammatory": (255, 179, 0), "Lymphocyte": (30, 136, 229), "Stromal": (67, 160, 71)}
OTHER_COLOR = (200, 200, 200)
LABELS = ("Epithelial_Malignant", "Inflammatory", "Lymphocyte", "Stromal")


def coordinates(ring: str = "ring", close: bool = False) -> Column:
    """A ring as an array of pairs, with the first vertex once more where ``close``."""
    whole = f"CASE WHEN size({ring}) > 0 AND {ring}[0] <> element_at({ring}, -1) THEN concat({ring}, slice({ring}, 1, 1)) ELSE {ring} END" if close else ring
    return F.expr(f"transform({whole}, p -> array(p.x, p.y))")


def envelopes(cells: DataFrame) -> DataFrame:
    """slide_id, json: cell count, rings in order of id, and the calibration by the median area."""
    from ..functions.ring import area

    own = cells.select("slide_id", F.struct("cell_id", coordinates().alias("ring")).alias("c"), area().alias("a"))
    slides = own.groupBy("slide_id").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list("c")).alias("cs"), F.percentile("a", F.lit(0.5)).alias("m"))
    doc = F.struct(F.col("n").alias("cell_count"), F.expr("transform(cs, c -> c.ring)").alias("cells"), F.struct(F.col("m").alias("median_area"), (F.col("m") * 1.5).alias("threshold")).alias("dynamic_calibration"))
    return slides.select("slide_id", F.to_json(doc).alias("json"))


def pieces(items: DataFrame, path: Column, order: str, text: Column, head: str = "", tail: str = "", between: str = "", keep: Column | None = None) -> DataFrame:
    """path, part, content: documents of the ``text`` of their items in the order of ``order``, a piece for each item, so
    that no document is a value. ``annotations.parse`` reads them one after another. ``keep``: which items are put in; the
    others go once items are numbered, since a filter before that would be pushed down to the few tasks that read a small
    file, with all that makes the columns it looks at."""
    w = Window.partitionBy("_p").orderBy(F.desc("_k"), order)
    own = items.withColumn("_p", path).withColumn("_k", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    own = own.withColumns({"_n": (F.row_number().over(w) - 1).cast("long"), "_last": ~F.coalesce(F.lead("_k").over(w), F.lit(False))}).where("_k")
    body = F.concat(F.when(F.col("_n") == 0, head).otherwise(between), F.coalesce(text, F.lit("")), F.when(F.col("_last"), tail).otherwise(""))
    return spread(own).select(F.col("_p").alias("path"), F.col("_n").alias("part"), body.cast("binary").alias("content"))


def feature(label: Column, extra: tuple[Column, ...] = ()) -> Column:
    """One GeoJSON polygon with its class; labels outside COLORS are Normal."""
    known = F.when(label.isin(*COLORS), label).otherwise("Normal")
    color = F.lit(None)
    for name, rgb in COLORS.items():
        color = F.when(known == name, F.array(*map(F.lit, rgb))).otherwise(color)
    name = F.concat(F.lit("Cell_"), F.col("cell_id").cast("string"))
    props = F.struct(F.lit("annotation").alias("objectType"), name.alias("name"), F.struct(known.alias("name"), color.alias("color")).alias("classification"), F.col("cell_id"), *extra)
    return F.struct(F.lit("Feature").alias("type"), name.alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(coordinates(close=True)).alias("coordinates")).alias("geometry"), props.alias("properties"))


def feature_collections(cells: DataFrame, label: str = "clinical") -> DataFrame:
    """slide_id, json: one feature collection by slide, without rings that are empty or not finite."""
    from ..functions.ring import finite

    good = cells.where(finite() & (F.size("ring") > 0)).select("slide_id", F.struct("cell_id", feature(F.col(label)).alias("f")).alias("c"))
    slides = good.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct(F.col("c.cell_id").alias("i"), F.to_json("c.f").alias("f")))).alias("fs"))
    body = F.array_join(F.expr("transform(fs, x -> x.f)"), ",")
    return slides.select("slide_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("json"))


def feature_pieces(cells: DataFrame, path: Column, label: str = "clinical") -> DataFrame:
    """path, part, content: ``feature_collections`` in pieces."""
    from ..functions.ring import finite

    return pieces(cells, path, "cell_id", F.to_json(feature(F.col(label))), '{"type":"FeatureCollection","features":[', "]}", ",", finite() & (F.size("ring") > 0))


def prediction_features(cells: DataFrame, predicted: DataFrame) -> DataFrame:
    """slide_id, json: a feature collection of the cells that have a prediction, by slide.

    ``cells``: slide_id, position (from 0 in the order of the slide), ring. ``predicted``: slide_id, position, cell_id,
    predicted_class (null: Stromal), confidence (null: 0). Cells without a row, and rings that are empty or not finite,
    are left out. A slide's document is one value, so it must fit into an executor, as any file of it must."""
    from ..functions.ring import finite

    name = F.coalesce("predicted_class", F.lit("Stromal"))
    color = F.array(*map(F.lit, OTHER_COLOR))
    for label, rgb in CLASS_COLORS.items():
        color = F.when(name == label, F.array(*map(F.lit, rgb))).otherwise(color)
    id_ = F.concat(F.lit("Cell_"), F.col("position").cast("string"))
    props = F.struct(F.lit("annotation").alias("objectType"), id_.alias("name"), F.struct(name.alias("name"), color.alias("color")).alias("classification"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("cell_id", "position").alias("cell_id"))
    one = F.struct(F.lit("Feature").alias("type"), id_.alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(coordinates(close=True)).alias("coordinates")).alias("geometry"), props.alias("properties"))
    good = cells.select("slide_id", "position", "ring").where(finite() & (F.size("ring") > 0)).join(predicted, ["slide_id", "position"])
    slides = good.groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("position", F.to_json(one).alias("f")))).alias("fs"))
    body = F.array_join(F.expr("transform(fs, x -> x.f)"), ",")
    return slides.select("slide_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("json"))


def manifest(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Annotations with cell_id, vertex-mean centroid and their file's digest, time and record count. ``sources``: files (path,
    content, modificationTime), or such files in pieces (with ``part``)."""
    from ..functions.ring import vertex_mean
    from ..operators.checkpoints import cut

    x, y = vertex_mean()
    if "part" in sources.columns:
        times = sources.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))
        about = _digests(sources, "path", "part", "content", "source_sha256").withColumn("source_bytes", F.col("bytes").cast("int")).drop("bytes").join(times, "path")
    else:
        about = sources.select("path", F.sha2("content", 256).alias("source_sha256"), F.length("content").alias("source_bytes"), "modificationTime")
    own = cut(records.select("path", F.col("source_index").alias("cell_id"), "source_index", "region_id", x.alias("centroid_x"), y.alias("centroid_y")))  # files are parsed once
    count = own.groupBy("path").agg(F.count("*").alias("record_count"))
    return own.join(count, "path").join(about, "path")


def parity(manifest_rows: DataFrame, predictions: DataFrame, most: float = 0.5) -> DataFrame:
    """Cells of either side with whether both have them and their centroids differ by at most ``most``."""
    m = manifest_rows.select("cell_id", F.col("centroid_x").alias("mx"), F.col("centroid_y").alias("my"))
    p = predictions.select("cell_id", F.col("centroid_x").alias("px"), F.col("centroid_y").alias("py"))
    drift = F.sqrt((F.col("mx") - F.col("px")) ** 2 + (F.col("my") - F.col("py")) ** 2)
    return m.join(p, "cell_id", "full").select("cell_id", drift.alias("drift"), F.coalesce(drift <= most, F.lit(False)).alias("ok"))


def predictions(cells: DataFrame, enriched: DataFrame) -> DataFrame:
    """Every cell with label, confidence and centroid of the enriched side, else Normal, 0.85 and its own centroid."""
    e = enriched.select("cell_id", F.col("clinical").alias("c"), F.col("confidence").alias("k"), F.col("centroid_x").alias("ex"), F.col("centroid_y").alias("ey"))
    out = cells.join(e, "cell_id", "left")
    return out.select("cell_id", F.coalesce("c", F.lit("Normal")).alias("clinical"), F.coalesce("k", F.lit(0.85)).alias("confidence"), F.coalesce("ex", "centroid_x").alias("centroid_x"), F.coalesce("ey", "centroid_y").alias("centroid_y"))


def biostat(cells: DataFrame, predicted: DataFrame, attention: DataFrame) -> DataFrame:
    """Cells with predicted class, confidence and mean attention (NaN without); rows whose numbers are not finite go."""
    from ..functions.score import finite

    out = cells.join(predicted, "cell_id", "left").join(attention.withColumnRenamed("target_node", "cell_id"), "cell_id", "left")
    out = out.withColumn("attention", F.coalesce("attention", F.lit(float("nan"))))
    numbers = [c for c, t in cells.dtypes if t == "double"]
    keep = F.lit(True)
    for c in numbers:
        keep = keep & finite(F.col(c))
    return out.where(keep)


def node_features(cells: DataFrame, label: str = "clinical") -> DataFrame:
    """Twelve single-precision node features: eight numbers and the class one-hot."""
    numbers = ["area", "perimeter", "circularity", "eccentricity", "knn_density", "rbf_risk_score", "centroid_x", "centroid_y"]
    hot = [(F.col(label) == name).cast("float") for name in LABELS]
    return cells.select("slide_id", "cell_id", F.array(*[F.col(c).cast("float") for c in numbers], *hot).alias("x"))


def artifacts(sources: DataFrame) -> DataFrame:
    """path, sha256 and bytes of files (path, content)."""
    return sources.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def output_path(path: Column, root: str) -> Column:
    """Where a file's result goes: its place below ``root`` with the suffix _enriched.json."""
    return F.regexp_replace(F.regexp_replace(path, "^" + root.rstrip("/") + "/", ""), r"\.[^./]+$", "_enriched.json")


def write_features_csv(df: DataFrame, path: str) -> None:
    """The feature table as CSV with a header."""
    df.write.option("header", True).mode("overwrite").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet with snappy, by slide."""
    df.write.option("compression", "snappy").mode("overwrite").partitionBy("slide_id").parquet(path)


def bundles(members: DataFrame) -> DataFrame:
    """bundle, content: a ZIP of each bundle's members (bundle, name, content) with a manifest of their digests and
    sizes. A bundle is one file and is made in one task; its members must fit into it."""

    def run(batches):
        for batch in batches:
            out = []
            for own in batch.column("members").to_pylist():
                about = {m["name"]: {"sha256": m["sha256"], "bytes": len(m["content"])} for m in own}
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("manifest.json", json.dumps({"schema_version": "checkpoint_bundle_v1", "artifacts": about}))
                    for m in own:
                        z.writestr(zipfile.ZipInfo(m["name"]), m["content"], zipfile.ZIP_DEFLATED)
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_pydict({"bundle": batch.column("bundle"), "content": pa.array(out, pa.binary())})

    own = members.select(F.col("bundle").cast("string").alias("bundle"), F.struct("name", F.sha2("content", 256).alias("sha256"), "content").alias("m"))
    return own.groupBy("bundle").agg(F.array_sort(F.collect_list("m")).alias("members")).mapInArrow(run, "bundle string, content binary")


def unbundled(zips: DataFrame) -> DataFrame:
    """bundle, name, sha256, bytes, intact of the members of bundles, by their manifests; a missing member is not intact."""

    def run(batches):
        for batch in batches:
            out = []
            for bundle, raw in zip(batch.column("bundle").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    held = set(z.namelist())
                    for name, about in json.loads(z.read("manifest.json"))["artifacts"].items():
                        same = name in held and hashlib.sha256(z.read(name)).hexdigest() == about["sha256"]
                        out.append((bundle, name, about["sha256"], about["bytes"], same))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = {"bundle": pa.string(), "name": pa.string(), "sha256": pa.string(), "bytes": pa.int64(), "intact": pa.bool_()}
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})

    return zips.select("bundle", "content").mapInArrow(run, "bundle string, name string, sha256 string, bytes long, intact boolean")


class _Labelled:
    """A target of XMLParser that writes a document as ElementTree does, with the next of ``rows`` on each element of a
    name. ``spaces``: prefixes of its namespaces."""

    def __init__(self, name: str, rows, spaces: dict[str, str]):
        self.name, self.rows, self.spaces, self.out, self.text, self.open, self.root = name, rows, spaces, [], [], False, True

    def _flush(self, end: bool = False):
        text = "".join(self.text)
        if self.open and not (end and not text):
            self.out.append(">")
            self.open = False
        if text:
            self.out.append(_XML["cdata"](text))
            self.text = []

    def _named(self, tag: str) -> str:
        if tag[:1] != "{":
            return tag
        uri, name = tag[1:].rsplit("}", 1)
        return f"{self.spaces[uri]}:{name}"

    def start(self, tag, attributes):
        self._flush()
        if tag.rpartition("}")[2] == self.name:
            row = next(self.rows)
            attributes = dict(attributes) | {"Classification": row["clinical"], "Confidence": f"{row['confidence']:.4f}", "CellId": str(row["cell_id"])}
        self.out.append("<" + self._named(tag))
        if self.root:
            self.out += [f' xmlns:{p}="{_XML["attribute"](u)}"' for u, p in sorted(self.spaces.items(), key=lambda x: x[1]) if p != "xml"]
            self.root = False
        self.out += [f' {self._named(k)}="{_XML["attribute"](v)}"' for k, v in attributes.items()]
        self.open = True

    def data(self, text):
        self.text.append(text)

    def end(self, tag):
        self._flush(True)
        self.out.append(" />" if self.open else f"</{self._named(tag)}>")
        self.open = False

    def close(self):
        pass


def _replaced(*pairs):
    def run(text: str) -> str:
        for a, b in pairs:
            text = text.replace(a, b)
        return text

    return run


_AND = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
_XML = {"cdata": _replaced(*_AND), "attribute": _replaced(*_AND, ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;"))}


class _Spaces:
    """Namespaces of a document in the order in which they come, with ElementTree's prefixes."""

    def __init__(self):
        self.found: dict[str, str] = {}

    def start(self, tag, attributes):
        from xml.etree.ElementTree import _namespace_map as known

        for name in (tag, *attributes):
            if name[:1] == "{" and (uri := name[1:].rsplit("}", 1)[0]) not in self.found:
                self.found[uri] = known.get(uri) or f"ns{sum(p != 'xml' for p in self.found.values())}"

    def close(self):
        pass


def xml_labelled(stream, n: int, rows) -> Iterator[bytes]:
    """Parts of an XML document with class, confidence (four digits) and cell id of ``n`` rows set on its regions (without
    one: its annotations) in document order; counts must match."""
    count = annotations.tags(stream)
    name = "Region" if count.get("Region") else "Annotation"
    if count.get(name, 0) != n:
        raise ValueError(f"{count.get(name, 0)} regions, {n} predictions")
    stream.seek(0)
    spaces = _Spaces()
    for _ in annotations._fed(stream, spaces):
        pass
    stream.seek(0)
    for own in annotations._fed(stream, _Labelled(name, iter(rows), spaces.found)):
        out, own.out = own.out, []
        yield "".join(out).encode("us-ascii", "xmlcharrefreplace")


def annotate_xml(raw: bytes, rows: list[dict]) -> bytes:
    """``xml_labelled`` of a whole document."""
    return b"".join(xml_labelled(io.BytesIO(raw), len(rows), rows))


@F.arrow_udf(StringType())  # a type, not a string: workers import this module without a session
def six_digits(rings: pa.Array) -> pa.Array:
    """x,y; of each vertex to six digits. The number as it is stored is rounded, ties to even: Spark's format_string rounds
    a tie, such as 0.0078125, away from zero."""
    import numpy as np

    out = []
    for start in range(0, len(rings), 1000):
        own = rings.slice(start, 1000)
        points, sizes = own.flatten(), own.value_lengths().to_pylist()
        if points.null_count or any(points.field(c).null_count for c in "xy"):
            for ring in own.to_pylist():
                out.append(None if ring is None else "".join("null,null;" if p is None else "".join(("null" if p[c] is None else f"{p[c]:.6f}") + end for c, end in (("x", ","), ("y", ";"))) for p in ring))
            continue
        flat, at = np.stack([points.field(c).to_numpy() for c in "xy"], 1).ravel().tolist(), 0
        for n in sizes:
            out.append(None if n is None else "%.6f,%.6f;" * n % tuple(flat[at : at + 2 * n]))
            at += 2 * (n or 0)
    return pa.array(out, pa.string())


def _digests(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """key, ``name`` (sha256) and bytes of all values of a key in their order, which go by one after another; null is
    nothing."""

    def run(batches):
        at = own = None
        size, out = 0, []
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v"), strict=True):
                if own is None or k != at:
                    if own is not None:
                        out.append((at, own.hexdigest(), size))
                    at, own, size = k, hashlib.sha256(), 0
                if v.is_valid:
                    own.update(v.as_buffer())
                    size += len(v.as_buffer())
            if out:
                yield made(out, batch.schema.field("k").type)
                out = []
        if own is not None:
            yield made([(at, own.hexdigest(), size)], batch.schema.field("k").type)

    def made(out, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, pa.string(), pa.int64()), strict=True)], names=["k", "d", "n"])

    own = rows.select(F.col(key).alias("k"), F.col(order).alias("i"), F.col(value).cast("binary").alias("v"))
    found = own.repartition("k").sortWithinPartitions("k", "i", "v").select("k", "v").mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, d string, n long")
    return found.select(F.col("k").alias(key), F.col("d").alias(name), F.col("n").alias("bytes"))


def coordinate_digests(records: DataFrame, key: str = "path", order: str = "source_index") -> DataFrame:
    """key, digest: sha256 over all coordinates (six digits) of a document in its order, to show that an export has left
    the geometry alone."""
    return _digests(records.select(key, F.col(order).alias("_i"), six_digits("ring").alias("_t")), key, "_i", "_t", "digest").drop("bytes")


def unchanged(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """key, same: whether both sides have the same digest."""
    a, b = coordinate_digests(before, key), coordinate_digests(after, key).withColumnRenamed("digest", "other")
    return a.join(b, key, "full").select(key, F.coalesce(F.col("digest") == F.col("other"), F.lit(False)).alias("same"))


def geojson_labelled(stream, n: int, rows) -> Iterator[bytes]:
    """Parts of a feature collection with class, confidence and cell id of ``n`` rows in the properties of its features that
    have a geometry, in document order; counts must match. Coordinates are not touched. The document is read once; what is
    made of it waits for its end."""
    has = lambda f: isinstance(f, dict) and isinstance(f.get("geometry"), dict)
    dump = json.JSONEncoder(ensure_ascii=False).encode
    keys, found = [], 0

    def labelled(f, own):
        nonlocal found
        if has(f):
            found += 1
            if (row := next(own, None)) is not None:
                old = f.get("properties")
                f["properties"] = (old if isinstance(old, dict) else {}) | {"Classification": row["clinical"], "Confidence": row["confidence"], "CellId": row["cell_id"]}
        return f

    def parts(members):
        own = iter(rows)
        yield "{"
        for i, (key, value) in enumerate(members):
            keys.append(key)
            yield f"{', ' if i else ''}{dump(key)}: "
            if key == "features" and isinstance(value, list | Iterator):
                value = (labelled(f, own) for f in value)
            if isinstance(value, Iterator):
                yield "["
                for k, item in enumerate(value):
                    yield f"{', ' if k else ''}{dump(item)}"
                yield "]"
            else:
                yield dump(value)
        yield "}"

    with annotations.spool(annotations.CHUNK) as out:
        members = annotations._members(annotations._decoded(stream))
        for text in parts(members) if members is not None else ():
            out.write(text.encode())
        if members is None or len(set(keys)) < len(keys):  # no object, or one with a key twice, of which the last counts
            doc, found = json.loads("".join(annotations._decoded(stream))), 0
            out.seek(0)
            out.truncate()
            for text in parts(doc.items()):
                out.write(text.encode())
        if found != n:
            raise ValueError(f"{found} features, {n} predictions")
        out.seek(0)
        while raw := out.read(annotations.CHUNK):
            yield raw


def annotate_geojson(text: str, rows: list[dict]) -> str:
    """``geojson_labelled`` of a whole document."""
    return b"".join(geojson_labelled(io.BytesIO(text.encode()), len(rows), rows)).decode()


def with_defaults(slides: DataFrame) -> DataFrame:
    """Slides (slide_id, cell_count, clinical array) with what later stages expect: labels of the right length or all
    Normal, biology labels, confidence, version and parameters."""
    fits = F.coalesce(F.size("clinical") == F.col("cell_count"), F.lit(False))
    labels = F.when(fits, F.col("clinical")).otherwise(F.expr("array_repeat('Normal', cell_count)"))
    out = slides.withColumns({"schema_version": F.lit("2"), "clinical": labels, "knn_k": F.lit(8), "knn_metric": F.lit("euclidean")})
    biology = F.expr("transform(clinical, c -> CASE WHEN c = 'Malignant' THEN 'Epithelial_Malignant' ELSE 'Stromal' END)")
    return out.withColumns({"biology": biology, "confidence": F.expr("array_repeat(0.85D, cell_count)")})


def prediction_records(text: DataFrame) -> DataFrame:
    """slide_id, cell_id, predicted_class of prediction files (slide_id, json): a list, or an object with records."""
    row = "array<struct<cell_id: bigint, predicted_class: string>>"
    listed = F.col("json").rlike(r"^\s*\[")
    found = F.when(listed, F.from_json("json", row)).otherwise(F.from_json("json", f"records {row}")["records"])
    own = text.select("slide_id", found.alias("r"))
    some = F.assert_true(F.coalesce(F.size("r"), F.lit(0)) > 0, F.lit("a prediction file has no rows"))
    return own.withColumn("_ok", some).where(F.col("_ok").isNull()).select("slide_id", F.explode("r").alias("p")).select("slide_id", "p.*")


class _Pickled:
    """``n`` values of a file, which can be gone through again."""

    def __init__(self, file, n: int):
        self.file, self.n = file, n

    def __iter__(self):
        self.file.seek(0)
        return (pickle.load(self.file) for _ in range(self.n))


def _labelled(sources: DataFrame, rows: DataFrame, label) -> DataFrame:
    """Files with what ``label`` (stream, count, rows) makes of them. Rows and pieces of a file pass through one task as
    streams, rows first; files of one of them only are left out."""
    whole = "part" not in sources.columns
    if "rows" in rows.columns:
        rows = rows.select("path", F.posexplode("rows").alias("position", "r")).select("path", "position", "r.*")

    def run(batches):
        path = own = held = None
        n = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("path", "content", "row")]
            for p, raw, row in zip(columns[0].to_pylist(), columns[1], columns[2].to_pylist(), strict=True):
                if own is None or p != path:
                    if own is not None:
                        yield from done(path, own, n, held)
                    path, own, held, n = p, annotations.spool(), None, 0
                if row is not None:
                    pickle.dump(row, own)
                    n += 1
                    continue
                held = held or annotations.spool()
                if raw.is_valid:
                    held.write(raw.as_buffer())
        if own is not None:
            yield from done(path, own, n, held)

    def done(path, own, n, held):
        if n and held is not None:
            held.seek(0)
            found = label(held, n, _Pickled(own, n))
            for i, raw in enumerate([b"".join(found)] if whole else _grouped(found)):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([i], pa.int64()), pa.array([raw], pa.binary())], names=["path", "part", "content"])
        for f in (own, held):
            if f is not None:
                f.close()

    row = F.struct("clinical", "confidence", "cell_id")
    kinds = rows.select(row.alias("row")).schema["row"].dataType
    texts = sources.select("path", F.lit(1).alias("kind"), (F.lit(0) if whole else F.col("part")).cast("long").alias("i"), "content", F.lit(None).cast(kinds).alias("row"))
    labels = rows.select("path", F.lit(0).alias("kind"), F.col("position").cast("long").alias("i"), F.lit(None).cast("binary").alias("content"), row.alias("row"))
    both = annotations.by_path(texts.unionByName(labels)).sortWithinPartitions("path", "kind", "i").select("path", "content", "row")
    out = both.mapInArrow(run, "path string, part long, content binary")
    return out.drop("part") if whole else out


def _grouped(parts: Iterator[bytes], size: int = 1 << 18) -> Iterator[bytes]:
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= size:
            yield b"".join(held)
            held, n = [], 0
    if held:
        yield b"".join(held)


def labelled_xml(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """XML files (path, content; or in pieces with ``part``) with the labels of ``rows``: clinical, confidence, cell_id by path
    and position in the document, or path with ``rows`` as an array of them."""
    return _labelled(sources, rows, xml_labelled)


def labelled_geojson(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """GeoJSON files with the labels of ``rows``, as ``labelled_xml``."""
    return _labelled(sources, rows, geojson_labelled)
