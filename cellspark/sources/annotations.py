"""Annotation files to rows: XML, GeoJSON, JSON polygons, CSV and HTML tables.

A file is the unit of parsing: ``parse`` takes a frame (path, content) of whole files, as ``files`` reads them, or (path,
part, content) of files in pieces, and yields (path, format, source_index, region_id, source_class, ring) in document
order. Files that are not well-formed give one row with ``error`` and no ring, so one bad file does not stop a job. A file
is read in one task as a stream. Where its end decides, records of XML and JSON wait for it and tables are read twice; what
is large lies in the task's scratch folder meanwhile."""

from __future__ import annotations

import codecs
import csv
import io
import json
import marshal
import math
import os
import re
import tempfile
import xml.etree.ElementTree as ET
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = "path string, format string, source_index int, region_id string, source_class string, ring array<struct<x:double,y:double>>, error string"
SEGMENT = "cell_count int, cells array<array<array<float>>>"
#: Names of the columns that group vertices, in the order they are looked for.
GROUPS = ("polygon_id", "cell_id", "object_id", "region_id", "id")
RING, HELD = 128, 200_000
#: Bytes that are read at once, and those of a file in pieces that stay in memory.
CHUNK, SPOOL = 1 << 18, 8 << 20
#: Records and points that wait in memory for a document's end.
RECORDS, POINTS = 256, 8192


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, length and modificationTime of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """slide_id (path), cell_id, ring of all segment JSON files below a folder."""
    text = files(spark, path, "*.[jJ][sS][oO][nN]").select(F.col("path").alias("slide_id"), F.decode("content", "UTF-8").alias("json"))
    return segment_cells(text)


def segment_cells(text: DataFrame) -> DataFrame:
    """Cells of envelopes (slide_id, json); a count that does not fit is an error."""
    own = text.select("slide_id", F.from_json("json", SEGMENT).alias("s"))
    cells = F.when(F.size("s.cells") == F.col("s.cell_count"), F.col("s.cells")).otherwise(F.raise_error(F.lit("cell_count does not match cells")))  # no filter, which would parse once more
    pts = F.expr("transform(cell, p -> struct(cast(p[0] AS double) AS x, cast(p[1] AS double) AS y))")
    return own.select("slide_id", F.posexplode(cells).alias("cell_id", "cell")).select("slide_id", "cell_id", pts.alias("ring"))


def detect(path: Column, text: Column) -> Column:
    """Format of a file from its name and its text."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    asap = text.rlike(r"<(\w+:)?Coordinate\b") & ~text.rlike(r"<(\w+:)?(Region|Vertex)\b")
    return (
        F.when(suffix == "xml", F.when(asap, "asap_xml").otherwise("aperio_xml")).when(suffix == "geojson", "geojson")
        .when(suffix == "json", F.when(text.rlike(r'"type"\s*:\s*"FeatureCollection"'), "geojson").otherwise("json"))
        .when(suffix == "csv", "csv").when(suffix.isin("html", "htm"), "html").otherwise("unknown")
    )


def _number(v) -> float | None:
    try:
        x = float(v)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def _pair(p) -> tuple[float, float] | None:
    if isinstance(p, dict):
        p = (p.get("x", p.get("X")), p.get("y", p.get("Y")))
    if isinstance(p, list | tuple) and len(p) >= 2 and (x := _number(p[0])) is not None and (y := _number(p[1])) is not None:
        return x, y
    return None


def _pairs(points) -> list[tuple[float, float]]:
    if type(points) is list and set(map(type, points)) == {list} and set(map(len, points)) == {2}:
        flat = list(chain.from_iterable(points))
        if set(map(type, flat)) == {float} and all(map(math.isfinite, flat)):
            return list(map(tuple, points))
    out = []
    for p in points if isinstance(points, list) else ():
        if type(p) is list and len(p) > 1 and type(x := p[0]) is float and type(y := p[1]) is float and math.isfinite(x) and math.isfinite(y):
            out.append((x, y))
        elif q := _pair(p):
            out.append(q)
    return out


@cache
def _unit(n: int) -> list[tuple[float, float]]:
    return [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]


def circle(x: float, y: float, r: float, n: int = RING) -> list[tuple[float, float]]:
    """A regular n-gon."""
    return [(x + r * c, y + r * s) for c, s in _unit(n)]


def radius(row: dict) -> float:
    """Radius or r, half of diameter or size, sqrt(area / pi), else 4; only positive values count."""
    low = {str(k).strip().lower(): _number(v) for k, v in row.items()}
    for names, f in ((("radius", "r"), lambda v: v), (("diameter", "size"), lambda v: v / 2), (("area",), lambda v: math.sqrt(v / math.pi))):
        for n in names:
            if (v := low.get(n)) and v > 0:
                return f(v)
    return 4.0


def _fed(stream, target) -> Iterator:
    """A document read in parts by a target of XMLParser; the target after each."""
    parser = ET.XMLParser(target=target)
    while raw := stream.read(CHUNK // 4):
        parser.feed(raw)
        yield target
    parser.close()
    yield target


@dataclass
class _Open:
    """A region or annotation whose end has not come: its points, and records inside it that it must come before."""

    name: str
    id: str | None
    points: list = field(default_factory=list)
    regions: bool = False
    held: list = field(default_factory=list)

    def waits(self) -> bool:
        return self.name == "Region" or not self.regions

    def records(self) -> list[tuple]:
        own = [(self.id, None, self.points)] if self.waits() and len(self.points) >= 3 else []
        return own + self.held


class _Regions:
    """Regions and annotations as they end (``found``), from the starts and ends of elements."""

    def __init__(self):
        self.stack, self.waiting, self.found, self.names = [], [], [], {}

    def _name(self, tag):
        return self.names.setdefault(tag, tag.rpartition("}")[2])

    def start(self, tag, attributes):
        name, get, stack = self.names.get(tag) or self._name(tag), attributes.get, self.stack
        if name in ("Vertex", "Coordinate"):
            if stack:
                try:
                    q = float(get("X", get("x"))), float(get("Y", get("y")))
                except (TypeError, ValueError):
                    return
                if math.isfinite(q[0]) and math.isfinite(q[1]):
                    for o in self.waiting:
                        o.points.append(q)
        elif name in ("Region", "Annotation"):
            if name == "Region":
                waiting = None
                for o in stack:
                    o.regions = True
                    if o.waits():
                        waiting = o
                        continue
                    found, o.points, o.held = o.held, [], []  # it gives no record, so nothing waits for it
                    (self.found if waiting is None else waiting.held).extend(found)
            stack.append(_Open(name, get("Id") or get("Name")))
            self.waiting = [o for o in stack if o.waits()]

    def end(self, tag):
        if (self.names.get(tag) or self._name(tag)) in ("Region", "Annotation"):
            found = self.stack.pop().records()
            self.waiting = [o for o in self.stack if o.waits()]
            (self.waiting[-1].held if self.waiting else self.found).extend(found)

    def close(self):
        pass


def xml_records(stream) -> Iterator[tuple]:
    """Regions (or annotations without one) with at least three vertices or coordinates, in document order, as they end:
    no more of a document is held than what is open."""
    for regions in _fed(stream, _Regions()):
        found, regions.found = regions.found, []
        yield from found


def from_xml(raw: bytes) -> list[tuple]:
    """``xml_records`` of a whole document."""
    return list(xml_records(io.BytesIO(raw)))


class _Tags:
    """How many elements there are of each tag."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def start(self, tag, attributes):
        self.seen[tag] = self.seen.get(tag, 0) + 1

    def close(self):
        pass


def tags(stream) -> dict[str, int]:
    """How many elements a document has of each name; one that is not well-formed is an error."""
    target = _Tags()
    for _ in _fed(stream, target):
        pass
    out: dict[str, int] = {}
    for tag, n in target.seen.items():
        name = tag.rpartition("}")[2]
        out[name] = out.get(name, 0) + n
    return out


class _Held:
    """Records that wait for the end of their document, in the task's scratch folder but for the last ones. What went wrong
    while they were made comes after them."""

    def __init__(self):
        self.n, self.own, self.points, self.file, self.error = 0, [], 0, None, None

    def add(self, record: tuple):
        self.n += 1
        self.own.append(record)
        self.points += len(record[2])
        if len(self.own) >= RECORDS or self.points >= POINTS:
            self.file = self.file or spool(CHUNK)
            raw = marshal.dumps(self.own)
            self.file.write(len(raw).to_bytes(8) + raw)
            self.own, self.points = [], 0

    def made(self, make: Callable[[object], Iterable[tuple]], item):
        """Add what ``make`` gives of an item, unless one before it was wrong."""
        if self.error is None:
            try:
                for record in make(item):
                    self.add(record)
            except Exception as e:
                self.error = e

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            with self.file as f:
                f.seek(0)
                while head := f.read(8):
                    yield from marshal.loads(f.read(int.from_bytes(head)))
        yield from self.own
        if self.error is not None:
            raise self.error


def _xml(stream) -> tuple[str, Iterator[tuple]]:
    """Which XML a document is, by all its tags, and its ``xml_records``; it is gone through first, so one that is not
    well-formed gives no record."""
    held, regions = _Held(), _Regions()
    for _ in _fed(stream, regions):
        for record in regions.found:
            held.add(record)
        regions.found = []
    names = set(regions.names.values())
    return "asap_xml" if "Coordinate" in names and not names & {"Region", "Vertex"} else "aperio_xml", iter(held)


_SPACE = re.compile(r"[ \t\n\r]*")
_decode = json.JSONDecoder().raw_decode


class _Cursor:
    """A place in a text that comes in parts; what lies before it is not held."""

    def __init__(self, texts: Iterable[str]):
        self.texts, self.text, self.at, self.done = iter(texts), "", 0, False
        self.more()
        self.at = 1 if self.text[:1] == "\ufeff" else 0

    def more(self):
        """Read on until twice as much lies ahead."""
        parts = [self.text[self.at :]]
        want = n = len(parts[0])
        while not self.done and n <= 2 * want:
            if (t := next(self.texts, None)) is None:
                self.done = True
            else:
                parts.append(t)
                n += len(t)
        self.text, self.at = "".join(parts), 0

    def peek(self, after: int = 0) -> str:
        """The next character that is no space, at the cursor or ``after`` places behind it; the cursor goes over spaces."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            at = _SPACE.match(self.text, self.at + after).end()
            if at < len(self.text) or self.done:
                return self.text[at : at + 1]
            self.more()

    def value(self):
        """The value at the cursor, which goes behind it."""
        self.peek()
        while True:
            try:
                found, end = _decode(self.text, self.at)
                if self.done or len(self.text) - end > 3:  # a number may go on
                    self.at = end
                    return found
            except json.JSONDecodeError as e:
                if self.done or len(self.text) - e.pos > 16 and not e.msg.startswith("Unterminated string"):
                    raise
            self.more()

    def wrong(self) -> json.JSONDecodeError:
        return json.JSONDecodeError("Unexpected character", self.text, self.at)


def _members(text: str | Iterable[str]) -> Iterator[tuple[str, object]] | None:
    """(key, value) of the members of a document that is an object, its lists of objects and of lists as iterators; such an
    iterator is used up before the next member. None for any other document."""
    c = _Cursor([text] if isinstance(text, str) else text)
    if c.peek() != "{":
        return None

    def items():
        while True:
            yield c.value()
            last = c.peek()
            if last not in ("]", ","):
                raise c.wrong()
            c.at += 1
            if last == "]":
                return

    def walk():
        c.at += 1
        if c.peek() == "}":
            c.at += 1
        else:
            while True:
                key = c.value()
                if not isinstance(key, str) or c.peek() != ":":
                    raise c.wrong()
                c.at += 1
                if c.peek() == "[" and c.peek(1) in ("{", "["):
                    c.at += 1
                    yield key, (own := items())
                    for _ in own:
                        pass
                else:
                    yield key, c.value()
                last = c.peek()
                if last not in ("}", ","):
                    raise c.wrong()
                c.at += 1
                if last == "}":
                    break
        if c.peek():
            raise json.JSONDecodeError("Extra data", c.text, c.at)

    return walk()


def _ring(item) -> list[tuple[float, float]]:
    """The points of an entry of cells or nuclei: a ring, or an object that names one."""
    if isinstance(item, list):
        return _pairs(item)
    return _pairs(next((item[k] for k in ("boundary", "ring", "polygon", "coordinates", "segmentation", "mask_polygon") if k in item), None)) if isinstance(item, dict) else []


def _feature(item) -> list[tuple]:
    return from_geojson({"features": [item]})


def _cell(item) -> list[tuple]:
    return [(None, None, p)] if len(p := _ring(item)) >= 3 else []


def _polygon(item) -> list[tuple]:
    return [(None, None, p)] if len(p := _pairs(item)) >= 3 else []


def json_records(text: str | Callable[[], Iterable[str]]) -> tuple[str, Iterator[tuple]]:
    """(geojson or json, records) of a document, which is a text or gives its parts each time it is called. Of lists of
    features, cells or rings one at a time is read; their records wait for the end of the document, so what is not
    well-formed gives no record."""
    again = (lambda: [text]) if isinstance(text, str) else text
    if _Cursor(again()).peek() == "[":
        bare = again
        again = lambda: chain(['{"polygons":'], bare(), ["}"])
    members = _members(again())
    kind, keys, lists, single, held = None, [], {}, set(), {}
    for key, value in members or ():
        kind = value if key == "type" else kind
        keys.append(key)
        if isinstance(value, Iterator):
            lists[key], own = None, _Held()
            held[key] = own
            if key == "features":
                for item in value:
                    own.made(_feature, item)
            elif key in ("cells", "nuclei"):
                for item in value:
                    own.made(_cell, item)
                    if own.error is not None and not own.n:
                        raise own.error
            elif key in ("polygons", "regions", "annotations"):
                only = True
                for item in value:
                    only = only and bool(_pair(item))
                    own.made(_polygon, item)
                if only:
                    single.add(key)
        elif isinstance(value, list):
            lists[key] = value
    if members is None or len(set(keys)) < len(keys):
        doc = json.loads("".join(again()))
        collection = isinstance(doc, dict) and doc.get("type") == "FeatureCollection"
        return ("geojson", iter(from_geojson(doc))) if collection else ("json", iter(from_json(doc)))

    def values(name):
        for key, value in _members(again()):
            if key == name:
                yield from value or ()

    if kind == "FeatureCollection":
        return "geojson", iter(held["features"]) if "features" in held else (x for f in values("features") for x in _feature(f))
    name = next((k for k in ("polygons", "regions", "annotations") if k in lists), None)
    if name is not None and (lists[name] is not None or name in single):
        return "json", iter(from_json(list(values(name))))
    name = name or next((k for k in ("cells", "nuclei") if k in held and held[k].n), None)
    return "json", iter(held[name]) if name else iter(())


def _class(props: dict) -> str | None:
    own = props.get("classification")
    if isinstance(own, dict) and isinstance(own.get("name"), str) and own["name"].strip():
        return own["name"].strip()
    return next((v.strip() for k in ("class", "classification", "name") if isinstance(v := props.get(k), str) and v.strip()), None)


def from_geojson(doc: dict, fixed_radius: float | None = None) -> list[tuple]:
    """Points as circles, polygons and the first polygon of multipolygons by their outer rings."""
    out = []
    for f in doc.get("features") or []:
        geometry, props = f.get("geometry") or {}, f.get("properties") or {}
        kind, at = geometry.get("type"), geometry.get("coordinates")
        if kind == "Point" and (q := _pair(at)):
            pts = circle(*q, fixed_radius or radius(props))
        elif kind in ("Polygon", "MultiPolygon") and at:
            pts = _pairs(at[0] if kind == "Polygon" else at[0][0])
        else:
            continue
        if len(pts) >= 3:
            out.append((props.get("id", f.get("id")), _class(props), pts))
    return out


def from_json(doc) -> list[tuple]:
    """Polygons from any of the known layouts: one ring, a list of rings, named lists, cells or nuclei with a ring."""
    if isinstance(doc, list):
        if doc and all(_pair(p) for p in doc):
            rings = [_pairs(doc)]
        else:
            rings = [_pairs(p) for p in doc]
        return [(None, None, p) for p in rings if len(p) >= 3]
    if not isinstance(doc, dict):
        return []
    if doc.get("type") == "FeatureCollection":
        return [x for x in from_geojson({"features": [f for f in doc.get("features") or [] if (f.get("geometry") or {}).get("type") == "Polygon"]})]
    for key in ("polygons", "regions", "annotations"):
        if isinstance(doc.get(key), list):
            return from_json(doc[key])
    for key in ("cells", "nuclei"):
        items = doc.get(key)
        if isinstance(items, list):
            if found := [(None, None, p) for i in items if len(p := _ring(i)) >= 3]:
                return found
    return []


def csv_records(again: Callable[[], Iterable[str]]) -> Iterator[tuple]:
    """Vertex tables by the first group column present, in the order in which the groups begin; tables of centroids as
    circles. All rows are read before the first record. Of a vertex table, whose groups may go on anywhere, numbers of its
    vertices are held; of other tables a row at a time."""
    for _ in csv.reader(_split(again())):
        pass
    table = lambda: ({(k or "").strip().lower(): v for k, v in row.items()} for row in csv.DictReader(_split(again())))
    head = set(next(table(), ()))
    x, y = ("x", "y") if {"x", "y"} <= head else ("coord_x", "coord_y")
    group = next((g for g in GROUPS if g in head), None)
    if not {x, y} <= head or head & {"radius", "r", "diameter", "size", "area", "cx", "centroid_x"}:
        yield from _centroids(table())
        return
    import numpy as np

    names, at, flat = {}, array("q"), array("d")
    for row in table():
        if q := _pair((row[x], row[y])):
            at.append(names.setdefault(row[group] if group else None, len(names)))
            flat.extend(q)
    own, points = np.frombuffer(at, np.int64), np.frombuffer(flat).reshape(-1, 2)
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=len(names)))
    start = 0
    for name, end in zip(names, ends.tolist(), strict=True):
        if end - start >= 3:
            yield name, None, list(map(tuple, points[order[start:end]].tolist()))
        start = end


def from_csv(text: str) -> list[tuple]:
    """``csv_records`` of a whole document."""
    return list(csv_records(lambda: [text]))


def _centroids(rows: Iterable[dict]) -> Iterator[tuple]:
    for row in rows:
        low = {str(k).strip().lower(): v for k, v in row.items()}
        q = next((q for a, b in (("x", "y"), ("centroid_x", "centroid_y"), ("cx", "cy")) if (q := _pair((low.get(a), low.get(b))))), None)
        q = q or _pair([v for v in low.values() if str(v or "").strip()][:2])
        if q:
            yield low.get("id") or low.get("cell_id"), None, circle(*q, radius(low))


def centroids(rows: list[dict]) -> list[tuple]:
    """Circles around x, y (or centroid_x, cx and their like, or else the first two numbers) of each row."""
    return list(_centroids(rows))


class _Tables(HTMLParser):
    """Rows of cells of every table of a page: (table, row) as rows end."""

    def __init__(self):
        super().__init__()
        self.table, self.row, self.ended = 0, None, []
        self.cell: list[str] | None = None

    def end_row(self):
        if self.row:
            self.ended.append((self.table, self.row))
        self.row = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.end_row()
            self.table += 1
        elif tag == "tr" and self.table:
            self.end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if self.row is None:
                raise IndexError("a cell ends in a table without a row")
            self.row.append("".join(self.cell).strip())
            self.cell = None


def _table_rows(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    p = _Tables()
    for text in texts:
        p.feed(text)
        yield from p.ended
        p.ended = []
    p.end_row()
    yield from p.ended


def html_records(again: Callable[[], Iterable[str]]) -> Iterator[tuple]:
    """Centroids of the tables that have x and y columns. The page is gone through first, so one that can't be read gives
    no record; then a row at a time is held."""
    for _ in _table_rows(again()):
        pass
    table, head = 0, None
    for n, row in _table_rows(again()):
        if n != table:
            table, head = n, [h.lower() for h in row]
            if not any({a, b} <= set(head) for a, b in (("x", "y"), ("cx", "cy"), ("centroid_x", "centroid_y"))):
                head = None
        elif head is not None:
            yield from _centroids([dict(zip(head, row, strict=False))])


def from_html(text: str) -> list[tuple]:
    """``html_records`` of a whole document."""
    return list(html_records(lambda: [text]))


def _decoded(stream) -> Iterator[str]:
    """The text of a file from its start, in parts."""
    stream.seek(0)
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while raw := stream.read(CHUNK):
        yield decoder.decode(raw)
    yield decoder.decode(b"", True)


def _split(texts: Iterable[str]) -> Iterator[str]:
    """Lines with their ends, which are line feeds."""
    rest = [""]
    for text in texts:
        *lines, last = text.split("\n")
        if lines:
            yield "".join(rest) + lines[0] + "\n"
            yield from (line + "\n" for line in lines[1:])
            rest = []
        rest.append(last)
    if last := "".join(rest):
        yield last


def records(kind: str, raw) -> tuple[str, Iterator[tuple]]:
    """The format of a whole file (bytes, or a stream that can seek) whose name says ``kind`` (of XML and JSON the document
    decides), and its records (region, class, points), one after another."""
    stream = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    again = lambda: _decoded(stream)
    if kind in ("aperio_xml", "asap_xml"):
        return _xml(stream)
    if kind == "json":
        return json_records(again)
    if kind == "geojson":
        found = json_records(again)
        return "geojson", found[1] if found[0] == "geojson" else iter(from_geojson(json.loads("".join(again()))))
    return kind, csv_records(again) if kind == "csv" else html_records(again) if kind == "html" else iter([])


def parse_one(kind: str, raw: bytes) -> list[tuple]:
    """The records of one file."""
    return list(records(kind, raw)[1])


def spool(most: int = SPOOL):
    """A file for a stream: in memory while it is small, then in the task's scratch folder."""
    return tempfile.SpooledTemporaryFile(most, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def _documents(batches, pieces: bool) -> Iterator[tuple]:
    """(path, format, stream) of files that are rows, or runs of rows of one path."""
    path, kind, held = None, None, None

    def done():
        held.seek(0)
        with held:
            yield path, kind, held

    for batch in batches:
        for p, k, raw in zip(batch.column("path").to_pylist(), batch.column("format").to_pylist(), batch.column("content"), strict=True):
            if not pieces:
                yield p, k, pa.BufferReader(raw.as_buffer()) if raw.is_valid else None
                continue
            if held is None or p != path:
                if held is not None:
                    yield from done()
                path, kind, held = p, k, spool()
            if raw.is_valid:
                held.write(raw.as_buffer())
    if held is not None:
        yield from done()


def by_path(rows: DataFrame) -> DataFrame:
    """Rows of a path in one partition; small partitions are not put together, since a byte of a file costs much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _arranged(contents: DataFrame) -> DataFrame:
    """path, format, content of files, or of pieces as they follow one another."""
    if "part" in contents.columns:
        contents = by_path(contents.select("path", "part", "content")).sortWithinPartitions("path", "part")
    return contents.select("path", detect(F.col("path"), F.lit("")).alias("format"), "content")


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


class _Rows:
    """Rows of SCHEMA as columns, their rings as flat numbers."""

    def __init__(self):
        self.rows, self.ends, self.flat = [], [0], array("d")

    def add(self, path, kind, i, region=None, label=None, points=None, error=None):
        self.rows.append((path, kind, i, region, label, error))
        if points is not None:
            self.flat.extend(chain.from_iterable(points))
        self.ends.append(len(self.flat) // 2)

    def batch(self) -> pa.RecordBatch:
        import numpy as np

        columns = list(zip(*self.rows, strict=True)) or [()] * 6
        xy = np.frombuffer(self.flat).reshape(-1, 2)
        points = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], fields=list(_POINT))
        none = pa.array([e is not None for e in columns[5]], pa.bool_())
        rings = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), points, mask=none) if self.rows else pa.array([], pa.list_(_POINT))
        own = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*own[:5], rings, own[5]], names=["path", "format", "source_index", "region_id", "source_class", "ring", "error"])


def parse(contents: DataFrame) -> DataFrame:
    """SCHEMA rows of files (path, content), or of files in pieces (path, part, content) that follow one another by
    ``part``. Records leave in batches and pieces are put down as they come, so neither a file nor its records are ever all
    held; what is wrong behind some of them is a row after them."""
    pieces = "part" in contents.columns

    def run(batches):
        out = _Rows()
        for path, kind, stream in _documents(batches, pieces):
            try:
                if kind == "unknown":
                    raise ValueError("unsupported annotation format")
                if stream is None:
                    raise TypeError("a file without content")
                kind, found = records(kind, stream)
                for i, (region, label, pts) in enumerate(found):
                    out.add(path, kind, i, None if region is None else str(region), label, pts)
                    if len(out.flat) > 2 * HELD:
                        yield out.batch()
                        out = _Rows()
            except Exception as e:  # a bad file becomes a row of its own
                out.add(path, kind, None, error=f"{type(e).__name__}: {e}"[:300])
        yield out.batch()

    return _arranged(contents).mapInArrow(run, SCHEMA)


def members(contents: DataFrame, name: str, schema: str) -> DataFrame:
    """path, position and the fields of ``schema`` of the objects of list ``name`` of JSON objects (path, content; or in
    pieces, as for ``parse``), one at a time."""
    pieces, fields = "part" in contents.columns, set(StructType.fromDDL(schema).names)

    def run(batches):
        out, size = [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "position", "json"])

        for path, _, stream in _documents(batches, pieces):
            for key, value in _members(_decoded(stream)) or ():
                for i, item in enumerate(value if key == name else ()):
                    out.append((path, i, json.dumps({k: item[k] for k in fields & item.keys()} if isinstance(item, dict) else item)))
                    size += len(out[-1][2])
                    if size > CHUNK:
                        yield made()
                        out, size = [], 0
        yield made()

    return _arranged(contents).mapInArrow(run, "path string, position long, json string").select("path", "position", F.from_json("json", schema).alias("f")).select("path", "position", "f.*")


def slabs(content: DataFrame, dims: int, rows: int = 64) -> DataFrame:
    """(path, slab, values array<float>, error) of raw little-endian single-precision matrices of ``rows`` x ``dims`` in
    files that are values (path, content); a length that is no multiple of a slab gives a row with an error. Files of any
    size are read by ``matrices.SlabSource``."""
    import numpy as np

    def run(parts):
        for part in parts:
            out, size = [], rows * dims * 4
            for path, raw in zip(part["path"], part["content"], strict=True):
                whole = 0 if raw is None else len(raw) // size
                values = np.frombuffer(bytes(raw[: whole * size]), "<f4").reshape(-1, rows * dims) if whole else []
                out += [(path, i, v.tolist(), None) for i, v in enumerate(values)]
                if raw is None or len(raw) % size or not whole:
                    out.append((path, whole, None, f"{0 if raw is None else len(raw)} bytes are no whole number of matrices of {size} bytes"))
            yield pd.DataFrame(out, columns=["path", "slab", "values", "error"], dtype=object)

    return content.select("path", "content").mapInPandas(run, "path string, slab long, values array<float>, error string")


def arrays(content: DataFrame, name: str = "image") -> DataFrame:
    """(path, height, width, channels, values, error) of the array ``name`` (or ``name``s, or the first) of NPZ files; a
    file that has none, or none of two dimensions, gives a row with an error."""
    import numpy as np

    def run(parts):
        for part in parts:
            out = []
            for path, raw in zip(part["path"], part["content"], strict=True):
                try:
                    with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as z:
                        a = np.asarray(z[next((n for n in (name, f"{name}s") if n in z.files), z.files[0])], np.float32)
                    if a.ndim < 2:
                        raise ValueError(f"an array of shape {a.shape} is no image")
                    a = a.reshape(*a.shape[:2], -1)
                    out.append((path, *a.shape, a.ravel().tolist(), None))
                except Exception as e:  # a bad file becomes a row of its own
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "values", "error"], dtype=object)

    return content.select("path", "content").mapInPandas(run, "path string, height int, width int, channels int, values array<float>, error string")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(id, y, x, r, g, b) of the pixels of all PNG, JPEG and BMP files below a folder, by Spark's own image source. Gray
    images have three equal channels; files that are no images are left out."""
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    return pixels(read.withColumnRenamed("origin", "id"))


def pixels(rows: DataFrame) -> DataFrame:
    """(id, y, x, r, g, b) of images (id, height, width, nChannels, data), whose bytes stand in the order b, g, r."""
    at = "conv(hex(substring(data, int(i * nChannels + {c} + 1), 1)), 16, 10)"
    each = rows.withColumn("i", F.explode(F.expr("sequence(0, height * width - 1)"))).where("height > 0 and width > 0")
    channel = lambda c: F.expr(f"int({at.format(c=c)})")
    gray = F.col("nChannels") == 1
    return each.select("id", F.expr("int(i div width)").alias("y"), F.expr("int(i % width)").alias("x"), *[F.when(gray, channel(0)).otherwise(channel(c)).alias(n) for n, c in (("r", 2), ("g", 1), ("b", 0))])
