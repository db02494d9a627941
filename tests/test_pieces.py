"""Files in pieces: what whole files give, with no file and no list of its records in memory."""

import io
import json
import tracemalloc
import xml.etree.ElementTree as ET

import pytest

from cellspark.sources import annotations as a
from cellspark.sources import exports

N = 40
RING = [[0.5, 1.25], [40, 1.25], [-3.0, 12e1], [7, 8]]
FEATURE = {"type": "Feature", "properties": {"classification": {"name": "Türkis"}}, "geometry": {"type": "Polygon", "coordinates": [RING]}}
TEXTS = {
    "a.xml": "<All>" + "".join(f'<Region Id="{i}é">' + "".join(f'<Vertex X="{x}" Y="{y}"/>' for x, y in RING) + "</Region>" for i in range(N)) + "</All>",
    "a.geojson": json.dumps({"type": "FeatureCollection", "features": [FEATURE] * N}, ensure_ascii=False),
    "nuclei.json": json.dumps({"n": 123, "nuclei": [{"boundary": RING}] * N + [{"mask": 1}, 7], "cells": [[[1, 2]]]}),
    "polygons.json": json.dumps({"polygons": [RING] * N + [None]}), "one.json": json.dumps({"regions": RING}), "bare.json": json.dumps([RING] * N), "onebare.json": json.dumps(RING),
    "vertices.csv": "polygon_id,x,y\n" + "".join(f'"p\n{i % 13}",{x},{y}\n' for i in range(N) for x, y in RING) + "last,1,bad\n",
    "centroids.csv": "id,cx,cy,area\r\n" + "".join(f"ä{i},{i}.5,{-i},{i}\r\n" for i in range(N)),
    "a.html": "<table><tr><th>x</th><th>y</th></tr>" + "<tr><td>1&amp;</td><td>4</td></tr><tr><td>2.5</td><td>é</td></tr><tr><td>3</td><td>4</td></tr>" * N + "</table><table><tr><td>1</td><td>2</td></tr></table>",
    "broken.xml": "<All>" + '<Region><Vertex X="1" Y="2"/></Region>' * N, "broken.json": '{"nuclei": [' + json.dumps({"boundary": RING}) + ",]}",
    "late.html": "<table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td><table></td></table>",
}


def plain(rows):
    return sorted((r.path, -1 if r.source_index is None else r.source_index, r.format, str(r.region_id), str(r.source_class), str(r.ring), str(r.error)[:12]) for r in rows)


def test_pieces_are_the_file(spark):
    whole = spark.createDataFrame([(p, t.encode()) for p, t in TEXTS.items()], "path string, content binary")
    cuts = [(p, i, t.encode()[i : i + 7]) for p, t in TEXTS.items() for i in range(0, len(t.encode()), 7)]
    pieces = spark.createDataFrame(cuts[::-1], "path string, part long, content binary")
    want, got = plain(a.parse(whole).collect()), plain(a.parse(pieces).collect())
    assert got == want
    found = {p: sum(r[0] == p and r[1] >= 0 for r in want) for p in TEXTS}
    assert found == {"a.xml": N, "a.geojson": N, "nuclei.json": N, "polygons.json": N, "one.json": 1, "bare.json": N, "onebare.json": 1, "vertices.csv": 13, "centroids.csv": N, "a.html": N, "broken.xml": 0, "broken.json": 0, "late.html": 0}


@pytest.mark.parametrize("path", TEXTS)
def test_any_chunk_gives_the_same(path, monkeypatch):
    def run():
        kind = {"xml": "aperio_xml"}.get(path.rpartition(".")[2], path.rpartition(".")[2])
        try:
            return a.parse_one(kind, TEXTS[path].encode())
        except Exception as e:
            return type(e)

    want = run()
    for size in (4, 5, 13, 64):
        monkeypatch.setattr(a, "CHUNK", size)
        assert run() == want


class Made(io.RawIOBase):
    """A file made while it is read, from the start each time."""

    def __init__(self, head, item, n, tail):
        self.parts, self.size = (head, item, n, tail), 0
        self.seek(0)

    def seek(self, at):
        head, item, n, tail = self.parts
        self.it = iter([head, *[item * 100] * (n // 100), tail])

    def read(self, n=-1):
        out = next(self.it, b"")
        self.size += len(out)
        return out


@pytest.mark.parametrize(("kind", "head", "item", "tail"), [
    ("csv", b"id,cx,cy,radius\n", b"7,1.5,2.5,7\n", b""), ("html", b"<table><tr><th>x</th><th>y</th></tr>", b"<tr><td>1.5</td><td>2.5</td></tr>", b"</table>"),
    ("json", b'{"nuclei":[{"boundary":[[0,0],[1,0],[1,1]]}', b',{"boundary":[[0.5,1.5],[4.5,1.5],[3.5,9.5]]}', b"]}"),
    ("geojson", b'{"type":"FeatureCollection","features":[' + json.dumps(FEATURE).encode(), b"," + json.dumps(FEATURE).encode(), b"]}"),
])
def test_memory_is_that_of_a_record(kind, head, item, tail):
    made = Made(head, item, 20_000, tail)
    tracemalloc.start()
    n = sum(1 for _ in a.records(kind, made)[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 20_000 and peak < 1_500_000


def test_labels_in_pieces(spark):
    xml = '<a:R xmlns:a="u:1" xmlns="u:2" k="&lt;&quot;&#10;é"><!-- gone --><Annotation/>t&amp;<Region a:b="1" Id="3"><Vertex X="1" Y="2"/> </Region>\n<Region>é</Region></a:R>'
    root = ET.fromstring(xml)
    rows = [{"clinical": "A", "confidence": 0.25, "cell_id": 9}, {"clinical": 'B"&', "confidence": 0.5, "cell_id": 4}]
    for e, r in zip(root.iter("{u:2}Region"), rows, strict=True):
        for k, v in (("Classification", r["clinical"]), ("Confidence", f"{r['confidence']:.4f}"), ("CellId", str(r["cell_id"]))):
            e.set(k, v)
    assert exports.annotate_xml(xml.encode(), rows) == ET.tostring(root)

    geo = {"k": [1], "features": [FEATURE | {"properties": None}, {"geometry": None}, FEATURE], "type": "FeatureCollection"}
    labels = spark.createDataFrame([(p, i, r["clinical"], r["confidence"], r["cell_id"]) for p in ("x", "g", "none") for i, r in enumerate(rows)], "path string, position long, clinical string, confidence double, cell_id long")
    for path, text, label, want in (("x", xml, exports.labelled_xml, ET.tostring(root).decode()), ("g", json.dumps(geo), exports.labelled_geojson, exports.annotate_geojson(json.dumps(geo), rows))):
        raw = text.encode()
        whole = spark.createDataFrame([(path, raw), ("other", raw)], "path string, content binary")
        pieces = spark.createDataFrame([(path, i, raw[i : i + 5]) for i in range(0, len(raw), 5)], "path string, part long, content binary")
        assert [(r.path, bytes(r.content).decode()) for r in label(whole, labels).collect()] == [(path, want)]
        assert b"".join(bytes(r.content) for r in sorted(label(pieces, labels).collect(), key=lambda r: r.part)).decode() == want
    assert [f["properties"] and f["properties"].get("CellId") for f in json.loads(want)["features"] if f["geometry"]] == [9, 4]
    got = a.members(spark.createDataFrame([("g", want.encode())], "path string, content binary"), "features", "properties struct<CellId: bigint>")
    assert sorted((r.position, r.properties and r.properties.CellId) for r in got.collect()) == [(0, 9), (1, None), (2, 4)]


def test_items_become_documents_in_pieces(spark):
    items = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("s", 1, "a"), ("t", 1, None)], "slide_id string, cell_id long, t string")
    from pyspark.sql import functions as F

    rows = exports.pieces(items, F.col("slide_id"), "cell_id", F.col("t"), "[", "]", ",").collect()
    text = {p: b"".join(bytes(r.content) for r in sorted(rows, key=lambda r: r.part) if r.path == p) for p in "st"}
    assert text == {"s": b"[a,a,b]", "t": b"[]"}
