"""Record iterators give what whole documents give, and hold little."""

import io
import json
import random
import tracemalloc
import xml.etree.ElementTree as ET

import pytest

from cellspark.sources import annotations as a


def whole_xml(raw):
    """The definition, over a parsed document."""
    out = []
    for e in ET.fromstring(raw).iter():
        if e.tag == "Region" or e.tag == "Annotation" and not any(c.tag == "Region" for c in e.iter()):
            pts = [(float(c.get("X")), float(c.get("Y"))) for c in e.iter() if c.tag in ("Vertex", "Coordinate")]
            if len(pts) >= 3:
                out.append((e.get("Id"), None, pts))
    return out


def document(draw, depth=0):
    tag = draw.choice(["Region", "Annotation", "Annotation", "Vertices", "Vertex", "Coordinate", "Vertex", "Coordinate", "Text"])
    own = "".join(document(draw, depth + 1) for _ in range(draw.randrange(6))) if depth < 5 else ""
    return f'<{tag} Id="{draw.randrange(99)}" X="{draw.randrange(9)}" Y="{draw.random():.3f}">{own}</{tag}>'


@pytest.mark.parametrize("seed", range(150))
def test_xml_records_are_those_of_the_document(seed):
    draw = random.Random(seed)
    raw = f"<All>{''.join(document(draw) for _ in range(12))}</All>".encode()
    assert list(a.xml_records(io.BytesIO(raw))) == whole_xml(raw)


def value(draw, depth=0):
    kind = draw.randrange(8 if depth < 4 else 5)
    if kind < 5:
        return [None, True, draw.random(), draw.randrange(99), 'a "b" \\ ] } é'][kind]
    if kind == 5:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    if kind == 6:
        return [{"k": value(draw, depth + 1)} for _ in range(draw.randrange(4))]
    return {f"k{i}": value(draw, depth + 1) for i in range(draw.randrange(4))}


@pytest.mark.parametrize("seed", range(60))
def test_members_are_those_of_the_document(seed):
    draw = random.Random(seed)
    doc = {f"key{i}": value(draw) for i in range(draw.randrange(6))}
    for indent in (None, 2):
        text = " " + json.dumps(doc, indent=indent, ensure_ascii=bool(seed % 2)) + "\n"
        got = {k: list(v) if hasattr(v, "__next__") else v for k, v in a._members(text)}
        assert got == doc and [k for k, _ in a._members(text)] == list(doc)
        for at in sorted({1, len(text) // 3, len(text) // 2, len(text) - 3}):
            broken = text[:at] + text[at + 1 :]
            try:
                want = json.loads(broken)
            except json.JSONDecodeError:
                with pytest.raises(json.JSONDecodeError):
                    for _ in a._members(broken) or json.loads(broken):
                        pass
            else:
                assert {k: list(v) if hasattr(v, "__next__") else v for k, v in a._members(broken)} == want


FEATURE = {"type": "Feature", "id": 3, "properties": {"classification": {"name": "Tumor"}}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4]]]}}


@pytest.mark.parametrize("doc", [
    {"type": "FeatureCollection", "features": [FEATURE, FEATURE]}, {"features": [FEATURE], "type": "FeatureCollection"}, {"features": [], "type": "FeatureCollection"}, {"type": "FeatureCollection"},
    {"type": "FeatureCollection", "features": None}, {"features": [FEATURE]}, {"cells": [[[0, 0], [1, 0], [1, 1]]]}, [[[0, 0], [1, 0], [1, 1]]], {"nuclei": [{"ring": [[0, 0], [1, 0], [1, 1]]}], "type": "x"},
])
def test_json_records_are_those_of_the_document(doc):
    collection = isinstance(doc, dict) and doc.get("type") == "FeatureCollection"
    kind, found = a.json_records(json.dumps(doc))
    assert (kind, list(found)) == (("geojson", a.from_geojson(doc)) if collection else ("json", a.from_json(doc)))


class Made(io.RawIOBase):
    """A document that is made as it is read."""

    def __init__(self, parts):
        self.parts, self.left, self.size = parts, b"", 0

    def read(self, n=-1):
        while len(self.left) < n:
            part = next(self.parts, None)
            if part is None:
                break
            self.left += part
        out, self.left = self.left[:n], self.left[n:]
        self.size += len(out)
        return out


def test_memory_is_that_of_a_region():
    region = b'<Region Id="7"><Vertices>' + b'<Vertex X="1.5" Y="2.5"/>' * 500 + b"</Vertices></Region>"
    made = Made(iter([b"<Annotations><Annotation><Regions>", *[region] * 2000, b"</Regions></Annotation></Annotations>"]))
    tracemalloc.start()
    n = sum(len(pts) for _, _, pts in a.xml_records(made))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_000 and made.size > 25_000_000 and peak < 3_000_000


def test_files_leave_in_batches(spark, monkeypatch):
    monkeypatch.setattr(a, "HELD", 10)
    good = b"<A>" + b'<Region Id="1"><Vertex X="0" Y="0"/><Vertex X="1" Y="0"/><Vertex X="1" Y="1"/></Region>' * 50 + b"</A>"
    df = spark.createDataFrame([("a.xml", bytearray(good)), ("b.xml", bytearray(good[:-1])), ("c.xml", bytearray(good))], "path string, content binary").coalesce(1)
    rows = a.parse(df).collect()
    assert [(r["path"], r["source_index"]) for r in rows if r["error"] is None] == [(p, i) for p in ("a.xml", "c.xml") for i in range(50)]
    assert [(r["path"], r["ring"]) for r in rows if r["error"]] == [("b.xml", None)]
