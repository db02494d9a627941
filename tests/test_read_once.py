"""Documents are read once: what their end decides waits for it, and is what reading them twice gave."""

import io
import json
import math

import numpy as np
import pyarrow as pa
import pytest

from cellspark.sources import annotations as a
from cellspark.sources import exports

RING = [[0.5, 1.25], [40.0, 1.25], [-3.0, 120.0], [7.0, 8.5]]
FEATURE = {"type": "Feature", "id": 3, "properties": {"classification": {"name": "Türkis"}}, "geometry": {"type": "Polygon", "coordinates": [RING]}}
N = 3000


class Counted(io.BytesIO):
    size = 0

    def read(self, n=-1):
        out = super().read(n)
        self.size += len(out)
        return out


XML = "<All>" + "".join(f'<Region Id="{i}">' + "".join(f'<Vertex X="{x}" Y="{y}"/>' for x, y in RING) + "</Region>" for i in range(N)) + "</All>"


@pytest.mark.parametrize(("kind", "text", "n"), [
    ("aperio_xml", XML, N), ("geojson", json.dumps({"type": "FeatureCollection", "features": [FEATURE] * N}), N), ("json", json.dumps({"features": [FEATURE] * N, "type": "FeatureCollection"}), N),
    ("json", json.dumps({"nuclei": [{"boundary": RING}] * N + [7]}), N), ("json", json.dumps({"cells": [[1]], "nuclei": [RING]}), 1), ("json", json.dumps({"polygons": [RING] * N + [None]}), N),
])
def test_documents_are_read_once(kind, text, n):
    stream = Counted(text.encode())
    found = list(a.records(kind, stream)[1])
    assert len(found) == n and all(p == list(map(tuple, RING)) for _, _, p in found)
    assert stream.size <= len(text.encode()) + a.CHUNK  # the first part is looked at for its kind


def test_labels_are_set_in_one_reading():
    text = json.dumps({"type": "FeatureCollection", "features": [FEATURE] * N})
    rows = [{"clinical": f"c{i % 3}", "confidence": i / N, "cell_id": i} for i in range(N)]
    stream = Counted(text.encode())
    got = json.loads(b"".join(exports.geojson_labelled(stream, N, rows)))
    assert stream.size <= len(text.encode())
    assert [(f["geometry"], f["properties"]["Classification"], f["properties"]["Confidence"], f["properties"]["CellId"]) for f in got["features"]] == [(FEATURE["geometry"], r["clinical"], r["confidence"], r["cell_id"]) for r in rows]
    for n in (N - 1, N + 1):
        with pytest.raises(ValueError, match=f"{N} features, {n} predictions"):
            b"".join(exports.geojson_labelled(io.BytesIO(text.encode()), n, (rows * 2)[:n]))


def test_labels_of_a_document_with_a_key_twice():
    rows = [{"clinical": "x", "confidence": 0.5, "cell_id": 1}, {"clinical": "y", "confidence": 0.25, "cell_id": 2}]
    one = json.dumps(FEATURE)
    got = json.loads(exports.annotate_geojson(f'{{"features": [{one}, {one}, {one}], "a": "é", "features": [{one}, {one}]}}', rows))
    assert list(got) == ["features", "a"] and [f["properties"]["CellId"] for f in got["features"]] == [1, 2]
    with pytest.raises(ValueError, match="0 features, 1 predictions"):
        exports.annotate_geojson("{}", rows[:1])


def test_what_is_wrong_comes_after_the_records_before_it():
    for doc in ({"type": "FeatureCollection", "features": [FEATURE] * 300 + [{"geometry": 7}, FEATURE]}, {"features": [FEATURE] * 300 + [[1]] + [FEATURE], "type": "FeatureCollection"}):
        n = 0
        with pytest.raises(AttributeError):
            for _ in a.json_records(json.dumps(doc))[1]:
                n += 1
        assert n == 300
    with pytest.raises(OverflowError):
        a.json_records(f'{{"cells": [[[1, {10**400}], [1, 2], [2, 3]], {RING}]}}')


def test_pairs_of_any_kind():
    odd = [[1.0, 2.0], [1, 2], ["3", "4.5"], [1.0, 2.0, 3.0], [1.0], [math.nan, 1.0], [1.0, math.inf], {"x": 1, "Y": "2"}, None, [True, False], "12", [[], 1.0]]
    for points in [RING, odd, [], odd[:1], odd[5:7], [*RING, [1.0, math.nan]], [*RING, [1.0, 2]], None, {}]:
        assert a._pairs(points) == [q for p in points or () if (q := a._pair(p))] and all(type(v) is float for q in a._pairs(points) for v in q)


def test_six_digits_of_rings_of_any_length():
    draw = np.random.default_rng(1)
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    rings = [None if i % 7 == 3 else [{"x": float(x), "y": float(y)} for x, y in draw.normal(size=(i % 5, 2))] for i in range(2500)]
    rings[2100] = [None, {"x": None, "y": 1.0}, {"x": math.nan, "y": -math.inf}]
    want = [None if r is None else "".join("null,null;" if p is None else f"{'null' if p['x'] is None else '%.6f' % p['x']},{p['y']:.6f};" for p in r) for r in rings]
    assert exports.six_digits.func(pa.array(rings, kind)).to_pylist() == want
    assert exports.six_digits.func(pa.array(rings, kind).slice(3, 1500)).to_pylist() == want[3:1503]
