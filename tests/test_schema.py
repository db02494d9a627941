"""Each keyword has documents that break it alone."""

import json

import pytest

from cellspark.sources import schema as s

SCHEMA = {
    "$schema": "x", "type": "object", "required": ["n", "kind"], "additionalProperties": False, "maxProperties": 6,
    "properties": {
        "n": {"type": "integer", "minimum": 1, "maximum": 9, "multipleOf": 2}, "kind": {"type": "string", "enum": ["a", "bb", "ccc", "dd1"], "minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"},
        "x": {"type": ["number", "null"], "exclusiveMinimum": 0, "exclusiveMaximum": 1}, "v": {"const": "2.0"}, "flag": {"const": True}, "o": {"type": "object", "minProperties": 1},
        "rings": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "array", "minItems": 2, "items": {"type": "number", "minimum": 0}}},
    },
}
GOOD = {"n": 4, "kind": "bb"}

CASES = [
    ({}, []), ({"n": 4.0}, []), ({"x": None}, []), ({"x": 0.5, "v": "2.0", "flag": True}, []), ({"rings": [[1, 2.5], [3, 4, 5]]}, []),
    ({"n": "4"}, [("$.n", "type")]), ({"n": 4.5}, [("$.n", "type"), ("$.n", "multipleOf")]), ({"n": 0}, [("$.n", "minimum")]), ({"n": 10}, [("$.n", "maximum")]), ({"n": 3}, [("$.n", "multipleOf")]),
    ({"kind": "zz"}, [("$.kind", "enum")]), ({"kind": "a"}, [("$.kind", "minLength")]), ({"kind": "dddd"}, [("$.kind", "enum"), ("$.kind", "maxLength")]), ({"kind": "dd1"}, [("$.kind", "pattern")]), ({"kind": 7}, [("$.kind", "type"), ("$.kind", "enum")]),
    ({"x": 0}, [("$.x", "exclusiveMinimum")]), ({"x": 1}, [("$.x", "exclusiveMaximum")]), ({"x": "s"}, [("$.x", "type")]), ({"x": [1]}, [("$.x", "type")]),
    ({"v": 2.0}, [("$.v", "const")]), ({"flag": 1}, [("$.flag", "const")]), ({"o": {}}, [("$.o", "minProperties")]), ({"o": []}, [("$.o", "type")]), ({"zzz": 1}, [("$", "additionalProperties")]),
    ({"rings": []}, [("$.rings", "minItems")]), ({"rings": [[1, 2], [1, 3], [1, 4]]}, [("$.rings", "maxItems")]), ({"rings": [[1, 2], [1, 2]]}, [("$.rings", "uniqueItems")]),
    ({"rings": [[1, 2], [1]]}, [("$.rings[1]", "minItems")]), ({"rings": [[1, 2], 5]}, [("$.rings[1]", "type")]), ({"rings": [[1, "2"]]}, [("$.rings[0][1]", "type")]), ({"rings": [[5, 2], [1, 3, -1]]}, [("$.rings[1][2]", "minimum")]),
    ({"x": 0.5, "v": "2.0", "flag": True, "o": {"a": 1}, "rings": [[1, 2]]}, [("$", "maxProperties")]),
]


def broken(spark, docs, schema, **more):
    df = spark.createDataFrame(list(enumerate(docs)), "id long, json string")
    out = {i: [] for i in range(len(docs))}
    for r in s.failures(df, schema, **more).collect():
        out[r["id"]].append((r["path"], r["keyword"]))
    return [sorted(out[i]) for i in range(len(docs))]


def test_each_keyword(spark):
    got = broken(spark, [json.dumps({**GOOD, **change}) for change, _ in CASES], SCHEMA)
    assert got == [sorted(want) for _, want in CASES]


def test_roots(spark):
    got = broken(spark, ["[1]", "{", None, '{"n": 2}', "7"], SCHEMA)
    assert got == [[("$", "type")], [("$", "json")], [("$", "json")], [("$", "required")], [("$", "type")]]


def test_unknown_keywords_are_errors():
    for bad in ({"anyOf": []}, {"properties": {"a": {"$ref": "#/b"}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            list(s.rules(bad))


def test_rules_are_a_table():
    found = [(r.path, r.keyword, r.argument) for r in s.rules(SCHEMA)]
    assert ("$.rings[*][*]", "minimum", 0) in found and ("$", "required", "kind") in found and len(found) == len({(p, k, str(a)) for p, k, a in found})


def test_gold_segments(spark):
    ring = [[0.5, 1]] * 32
    docs = [{"cells": [ring], "cell_count": 1}, {"cells": [ring], "cell_count": 2}, {"cells": [ring, ring[1:]], "cell_count": 2}, {"cells": [], "cell_count": 0}, {"cells": [ring]}, {"cells": 5, "cell_count": 1}]
    schema, also = s.gold_segments()
    got = broken(spark, list(map(json.dumps, docs)), schema, also=also)
    assert got == [[], [("$", "cell_count")], [("$.cells[1]", "minItems")], [("$.cells", "minItems")], [("$", "required")], [("$.cells", "type")]]
