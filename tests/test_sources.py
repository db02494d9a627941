"""Parsers, exports and streams."""

import io
import json
import os
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.sources import annotations, exports
from cellspark.streaming import service


def parsed(spark, *files):
    return annotations.parse(spark.createDataFrame([(n, bytearray(t.encode())) for n, t in files], "path string, content binary")).collect()


def test_bad_files_become_rows(spark):
    rows = parsed(spark, ("a.xml", "<A><Region>"), ("b.json", "{"), ("c.tif", "x"), ("d.csv", ""))
    assert sorted(r["path"] for r in rows) == ["a.xml", "b.json", "c.tif"] and all(r["error"] and r["ring"] is None for r in rows)


def test_json_layouts():
    tri = [[0, 0], [1, 0], [0, 1]]
    assert len(annotations.from_json(tri)) == 1
    assert len(annotations.from_json([tri, tri, [[0, 0]]])) == 2
    assert len(annotations.from_json({"regions": [tri]})) == 1
    assert len(annotations.from_json({"nuclei": [{"boundary": tri}, {"other": 1}]})) == 1
    assert annotations.from_json({"cells": []}) == [] == annotations.from_json("text")


def test_geojson_points_and_classes():
    doc = {"features": [{"id": "p", "geometry": {"type": "Point", "coordinates": [5, 5]}, "properties": {"area": 3.14159, "class": " A "}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1]]]]}, "properties": {"classification": {"name": "B"}}}, {"geometry": None}]}
    got = annotations.from_geojson(doc)
    assert [(g[0], g[1], len(g[2])) for g in got] == [("p", "A", 128), (None, "B", 3)]
    assert got[0][2][0][0] == pytest.approx(6, abs=1e-3)
    assert annotations.from_geojson(doc, 4.0)[0][2][0][0] == 9


def test_radius():
    assert [annotations.radius(r) for r in ({"R": 2}, {"size": 6}, {"radius": -1, "area": np.pi}, {}, {"r": "x"})] == [2, 3, 1, 4, 4]


def test_slabs(spark):
    data = np.arange(64 * 2 * 2, dtype="<f4")
    df = spark.createDataFrame([("a", bytearray(data.tobytes()))], "path string, content binary")
    rows = annotations.slabs(df, 2).orderBy("slab").collect()
    assert [len(r["values"]) for r in rows] == [128, 128] and rows[1]["values"][0] == 128
    bad = annotations.slabs(spark.createDataFrame([("a", bytearray(b"1234")), ("b", None)], df.schema), 2).collect()
    assert [(r["slab"], r["values"]) for r in bad] == [(0, None)] * 2 and all("no whole number" in r["error"] for r in bad)


def test_segment_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.JSON").write_text(json.dumps({"cell_count": 1, "cells": [[[0, 0], [1, 0], [0, 1]]], "extra": 1}))
    (tmp_path / "note.txt").write_text("no")
    assert annotations.segments(spark, str(tmp_path)).count() == 1
    bad = spark.createDataFrame([("s", '{"cell_count": 2, "cells": [[[0, 0]]]}')], "slide_id string, json string")
    with pytest.raises(Exception, match="does not match"):
        annotations.segment_cells(bad).collect()


def test_manifest_and_bundle(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<A><Region Id="1"><Vertex X="0" Y="0"/><Vertex X="3" Y="0"/><Vertex X="0" Y="3"/></Region></A>')
    files = annotations.files(spark, str(tmp_path), "*.xml")
    row = exports.manifest(annotations.parse(files), files).first()
    assert (row["record_count"], row["region_id"], row["centroid_x"]) == (1, "1", 1) and len(row["source_sha256"]) == 64
    zips = exports.bundles(spark.createDataFrame([("b", "x", bytearray(b"1")), ("b", "y/z", bytearray(b""))], "bundle string, name string, content binary"))
    assert sorted(zipfile.ZipFile(io.BytesIO(bytes(zips.first()["content"]))).namelist()) == ["manifest.json", "x", "y/z"]
    assert [r["intact"] for r in exports.unbundled(zips).collect()] == [True, True]
    out = exports.annotate_xml((tmp_path / "a.xml").read_bytes(), [{"clinical": "Normal", "confidence": 0.5, "cell_id": 0}])
    assert b'Confidence="0.5000"' in out
    with pytest.raises(ValueError):
        exports.annotate_xml((tmp_path / "a.xml").read_bytes(), [])


def test_file_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y,radius\n1,2,3\n4,5,6\n")
    q = service.arriving_files(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM arrived").count() == 2


def test_limiter_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, f"2024-01-01 00:00:{i:02d}") for i in range(20)], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = service.limiter(stream, 60, 4).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["event_id"]: r["allowed"] for r in spark.sql("SELECT * FROM limited").collect()}
    assert got == {i: i < 8 for i in range(20)}


def test_arrays(spark):
    b = io.BytesIO()
    np.savez(b, images=np.ones((2, 3, 3)))
    row = annotations.arrays(spark.createDataFrame([("a", bytearray(b.getvalue()))], "path string, content binary")).first()
    assert (row["height"], row["width"], row["channels"], len(row["values"])) == (2, 3, 3, 18)


def test_geojson_export_keeps_coordinates():
    text = json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"k": 1}}, {"geometry": None}, {"geometry": {"type": "Point", "coordinates": [3, 4]}, "properties": 5}]})
    rows = [{"clinical": "Immune", "confidence": 0.5, "cell_id": 0}, {"clinical": "Normal", "confidence": 1.0, "cell_id": 7}]
    doc = json.loads(exports.annotate_geojson(text, rows))
    assert doc["features"][0]["properties"] == {"k": 1, "Classification": "Immune", "Confidence": 0.5, "CellId": 0}
    assert doc["features"][0]["geometry"]["coordinates"] == [1, 2] and doc["features"][1] == {"geometry": None} and doc["features"][2]["properties"]["CellId"] == 7
    with pytest.raises(ValueError):
        exports.annotate_geojson(text, rows[:1])


def test_images(spark, tmp_path):
    """PNG files through Spark's image source: colour and gray."""
    import struct
    import zlib

    def png(rows, channels):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, 2 if channels == 3 else 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png([[255, 0, 1, 2, 3, 4], [5, 6, 7, 8, 9, 250]], 3))
    (tmp_path / "b.png").write_bytes(png([[9, 200]], 1))
    (tmp_path / "c.txt").write_text("no image")
    got = sorted((r["id"][-5:], r["y"], r["x"], r["r"], r["g"], r["b"]) for r in annotations.images(spark, str(tmp_path)).collect())
    assert got == [("a.png", 0, 0, 255, 0, 1), ("a.png", 0, 1, 2, 3, 4), ("a.png", 1, 0, 5, 6, 7), ("a.png", 1, 1, 8, 9, 250), ("b.png", 0, 0, 9, 9, 9), ("b.png", 0, 1, 200, 200, 200)]


def test_cache_and_callback(spark, tmp_path):
    from cellspark.operators import checkpoints

    rows = checkpoints.cut(spark.range(5).repartition(2))
    path = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert rows.count() == 5 and os.path.isdir(path) and checkpoints.clear(spark) >= 1 and not os.path.exists(path)
    kept = checkpoints.cut(spark.range(3))
    with pytest.raises(ValueError), checkpoints.scratch(spark):
        gone = checkpoints.cut(spark.range(4)).inputFiles()[0]
        raise ValueError
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file://"))
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [checkpoints.cached(spark, "t", key, make).count() for key in ("a", "a", "b")] == [3, 3, 3] and len(made) == 2
    told = []
    listener = service.Callback(lambda *a: told.append(a[1:]))
    failing = service.Callback(lambda *a: 1 / 0)
    spark.streams.addListener(listener)
    spark.streams.addListener(failing)
    spark.range(4).write.parquet(str(tmp_path / "in"))
    rows = service.run_to_end(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), tag="t1")
    assert rows.count() == 4 and service.cancel(spark, "t1") == []
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    assert service.run_to_end(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out")).count() == 6
    for _ in range(100):
        if ("done", None) in told and len(failing.failures) > 3:
            break
        time.sleep(0.1)
    for x in (listener, failing):
        spark.streams.removeListener(x)
    assert ("started", None) in told and ("progress", 4) in told and ("done", None) in told and failing.failures


def test_patch_models_must_keep_their_contract(spark):
    from cellspark.operators import patches

    pixels = spark.createDataFrame([("i", y, x, 255, 51, 0) for y in range(6) for x in range(8)], "id string, y int, x int, r int, g int, b int")
    cells = spark.createDataFrame([("i", 1, 3.9, 2.2), ("i", 2, 0.0, 0.0), ("i", 3, 900.0, 5.0)], "id string, cell_id long, centroid_x double, centroid_y double")
    rows = {r["cell_id"]: np.array(r["patch"]).reshape(3, 4, 4) for r in patches.patches(pixels, cells, 4).collect()}
    assert (rows[1][0] == 1).all() and np.allclose(rows[1][1], 0.2) and not rows[3].any()
    assert rows[2][0].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]]
    good = patches.visual_features(patches.patches(pixels, cells, 4), lambda: lambda b: b.mean((2, 3)), 4, 3).collect()
    assert {r["cell_id"]: round(r["features"][0], 3) for r in good} == {1: 1.0, 2: 0.25, 3: 0.0}
    with pytest.raises(Exception, match="must return"):
        patches.visual_features(patches.patches(pixels, cells, 4), lambda: lambda b: b.mean((2, 3)), 4).collect()


def test_formats_are_those_of_whole_files(spark):
    """A top-level type, a Region and a Vertex count wherever they stand; a nested type or a comment does not."""
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    features = [{"geometry": {"coordinates": at, "type": kind}, "properties": {"note": "x" * 60_000}, "type": "Feature"} for kind, at in (("Polygon", [square]), ("Point", [5, 5]), ("MultiPolygon", [[square]]))]
    late = json.dumps({"features": features, "type": "FeatureCollection"})
    nested = json.dumps({"meta": {"type": "FeatureCollection"}, "polygons": [square]})
    corners = lambda tag: "".join(f'<{tag} X="{x}" Y="{y}"/>' for x, y in square)
    aperio = f'<A><!--{"x" * 110_000}--><Annotation><Coordinate X="0" Y="0"/></Annotation><Region Id="7"><Vertices>{corners("Vertex")}</Vertices></Region></A>'.replace("<!--", "<Coordinate/><!--", 1)
    asap = f'<A><!-- <Region> --><Annotation Name="n"><Coordinates>{corners("Coordinate")}</Coordinates></Annotation></A>'
    rows = parsed(spark, ("late.json", late), ("nested.json", nested), ("late.xml", aperio), ("comment.xml", asap))
    assert [(r["path"], r["format"], r["source_index"]) for r in rows if r["path"] == "late.json"] == [("late.json", "geojson", i) for i in range(3)]
    assert {r["path"]: r["format"] for r in rows} == {"late.json": "geojson", "nested.json": "json", "late.xml": "aperio_xml", "comment.xml": "asap_xml"}
    assert not any(r["error"] for r in rows)
