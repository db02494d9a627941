"""Raw matrices by ranges of bytes, and as values."""

import numpy as np
import pytest

from cellspark.sources import annotations, matrices


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    data = {"a.raw": rng.normal(size=(1000, 8, 3)).astype("<f4"), "sub/b.raw": rng.normal(size=(3, 8, 3)).astype("<f4")}
    (tmp_path / "sub").mkdir()
    for name, m in data.items():
        (tmp_path / name).write_bytes(m.tobytes())
    (tmp_path / "c.raw").write_bytes(data["a.raw"].tobytes()[: 96 * 5 + 7])
    (tmp_path / "d.raw").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    return tmp_path, data


def read(spark, path, **options):
    matrices.register(spark)
    return spark.read.format("slabs").options(dims=3, rows=8, **options).load(str(path))


@pytest.mark.parametrize("split", [1, 5000, 1 << 30])
def test_ranges_give_the_rows_of_whole_files(spark, folder, split):
    at, data = folder
    df = read(spark, at, splitBytes=split)
    got = {(r["path"].removeprefix(f"{at}/"), r["slab"]): r for r in df.collect()}
    assert {k for k, r in got.items() if r["error"]} == {("c.raw", 5), ("d.raw", 0)} and all(got[k]["values"] is None for k in (("c.raw", 5), ("d.raw", 0)))
    assert len(got) == 1000 + 3 + 6 + 1
    for name, m in data.items():
        assert all(np.array_equal(got[name, i]["values"], m[i].ravel()) for i in range(len(m)))
    whole = annotations.slabs(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(at)).where("path LIKE '%.raw'"), 3, 8)
    assert sorted((r["path"].rsplit("/", 1)[1], r["slab"], r["values"], r["error"]) for r in whole.collect()) == sorted((k[0].rsplit("/", 1)[-1], k[1], r["values"], r["error"]) for k, r in got.items() if k[0] != "d.raw")  # which that source leaves out
    if split == 5000:
        assert df.rdd.getNumPartitions() == 20 + 1 + 1 + 2  # 52 matrices to a range


def test_one_file_and_no_file(spark, folder):
    at, data = folder
    assert read(spark, at / "sub/b.raw").count() == 3
    with pytest.raises(Exception, match="does not exist"):
        read(spark, at / "none").count()
    (at / "empty").mkdir()
    assert read(spark, at / "empty").count() == 0


def test_broken_archives_are_rows(spark, tmp_path):
    np.savez(tmp_path / "a.npz", image=np.arange(6.0).reshape(2, 3))
    (tmp_path / "b.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "c.npz", flat=np.zeros(3))
    got = {r["path"][-5:]: r for r in annotations.arrays(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.npz"]["values"] == [0, 1, 2, 3, 4, 5] and got["a.npz"]["channels"] == 1 and got["a.npz"]["error"] is None
    assert got["b.npz"]["error"] and got["c.npz"]["error"]
