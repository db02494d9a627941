"""A data source of raw matrices of any size, read by ranges of bytes.

``register(spark)``, then ``spark.read.format("slabs").option("dims", 2).load(folder)``: rows (path, slab, values, error) of
little-endian single-precision matrices of ``rows`` (64) x ``dims`` that stand one after another in files. Files are split
at whole matrices, about ``splitBytes`` (64 MB) to a task, or as many times that as keep it to some 1,000 tasks, so neither a task nor a row ever holds a file. What is left at
the end of a file is a row with an error; an empty file is one, too, as is a file that cannot be read. Files are in any
place that pyarrow's file systems reach (local or shared folders, HDFS, object stores)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, slab long, values array<float>, error string"
ROWS, SPLIT, BATCH, TASKS = 64, 64 << 20, 4 << 20, 1000


@dataclass
class Range(InputPartition):
    """Matrices ``first`` to ``first + n - 1`` of a file, or what is wrong with it."""

    path: str
    first: int
    n: int
    error: str | None = None


class SlabReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        rows, dims, split = int(options.get("rows", ROWS)), int(options.get("dims", 0)), int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        if rows < 1 or dims < 1 or split < 1:
            raise ValueError("rows, dims and splitBytes must be 1 at least")
        self.values, self.each = rows * dims, max(1, split // (rows * dims * 4))

    def _system(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = self._system()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} does not exist")
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [], self.values * 4
        found = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        each = self.each * max(1, math.ceil(sum(f.size for f in found) / (self.each * size * TASKS)))
        for f in found:
            whole = f.size // size
            out += [Range(f.path, at, min(each, whole - at)) for at in range(0, whole, each)]
            if f.size % size or not whole:
                out.append(Range(f.path, whole, 0, f"{f.size} bytes are no whole number of matrices of {size} bytes"))
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.list_(pa.float32()), pa.string())
        batch = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)], names=["path", "slab", "values", "error"])
        if partition.error:
            yield batch([partition.path], [partition.first], [None], [partition.error])
            return
        size, step = self.values * 4, max(1, BATCH // (self.values * 4))
        at, end = partition.first, partition.first + partition.n
        try:
            with self._system()[0].open_input_file(partition.path) if partition.n else _nothing() as f:
                while at < end:
                    n = min(step, end - at)
                    f.seek(at * size)
                    raw = f.read(n * size)
                    if len(raw) != n * size:
                        raise OSError(f"{len(raw)} of {n * size} bytes could be read")
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.values)
                    values = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(raw, "<f4")))
                    yield batch([partition.path] * n, list(range(at, at + n)), values, [None] * n)
                    at += n
        except OSError as e:
            yield batch([partition.path], [at], [None], [f"{type(e).__name__}: {e}"[:300]])


class _nothing:
    """A file that is never read."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


class SlabSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slabs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SlabReader:
        return SlabReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SlabSource)
