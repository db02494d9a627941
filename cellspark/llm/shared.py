"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 26
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs on this machine
    alone, as in tests, a temporary folder is set; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-cellspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches to Python workers hold ``most`` bytes: batches of so many rows hold any amount of text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


@contextmanager
def _cleaned(spark: SparkSession):
    """Spark deletes the shuffle files of a plan when its execution ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files outlive executors, so a lost one costs no recomputation of what stands before; the shuffle files behind
    them are deleted, so ``df`` itself should not be executed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellspark-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _cleaned(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``materialize`` that no later plan reads."""
    spark = frames[0].sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}
    for root in roots:
        if "/cellspark-" in root:
            p = jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each 64-bit key in a filter."""
    slot = mix(keys.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
    return (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))


def key_filter(keys: DataFrame, column: str):
    """A broadcast bit map of 2**FILTER_BITS bits (8 MB, whatever the number of keys) in which each key's bit is set.

    It only spares work: what passes ``may_hold`` is joined exactly, and a full map lets everything pass."""
    spark, n = keys.sparkSession, 1 << FILTER_BITS - 6

    def run(batches):
        bits = np.zeros(n, np.uint64)
        for batch in batches:
            word, bit = _slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            np.bitwise_or.at(bits, word, bit)
        at = np.flatnonzero(bits)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part), "bits": pa.array(bits[part].view(np.int64))})

    rows = keys.where(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # n rows at most
    bits = np.zeros(n, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys might be in a filter."""
    word, bit = _slots(keys)
    return bits[word] & bit != 0
