"""Where checkpoints go."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and Spark runs on this machine alone, as in tests, a temporary folder is
    set; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-cellspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: later plans start from its rows, and a lost
    executor costs no more than the stage it was in. The shuffle files behind the rows go, so ``df`` itself should not be
    executed again; the rows stay until ``clear``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cellspark-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete what ``cut`` has written in this application but its first ``since`` tables, once no plan reads it any more;
    how many tables that were."""
    written = _written.setdefault(spark.sparkContext.applicationId, [])
    paths, written[since:] = written[since:], []
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``cut`` writes inside goes at the end, also after an error. Results must have been written or collected by
    then: ``with scratch(spark): enrich(cells).write.parquet(path)``."""
    since = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        clear(spark, since)


def cached(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``make`` gave for this name and key before, from the shared folder, or now. The key should be a
    digest of all that the rows depend on, such as those of the sources' files."""
    path = f"{folder(spark)}/cellspark-cache/{name}/{hashlib.sha256(key.encode()).hexdigest()}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
