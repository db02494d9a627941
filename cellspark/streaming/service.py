"""Streams: files as they arrive, calls in a sliding window, sessions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import annotations


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of parsed annotations of the files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    return annotations.parse(files)


def windowed_counts(events: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Calls by key and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "user_id").agg(F.count("*").alias("calls"))


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each key: a gap ends one."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def limiter(events: DataFrame, seconds: int = 60, limit: int = 100, late: str = "10 minutes") -> DataFrame:
    """event_id, user_id, allowed: exact sliding-window limiter with the allowed times of each key as state, ``limit`` at
    most. A key's state goes when the watermark has passed its last call by more than the window."""

    def decide(key, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        at = 0.0
        for event, at in zip(rows["event_id"], rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9, strict=True):
            times = [t for t in times if t >= at - seconds]
            ok = len(times) < limit
            if ok:
                times.append(at)
            out.append((event, key[0], ok))
        state.update((times,))
        state.setTimeoutTimestamp(max(int((at + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed"])

    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(decide, "event_id long, user_id long, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def jobs(events: DataFrame) -> DataFrame:
    """Jobs by key: items, done, failed, progress in percent to one digit, and the status that follows."""
    done, failed = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "error")
    out = events.groupBy("user_id").agg(F.count("*").alias("total"), done.alias("done"), failed.alias("failed"), F.min("ts").alias("created_at"))
    status = F.when(F.col("failed") == F.col("total"), "FAILED").otherwise("COMPLETED")
    return out.withColumns({"progress": F.round(100 * (F.col("done") + F.col("failed")) / F.col("total"), 1), "status": status})


def newest(rows: DataFrame, status: str | None = None) -> DataFrame:
    """Jobs, of one status if named, newest first."""
    out = rows if status is None else rows.where(F.col("status") == status)
    return out.orderBy(F.desc("created_at"), "user_id")


def unexpired(rows: DataFrame, now, seconds: int) -> DataFrame:
    """Jobs made within ``seconds`` before ``now``."""
    return rows.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"))


def batch_checks(files: DataFrame, most_files: int = 100, most_bytes: int = 500_000_000) -> DataFrame:
    """By batch: files, bytes, empty files, and whether all limits hold."""
    out = files.groupBy("batch").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") == 0).alias("empty"))
    return out.withColumn("ok", (F.col("files") <= most_files) & (F.col("bytes") <= most_bytes) & (F.col("empty") == 0))


def fresh(artifacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Artifacts with whether they are as new as their input."""
    return artifacts.join(inputs.withColumnRenamed("at", "input_at"), "name", "left").withColumn("fresh", F.coalesce(F.col("at") >= F.col("input_at"), F.lit(False)))


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with their position within a key."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def run_to_end(stream: DataFrame, folder: str, output: str = "append", tag: str | None = None) -> DataFrame:
    """What a stream has to say about all that has arrived, as a table: written to ``folder`` with its checkpoint, which a
    later call goes on from. ``tag`` names its jobs, so that ``cancel`` can end them."""
    spark = stream.sparkSession
    if tag:
        spark.addTag(tag)
    try:
        query = stream.writeStream.format("parquet").outputMode(output).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
        query.awaitTermination()
    finally:
        if tag:
            spark.removeTag(tag)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Interrupt the running operations of a tag; what they have written so far stays."""
    return spark.interruptTag(tag)


class Callback(StreamingQueryListener):
    """Calls ``send`` with (query's id, event, rows or error) when a stream starts, makes progress and ends. What ``send``
    raises is kept in ``failures`` and does not disturb the stream."""

    def __init__(self, send: Callable[[str, str, object], None]):
        self.send, self.failures = send, []

    def _tell(self, *about):
        try:
            self.send(*about)
        except Exception as e:  # the receiver's trouble is not the stream's
            self.failures.append(repr(e))

    def onQueryStarted(self, event):  # noqa: N802
        self._tell(str(event.id), "started", None)

    def onQueryProgress(self, event):  # noqa: N802
        self._tell(str(event.progress.id), "progress", event.progress.numInputRows)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self._tell(str(event.id), "failed" if event.exception else "done", event.exception)
