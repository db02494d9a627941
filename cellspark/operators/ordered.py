"""Operators over ordered rows: path entropy, gradients, line integrals, walks, sliding counters, tiles."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, REACH = 4, 2


def path_entropy(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Each step of each path with its value, the entropy of a centred window of up to five values (fractions of |v| in
    four bins), the change of entropy and the ratio to the next step, and the running sum.

    Paths of two to four steps have a window of one less on either side, as half their length; of one step 0."""
    own = Window.partitionBy(key).orderBy(step)
    n = F.count("*").over(Window.partitionBy(key))
    v = F.col(value)
    binned = F.least(F.lit(BINS - 1), F.floor((F.abs(v) - F.floor(F.abs(v))) * BINS)).cast("int")
    df = df.withColumns({"_n": n, "_bin": binned})

    def entropy(reach: int) -> Column:
        w = own.rowsBetween(-reach, reach)
        total = F.count("*").over(w)
        shares = [F.sum((F.col("_bin") == b).cast("int")).over(w) / total for b in range(BINS)]
        return sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in shares)

    df = df.withColumn("entropy", F.when(F.col("_n") < 2, 0.0).when(F.col("_n") < 4, entropy(1)).otherwise(entropy(REACH)))
    after = F.lead(v).over(own)
    return df.withColumns({
        "entropy_delta": F.lead("entropy").over(own) - F.col("entropy"),
        "ratio": F.when(after.isNull(), None).when(F.abs(v) > 1e-18, after / F.nullif(v, F.lit(0.0))).otherwise(1.0),
        "cumulative": F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, 0)),
    }).drop("_n", "_bin")


def harmonic_gradient(df: DataFrame, key: str, order: str, x: str, y: str, value: str, axis=(1.0, 0.0)) -> DataFrame:
    """By key: amplitude, decay (at least 0) and frequency of a log-linear fit along an axis; keys with fewer than four
    rows, or three positive values, have none. Sign changes are counted in the order of ``order``."""
    norm = float(np.hypot(*axis))
    own = Window.partitionBy(key)
    d = (F.col(x) * axis[0] + F.col(y) * axis[1]) / norm
    df = df.select(key, order, d.alias("_d"), F.col(value).alias("_v"))
    df = df.withColumns({"_all": F.count("*").over(own), "_s": F.col("_d") - F.min("_d").over(own)})
    last = df.groupBy(key).agg(F.max_by("_s", order).alias("_last"))
    good = df.where((F.col("_all") >= 4) & (F.col("_v") > 1e-18) & (F.col("_v") < float("inf"))).withColumn("_l", F.ln("_v"))
    fit = good.groupBy(key).agg(F.count("*").alias("_m"), F.avg("_s").alias("_md"), F.avg("_l").alias("_ml"), F.regr_sxy("_l", "_s").alias("_sxy"), F.regr_sxx("_l", "_s").alias("_sxx")).where("_m >= 3")
    fit = fit.withColumn("_lambda", F.when(F.col("_sxx") > 1e-18, -F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))).otherwise(0.0))
    rest = good.join(fit, key).withColumn("_up", F.col("_l") - F.col("_ml") + F.col("_lambda") * F.col("_s") >= 0)
    turn = rest.withColumn("_turn", (F.lag("_up").over(Window.partitionBy(key).orderBy(order)) != F.col("_up")).cast("int"))
    turns = turn.groupBy(key).agg(F.sum(F.coalesce("_turn", F.lit(0))).alias("_turns"))
    out = fit.join(turns, key).join(last, key)
    return out.select(
        key, F.greatest(F.exp(F.col("_ml") + F.col("_lambda") * F.col("_md")), F.lit(1e-18)).alias("amplitude"), F.greatest("_lambda", F.lit(0.0)).alias("decay"),
        (F.col("_turns") / (2 * F.greatest("_last", F.lit(1e-9)))).alias("frequency"),
    )


def path_integral(df: DataFrame, key: str, step: str, x: str, y: str, field) -> DataFrame:
    """By key: the midpoint-rule line integral of ``field`` (a function of two Columns) over consecutive points."""
    own = Window.partitionBy(key).orderBy(step)
    df = df.withColumns({"_x": F.lead(x).over(own), "_y": F.lead(y).over(own)})
    ds = F.sqrt((F.col("_x") - F.col(x)) ** 2 + (F.col("_y") - F.col(y)) ** 2)
    term = field((F.col("_x") + F.col(x)) / 2, (F.col("_y") + F.col(y)) / 2) * ds
    return df.groupBy(key).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("integral"))


def radial_walk(cells: DataFrame, steps: int = 50) -> DataFrame:
    """slide_id, step, cell_id: from the least id always on to the nearest cell not yet visited, ties to the lower id.

    Each step depends on the one before, so a slide's centroids (three numbers each) go through one kernel."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        ids, x, y = pdf["cell_id"].to_numpy(), pdf["centroid_x"].to_numpy(), pdf["centroid_y"].to_numpy()
        open_, path = np.ones(len(ids), bool), [0]
        open_[0] = False
        for _ in range(min(steps, len(ids) - 1)):
            d2 = np.where(open_, (x - x[path[-1]]) ** 2 + (y - y[path[-1]]) ** 2, np.inf)
            d2[np.isnan(d2)] = np.inf
            at = int(d2.argmin())
            if not np.isfinite(d2[at]):
                break
            path.append(at)
            open_[at] = False
        return pd.DataFrame({"slide_id": pdf["slide_id"].iloc[0], "step": range(len(path)), "cell_id": ids[path]})

    return cells.select("slide_id", "cell_id", "centroid_x", "centroid_y").groupBy("slide_id").applyInPandas(walk, "slide_id string, step long, cell_id long")


def sliding_count(df: DataFrame, key: str, ts: str, seconds: int = 60, limit: int = 100) -> DataFrame:
    """Each row with the calls of its key that were allowed in the ``seconds`` before it (both ends included, itself too
    if it is), whether it is allowed, and the seconds until the oldest of them leaves the window (at least 1).

    Only allowed calls count, so each decision depends on those before it: a key's rows go through a task in the order
    of time, then of their other columns, and at most ``limit`` times are held. Rows without a time are not allowed and
    count nothing; a null key is a key."""
    names = df.columns
    timed = df.withColumn("_t", F.col(ts).cast("timestamp").cast("double"))
    shape = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", calls long, allowed boolean, retry_after double"

    def decide(batches):
        own, held = None, deque()
        for batch in batches:
            keys, times, out = batch.column(key).to_pylist(), batch.column("_t").to_pylist(), []
            for k, t in zip(keys, times, strict=True):
                if k != own:
                    own, held = k, deque()
                if t is None:
                    out.append((0, False, 1.0))
                    continue
                while held and held[0] < t - seconds:
                    held.popleft()
                allowed = len(held) < limit
                if allowed:
                    held.append(t)
                out.append((len(held), allowed, max(1.0, seconds - (t - held[0])) if held else 1.0))
            calls, allowed, retry = zip(*out, strict=True) if out else ((), (), ())
            found = {"calls": pa.array(calls, pa.int64()), "allowed": pa.array(allowed, pa.bool_()), "retry_after": pa.array(retry, pa.float64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | found)

    return timed.repartition(key).sortWithinPartitions(key, "_t", *[c for c in names if c not in (key, ts)]).mapInArrow(decide, shape)


def tiles(images: DataFrame, tile: int = 512, overlap: int = 64) -> DataFrame:
    """Overlapping tiles (x0, y0, w, h) of images (id, width, height): the last one is moved back to the edge."""
    size = max(64, tile)
    stride = size - min(overlap, size // 2)

    def starts(n: str) -> Column:
        last = F.greatest(F.lit(0), F.col(n) - size)
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))

    out = images.withColumn("y0", F.explode(starts("height"))).withColumn("x0", F.explode(starts("width")))
    return out.select("id", "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("h"))


def plain_tiles(images: DataFrame, tile: int = 256) -> DataFrame:
    """Tiles without overlap in row order, clipped at the edges."""
    axis = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1), F.lit(tile))
    out = images.where("width > 0 and height > 0").withColumn("y0", F.explode(axis("height"))).withColumn("x0", F.explode(axis("width")))
    return out.select("id", "x0", "y0", F.least(F.lit(tile), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(tile), F.col("height") - F.col("y0")).alias("h"))


def to_uint8(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values scaled to 0 to 255 within each key; 128 for one value."""
    ends = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 255)
    return df.join(ends, key).withColumn("u8", F.coalesce(scaled, F.lit(128)).cast("int")).drop("_lo", "_hi")
