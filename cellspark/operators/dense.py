"""Gaussian fields of dense squares, by moments, so that their cost grows with the places and not with their pairs.

Inside a square whose side is some REACH sigma the Gaussian is a product of polynomials of DEGREES terms in x and y, but for
some 1e-15. The places of a square are summed up as the moments of those polynomials, moments of the squares around go over
to a square's own polynomials, and these are read at its places. Sums therefore differ from those of all pairs by some 1e-14
times the cells around. Places of a full square are dealt to several tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import _column, _runs

DEGREES, SHARE = 54, 50_000
SQUARE = ("slide_id", "_gx", "_gy")


@lru_cache(64)
def transfers(width: float) -> np.ndarray:
    """From moments of a square to the polynomial of a square -1, 0 or 1 squares away, along one axis; ``width`` is the
    side in sigma."""
    node = np.cos(np.pi * (np.arange(DEGREES) + 0.5) / DEGREES)
    fit = chebvander(node, DEGREES - 1).T * (2 / DEGREES)
    fit[0] /= 2
    return np.stack([fit @ np.exp(-(((node[:, None] - node + 2 * away) * width / 2) ** 2) / 2) @ fit.T for away in (-1, 0, 1)])


def _basis(part: pa.RecordBatch, axis: str) -> np.ndarray:
    """The polynomials at the places of one square, whose side has few digits: the product and difference are exact."""
    at, square, side = (part.column(c).to_numpy(zero_copy_only=False) for c in (axis, f"_g{axis}", "_side"))
    return chebvander(2 * (at - square * side) / side - 1, DEGREES - 1)


def _moments(batches):
    """One row for the places of a square that a task has (slide_id, square, width, table)."""
    at, total, width, kind = None, None, 0.0, None

    def row():
        values = (at[0], at[1], at[2], width, total.tobytes())
        return pa.RecordBatch.from_pydict({c: pa.array([v], t) for c, v, t in zip((*SQUARE, "width", "table"), values, (kind, pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)})

    for key, part in _runs(batches, *SQUARE, "share"):
        if key != at:
            if at is not None:
                yield row()
            at, total, kind = key, np.zeros((DEGREES, DEGREES)), part.schema.field("slide_id").type
            width = part.column("_side")[0].as_py() / part.column("_sigma")[0].as_py()
        n = part.column("_n").to_numpy(zero_copy_only=False).astype(float)
        total += (_basis(part, "x") * n[:, None]).T @ _basis(part, "y")
    if at is not None:
        yield row()


def _polynomials(batches):
    """The table of a square from the moments that reach it, ``ax`` and ``ay`` squares away."""
    at, total, kind = None, None, None

    def row():
        return pa.RecordBatch.from_pydict({c: pa.array([v], t) for c, v, t in zip((*SQUARE, "table"), (*at, total.tobytes()), (kind, pa.int64(), pa.int64(), pa.binary()), strict=True)})

    for key, part in _runs(batches, *SQUARE):
        if key != at:
            if at is not None:
                yield row()
            at, total, kind = key, np.zeros((DEGREES, DEGREES)), part.schema.field("slide_id").type
        for ax, ay, width, table in zip(*(part.column(c).to_pylist() for c in ("ax", "ay", "width", "table")), strict=True):
            over = transfers(width)
            total += over[ax + 1] @ np.frombuffer(table).reshape(DEGREES, DEGREES) @ over[ay + 1].T
    if at is not None:
        yield row()


def _values(batches):
    """The table of a square comes first, then its places."""
    table = None
    for _, part in _runs(batches, *SQUARE, "share", "guest"):
        if not part.column("guest")[0].as_py():
            table = np.frombuffer(part.column("table")[0].as_py()).reshape(DEGREES, DEGREES)
            continue
        value = ((_basis(part, "x") @ table) * _basis(part, "y")).sum(1)
        yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("slide_id", "x", "y")} | {"value": pa.array(value)})


def sums(sources: DataFrame, places: DataFrame) -> DataFrame:
    """slide_id, x, y, value: the sum of _n exp(-d2 / (2 sigma^2)) over all ``sources`` in the square of a place and those
    around it, its own place included, for each of ``places`` that has any there.

    Both have slide_id, x, y, the square (_gx, _gy), _side and _sigma of their slide; ``sources`` also _n."""
    kind = next(f.dataType.simpleString() for f in places.schema if f.name == "slide_id")
    square = f"slide_id {kind}, _gx long, _gy long"

    def dealt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
        shares = t.groupBy(*SQUARE).agg((1 + F.floor(F.count("*") / SHARE)).alias("shares"))
        return t.join(shares, [*SQUARE]).withColumn("share", F.pmod(F.xxhash64("x", "y"), F.col("shares"))), shares

    ordered = lambda t, *keys: t.repartition(*keys[: 4 if "share" in keys else 3]).sortWithinPartitions(*keys)
    own = dealt(sources)[0].select(*SQUARE, "share", "x", "y", "_n", "_side", "_sigma")
    moments = ordered(own, *SQUARE, "share").mapInArrow(_moments, f"{square}, width double, table binary")
    around = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    reach = moments.withColumn("ax", F.explode(around)).withColumn("ay", F.explode(around)).withColumns({"_gx": F.col("_gx") + F.col("ax"), "_gy": F.col("_gy") + F.col("ay")})
    guests, shares = dealt(places)
    tables = ordered(reach.join(shares.select(*SQUARE), [*SQUARE], "left_semi"), *SQUARE).mapInArrow(_polynomials, f"{square}, table binary")
    hosts = tables.join(shares, [*SQUARE]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    columns = [*SQUARE, "share", "guest", "x", "y", "_side", "table"]
    none = lambda *names: {c: F.lit(None).cast("binary" if c == "table" else "double") for c in names}
    hosts = hosts.withColumn("guest", F.lit(False)).withColumns(none("x", "y", "_side")).select(columns)
    guests = guests.join(tables.select(*SQUARE), [*SQUARE], "left_semi").withColumn("guest", F.lit(True)).withColumns(none("table")).select(columns)
    return ordered(hosts.union(guests), *SQUARE, "share", "guest").mapInArrow(_values, f"slide_id {kind}, x double, y double, value double")
