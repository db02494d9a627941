"""Connected parts of masks of any size, from runs of pixels.

Masks come as tiles; each tile becomes rows (id, y, x0, x1), the horizontal runs of its set pixels. Runs that touch, in one
row across a tile's border or in neighbouring rows, are edges; parts are the components of that graph, so a part may lie
over any number of tiles. A part's outline is traced from its runs, never from a mask of its own size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nuclei import runs
from .checkpoints import cut
from .graph import components

SQUARE = 256


def tile_runs(tiles: DataFrame) -> DataFrame:
    """id, y, x0, x1 of tiles (id, x, y: where the tile begins; height, width, mask: its flags row by row)."""
    kind = tiles.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                x, y, h, w = (batch.column(c)[k].as_py() for c in ("x", "y", "height", "width"))
                mask = np.asarray(batch.column("mask")[k].values.to_numpy(zero_copy_only=False), bool).reshape(h, w)
                row, begin, end = runs(mask)
                out.append((np.full(len(row), k), row + y, begin + x, end + x))
            at, row, begin, end = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 4
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(at)), "y": pa.array(row.astype(np.int64)), "x0": pa.array(begin.astype(np.int64)), "x1": pa.array(end.astype(np.int64))})

    return tiles.select("id", "x", "y", "height", "width", "mask").mapInArrow(run, f"id {kind}, y long, x0 long, x1 long")


def labelled(runs_: DataFrame) -> DataFrame:
    """``runs_`` (id, y, x0, x1; x1 exclusive, disjoint in a row, 0 to 2**31 - 1) with part: the number of the first run,
    in row order, of its 4-connected part."""
    number = F.shiftleft("y", 31) + F.col("x0")
    own = cut(runs_.select("id", "y", "x0", "x1", number.alias("run")))
    upper = own.select("id", F.col("run").alias("src"), (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    lower = own.select("id", F.col("run").alias("dst"), "y", "x0", "x1")
    squares = lambda t, a, b: t.withColumn("s", F.explode(F.sequence(F.floor(F.col(a) / SQUARE), F.floor((F.col(b) - 1) / SQUARE))))
    met = squares(upper, "a0", "a1").join(squares(lower, "x0", "x1"), ["id", "y", "s"]).where("a0 < x1 AND x0 < a1").select("id", "src", "dst")
    beside = own.select("id", "y", F.col("x1").alias("x0"), F.col("run").alias("src")).join(lower, ["id", "y", "x0"]).select("id", "src", "dst")
    found = components(met.unionByName(beside).withColumnRenamed("id", "slide_id"))
    parts = found.select(F.col("slide_id").alias("id"), F.col("cell_id").alias("run"), F.col("component").alias("part"))
    return own.join(parts, ["id", "run"], "left").select("id", "y", "x0", "x1", F.coalesce("part", "run").alias("part"))


def _minus(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted disjoint intervals hold that others do not."""
    out = []
    for lo, hi in a:
        for u, v in b:
            if v <= lo or u >= hi:
                continue
            if u > lo:
                out.append((lo, u))
            lo = max(lo, v)
        if lo < hi:
            out.append((lo, hi))
    return out


def traced(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[tuple[int, int]]:
    """Corners of the outer pixel edge of one part, clockwise on a screen, closed; from its runs."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for i in np.lexsort((x0, y)).tolist():
        own = rows.setdefault(int(y[i]), [])
        if own and own[-1][1] == x0[i]:  # across a tile's border
            own[-1] = own[-1][0], int(x1[i])
        else:
            own.append((int(x0[i]), int(x1[i])))
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for v, own in rows.items():  # edges with the part on their right
        for lo, hi in own:
            step.setdefault((lo, v + 1), []).append((lo, v))
            step.setdefault((hi, v), []).append((hi, v + 1))
        for lo, hi in _minus(own, rows.get(v - 1, [])):
            step.setdefault((lo, v), []).append((hi, v))
        for lo, hi in _minus(own, rows.get(v + 1, [])):
            step.setdefault((hi, v + 1), []).append((lo, v + 1))
    first = (rows[min(rows)][0][0], min(rows))
    path, at, way = [first], first, (1, 0)
    while True:
        # Where two edges leave a corner the part touches itself there; the right turn stays with the pixel at hand.
        after = max(step[at], key=lambda p: way[0] * (p[1] - at[1]) - way[1] * (p[0] - at[0]))
        step[at].remove(after)
        turn = (int(np.sign(after[0] - at[0])), int(np.sign(after[1] - at[1])))
        if turn == way and len(path) > 1:
            path[-1] = after
        else:
            path.append(after)
        at, way = after, turn
        if at == first:
            return path


def mask_parts(tiles: DataFrame, least: int = 20) -> DataFrame:
    """id, part, n (pixels), ring (closed outline) of the parts of at least ``least`` pixels of masks of any size. One
    kernel sees the runs of one part."""
    rows = labelled(tile_runs(tiles))
    keys = ["id", "part"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    lists = rows.groupBy(keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("n"), *[F.collect_list(c).alias(c) for c in ("y", "x0", "x1")]).where(F.col("n") >= least)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches):
        for batch in batches:
            rings = [[{"x": float(x), "y": float(y)} for x, y in traced(*(np.asarray(batch.column(c)[k].values) for c in ("y", "x0", "x1")))] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("id", "part", "n")} | {"ring": pa.array(rings, pa.list_(point))})

    return lists.mapInArrow(run, f"id {kinds['id']}, part long, n long, ring array<struct<x:double,y:double>>")
