"""Nearest neighbours within slides, exact, over leaves that follow the density of the cells.

A slide of at most ``leaf`` cells is one leaf. A larger one is split by counts, again and again, at the quantiles of its
longer side, so a leaf has at most ``leaf`` cells wherever they lie: a far outlier or a dense corner only moves the
cuts. One kernel finds the neighbours inside each leaf. A cell whose circle of neighbours stays within its leaf's region
is done; the others go down the tree of boxes to the leaves that their circles touch, visit those, and keep the nearest
of all. Of more than k + 1 cells in one place (a pile) the k + 1 of the least ids stand for them, whatever the leaf's size.

Distances compare as squares; ties go to the lower id. Leaves that are visited very often are dealt to several tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

LEAF, FAN, VISITORS, QUERIES = 1024, 16, 50_000, 256
_INF = float("inf")
_REGION = ("rx0", "ry0", "rx1", "ry1")


def _box() -> list[Column]:
    return [F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]]


def _leaf(most: int) -> Column:
    """Whether a node is no longer split: small enough, or all in one place."""
    return (F.col("n") <= most) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")))


def _cuts() -> tuple[Column, Column]:
    """(whether to cut by x, where): quantiles above the least value of the longer side, else of the other one; where
    most cells share both their x and their y, the middle."""
    above = lambda c: F.array_distinct(F.filter(f"q{c}", lambda b: b > F.col(f"{c}0")))
    wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
    by_x = F.when(F.size(above("x")) == 0, F.when(F.size(above("y")) == 0, wide).otherwise(False)).when(F.size(above("y")) == 0, True).otherwise(wide)
    middle = lambda c: F.array(F.greatest(F.col(f"{c}0") / 2 + F.col(f"{c}1") / 2, F.when(F.col(f"{c}0") / 2 + F.col(f"{c}1") / 2 <= F.col(f"{c}0"), F.col(f"{c}1"))))
    at = lambda c: F.when(F.size(above(c)) > 0, above(c)).otherwise(middle(c))
    return by_x, F.when(by_x, at("x")).otherwise(at("y"))


def split(points: DataFrame, most: int = LEAF) -> tuple[DataFrame, DataFrame | None]:
    """(``points`` with their leaf, ``node``, and its region; the boxes of all nodes below the roots, None if every
    slide is one leaf). ``points`` has slide_id, cell_id, x and y."""
    keys = ["slide_id", "node"]
    placed = points.select("slide_id", "cell_id", "x", "y", F.lit("").alias("node"), *[F.lit(-_INF if i < 2 else _INF).alias(c) for i, c in enumerate(_REGION)])
    nodes = placed.groupBy(keys).agg(*_box())
    if not nodes.where(~_leaf(most)).head(1):
        return placed, None
    shares = [i / FAN for i in range(1, FAN)]
    nodes, boxes, done = cut(nodes), [], []
    while True:
        open_nodes = nodes.where(~_leaf(most))
        done.append(placed.join(open_nodes.select(keys), keys, "left_anti"))
        if not open_nodes.head(1):
            return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, boxes)
        placed = cut(placed.join(open_nodes.select(keys), keys, "left_semi"))
        by_x, at = _cuts()
        spread = placed.groupBy(keys).agg(*[F.percentile_approx(c, shares, 1000).alias(f"q{c}") for c in "xy"])
        cuts = open_nodes.join(spread, keys).select(*keys, by_x.alias("by_x"), at.alias("at"))
        own = F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y"))
        moved = placed.join(cuts, keys).withColumn("i", F.size(F.filter("at", lambda b: b <= own)))
        low, high = F.when(F.col("i") > 0, F.element_at("at", F.when(F.col("i") > 0, F.col("i")).otherwise(1))), F.get("at", F.col("i"))
        region = {c: F.when(F.col("by_x") == (c[1] == "x"), F.coalesce(low if c[2] == "0" else high, F.col(c))).otherwise(F.col(c)) for c in _REGION}
        moved = moved.withColumns(region).withColumn("node", F.concat("node", F.substring(F.lit("abcdefghijklmnop"), F.col("i") + 1, F.lit(1))))
        placed = cut(moved.select("slide_id", "cell_id", "x", "y", "node", *_REGION))
        nodes = cut(placed.groupBy(keys).agg(*_box()))
        boxes.append(nodes.withColumn("leaf", _leaf(most)))


def _runs(batches, *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches in which the keys stay the same, with the keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in keys:
            code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(batch.column(c)[a].as_py() for c in keys), batch.slice(a, b - a)


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, qx: np.ndarray, qy: np.ndarray, qids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the ``k`` nearest points with another id, by query, distance and id; the
    points must be in the order of their ids."""
    rows, cols, values = [], [], []
    for lo in range(0, len(qx), QUERIES):
        part = slice(lo, lo + QUERIES)
        dx, dy = qx[part, None] - x, qy[part, None] - y
        d2 = dx * dx + dy * dy
        d2[qids[part, None] == ids] = np.inf
        if k < len(x):
            r, c = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
        else:
            r, c = np.nonzero(d2 < np.inf)
        v = d2[r, c]
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        first = np.searchsorted(r, r)
        kept = (np.arange(len(r)) - first < k) & (v < np.inf)
        rows.append(r[kept] + lo)
        cols.append(c[kept])
        values.append(v[kept])
    return tuple(map(np.concatenate, (rows, cols, values))) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _inside(placed: DataFrame, k: int) -> DataFrame:
    """Each cell with its neighbours inside its leaf (dst, d2), the squared distance that others must not exceed (far)
    and whether others may be that near (open)."""
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}

    def out(key, parts: list[pa.RecordBatch], types) -> pa.RecordBatch:
        ids = _column(parts, "cell_id")
        order = np.argsort(ids, kind="stable")
        ids, x, y = ids[order], *(_column(parts, c)[order] for c in "xy")
        row, col, d2 = nearest(x, y, ids, x, y, ids, k)
        n = np.bincount(row, minlength=len(ids))
        ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        far = np.full(len(ids), np.inf)
        full = n == k
        far[full] = d2[ends[1:][full] - 1]
        edge = reduce(np.minimum, (x - _column(parts, "rx0")[order], _column(parts, "rx1")[order] - x, y - _column(parts, "ry0")[order], _column(parts, "ry1")[order] - y))
        columns = {
            "slide_id": pa.array([key[0]] * len(ids), types["slide_id"]), "node": pa.array([key[1]] * len(ids)), "cell_id": pa.array(ids, types["cell_id"]), "x": pa.array(x), "y": pa.array(y),
            "dst": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[col], types["cell_id"])), "d2": pa.ListArray.from_arrays(pa.array(ends), pa.array(d2)),
            "far": pa.array(far), "open": pa.array(np.isfinite(edge) & (far >= edge * edge)),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        at, held, types = None, [], None
        for key, part in _runs(batches, "slide_id", "node"):
            types = types or {c: part.schema.field(c).type for c in ("slide_id", "cell_id")}
            if held and key != at:
                yield out(at, held, types)
                held = []
            at = key
            held.append(part)
        if held:
            yield out(at, held, types)

    sorted_ = placed.repartition("slide_id", "node").sortWithinPartitions("slide_id", "node")
    return sorted_.mapInArrow(run, f"slide_id {kinds['slide_id']}, node string, cell_id {kinds['cell_id']}, x double, y double, dst array<{kinds['cell_id']}>, d2 array<double>, far double, open boolean")


def _visits(open_: DataFrame, boxes: DataFrame) -> DataFrame:
    """(cell, leaf) for all other leaves that a cell's circle touches: down the tree, level by level."""
    kids = boxes.groupBy("slide_id", F.expr("left(node, length(node) - 1)").alias("at")).agg(F.collect_list(F.struct("node", "x0", "x1", "y0", "y1", "leaf")).alias("kids"))  # FAN of them
    kids = cut(kids)
    gap = lambda c, v: F.greatest(c[f"{v}0"] - F.col(v), F.col(v) - c[f"{v}1"], F.lit(0.0))
    touched = F.filter("kids", lambda c: (gap(c, "x") * gap(c, "x") + gap(c, "y") * gap(c, "y") <= F.col("far")) & (c["node"] != F.col("own")))
    columns = ["slide_id", "cell_id", "x", "y", "far", "own"]
    front, found = open_.select(*columns[:-1], F.col("node").alias("own"), F.lit("").alias("at")), []
    while True:
        hit = cut(front.hint("merge").join(kids, ["slide_id", "at"]).select(*columns, F.explode(touched).alias("c")).select(*columns, "c.node", "c.leaf"))
        found.append(hit.where("leaf"))
        front = hit.where("NOT leaf").select(*columns, F.col("node").alias("at"))
        if not front.head(1):
            return reduce(DataFrame.unionByName, found).select("slide_id", "node", "cell_id", "x", "y", "far")


def _meet(visits: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """slide_id, src, dst, d2: the ``k`` nearest cells of each leaf that a cell visits, no further than far."""
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    keys = ["slide_id", "node"]
    counts = visits.groupBy(keys).agg((1 + F.floor(F.count("*") / VISITORS)).alias("places"))
    guests = visits.join(counts, keys).withColumn("place", F.pmod(F.xxhash64("cell_id"), F.col("places"))).withColumn("guest", F.lit(True))
    hosts = placed.select(*keys, "cell_id", "x", "y").join(counts, keys).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)))
    columns = [*keys, "place", "guest", "cell_id", "x", "y", "far"]
    both = hosts.withColumn("guest", F.lit(False)).withColumn("far", F.lit(0.0)).select(columns).union(guests.select(columns))

    def run(batches):
        at, held, own = None, [], None
        for key, part in _runs(batches, "slide_id", "node", "place", "guest"):
            if key[:3] != at:
                at, held, own = key[:3], [], None
            if not key[3]:
                held.append(part)
                continue
            if own is None:
                own = [_column(held, c) for c in ("x", "y", "cell_id")]
            x, y, ids, far = (_column([part], c) for c in ("x", "y", "cell_id", "far"))
            row, col, d2 = nearest(*own, x, y, ids, k)
            near = d2 <= far[row]
            row, col, d2 = row[near], col[near], d2[near]
            kind = part.schema.field("cell_id").type
            yield pa.RecordBatch.from_pydict({"slide_id": pa.array([key[0]] * len(row), part.schema.field("slide_id").type), "src": pa.array(ids[row], kind), "dst": pa.array(own[2][col], kind), "d2": pa.array(d2)})

    place = [*keys, "place"]
    sorted_ = both.repartition(*place).sortWithinPartitions(*place, "guest", "cell_id")
    return sorted_.mapInArrow(run, f"slide_id {kinds['slide_id']}, src {kinds['cell_id']}, dst {kinds['cell_id']}, d2 double")


def _edges(found: DataFrame) -> DataFrame:
    """Rows of lists as edges."""
    each = found.select("slide_id", F.col("cell_id").alias("src"), F.posexplode(F.arrays_zip("dst", "d2")).alias("at", "e"))
    return each.select("slide_id", "src", "e.dst", "e.d2", (F.col("at") + 1).alias("rank"))


def nearest_neighbours(points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """Edges (slide_id, src, dst, d2, rank) to the min(k, n - 1) nearest other cells of the slide.

    ``points`` has slide_id, cell_id (a number), x and y, all finite; a cell id stands once in a slide."""
    if leaf <= k + 1:
        raise ValueError("a leaf must hold more than k + 1 cells")
    place = ["slide_id", "x", "y"]
    piled = points.groupBy(place).count().where(F.col("count") > k + 1).select(place)
    if not piled.head(1):
        return _spread_out(points, k, leaf)
    # Of a pile, the k + 1 cells of the least ids can be neighbours of others; the rest has the first k of them.
    rank = F.row_number().over(Window.partitionBy(place).orderBy("cell_id"))
    heads = cut(points.select(*place, "cell_id", rank.alias("head")).where(F.col("head") <= k + 1))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("head") <= k, F.col("cell_id")))), lambda c: F.struct(c.alias("dst"), F.lit(0.0).alias("d2")))
    piles = heads.groupBy(place).agg(F.max("cell_id").alias("last"), F.count("*").alias("n"), first.alias("e")).where(F.col("n") == k + 1)
    rest = points.hint("merge").join(piles, place).where(F.col("cell_id") > F.col("last"))
    of_rest = rest.select("slide_id", "cell_id", F.col("e.dst").alias("dst"), F.col("e.d2").alias("d2"))
    return _spread_out(heads.drop("head"), k, leaf).unionByName(_edges(of_rest))


def _spread_out(points: DataFrame, k: int, leaf: int) -> DataFrame:
    """The edges of points of which at most k + 1 share a place, so that leaves can always be split."""
    placed, boxes = split(points, leaf)
    if boxes is None:
        return _edges(_inside(placed, k))
    placed = cut(placed)
    inside = cut(_inside(placed, k))
    open_ = inside.where("open")
    cross = _meet(cut(_visits(open_, boxes)), placed, k)
    order = Window.partitionBy("slide_id", "src").orderBy("d2", "dst")
    merged = _edges(open_).select("slide_id", "src", "dst", "d2").unionByName(cross).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _edges(inside.where("NOT open")).unionByName(merged)
