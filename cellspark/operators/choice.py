"""Greedy choice in parallel rounds: candidates in an order, each kept if it conflicts with none that was kept before.

What is kept is the first independent set of the graph of conflicts. Conflicts are edges from the better to the worse
candidate, found by joins on squares. In each round all candidates that no open one beats are kept, and what they beat
goes; rounds end when no edge is left, mostly after a few. Long chains of candidates, each beaten by the one before, go
on after ROUNDS as components: each is read in the candidates' order, edge by edge, by one task that keeps the ids beaten.

Copies: of candidates in the same place only the best can be kept, so the others go before conflicts are looked for."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut
from .graph import components
from .neighbours import _runs

ROUNDS = 6


def _order(score: str) -> Column:
    """Scores in ascending order, those that are none first."""
    return F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))


def beaten(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """slide_id, id: candidates that some kept one beats, from conflicts (slide_id, src, dst, score) in which src, of this
    score, is the better one; of equal scores the lower id is better."""
    gone, left = [], cut(edges)
    for _ in range(rounds):
        if not left.head(1):
            break
        worse = left.select("slide_id", F.col("dst").alias("src")).distinct()
        lost = cut(left.join(worse, ["slide_id", "src"], "left_anti").select("slide_id", F.col("dst").alias("id")).distinct())
        gone.append(lost)
        for end in ("src", "dst"):
            left = left.join(lost.withColumnRenamed("id", end), ["slide_id", end], "left_anti")
        left = cut(left)
    else:
        if left.head(1):
            gone.append(_by_component(left))
    out = gone[0] if gone else left.select("slide_id", F.col("dst").alias("id"))
    for g in gone[1:]:
        out = out.unionByName(g)
    return out


def _by_component(edges: DataFrame) -> DataFrame:
    """``beaten`` in the order of the candidates, component by component."""
    own = components(edges.select("slide_id", "src", "dst")).withColumnRenamed("cell_id", "src")
    ordered = edges.join(own, ["slide_id", "src"]).withColumn("order", -F.col("score"))
    ordered = ordered.repartition("slide_id", "component").sortWithinPartitions("slide_id", "component", "order", "src")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(batches):
        at, lost = None, set()
        for key, part in _runs(batches, "slide_id", "component"):
            if key != at:
                at, lost = key, set()
            new = []
            for src, dst in zip(part.column("src").to_pylist(), part.column("dst").to_pylist(), strict=True):
                if src not in lost and dst not in lost:
                    lost.add(dst)
                    new.append(dst)
            yield pa.RecordBatch.from_pydict({"slide_id": pa.array([key[0]] * len(new), part.schema.field("slide_id").type), "id": pa.array(new, part.schema.field("dst").type)})

    return ordered.select("slide_id", "component", "src", "dst").mapInArrow(run, f"slide_id {kinds['slide_id']}, id {kinds['dst']}")


def _best_of_copies(rows: DataFrame, *place: str) -> DataFrame:
    """The best candidate of each place."""
    best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b")
    return rows.groupBy("slide_id", *place).agg(best).select("slide_id", *place, "b.id", "b.score")


def _conflicts(a: DataFrame, b: DataFrame, on: list[str], conflict: Column) -> DataFrame:
    """Edges from the better to the worse of each pair that meets."""
    met = a.alias("a").join(b.alias("b"), on).where((F.col("a.id") != F.col("b.id")) & conflict)
    first = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.id") < F.col("b.id")))
    return met.where(first).select("slide_id", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.score").alias("score"))


def apart(points: DataFrame, least: float) -> DataFrame:
    """slide_id, id of points (slide_id, id, x, y, score), best first, that lie at least ``least`` from all kept before.
    Points without a place take no part."""
    kept = points.select("slide_id", "id", "x", "y", _order("score").alias("score")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    kept = cut(_best_of_copies(kept, "x", "y")) if least > 0 else kept
    square = {f"g{c}": F.floor(F.col(c) / least) for c in "xy"} if least > 0 else {"gx": F.lit(0), "gy": F.lit(0)}
    own = kept.withColumns(square)
    near = own
    for c in ("gx", "gy"):
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    edges = _conflicts(own, near, ["slide_id", "gx", "gy"], dx * dx + dy * dy < least * least)
    return kept.select("slide_id", "id").join(beaten(edges), ["slide_id", "id"], "left_anti")


def apart_boxes(boxes: DataFrame, most: float) -> DataFrame:
    """slide_id, id of boxes (slide_id, id, x0, y0, x1, y1, score), best first, whose overlap (intersection over union)
    with all kept before is at most ``most``.

    Two boxes whose overlap is over ``most`` have longer sides within a factor of 1 / most of each other, so a box meets
    others in squares of its own longer side's power of two and of the next few."""
    if most < 0:
        raise ValueError("an overlap is 0 at least")
    sides = [F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0)) for c in "xy"]
    rows = boxes.select("slide_id", "id", "x0", "y0", "x1", "y1", _order("score").alias("score")).withColumn("size", sides[0] * sides[1])
    solid = rows.where("size > 0")  # others overlap nothing
    solid = cut(_best_of_copies(solid.where("size > 1e-12"), "x0", "y0", "x1", "y1", "size").unionByName(solid.where("size <= 1e-12"), allowMissingColumns=True)) if most < 1 else cut(solid)
    level = F.ceil(F.log2(F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xy"]))).cast("int")
    own = solid.withColumn("level", level)
    if most > 0:
        top = F.col("level") + math.ceil(math.log2(1 / most) + 1e-9)
    else:
        top = F.max("level").over(Window.partitionBy("slide_id"))
    low = own.withColumn("top", top).withColumn("level", F.explode(F.sequence("level", "top"))).drop("top")

    def touched(t: DataFrame) -> DataFrame:
        for c in "xy":
            at = [F.floor(F.col(f"{c}{i}") / F.pow(F.lit(2.0), F.col("level"))) for i in (0, 1)]
            t = t.withColumn(f"g{c}", F.explode(F.sequence(*at)))
        return t

    # A pair counts in the square of its intersection's first corner only, and once if both have one level.
    first = [F.floor(F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")) / F.pow(F.lit(2.0), F.col("level"))) == F.col(f"g{c}") for c in "xy"]
    w, h = [F.greatest(F.least(F.col(f"a.{c}1"), F.col(f"b.{c}1")) - F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")), F.lit(0.0)) for c in "xy"]
    union = F.col("a.size") + F.col("b.size") - w * h
    over = F.when(union <= 1e-12, 0.0).otherwise(w * h / union) > most
    large, small = touched(own), touched(low)
    keys = ["slide_id", "level", "gx", "gy"]
    edges = _conflicts(large, small, keys, first[0] & first[1] & over).unionByName(_conflicts(small, large, keys, first[0] & first[1] & over)).distinct()
    flat = rows.where("NOT size > 0").select("slide_id", "id")
    return solid.select("slide_id", "id").join(beaten(edges), ["slide_id", "id"], "left_anti").unionByName(flat)


def suppress(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Greedy suppression by group: group, id of boxes (group, id, x0, y0, x1, y1, score) kept by ``apart_boxes``."""
    return apart_boxes(boxes.withColumnRenamed("group", "slide_id"), most).select(F.col("slide_id").alias("group"), "id")


def dedupe_by_distance(cells: DataFrame, least: float = 12.0) -> DataFrame:
    """slide_id, cell_id of cells kept by ``apart``, largest area first, by their centroids."""
    points = cells.select("slide_id", F.col("cell_id").alias("id"), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.col("area").alias("score"))
    return apart(points, least).select("slide_id", F.col("id").alias("cell_id"))
