"""Tree ensembles as rows, and their scores.

A model is a table: tree, node, feature (position; null at a leaf), threshold, low, high (nodes to go to if the feature is
at most the threshold, or else), value (of a leaf). Node 0 is a tree's root. A score is ``base`` plus ``rate`` times the
sum of the leaves reached; its logistic is the probability. Features that are none or not a number go to ``high``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 1_000_000


class Ensemble:
    """Trees as arrays; all rows of a batch go down all trees together, level by level."""

    def __init__(self, trees: pa.Table, base: float = 0.0, rate: float = 1.0):
        t = trees.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, node = (t.column(c).to_numpy() for c in ("tree", "node"))
        self.base, self.rate = base, rate
        self.roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if len(tree) else np.zeros(0, int)
        offset = np.repeat(self.roots, np.diff(self.roots, append=len(tree)))
        if not np.array_equal(node, np.arange(len(node)) - offset):
            raise ValueError("a tree's nodes must be 0, 1, 2, ...")
        self.feature = t.column("feature").fill_null(-1).to_numpy().astype(int)
        self.threshold, self.value = (t.column(c).fill_null(0.0).to_numpy().astype(float) for c in ("threshold", "value"))
        inner = self.feature >= 0
        self.low, self.high = (np.where(inner, t.column(c).fill_null(-1).to_numpy() + offset, np.arange(len(node))) for c in ("low", "high"))
        size = np.repeat(np.diff(self.roots, append=len(tree)), np.diff(self.roots, append=len(tree)))
        for side in (self.low, self.high):
            if (side[inner] <= np.flatnonzero(inner)).any() or (side[inner] >= (offset + size)[inner]).any():
                raise ValueError("a node must lead to later nodes of its tree")

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The score of each row of features."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        if self.feature.max(initial=-1) >= x.shape[1]:
            raise ValueError(f"the model has feature {self.feature.max()}, the rows have {x.shape[1]}")
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            small = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(small, self.low[at], self.high[at]), at)
        return self.base + self.rate * self.value[at].sum(1)


def classify(rows: DataFrame, features: list[str], trees: DataFrame, base: float = 0.0, rate: float = 1.0, over: float = 0.5) -> DataFrame:
    """``rows`` with probability and positive (probability > ``over``) by a model of at most MOST_NODES nodes."""
    model = trees.select(F.col("tree").cast("long"), F.col("node").cast("long"), F.col("feature").cast("int"), F.col("threshold").cast("double"), F.col("low").cast("long"), F.col("high").cast("long"), F.col("value").cast("double"))
    if (n := model.count()) > MOST_NODES:
        raise ValueError(f"a model of {n} nodes is over {MOST_NODES}")
    own = Ensemble(model.toArrow(), base, rate)  # checked above
    shared = rows.sparkSession.sparkContext.broadcast(own)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in features], 1)
            p = 1 / (1 + np.exp(-shared.value.scores(x)))
            out = {c: batch.column(c) for c in batch.schema.names} | {"probability": pa.array(p), "positive": pa.array(p > over)}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, f"{kept}, probability double, positive boolean")
