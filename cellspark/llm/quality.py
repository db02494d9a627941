"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text fall into quantile bins. Boosting goes round the features: at each step a shallow tree over one
feature's bins (at most three cuts) fits the gradient of the log-loss, and its leaf values, shrunk, are added to that
feature's table. Then the pairs of features whose coarse bins explain most of what is left are boosted the same way
with trees of one cut on either feature. A score is the logistic of the bias and one table entry for each feature and
pair: a few vectorised additions.

The model is fitted on at most TRAIN_ROWS labelled rows, those with the least hash of their id; everything else covers
all rows. Only the text is an input. Null text: as the empty text, which is scored too. Rows are kept one for one.
A document with several labels counts once with each; null labels and labels of unknown documents teach nothing.
With labels of one kind or none the score is the (smoothed) share of label 1.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out

TRAIN_ROWS = 20_000
BINS, COARSE, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, PENALTY = 200, 80, 0.1, 2.0
CUT = 0.7
FEATURES = (
    "log_chars", "letters", "upper", "digits", "symbols", "top_symbol", "mean_word", "distinct_words", "top_word", "repeats",
    "log_line", "distinct_lines", "ended_lines", "symbol_ends", "capital_words", "short_words",
)

_kinds = np.full(0x110000, 255, np.uint8)


def features(text: str | None) -> tuple[float, ...]:
    """The numbers FEATURES of a whole text."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds[points]
    if (kind == 255).any():
        for p in np.unique(points[kind == 255]):
            c = chr(p)
            _kinds[p] = 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4
        kind = _kinds[points]
    lower, upper, digits, spaces, symbols = np.bincount(kind, minlength=5)[:5].tolist()
    n, solid = max(1, len(points)), max(1, len(points) - spaces)
    marks = points[kind == 4]
    top_mark = np.bincount(np.minimum(marks, 255)).max() if len(marks) else 0
    words = text.split()
    count, m = Counter(words), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    return (
        np.log1p(len(points)), (lower + upper) / solid, upper / max(1, lower + upper), digits / solid, symbols / solid, top_mark / solid,
        solid / m, len(count) / m, max(count.values(), default=0) / m, sum(a == b for a, b in pairwise(words)) / m,
        np.log1p(n / k), len(set(lines)) / k, sum(x[-1] in ".!?" for x in lines) / k, sum(not w[-1].isalnum() for w in words) / m,
        sum(w[0].isupper() for w in words) / m, sum(len(w) < 3 for w in words) / m,
    )


class Model:
    """Bin edges, a bias, a table for each feature and for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, f = x.shape
        share = (y.sum() + 1) / (n + 2)
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
        self.coarse = [e[np.unique(np.linspace(0, len(e) - 1, COARSE - 1).round().astype(int))] if len(e) else e for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not 0 < y.sum() < n:
            return
        fine, rough = self._bins(x)
        total = np.full(n, self.bias)
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                step = self._tree(*self._sums(fine[j], len(table), y - p, p * (1 - p)))
                table += step
                total += step[fine[j]]
        p = 1 / (1 + np.exp(-total))
        shape = lambda a, b: (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
        gains = []
        for a, b in combinations(range(f), 2):
            rows, cols = shape(a, b)
            gains.append((self._cross(*(s.reshape(rows, cols) for s in self._sums(rough[a] * cols + rough[b], rows * cols, y - p, p * (1 - p))))[1], a, b))
        self.pairs = [(a, b) for gain, a, b in sorted(gains, key=lambda g: (-g[0], g[1:]))[:PAIRS] if gain > 0]
        self.pair_tables = [np.zeros(shape(a, b)) for a, b in self.pairs]
        cells = [rough[a] * shape(a, b)[1] + rough[b] for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for table, cell in zip(self.pair_tables, cells, strict=True):
                p = 1 / (1 + np.exp(-total))
                step, _gain = self._cross(*(s.reshape(table.shape) for s in self._sums(cell, table.size, y - p, p * (1 - p))))
                table += step
                total += step.ravel()[cell]

    @staticmethod
    def _sums(cell, n, g, h):
        return np.bincount(cell, weights=g, minlength=n), np.bincount(cell, weights=h, minlength=n)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, cuts: int = 3) -> np.ndarray:
        """Shrunk leaf values by bin of the tree whose cuts gain most, one after another."""
        gain = lambda a, b: a * a / (b + PENALTY)
        parts = [(0, len(g))]
        for _ in range(cuts):
            best = (1e-9, None, None)
            for lo, hi in parts:
                if hi - lo > 1:
                    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                    won = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
                    i = int(won.argmax())
                    best = max(best, (float(won[i]), (lo, hi), lo + i + 1), key=lambda b: b[0])
            if best[1] is None:
                break
            parts.remove(best[1])
            parts += [(best[1][0], best[2]), (best[2], best[1][1])]
        out = np.zeros(len(g))
        for lo, hi in parts:
            out[lo:hi] = RATE * g[lo:hi].sum() / (h[lo:hi].sum() + PENALTY)
        return out

    @staticmethod
    def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """Shrunk values of the tree with one cut on either feature, and its gain."""
        if min(g.shape) < 2:
            return np.zeros(g.shape), 0.0
        cg, ch = (np.cumsum(np.cumsum(t, 0), 1) for t in (g, h))

        def corners(c):
            a = c[:-1, :-1]
            return a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a

        quarters = list(zip(corners(cg), corners(ch), strict=True))
        won = sum(a * a / (b + PENALTY) for a, b in quarters) - cg[-1, -1] ** 2 / (ch[-1, -1] + PENALTY)
        i, j = np.unravel_index(int(won.argmax()), won.shape)
        v = [RATE * a[i, j] / (b[i, j] + PENALTY) for a, b in quarters]
        out = np.empty(g.shape)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return out, float(won[i, j])

    def _bins(self, x):
        return tuple([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)] for edges in (self.edges, self.coarse))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for rows of features."""
        fine, rough = self._bins(x)
        total = np.full(len(x), self.bias)
        for table, b in zip(self.tables, fine, strict=True):
            total += table[b]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[rough[a], rough[b]]
        return 1 / (1 + np.exp(-total))


def _matrix(texts: list) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from doc_id and text of ``docs`` and doc_id and label of ``labels``, on at most ``rows`` labels."""
    taken = labels.where("doc_id is not null and label is not null").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    joined = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", F.col("label").cast("int").alias("label"))  # ``rows`` rows at most
    found = joined.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, len(FEATURES))
    y = np.array(found.column("label").to_pylist(), float)
    order = np.lexsort((y, *x.T))  # the order in which rows arrive must not matter
    return Model(x[order], y[order])


def score(docs: DataFrame, model: Model, carry=("doc_id",)) -> DataFrame:
    """The columns of ``carry`` and score of each row of ``docs``, which has ``text``."""

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {"score": pa.array(s, pa.float64())})

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, kept + "score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
