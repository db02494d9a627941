"""Graphs of cells: components, communities, constrained weights, spectral embedding."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoints import cut

#: Fixed value: cells of a slide that meet as many others at a time.
BUCKET = 1_000


def components(edges: DataFrame) -> DataFrame:
    """slide_id, cell_id and component (the least id reachable) of all ends of edges (slide_id, src, dst).

    Rounds of least labels and label jumping over written tables; the driver sees a sum."""
    both = cut(edges.select("slide_id", "src", "dst").union(edges.select("slide_id", "dst", "src")).distinct())
    labels = cut(both.groupBy("slide_id", F.col("src").alias("cell_id")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            return labels
        total = now
        near = both.join(labels.withColumnRenamed("cell_id", "src"), ["slide_id", "src"]).select("slide_id", F.col("dst").alias("cell_id"), "component")
        least = cut(near.union(labels).groupBy("slide_id", "cell_id").agg(F.min("component").alias("component")))
        up = least.select("slide_id", F.col("cell_id").alias("component"), F.col("component").alias("upper"))
        labels = cut(least.join(up, ["slide_id", "component"]).select("slide_id", "cell_id", F.col("upper").alias("component")))


def equilibrium_patches(cells: DataFrame, edges: DataFrame, value: str, most: float) -> DataFrame:
    """Members (slide_id, patch, cell_id) of the components over edges whose values differ by at most ``most``."""
    v = cells.select("slide_id", "cell_id", F.col(value).alias("v"))
    a, b = v.toDF("slide_id", "src", "va"), v.toDF("slide_id", "dst", "vb")
    calm = edges.join(a, ["slide_id", "src"]).join(b, ["slide_id", "dst"]).where(F.abs(F.col("va") - F.col("vb")) <= most)
    return components(calm).select("slide_id", F.col("component").alias("patch"), "cell_id")


def merged(n: int, src: np.ndarray, dst: np.ndarray, target: int) -> np.ndarray:
    """The least member of the group of each of ``n`` nodes, after merging, again and again, the two groups with the most
    edges between them (of equals, those of the least members) until ``target`` are left or none are joined.

    A heap holds the pairs of groups by weight; a pair whose weight has changed since is passed over."""
    up, left = np.arange(n), n
    if n <= target:
        return up
    lo, hi = np.minimum(src, dst), np.maximum(src, dst)
    pairs, weights = np.unique((lo * n + hi)[lo != hi], return_counts=True)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    heap = []
    for pair, w in zip(pairs.tolist(), weights.tolist(), strict=True):
        a, b = divmod(pair, n)
        near[a][b] = near[b][a] = w
        heap.append((-w, a, b))
    heapq.heapify(heap)
    while heap and left > target:
        w, a, b = heapq.heappop(heap)
        if near[a].get(b) != -w:
            continue
        up[b], left = a, left - 1
        own, gone, near[b] = near[a], near[b], {}
        del own[b], gone[a]
        for c, v in gone.items():
            del near[c][b]
            own[c] = near[c][a] = v = own.get(c, 0) + v
            heapq.heappush(heap, (-v, min(a, c), max(a, c)))
    for i in range(n):  # a group's node comes before those merged into it
        up[i] = up[up[i]]
    return up


def communities(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """slide_id, module, cell_id: greedy merging down to max(4, floor(sqrt n)) groups, at most n / 2; a slide of fewer
    than four cells has none. Modules are numbered by their least cells.

    Every merge depends on the one before, so a slide's edges go through one kernel; slides run side by side."""
    sizes = cells.groupBy("slide_id").agg(F.array_sort(F.collect_list("cell_id")).alias("ids"))
    lists = edges.groupBy("slide_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    kinds = {f.name: f.dataType.simpleString() for f in cells.select("slide_id", "cell_id").schema}

    def run(batches):
        for batch in batches:
            for k, slide in enumerate(batch.column("slide_id")):
                ids, src, dst = (np.asarray(batch.column(c)[k].values) if batch.column(c)[k].is_valid else np.zeros(0, np.int64) for c in ("ids", "src", "dst"))
                n = len(ids)
                if n >= 4:
                    group = merged(n, np.searchsorted(ids, src), np.searchsorted(ids, dst), min(max(math.isqrt(n), 4), n // 2))
                    module = np.unique(group, return_inverse=True)[1]
                    yield pa.RecordBatch.from_pydict({"slide_id": pa.array([slide.as_py()] * n, batch.schema.field("slide_id").type), "module": pa.array(module.astype(np.int32)), "cell_id": pa.array(ids, batch.schema.field("ids").type.value_type)})

    found = sizes.join(lists, "slide_id", "left").select("slide_id", "ids", "src", "dst")
    return found.mapInArrow(run, f"slide_id {kinds['slide_id']}, module int, cell_id {kinds['cell_id']}")


def tissue_iq(cells: DataFrame, modules: DataFrame, phenotype: str, area: str = "area") -> DataFrame:
    """By slide: number of modules, mean, deviation and variation of distinct phenotypes over mean area, and how many
    modules lie above the mean by more than one deviation."""
    own = modules.join(cells.select("slide_id", "cell_id", F.col(phenotype).alias("p"), F.greatest(F.col(area), F.lit(1e-12)).alias("a")), ["slide_id", "cell_id"])
    iq = own.groupBy("slide_id", "module").agg((F.count_distinct("p") / F.avg("a")).alias("iq"))
    mean = iq.groupBy("slide_id").agg(F.count("*").alias("n_modules"), F.avg("iq").alias("mean_iq"), F.stddev_pop("iq").alias("std_iq"))
    above = iq.join(mean, "slide_id").groupBy("slide_id").agg(F.count_if(F.col("iq") > F.col("mean_iq") + F.col("std_iq")).alias("heterogeneous"))
    cv = F.when(F.col("mean_iq") > 1e-18, F.col("std_iq") / F.nullif(F.col("mean_iq"), F.lit(0.0))).otherwise(0.0)
    return mean.withColumn("cv_iq", cv).join(above, "slide_id")


def laplacian_loss(edges: DataFrame, cells: DataFrame, columns: list[str], weight: str = "weight") -> DataFrame:
    """By slide: sum of weight * squared feature difference plus 0.01 * squared weights."""
    side = lambda k: cells.select("slide_id", F.col("cell_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    both = edges.join(side("src"), ["slide_id", "src"]).join(side("dst"), ["slide_id", "dst"])
    d2 = sum((F.col(f"{c}_src") - F.col(f"{c}_dst")) ** 2 for c in columns)
    return both.groupBy("slide_id").agg(F.sum(F.col(weight) * d2 + 0.01 * F.col(weight) * F.col(weight)).alias("loss"))


def constrained_weights(edges: DataFrame, cells: DataFrame, columns: list[str], first: int = 30, rate: float = 0.001, rounds: int = 200, tol: float = 1e-6) -> DataFrame:
    """By slide: loss and rounds of projected gradient descent on edge weights (0 to 10, total 0.1 to 1e6) over the
    first cells of each slide. Each round depends on the one before; ``first`` bounds what a kernel sees."""
    from pyspark.sql import Window

    some = cells.withColumn("_i", F.row_number().over(Window.partitionBy("slide_id").orderBy("cell_id"))).where(F.col("_i") <= first).select("slide_id", "cell_id", *columns)
    side = lambda k: some.select("slide_id", F.col("cell_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    both = edges.join(side("src"), ["slide_id", "src"]).join(side("dst"), ["slide_id", "dst"])
    d2 = sum((F.col(f"{c}_src") - F.col(f"{c}_dst")) ** 2 for c in columns)

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values(["src", "dst"])["d2"].to_numpy()
        w, before, loss, done = np.ones(len(g)), np.inf, 0.0, rounds
        for i in range(rounds):
            loss = float((w * g + 0.01 * w * w).sum())
            if abs(before - loss) < tol:
                done = i + 1
                break
            before = loss
            w = np.clip(w - rate * (g + 0.02 * w), 0, 10)
            total = w.sum()
            if total > 1e6:
                w *= 1e6 / total
            elif total < 0.1:
                w *= 0.1 / max(total, 1e-18)
        else:
            loss = float((w * g + 0.01 * w * w).sum())
        return pd.DataFrame({"slide_id": [pdf["slide_id"].iloc[0]], "loss": [loss], "rounds": [done]})

    return both.select("slide_id", "src", "dst", d2.alias("d2")).groupBy("slide_id").applyInPandas(descend, "slide_id string, loss double, rounds long")


def spectral(cells: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by slide: singular_values, rank90, energy; by cell: u, the left vector, and its quadrant).

    Only sums of products are gathered; decompositions are of len(columns) squared."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    sums = cells.groupBy("slide_id").agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"m{i}_{j}") for i, j in pairs])
    grams = sums.select("slide_id", F.array(*[f"m{i}_{j}" for i, j in pairs]).alias("gram"))
    doubles = T.ArrayType(T.DoubleType())
    kind = T.StructType([T.StructField("singular_values", doubles), T.StructField("vectors", T.ArrayType(doubles)), T.StructField("rank90", T.IntegerType()), T.StructField("energy", T.DoubleType())])

    @F.pandas_udf(kind)
    def decompose(gram: pd.Series) -> pd.DataFrame:
        if not len(gram):
            return pd.DataFrame([], columns=["singular_values", "vectors", "rank90", "energy"])
        values, vectors = np.linalg.eigh(np.stack([np.array(g, float).reshape(len(columns), -1) for g in gram]))
        vectors = np.swapaxes(vectors, 1, 2)
        vectors = vectors * np.where(vectors.sum(2, keepdims=True) < 0, -1, 1)  # the sign that a sum of at least 0 has
        out = []
        for own, rows in zip(values[:, ::-1], vectors[:, ::-1], strict=True):
            some = own >= 1e-15
            own, rows = own[some], rows[some]
            part, total = np.cumsum(own), own.sum()
            rank = min(int((part < 0.9 * total).sum()) + 1, len(own))
            out.append((np.sqrt(own).tolist(), rows.tolist(), rank, float(part[rank - 1] / total) if total > 1e-18 else 1.0))
        return pd.DataFrame(out, columns=["singular_values", "vectors", "rank90", "energy"])

    slides = cut(grams.select("slide_id", decompose("gram").alias("d")).select("slide_id", "d.*"))
    row = "array(" + ", ".join(columns) + ")"
    u = F.expr(f"zip_with(vectors, singular_values, (v, s) -> CASE WHEN s < 1e-18D THEN 0D ELSE aggregate(zip_with({row}, v, (a, b) -> a * b), 0D, (t, x) -> t + x) / s END)")
    per = cells.join(slides, "slide_id").select("slide_id", "cell_id", u.alias("u"), "rank90")
    quadrant = F.expr("CASE WHEN size(u) < 2 THEN 0 ELSE int(u[0] >= 0) * 2 + int(u[1] >= 0) END")
    return slides.drop("vectors"), per.withColumn("cluster", quadrant)


def orthogonal_pairs(embedded: DataFrame, tol: float = 0.05, width: int | None = None) -> DataFrame:
    """Pairs a < b of a slide whose vectors have a product of at most ``tol`` over the first rank90 entries. ``width``: most
    entries of a vector, counted if not given.

    Of many cells nearly all pairs are results, so all are looked at. The cells of a slide are dealt to buckets of some
    ``BUCKET``, and two buckets meet at a time: no task grows with a slide, and a pair costs products of plain columns."""
    own = cut(embedded.select("slide_id", "cell_id", "u", "rank90").where("cell_id IS NOT NULL"))
    if width is None:
        width = own.agg(F.max(F.size("u"))).first()[0] or 0
    sizes = own.groupBy("slide_id").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("_n"))
    entry = lambda i: F.when(F.lit(i) < F.least("rank90", F.size("u")), F.get("u", F.lit(i))).otherwise(0.0)
    own = own.join(sizes, "slide_id").withColumn("_at", F.pmod(F.xxhash64("cell_id"), F.col("_n")).cast("int"))
    side = lambda k, i, j: own.select("slide_id", i.alias("_i"), j.alias("_j"), F.col("cell_id").alias(f"_{k}"), *[entry(n).alias(f"_{k}{n}") for n in range(width)])
    keys, n = ["slide_id", "_i", "_j"], int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = side("a", F.col("_at"), F.explode(F.sequence("_at", F.col("_n") - 1))).repartition(n, *keys)
    b = side("b", F.explode(F.sequence(F.lit(0), F.col("_at"))), F.col("_at")).repartition(n, *keys)
    dot = sum((F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(width)), F.lit(0.0))
    both = a.join(b.hint("merge"), keys).where("_i < _j OR _a < _b").withColumn("dot", dot).where(F.abs("dot") <= tol)
    return both.select("slide_id", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "dot")


def best_axis(cells: DataFrame, first: str, second: str, flag: str, steps: int = 7) -> DataFrame:
    """By slide: alpha, beta, theta with the best separation of the flagged cells along (alpha * first + beta * second)
    cos theta, the first of equals; the score follows from class moments, so the grid never meets the cells."""
    a, b = F.col(first), F.col(second)
    stats = [F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab")]
    m = cells.groupBy("slide_id", F.col(flag).alias("f")).agg(*stats)
    one = lambda f, k: m.where(F.col("f") == f).select("slide_id", *[F.col(c).alias(f"{c}{k}") for c in ("n", "ma", "mb", "va", "vb", "cab")])
    both = one(True, 1).join(one(False, 0), "slide_id").where("n1 >= 2 and n0 >= 2")
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    both = both.withColumn("i", F.explode(grid)).withColumn("j", F.explode(grid)).withColumn("t", F.explode(grid))
    both = both.withColumns({"alpha": F.lit(-3.0) + 6.0 * F.col("i") / (steps - 1), "beta": F.lit(-3.0) + 6.0 * F.col("j") / (steps - 1), "theta": F.pi() * F.col("t") / (steps - 1)})
    c2 = F.cos("theta") * F.cos("theta")
    var = sum(F.col("alpha") ** 2 * F.col(f"va{k}") + F.col("beta") ** 2 * F.col(f"vb{k}") + 2 * F.col("alpha") * F.col("beta") * F.col(f"cab{k}") for k in "10")
    gap = F.abs(F.col("alpha") * (F.col("ma1") - F.col("ma0")) + F.col("beta") * (F.col("mb1") - F.col("mb0")))
    spread = F.sqrt(F.greatest(var * c2, F.lit(0.0)))
    scored = both.withColumn("s", F.when(spread > 1e-12, F.round(gap * F.abs(F.cos("theta")) / F.nullif(spread, F.lit(0.0)), 9)).otherwise(0.0))
    best = scored.groupBy("slide_id").agg(F.max(F.struct("s", -F.col("i"), -F.col("j"), -F.col("t"), "alpha", "beta", "theta")).alias("m"))
    return best.select("slide_id", F.col("m.alpha").alias("alpha"), F.col("m.beta").alias("beta"), F.col("m.theta").alias("theta"), F.col("m.s").alias("separation"))
