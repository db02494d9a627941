"""Slide aggregates: distributions, entropy, inequality, class counts, validation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import buckets, finite

#: Bounds of the readings and their names.
NAI = ([0.2, 0.4, 0.6], ["low", "mild", "moderate", "high"])
TADS = ([1.5, 2.5, 3.5], ["organized", "mild", "moderate", "severe"])
SKEW = ([-0.5, 0.5, 1.5], ["dispersed", "uniform", "clustered", "focal"])
THS = ([0.2, 0.4, 0.6], ["homogeneous", "mild", "moderate", "heterogeneous"])


def median(v: Column) -> Column:
    """Exact median over finite values, 0 without any."""
    return F.coalesce(F.percentile(F.when(finite(v), v), F.lit(0.5)), F.lit(0.0))


def upper_median(df: DataFrame, value: str, keys=("slide_id",)) -> DataFrame:
    """The element in the middle of each group, the upper of two."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").alias("upper_median"))


def distribution(df: DataFrame, value: str, keys=("slide_id",)) -> DataFrame:
    """Count, mean, population deviation, least, largest, quartiles and range between them."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    return out.select(*keys, "n", "mean", "std", "least", "most", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)], (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def entropy(df: DataFrame, value: str, bins: int = 20, keys=("slide_id",)) -> DataFrame:
    """Shannon entropy (nats) of an equal-width histogram between the extremes; 0 for one value."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins))
    counts = df.join(ends, list(keys)).groupBy(*keys, F.coalesce(place, F.lit(0)).alias("_b")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    p = F.col("_c") / F.col("_n")
    return counts.groupBy(*keys).agg((-F.sum(p * F.ln(p)) + 0.0).alias("entropy"))


def ranked(df: DataFrame, value: str, keys=("slide_id",), rows: int = 1_000) -> DataFrame:
    """``df`` with _rank, the place (from 1) of each row in its group in ascending order of ``value``.

    A group is cut into buckets between its extremes, about ``rows`` rows each if values are even, so that rows are sorted
    within a bucket and only the buckets' counts along the group."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.ceil(F.count("*") / rows).alias("_parts"))
    place = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * F.col("_parts"))
    own = df.join(ends, list(keys)).withColumn("_b", F.coalesce(place, F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(value))
    return own.withColumn("_i", within).join(sums, [*keys, "_b"]).withColumn("_rank", F.col("_before") + F.col("_i")).select(*df.columns, "_rank")


def gini(df: DataFrame, value: str, keys=("slide_id",)) -> DataFrame:
    """2 sum(rank x) / (n sum x) - (n + 1) / n over ascending ranks; 0 where the sum is 0."""
    own = ranked(df.select(*keys, value), value, keys)
    sums = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.sum(F.col("_rank") * F.col(value)).alias("_w"))
    n = F.col("_n")
    return sums.select(*keys, F.coalesce(2 * F.col("_w") / F.nullif(n * F.col("_s"), F.lit(0.0)) - (n + 1) / n, F.lit(0.0)).alias("gini"))


def _skew(value: str) -> Column:
    return F.when(F.stddev_pop(value) > 1e-12, F.skewness(value)).otherwise(0.0).alias("skew")


def skewness(df: DataFrame, value: str, keys=("slide_id",)) -> DataFrame:
    """Population skewness; 0 for one value."""
    return df.groupBy(*keys).agg(_skew(value))


def _counts(label: str) -> list[Column]:
    low = F.lower(F.trim(label))
    return [F.count("*").alias("n"), F.count_if(low == "malignant").alias("malignant"), F.count_if(low == "immune").alias("immune")]


def _shares(out: DataFrame) -> DataFrame:
    out = out.withColumn("normal", F.col("n") - F.col("malignant") - F.col("immune"))
    return out.withColumns({f"{c}_fraction": F.col(c) / F.col("n") for c in ("malignant", "immune", "normal")})


def class_counts(df: DataFrame, label: str = "clinical", keys=("slide_id",)) -> DataFrame:
    """Counts and shares of malignant, immune and all other labels, trimmed and without case."""
    return _shares(df.groupBy(*keys).agg(*_counts(label)))


def biomarkers(df: DataFrame) -> DataFrame:
    """One row by slide: class counts, atypia, disruption, infiltration skew and heterogeneity with their readings.

    ``df``: slide_id, clinical, circularity, eccentricity, knn_density, rbf_risk_score."""
    own = df.withColumn("atypia", 0.5 * (1 - F.col("circularity")) + 0.5 * F.col("eccentricity"))
    out = _shares(own.groupBy("slide_id").agg(*_counts("clinical"), F.avg("atypia").alias("nai"), F.stddev_pop("atypia").alias("nai_std"), _skew("knn_density")))
    out = out.join(entropy(own, "rbf_risk_score").withColumnRenamed("entropy", "tads"), "slide_id").join(gini(own, "eccentricity").withColumnRenamed("gini", "ths"), "slide_id")
    reads = {"nai_reading": ("nai", NAI), "tads_reading": ("tads", TADS), "skew_reading": ("skew", SKEW), "ths_reading": ("ths", THS)}
    return out.withColumns({n: buckets(F.col(c), *b) for n, (c, b) in reads.items()})


def clustering(cells: DataFrame, nearest: DataFrame) -> DataFrame:
    """By slide: mean nearest distance over its expectation for a random pattern, and the share of immune-tumour pairs.

    ``cells``: slide_id, cell_id, centroid_x, centroid_y, label. ``nearest``: slide_id, src, dst, d."""
    box = cells.groupBy("slide_id").agg(F.count("*").alias("n"), F.greatest((F.max("centroid_x") - F.min("centroid_x")) * (F.max("centroid_y") - F.min("centroid_y")), F.lit(1e-9)).alias("box"))
    a = cells.select("slide_id", F.col("cell_id").alias("src"), F.col("label").alias("la"))
    b = cells.select("slide_id", F.col("cell_id").alias("dst"), F.col("label").alias("lb"))
    kind = lambda c: F.when(F.col(c).isin("Inflammatory", "Lymphocyte"), "i").when(F.col(c) == "Epithelial_Malignant", "t").otherwise("o")
    e = nearest.join(a, ["slide_id", "src"]).join(b, ["slide_id", "dst"]).withColumns({"ka": kind("la"), "kb": kind("lb")})
    mixed = F.concat("ka", "kb").isin("it", "ti")
    sums = e.groupBy("slide_id").agg(F.avg("d").alias("seen"), F.count_if(mixed).alias("immune_tumor_edges"), F.greatest(F.count_if((F.col("ka") != "o") | (F.col("kb") != "o")), F.lit(1)).alias("eligible_edges"))
    out = box.join(sums, "slide_id", "left")
    expected = F.greatest(0.5 * F.sqrt(F.col("box") / F.col("n")), F.lit(1e-9))
    return out.select("slide_id", F.coalesce(F.col("seen") / expected, F.lit(1.0)).alias("global_ci"), F.coalesce("immune_tumor_edges", F.lit(0)).alias("immune_tumor_edges"), F.coalesce("eligible_edges", F.lit(1)).alias("eligible_edges")).withColumn("mixing", F.col("immune_tumor_edges") / F.col("eligible_edges"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: counts and precision, recall, specificity, F1, accuracy (0 where undefined)."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumns({"precision": over("tp", F.col("tp") + F.col("fp")), "recall": over("tp", F.col("tp") + F.col("fn")), "specificity": over("tn", F.col("tn") + F.col("fp"))})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.withColumns({"f1": f1, "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def auc(df: DataFrame, truth: str, value: str, steps: int = 101) -> DataFrame:
    """One row: area under the curve by trapezoids over equally spaced thresholds.

    Each row counts once, at the highest threshold it reaches; running sums give all thresholds."""
    place = F.floor(F.least(F.greatest(F.col(value), F.lit(-1e-9)), F.lit(1.0)) * (steps - 1) + 1e-9).cast("int")
    at = df.groupBy(place.alias("t")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("t")).join(at, "t", "left")  # ``steps`` rows
    down = Window.orderBy(F.desc("t"))
    total = df.agg(F.count_if(F.col(truth) == 1).alias("tp"), F.count_if(F.col(truth) != 1).alias("tn"))
    run = grid.withColumns({"cp": F.sum(F.coalesce("p", F.lit(0))).over(down), "cn": F.sum(F.coalesce("n", F.lit(0))).over(down)}).crossJoin(total)
    run = run.withColumns({"tpr": F.col("cp") / F.col("tp"), "fpr": F.col("cn") / F.col("tn")})
    before = run.withColumns({"pt": F.coalesce(F.lag("tpr").over(down), F.lit(0.0)), "pf": F.coalesce(F.lag("fpr").over(down), F.lit(0.0))})
    return before.agg(F.sum((F.col("fpr") - F.col("pf")) * (F.col("tpr") + F.col("pt")) / 2).alias("auc"))


def tolerance(df: DataFrame, shift: str, ratio: str) -> DataFrame:
    """One row: median and 95th percentile of shifts and area ratios, and the verdict."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.95)))
    out = df.agg(F.count("*").alias("n"), q(shift).alias("s"), q(ratio).alias("a"))
    out = out.select("n", F.col("s")[0].alias("shift_median"), F.col("s")[1].alias("shift_p95"), F.col("a")[0].alias("ratio_median"), F.col("a")[1].alias("ratio_p95"))
    return out.withColumn("verdict", F.when((F.col("shift_p95") <= 1.0) & F.col("ratio_median").between(0.95, 1.05), "PASS").otherwise("REVIEW"))


def bridge(df: DataFrame, value: str = "area", keys=("slide_id",)) -> DataFrame:
    """Mean over median of floored values, its logarithm, and their geometric mean."""
    v = F.greatest(F.col(value), F.lit(1e-18))
    out = df.groupBy(*keys).agg(F.avg(v).alias("macro"), F.percentile(v, F.lit(0.5)).alias("micro"))
    out = out.withColumn("ratio", F.when(F.col("micro") > 1e-18, F.col("macro") / F.col("micro")).otherwise(0.0))
    return out.withColumns({"lambda": F.when(F.col("ratio") > 0, F.ln("ratio")).otherwise(0.0), "geometric_mean": F.sqrt(F.col("macro") * F.col("micro"))})


def gram(df: DataFrame, columns: list[str], keys=("slide_id",)) -> DataFrame:
    """Sums of products of each two columns: the Gram matrix, one partial row for each task."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])


def incoming_attention(df: DataFrame) -> DataFrame:
    """Mean weight by target node; only the second layer where a layer column is present."""
    rows = df.where("layer = 'layer2'") if "layer" in df.columns else df
    return rows.groupBy("target_node").agg(F.avg("alpha_weight").alias("attention"))


def slide_summary(df: DataFrame) -> DataFrame:
    """Counts by label and mean and deviation of field and eccentricity."""
    low = F.lower("clinical")
    return df.groupBy("slide_id").agg(
        F.count("*").alias("total"), F.count_if(low == "malignant").alias("malignant"), F.count_if(low == "normal").alias("normal"), F.avg("rbf_risk_score").alias("mean_rbf"),
        F.avg("eccentricity").alias("mean_ecc"), F.stddev_pop("eccentricity").alias("std_ecc"),
    )
