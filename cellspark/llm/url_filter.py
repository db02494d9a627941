"""URL filter: rules first, then a ratio of two character language models.

Each rule is a host and a path prefix with a verdict; it fits the host and all its subdomains if the URL's path starts
with the rule's, and the longest fitting rule decides. URLs that rules decide are also the examples: one variable-order
Markov model is counted over all accepted URLs and one over all rejected ones. Order k predicts a byte from the k bytes
before it, (n(context, byte) + A * p of order k-1) / (n(context) + A). The score of a URL is the difference of the two
log-likelihoods over its length. The threshold is the one with the least balanced error on a quarter of the examples
that the models do not see, read from a histogram; without examples of both kinds the method allows.

Counts are exact: an n-gram has at most ORDERS bytes, so it and its order make one whole number, which is the key of
its counts in a table with one row for each distinct n-gram and context of the examples. URLs meet that table in a join:
blocks of about BLOCK rows ask for their distinct n-grams, and the answers go to the block's URLs, so a task holds the
n-grams of one block and nothing is broadcast. Each row is dealt by the hash of all it carries; equal rows share a block,
which is read as a stream.

Null URLs and URLs without ``://`` have an empty host and path; no rule fits them and the models judge the string as it
is (null: the empty string, score 0). Rows are kept one for one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, release

#: The rules of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
ORDERS, A = 5, 2.0
BIN = 0.005
BLOCK = 5_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _grams(urls: list[str | None]):
    """(URL's index for each byte, per order the keys of (context, byte) and of the context)."""
    raw = [(u or "").encode("utf-8", "replace") for u in urls]
    lengths = np.array([len(r) for r in raw])
    pad = b"\0" * (ORDERS - 1)  # no URL looks into the one before it
    data = np.frombuffer(b"".join(pad + r for r in raw) or b"\0", np.uint8).astype(np.int64)
    starts = np.cumsum(lengths + ORDERS - 1) - lengths
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    keys, context = [], np.zeros(len(at), np.int64)
    for k in range(ORDERS):
        if k:
            context = context | data[at - k] << 8 * k
        keys.append((context | data[at] | 2 * k << 8 * ORDERS, context | 2 * k + 1 << 8 * ORDERS))
    return np.repeat(np.arange(len(raw)), lengths), keys


def _count(examples: DataFrame) -> DataFrame:
    """(key, bad, good) of each n-gram and context of the examples (columns url, kind 0 or 1)."""

    def run(batches):
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            of, keys = _grams(batch.column("url").to_pylist())
            found, place = np.unique(np.concatenate([x for pair in keys for x in pair]), return_inverse=True)
            good = np.tile(kinds[of] == 1, 2 * ORDERS)
            bad, good = (np.bincount(place[own], minlength=len(found)) for own in (~good, good))
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_pydict({n: pa.array(x[at : at + 50_000], pa.int64()) for n, x in (("key", found), ("bad", bad), ("good", good))})

    counted = examples.select("url", "kind").mapInArrow(run, "key long, bad long, good long")
    return counted.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _ratio(keys: np.ndarray, counts: np.ndarray, urls: list[str | None]) -> np.ndarray:
    """Length-normalised log-likelihood of accepted less that of rejected."""
    of, pairs = _grams(urls)

    def seen(x):
        if not len(keys):
            return np.zeros((2, len(x)))
        near = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[near] == x, counts[:, near], 0.0)

    p = np.full((2, len(of)), 1 / 256)
    for gram, whole in pairs:
        p = (seen(gram) + A * p) / (seen(whole) + A)
    logs = np.log(p)
    lengths = np.bincount(of, minlength=len(urls))
    return np.bincount(of, weights=logs[1] - logs[0], minlength=len(urls)) / np.maximum(lengths, 1)


def _scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (url, row) with ratio, by the table ``counts``."""
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("url", F.to_json("row")), F.lit(blocks)))

    def ask(batches):
        block, urls = None, []

        def wanted():
            keys = np.unique(np.concatenate([x for pair in _grams(urls)[1] for x in pair]))
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(part), block)), "key": pa.array(part)})

        for batch in batches:
            of, own = batch.column("block").to_numpy(), batch.column("url").to_pylist()
            at = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(at, at[1:], strict=False):
                if urls and (of[a] != block or len(urls) > 4 * BLOCK):
                    yield from wanted()
                    urls = []
                block = of[a] if b > a else block
                urls += own[a:b]
        if urls:
            yield from wanted()

    def judge_block(batches):
        block, held, model = None, [], None
        for batch in batches:
            of, is_row = batch.column("block").to_numpy(), np.array(batch.column("row").is_valid())
            at = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (is_row[1:] != is_row[:-1])) + 1).tolist(), len(of)]
            for a, b in zip(at, at[1:], strict=False):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if of[a] != block:
                    block, held, model = of[a], [], None
                if not is_row[a]:
                    held.append([part.column(c).to_numpy() for c in ("key", "bad", "good")])
                    continue
                if model is None:
                    key, bad, good = map(np.concatenate, zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 3
                    model, held = (key, np.stack((bad, good)).astype(float)), []
                ratio = pa.array(_ratio(*model, part.column("url").to_pylist()), pa.float64())
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "ratio": ratio})

    asked = dealt.select("block", "url").repartition("block").sortWithinPartitions("block").mapInArrow(ask, "block long, key long").distinct()
    shape = rows.schema["row"].dataType
    none = F.lit(None)
    answers = asked.join(counts, "key").select("block", "key", "bad", "good", none.cast("string").alias("url"), none.cast(shape).alias("row"))
    wanting = dealt.select("block", *(none.cast("long").alias(c) for c in ("key", "bad", "good")), "url", "row")
    met = answers.union(wanting).repartition("block").sortWithinPartitions("block", F.col("row").isNotNull(), "key")
    return met.mapInArrow(judge_block, T.StructType([T.StructField("row", shape), T.StructField("ratio", T.DoubleType())])).select("row.*", "ratio")


def _threshold(examples: DataFrame) -> float:
    """The edge between bins of ``ratio`` with the least mean of both error rates; of several the one nearest 0."""
    rows = examples.groupBy(F.floor(F.col("ratio") / BIN).alias("b")).agg(F.sum(1 - F.col("kind")).alias("bad"), F.sum("kind").alias("good")).collect()
    rows.sort(key=lambda r: r["b"])
    bad, good = sum(r["bad"] for r in rows), sum(r["good"] for r in rows)
    if not bad or not good:
        return 0.0
    best, below_bad, below_good = (0.5, 0.0, rows[0]["b"] * BIN), 0, 0
    for r, after in zip(rows, [*rows[1:], None], strict=True):
        below_bad, below_good = below_bad + r["bad"], below_good + r["good"]
        edge = (r["b"] + 1 + (after["b"] if after else r["b"] + 1)) / 2 * BIN
        best = min(best, ((below_good / good + 1 - below_bad / bad) / 2, abs(edge), edge))
    return best[2]


def judge(pages: DataFrame, rules=RULES, carry=("page_id",)) -> DataFrame:
    """The columns of ``carry``, host, path, rule, ratio, verdict of each row of ``pages``, which has ``url``."""
    host, path = host_path(F.col("url"))
    parsed = pages.select(*dict.fromkeys([*carry, "url"])).withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = [r for r, v in rules if v == "allow"]
    parsed = parsed.withColumns({"_kind": F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed).cast("int")), "_test": F.crc32(F.col("url").cast("binary")) % 4 == 0})
    counts = materialize(_count(parsed.where("_kind is not null and not _test").select("url", F.col("_kind").alias("kind"))))
    names = (*carry, "host", "path", "rule", "_kind", "_test")
    out = materialize(_scored(parsed.select("url", F.struct(*names).alias("row")), counts))
    release(counts)
    sizes = out.where("_kind is not null").groupBy("_kind").agg(F.count("*")).collect()  # two rows
    edge = _threshold(out.where("_kind is not null and _test").withColumnRenamed("_kind", "kind")) if len(sizes) == 2 else -1e300
    own = F.when(F.col("_kind") == 1, "allow").when(F.col("_kind") == 0, "block")
    return out.withColumn("verdict", own.otherwise(F.when(F.col("ratio") >= edge, "allow").otherwise("block"))).drop("_kind", "_test")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", F.col("ratio").alias("log_ratio"))
