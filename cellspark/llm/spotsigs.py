"""SpotSigs: document fingerprints from chains of content words behind common-word anchors.

Each anchor (a common function word) starts a signature: the anchor and the next CHAIN content words after it, of which
every SPACING-th is taken. Words are runs of letters and digits, lower-cased; common words are anchors, not content. A
document's fingerprint is the set of its signatures, each a 32-bit hash. A text with words but without a whole chain
has the hashes of its words as its set, so that short texts compare too; a text without words has the hash of its
characters (the empty text: the empty set). Likeness is the Jaccard coefficient of two sets; that of two empty sets is 1.

``classes`` puts together all documents that likenesses of at least a threshold link. Sets are partitioned by length into
bands, so that only sets whose lengths allow the threshold meet; within a band candidates meet by parity words of their
signatures, which no pair at the threshold can miss. The comparison is pruned: lengths first, then sketches, whose
distance bounds the likeness from above, and only what is left by the exact coefficient. Equal sets are one from the
start, and no bucket is compared pair by pair (see ngram_join, whose rounds these are). Empty sets are linked with nothing.
Likenesses in a class are not stored; those of a document with its edited text and its successor are exact.

Null text: as the empty text. Rows are kept one for one; repeated ids and texts have equal fingerprints. The next
document is the one that follows in (doc_id, text) order, null ids first, and the first follows the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import cluster_sets
from .shared import mix

#: Common function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by can do for from had has have he his if in is it its not of on or said she that the there they this to was were which will with you "
    "aber als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war was wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa se ses son sont sur un une vous y "
    "al como con cuando del el ella ellos entre eran este esta fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también te tiene una uno unos unas".split()
)
CHAIN, SPACING = 2, 1
PERCENT = 80
ROWS, MOST_BUCKETS = 250, 65_536

_words = re.compile(r"[^\W_]+")


def signatures(text: str | None, chain: int = CHAIN, spacing: int = SPACING) -> np.ndarray:
    """The sorted distinct signature hashes of a whole text."""
    words = _words.findall(text.lower()) if text else []
    if not words:
        return np.array([zlib.crc32(text.encode("utf-8", "replace"))] if text else [], np.uint32)
    spots = [i for i, w in enumerate(words) if w not in ANCHORS]
    content = [words[i] for i in spots]
    out, reach, at = set(), (chain - 1) * spacing, 0
    crc, n = zlib.crc32, len(content)
    for i, w in enumerate(words):
        if at < n and spots[at] == i:
            at += 1
        elif at + reach < n:
            out.add(crc(" ".join((w, *content[at : at + reach + 1 : spacing])).encode()))
    if not out:
        out = {crc(w.encode()) for w in words}
    return np.sort(np.fromiter(out, np.uint32, len(out)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def packed(s: np.ndarray) -> str:
    """A fingerprint as text: base64 of its sorted 32-bit hashes."""
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, carry=("doc_id",), chain: int = CHAIN, spacing: int = SPACING) -> DataFrame:
    """The columns of ``carry`` and ``signatures array<long>``."""

    def run(batches):
        for batch in batches:
            sets = [signatures(t, chain, spacing).astype(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {"signatures": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))})

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, kept + "signatures array<long>")


def signature_sets(texts: list[str | None], chain: int = CHAIN, spacing: int = SPACING) -> Iterator[np.ndarray]:
    """The signatures of each text, spread over 64 bits."""
    for text in texts:
        yield np.sort(mix(signatures(text, chain, spacing).astype(np.uint64) + np.uint64(1)))


def classes(docs: DataFrame, percent: int = PERCENT, chain: int = CHAIN, spacing: int = SPACING) -> DataFrame:
    """doc_id, n_signatures and class_id (the least id reachable by likenesses of ``percent``) of every row of ``docs``;
    rows with a null id have a null class."""
    found = cluster_sets(docs, partial(signature_sets, chain=chain, spacing=spacing), percent)
    return found.select("doc_id", F.col("size").alias("n_signatures"), F.col("component_id").alias("class_id"))


def _ranges(docs: DataFrame, rows: int) -> tuple[np.ndarray, int | None]:
    """First id of each bucket but the lowest, taken from the ids themselves, and the first id of all (None: a null)."""
    ids = docs.select("doc_id")
    total, nulls, least = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    buckets = min(MOST_BUCKETS, -(-total // rows))
    if buckets < 2:
        return np.zeros(0, np.int64), None if nulls else least
    found = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0]
    cuts = np.array(sorted({x for x in found or [] if x is not None}), np.int64)  # of doubles, so perhaps no ids

    def firsts(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            place, at = np.unique(np.searchsorted(cuts, own[order], side="right"), return_index=True)
            yield pa.RecordBatch.from_pydict({"range": pa.array(place.astype(np.int32)), "first": pa.array(own[order][at])})

    known = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).mapInArrow(firsts, "range int, first long")
    first = sorted(r["first"] for r in known.groupBy("range").agg(F.min("first").alias("first")).collect())  # a row for each bucket
    return np.array(first[1:], np.int64), None if nulls else least


def edits(docs: DataFrame, rows: int = ROWS, chain: int = CHAIN, spacing: int = SPACING, beside: DataFrame | None = None) -> DataFrame:
    """Each document beside its edited text and its next document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and class_id of ``beside`` (doc_id, class_id; one row an id at most).

    Texts are dealt once, by ranges of doc_id; the first row of a range also goes, as ``tail``, to the range before it.
    Rows of ``beside`` go to the same ranges, so that neither texts nor fingerprints are shuffled again for them.
    There are at most MOST_BUCKETS ranges, whose bounds are all that the driver sees."""
    spark = docs.sparkSession
    bounds, least = _ranges(docs, rows)
    edges = spark.sparkContext.broadcast(bounds)

    def places(ids):
        known, missing = ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(ids.is_null())
        own = np.where(missing, 0, np.searchsorted(edges.value, known, side="right"))
        opens = np.isin(known, edges.value) & ~missing
        opens |= missing if least is None else (known == least) & ~missing
        return own, opens

    def deal(batches):
        for batch in batches:
            own, opens = places(batch.column("doc_id"))
            n, again = batch.num_rows, np.flatnonzero(opens)
            rows_at = pa.array(np.concatenate((np.arange(n), again)))
            bucket = np.concatenate((own, (own[again] - 1) % (len(edges.value) + 1)))
            tail = np.concatenate((np.zeros(n, bool), np.ones(len(again), bool)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(rows_at), "text": batch.column("text").take(rows_at), "bucket": pa.array(bucket, pa.int32()), "tail": pa.array(tail), "class_id": pa.nulls(len(bucket), pa.int64())})

    def deal_beside(batches):
        for batch in batches:
            own, _ = places(batch.column("doc_id"))
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.nulls(n, pa.string()), "bucket": pa.array(own, pa.int32()), "tail": pa.array(np.zeros(n, bool)), "class_id": batch.column("class_id")})

    def compare(batches):
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        last, known = None, (None, None)
        for batch in batches:
            out = []
            for doc, text, bucket, tail, own_class in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail", "class_id")), strict=True):
                if text is None:  # what stands beside the rows of this id, which follow
                    known = (doc, own_class)
                    continue
                if tail and (last is None or last[0] != bucket):
                    continue  # a further tail of this bucket
                own = signatures(text, chain, spacing)
                if last is not None and last[0] == bucket:
                    _, before, old, prints, found = last
                    new = edited(old, text)
                    marks = signatures(new, chain, spacing)
                    out.append((before, len(old), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), packed(prints), packed(marks), likeness(prints, marks), likeness(prints, own), found))
                last = None if tail else (bucket, doc, text, own, known[1] if doc is not None and known[0] == doc else None)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(names, columns, kinds, strict=True)})

    shape = "doc_id long, text string, bucket int, tail boolean, class_id long"
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, shape)
    if beside is not None:
        dealt = dealt.union(beside.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "class_id").mapInArrow(deal_beside, shape))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", F.asc_nulls_first("text"))
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


def op10_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, with likenesses."""
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")
