"""Suffix-array dedup by prefix-free parsing: bytes that a long string covers which also starts earlier are removed.

Parsing. A rolling hash runs over the bytes. Among the hashes inside each WINDOW-byte string the least one (the leftmost
of equal ones) is its trigger, so every such string has a trigger that its bytes alone decide, and equal strings have
equal triggers at equal places. Consecutive string starts with one trigger form a phrase; phrases partition the starts
of a document, and a phrase's text is what its strings cover.

Parse. Its rows (trigger, phrase, document, position) are put in order by trigger and phrase, which is the suffix array
of the parse as deep as one phrase: equal phrases come together, the first occurrence in corpus order enters the
dictionary, all others are removed whole. In very repetitive text nearly all phrases end here.

Dictionary. A phrase whose trigger no other dictionary phrase has is done. Of the others, all phrases of a trigger come
into one task, and their suffixes are ranked by prefix doubling: ranks of 8, 16, 32 and 64 bytes give the rank of WINDOW
bytes, which is the suffix array of the dictionary as deep as a match needs, with bytes compared exactly. Within equal
ranks the corpus order (document, position) decides: all but the first are removed.

Equal phrases of one block are merged before the shuffle, and what is removed there goes out as joined spans, so a phrase
that fills a third of the corpus is one row for each block, and a run of one letter one row. Triggers with over HOT
dictionary phrases are split: each of their suffixes is dealt by the hash of its own bytes, also merged beforehand.
Phrases, and suffixes of such triggers, are compared as 64-bit hashes under an equal 64-bit hash of the trigger; for 10**12
phrases under triggers of 1,000 phrases at most a wrong match has odds of about one to 30,000.

Null and empty texts have no bytes; texts shorter than WINDOW keep all. Equal rows (id and text) are one document and
get one result each. Null ids come first; rows that share an id but not a text follow in the order of a text hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_join import _BASE, _BYTE, _power
from .shared import key_filter, materialize, may_hold, mix, release

WINDOW, GRAM = 100, 32
BYTES, RANKED = 1_000_000, 500_000  # parsed and ranked at once
HOT = 1_000
LOW = np.uint64((1 << 30) - 1)
FIRST, GONE = 0, 1


def _blocks(batches, column: str):
    """(first row, texts as bytes) in blocks of about BYTES, (row, offset, bytes); very long texts in parts."""
    for batch in batches:
        part, size = [], 0
        for row, text in enumerate(batch.column(column).to_pylist()):
            raw = (text or "").encode("utf-8", "replace")
            for at in range(0, max(1, len(raw) - WINDOW + 1), BYTES):
                piece = raw[at : at + BYTES + WINDOW - 1]
                if len(piece) >= WINDOW:
                    part.append((row, at, piece))
                    size += len(piece)
            if size >= BYTES:
                yield batch, part
                part, size = [], 0
        if part:
            yield batch, part


def parse(pieces: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Phrases of texts of at least ``window`` bytes: (text, start, strings less one, distance of the trigger, trigger's
    hash, phrase's hash)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    stops = np.cumsum(lengths)
    starts = stops - lengths
    rolled, step, power = _BYTE[data], 1, int(_BASE)
    while step < gram:
        rolled = rolled[:-step] + np.uint64(power) * rolled[step:]
        power, step = power * power & (1 << 64) - 1, step * 2
    rolled = mix(rolled)
    least = rolled & ~LOW | np.arange(len(rolled), dtype=np.uint64)
    reach, span = window - gram + 1, 1
    while span * 2 <= reach:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    trigger = (least & LOW).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    edge[starts] += 1
    np.add.at(edge, stops - window + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[: len(trigger)] > 0)
    own = trigger[at]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
    first, last, own = at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))], own[new]
    up, down = _power(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
    phrase = mix((sums[last + window] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    text = np.searchsorted(stops, first, side="right")
    return text, first - starts[text], last - first, own - first, rolled[own].view(np.int64), phrase.view(np.int64)


def _rows(schema: dict[str, pa.DataType], *columns):
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns, strict=True)})


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _sorted(columns: dict[str, np.ndarray], by: tuple[str, ...]) -> dict[str, np.ndarray]:
    order = np.lexsort([columns[c] for c in reversed(by)])
    return {c: v[order] for c, v in columns.items()}


_KEY = ("trigger", "phrase")
_PLACE = ("doc", "tie", "at")
_PARSED = {"kind": pa.int8(), "trigger": pa.int64(), "phrase": pa.int64(), "doc": pa.int64(), "tie": pa.int64(), "at": pa.int64()}
_SHAPE = "kind byte, trigger long, phrase long, doc long, tie long, at long"


def _spans(doc: np.ndarray, tie: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Spans of starts (a to b, both included) of documents, those that touch joined."""
    order = np.lexsort((a, tie, doc))
    doc, tie, a, b = doc[order], tie[order], a[order], b[order]
    new = _changes([doc, tie])
    new[1:] |= a[1:] > b[:-1] + 1
    at = np.flatnonzero(new)
    return doc[at], tie[at], a[at], b[np.concatenate((at[1:] - 1, [len(a) - 1]))] if len(at) else b


def _gone(doc, tie, a, b):
    """Rows of spans that are removed; dealt by a hash of their own, as they need no company."""
    doc, tie, a, b = _spans(doc, tie, a, b)
    spread = mix(doc.view(np.uint64) + mix(a.view(np.uint64) + tie.view(np.uint64))).view(np.int64)
    return _rows(_PARSED, np.full(len(doc), GONE, np.int8), spread, b, doc, tie, a << 14)


def _phrases(docs: DataFrame) -> DataFrame:
    """The parse: FIRST rows (trigger, phrase, doc, tie, at = start << 14 | strings less one << 7 | distance of the
    trigger) and GONE rows (any, last start, doc, tie, first start << 14)."""

    def run(batches):
        for batch, part in _blocks(batches, "text"):
            doc, tie = (batch.column(c).to_numpy() for c in ("doc", "tie"))
            text, start, more, off, trigger, phrase = parse([p for _, _, p in part])
            row = np.array([r for r, _, _ in part])[text]
            at = (start + np.array([o for _, o, _ in part])[text]) << 14 | more << 7 | off
            c = _sorted({"trigger": trigger, "phrase": phrase, "doc": doc[row], "tie": tie[row], "at": at}, _KEY + _PLACE)
            first = _changes([c[k] for k in _KEY])
            equal = ~_changes([c[k] for k in _KEY + _PLACE])  # the same place of an equal row
            yield _rows(_PARSED, np.full(first.sum(), FIRST, np.int8), *(c[k][first] for k in _KEY + _PLACE))
            late = ~first & ~equal
            a = c["at"][late] >> 14
            yield _gone(c["doc"][late], c["tie"][late], a, a + (c["at"][late] >> 7 & 127))

    return docs.mapInArrow(run, _SHAPE)


def _dictionary(phrases: DataFrame) -> DataFrame:
    """The parse with FIRST rows only for the first occurrence of each phrase (without its hash, which nothing asks for
    any more); all others are GONE."""

    def run(batches):
        lead = None  # the first row of the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.column("kind").to_numpy() == GONE
            yield batch.filter(pa.array(done))
            c = {k: batch.column(k).to_numpy()[~done] for k in _KEY + _PLACE}
            if not len(c["doc"]):
                continue
            if lead is not None:
                c = {k: np.concatenate((lead[k], v)) for k, v in c.items()}
            new = _changes([c[k] for k in _KEY])
            leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            late = ~new & np.logical_or.reduce([c[k] != c[k][leader] for k in _PLACE])
            keep = new.copy()
            keep[: int(lead is not None)] = False
            n = int(keep.sum())
            yield _rows(_PARSED, np.full(n, FIRST, np.int8), c["trigger"][keep], np.zeros(n, np.int64), *(c[k][keep] for k in _PLACE))
            a = c["at"][late] >> 14
            yield _gone(c["doc"][late], c["tie"][late], a, a + (c["at"][late] >> 7 & 127))
            lead = {k: v[leader[-1] : leader[-1] + 1] for k, v in c.items()}

    return phrases.repartition(*_KEY).sortWithinPartitions("kind", *_KEY, *_PLACE).mapInArrow(run, _SHAPE)


_SUFFIX = {"hot": pa.int8(), "trigger": pa.int64(), "hash": pa.int64(), "doc": pa.int64(), "tie": pa.int64(), "at": pa.int64(), "bytes": pa.binary()}
_FOUND = {"doc": pa.int64(), "tie": pa.int64(), "a": pa.int64(), "b": pa.int64()}
PLAIN, HOT_ONE, DONE = 0, 1, 2


def _strings(raw: list[bytes]):
    """All bytes, and text, start in its text and place in all bytes of each WINDOW-byte string."""
    lengths = np.array([len(r) for r in raw])
    count = lengths - WINDOW + 1
    text = np.repeat(np.arange(len(raw)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(raw), np.uint8), text, start, (np.cumsum(lengths) - lengths)[text] + start


def hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW bytes at each place."""
    up, down = _power(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
    return mix((sums[at + WINDOW] - sums[at]) * down[at]).view(np.int64)


def ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rank of the WINDOW bytes at each place among all of them, in byte order, by prefix doubling."""
    word = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | data[j : j + len(word)]
    rank, width = np.unique(word, return_inverse=True)[1], 8
    while width < WINDOW:
        step = min(width, WINDOW - width)
        rank = np.unique(rank[:-step] * np.int64(len(rank) + 1) + rank[step:], return_inverse=True)[1]
        width += step
    return rank[at]


def _suffixes(docs: DataFrame, first: DataFrame, hot_from: int) -> DataFrame:
    """Spans (doc, tie, a, b) of string starts that the dictionary's own order removes."""
    shared = first.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1")
    marked = first.select("trigger", *_PLACE).join(shared, "trigger").withColumn("hot", F.col("n") > hot_from)
    wanted = marked.groupBy("doc", "tie").agg(F.collect_list(F.struct("trigger", "at", "hot")).alias("w"))  # phrases of one document

    def cut(batches):
        for batch in batches:
            plain, parts = [], []
            for doc, tie, text, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "w")), strict=True):
                raw = text.encode("utf-8", "replace")
                for w in want:
                    start, more = w["at"] >> 14, w["at"] >> 7 & 127
                    (parts if w["hot"] else plain).append((w["trigger"], doc, tie, w["at"], raw[start : start + more + WINDOW]))
                if len(plain) >= 20_000:
                    yield whole(plain)
                    plain = []
            if plain:
                yield whole(plain)
            for lo in range(0, len(parts), 20_000):
                yield from split(parts[lo : lo + 20_000])

    def whole(plain):
        trigger, doc, tie, at, raw = zip(*plain, strict=True)
        return _rows(_SUFFIX, [PLAIN] * len(plain), trigger, [0] * len(plain), doc, tie, at, raw)

    def split(parts):
        trigger, doc, tie, at, raw = zip(*parts, strict=True)
        data, text, start, place = _strings(list(raw))
        trigger, doc, tie, at = (np.array(v, np.int64)[text] for v in (trigger, doc, tie, at))
        key = mix(trigger.view(np.uint64) + ((at & 127) - start).astype(np.uint64)).view(np.int64)
        c = _sorted({"trigger": key, "hash": hashes(data, place), "doc": doc, "tie": tie, "at": (at >> 14) + start}, ("trigger", "hash", *_PLACE))
        new = _changes([c["trigger"], c["hash"]])
        late = ~new & _changes([c[k] for k in ("trigger", "hash", *_PLACE)])
        n = int(new.sum())
        yield _rows(_SUFFIX, [HOT_ONE] * n, c["trigger"][new], c["hash"][new], c["doc"][new], c["tie"][new], c["at"][new], [b""] * n)
        doc, tie, a, b = _spans(c["doc"][late], c["tie"][late], c["at"][late], c["at"][late])
        key = mix(doc.view(np.uint64) + mix(a.view(np.uint64))).view(np.int64)
        yield _rows(_SUFFIX, [DONE] * len(doc), key, b, doc, tie, a, [b""] * len(doc))

    def order(batches):
        held, lead = None, None
        for batch in batches:
            kind = batch.column("hot").to_numpy()
            done = batch.filter(pa.array(kind == DONE))
            yield _rows(_FOUND, done.column("doc"), done.column("tie"), done.column("at"), done.column("hash"))
            if (kind == HOT_ONE).any():
                c = {k: batch.column(k).to_numpy()[kind == HOT_ONE] for k in ("trigger", "hash", *_PLACE)}
                c = c if lead is None else {k: np.concatenate((lead[k], v)) for k, v in c.items()}
                new = _changes([c["trigger"], c["hash"]])
                leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                late = ~new & np.logical_or.reduce([c[k] != c[k][leader] for k in _PLACE])
                yield _rows(_FOUND, *_spans(c["doc"][late], c["tie"][late], c["at"][late], c["at"][late]))
                lead = {k: v[leader[-1] : leader[-1] + 1] for k, v in c.items()}
            plain = batch.filter(pa.array(kind == PLAIN))
            if plain.num_rows:  # the phrases of the last trigger wait for the next batch: HOT at most
                rows = pa.Table.from_batches([plain] if held is None else [held, plain])
                trigger = rows.column("trigger").to_numpy()
                cut_at = int(np.flatnonzero(_changes([trigger]))[-1])
                if cut_at:
                    yield from in_parts(rows.slice(0, cut_at))
                held = rows.slice(cut_at).combine_chunks().to_batches()[0]
        if held is not None:
            yield ranked(pa.Table.from_batches([held]))

    def in_parts(rows):
        """Whole triggers, about RANKED bytes at once, which bounds the memory of ranking."""
        opens = np.flatnonzero(_changes([rows.column("trigger").to_numpy()]))
        size = np.cumsum(pc.binary_length(rows.column("bytes")).to_numpy())
        at = 0
        while at < rows.num_rows:
            most = int(np.searchsorted(size, (size[at - 1] if at else 0) + RANKED, side="right"))
            later = opens[opens > at]
            fitting = later[later <= most]
            end = int(fitting[-1] if len(fitting) and most < rows.num_rows else later[0] if len(later) and most < rows.num_rows else rows.num_rows)
            yield ranked(rows.slice(at, end - at))
            at = end

    def ranked(rows):
        data, text, start, place = _strings(rows.column("bytes").to_pylist())
        doc, tie, at = (rows.column(c).to_numpy()[text] for c in _PLACE)
        c = _sorted({"rank": ranks(data, place), "doc": doc, "tie": tie, "at": (at >> 14) + start}, ("rank", *_PLACE))
        late = ~_changes([c["rank"]]) & _changes([c[k] for k in ("rank", *_PLACE)])
        return _rows(_FOUND, *_spans(c["doc"][late], c["tie"][late], c["at"][late], c["at"][late]))

    cuts = docs.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "w").mapInArrow(cut, "hot byte, trigger long, hash long, doc long, tie long, at long, bytes binary")
    dealt = cuts.repartition("hot", "trigger", "hash").sortWithinPartitions("hot", "trigger", "hash", *_PLACE)
    return dealt.mapInArrow(order, "doc long, tie long, a long, b long")


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with doc and tie, by which rows stand in corpus order. tie is 0 unless an id is null or might repeat, for
    which a filter of fixed size stands; then it is a hash of the text."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    held = key_filter(again, "doc_id")
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")
    if not held.value.any():
        return docs.withColumns({"doc": doc, "tie": F.when(F.col("doc_id").isNull(), text).otherwise(F.lit(0).cast("long"))})

    @F.pandas_udf("boolean")
    def repeats(ids: pd.Series) -> pd.Series:
        return pd.Series(may_hold(held.value, ids.to_numpy(np.int64)))

    return docs.withColumn("doc", doc).withColumn("tie", F.when(F.col("doc_id").isNull() | repeats("doc"), text).otherwise(F.lit(0).cast("long")))


def remove(docs: DataFrame, carry=("doc_id",), hot_from: int = HOT, as_text: bool = False) -> DataFrame:
    """The columns of ``carry``, n_bytes, n_removed, n_spans and kept (binary) of each row of ``docs`` (doc_id, text).

    With ``as_text`` kept is a string, without the parts of characters that a cut has left."""
    rows = _placed(docs.select("doc_id", "text", F.struct(*carry).alias("row"))).select("doc", "tie", "text", "row")
    texts = rows.select("doc", "tie", "text")
    entries = materialize(_dictionary(_phrases(texts)))
    later = _suffixes(texts, entries.where(F.col("kind") == FIRST), hot_from)
    whole = entries.where(F.col("kind") == GONE).select("doc", "tie", F.shiftright("at", 14).alias("a"), F.col("phrase").alias("b"))
    removed = materialize(whole.union(later))
    release(entries)
    spans = removed.groupBy("doc", "tie").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))  # of one document
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string() if as_text else pa.binary()}
    ready = (lambda b: b.decode("utf-8", "ignore")) if as_text else bytes

    def apply(batches):
        for batch in batches:
            out = []
            for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                if not a:
                    out.append((len(raw), 0, 0, ready(raw)))
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, a, 1)
                np.add.at(edge, np.array(b) + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(raw), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), ready(np.frombuffer(raw, np.uint8)[~gone].tobytes())))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row")} | {n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(kinds.items())})

    row = rows.schema["row"].dataType
    shape = T.StructType([T.StructField("row", row)] + [T.StructField(n, T.LongType() if n != "kept" else T.StringType() if as_text else T.BinaryType()) for n in kinds])
    return rows.join(spans, ["doc", "tie"], "left").mapInArrow(apply, shape).select("row.*", *kinds)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What of every document is left, as counts and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
