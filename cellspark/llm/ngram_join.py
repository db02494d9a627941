"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles, as 64-bit hashes. Two sets link when 100 * |both| >= T * |either|, so
they differ in at most D = (|A| + |B|) (100 - T) / (100 + T) shingles.

Candidates. Sizes fall into bands, so that linked sets lie in one band or in neighbours. In a band, D has a bound, and
each set becomes m > D words of 64 parity bits: a shingle belongs to the word that the high part of its hash names and
is XORed into it. A differing shingle disturbs one word, so at least m - D words of linked sets are equal; of these at
least one is not empty unless the empty words of a set alone number m - D, and then the set also keeps its empty words.
A join on (band, word's place, word) therefore misses no link. Within a task, equal sets are linked at once and only one
of them goes on. A document's size and its sketch of 2048 bits come from the same pass over the texts.

Verification, without comparing all members of a bucket. Round 1 compares each member with the first of its bucket,
exactly. Buckets of three and more where that failed go to round 2, which compares with the member that shares most
buckets, usually the original of a family. Where a bucket of at most BLOCK members still holds several components, round 3
compares members of different components by 2048-bit parity sketches, whose Hamming distance is a lower bound of the
difference, and verifies exactly those pairs that the bound lets pass. Members of larger mixed buckets, such as
documents that have half of their text in common, get new keys: 4 (D + 1) finer parity words, of which linked sets share
all but D, so that each needs only the D + 1 rarest of its words. What all have in common is frequent and drops
out, and rounds 2 and 3 go over the small buckets of rare words; only words that even then are both rarest and in over
BLOCK mixed members (documents that all but link) are compared in blocks of BLOCK by BLOCK. Every pair that might link and
whose ends are not yet connected is thus tried, and components are those of all links. Before whole sets are made, the
sketches rule out most unlike pairs; the sets of the others come from one pass over the texts, which a filter of fixed size
keeps to the documents named, so texts are never shuffled. Shingles are compared as 64-bit hashes: for two sets of a
thousand shingles each a wrong match has odds of about one to 10**13.

No words or null text: size 0, linked with nothing. Fewer words than a shingle has: the whole sequence is one shingle.
Equal ids are one node; rows with a null id are in no link and have a null component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import key_filter, materialize, may_hold, mix, release

WORDS, PERCENT = 3, 90
BLOCK = 256
LEAST_KEYS = 8
SKETCH_BITS = 2048
TEXTS = 1_000_000  # bytes hashed at once
KNOWN = 100_000  # sets whose hash a task remembers
KEY, PAIR, SIZE = 0, 1, 2

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            _powers[name] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))))
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def _shingles(raw: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_at = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    up, down = _power(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
    word = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    of = np.searchsorted(begin, ends_at)  # words before the end of each text
    roll, length = np.zeros(max(0, len(word) - words + 1), np.uint64), len(word) - words + 1
    for j in range(words):
        if length > 0:
            roll = mix(roll * np.uint64(3) + word[j : j + length])
    at = 0
    for stop in of.tolist():
        if stop - at >= words:
            yield np.unique(roll[at : stop - words + 1])
        elif stop > at:
            one = np.zeros(1, np.uint64)
            for w in word[at:stop]:
                one = mix(one * np.uint64(5) + w)
            yield one
        else:
            yield np.zeros(0, np.uint64)
        at = stop


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A to Z lower-cased, words split at ASCII white space."""
    block, size = [], 0
    for t in texts:
        block.append((t or "").encode("utf-8", "replace").lower())
        size += len(block[-1])
        if size >= TEXTS:
            yield from _shingles(block, words)
            block, size = [], 0
    if block:
        yield from _shingles(block, words)


class Bands:
    """Size bands of a threshold in percent: bounds, the most differences and the number of parity words of each; 4 (D + 1)
    words where ``fine``."""

    def __init__(self, percent: int, fine: bool = False):
        self.percent, self.fine = percent, fine
        self.low, self.parts = [1], []

    def most(self, total: int) -> int:
        """How many shingles linked sets of these sizes together may differ in."""
        return total * (100 - self.percent) // (100 + self.percent)

    def band(self, n: int) -> int:
        """The band of a size."""
        while self.low[-1] <= n:
            low = self.low[-1]
            high = low * 100 // self.percent
            self.low.append(high + 1)
            d = self.most(high + high * 100 // self.percent)
            m = 4 * (d + 1) if self.fine else d + 1 + (d > 0)
            while d and not self.fine and m < 2 * d + 2 and m - d <= 1.6 * m * np.exp(-low / m) + 1:
                m += 1
            self.parts.append((d, m))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def of(self, n: int) -> list[int]:
        """The bands in which a set of this size meets others."""
        k = self.band(n)
        return [k, k - 1] if k and self.percent * n <= 100 * (self.low[k] - 1) else [k]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The join keys of a set."""
        out, inner = [], mix(s ^ np.uint64(0x5DEECE66D1234567))
        for k in self.of(len(s)):
            d, m = self.parts[k]
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            value, place = np.bitwise_xor.reduceat(inner, first), part[first]
            if m - len(place) >= m - d:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), place)
                value, place = np.concatenate((value, np.zeros(len(empty), np.uint64))), np.concatenate((place, empty))
            out.append(mix(value + mix(place * np.uint64(1 << 20) + np.uint64(k + 1))))
        return np.unique(np.concatenate(out)).view(np.int64)


    def words(self, s: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(band, most differences, keys of all parity words, the empty ones too) of a set in each of its bands."""
        inner = mix(s ^ np.uint64(0x5DEECE66D1234567))
        for k in self.of(len(s)):
            d, m = self.parts[k]
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            value = np.zeros(m, np.uint64)
            value[part[first].astype(np.int64)] = np.bitwise_xor.reduceat(inner, first)
            place = np.arange(m, dtype=np.uint64)
            yield k, d, mix(value + mix(place * np.uint64(1 << 20) + np.uint64(k + 1))).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits of a set as 64-bit words: each shingle flips one bit."""
    bit = mix(s + np.uint64(77)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _runs(batches, keys: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of equal keys in sorted batches."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, *rest)}
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        new[0] = not held or any(held[-1][k][-1] != cols[k][0] for k in keys)
        at = np.flatnonzero(new).tolist()
        for a, b in zip([0, *at], [*at, batch.num_rows], strict=True):
            if a in (at[:1] or [-1]) or (at and a >= at[0]):
                if held:
                    yield {c: np.concatenate([h[c] for h in held]) for c in cols}
                held = []
            if b > a:
                held.append({c: v[a:b] for c, v in cols.items()})
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of longs as a column of lists."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _meet(docs: DataFrame, sets_of, percent: int) -> DataFrame:
    """Rows (kind, key, a, b, bits): sizes and sketches of documents (SIZE: a, b, bits), equal sets within a task (PAIR:
    a, b), and pairs of the first and another member of each bucket (KEY: key, a, b)."""

    def keys(batches):
        bands, known = Bands(percent), {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            sets = iter(sets_of(batch.column("text").to_pylist()))
            for at in range(0, len(ids), 500):
                own, key, of, pairs = ids[at : at + 500], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                sizes, bits = [], []
                for doc, s in zip(own, sets, strict=False):
                    sizes.append(len(s))
                    bits.append(sketch(s).view(np.int64))
                    if len(s):
                        mark = s.tobytes() if len(s) < 4 else (len(s), int(np.bitwise_xor.reduce(mix(s))), int(np.add.reduce(mix(s + np.uint64(9)))))
                        if (first := known.setdefault(mark, doc)) != doc:
                            pairs.append((first, doc))
                        else:
                            key.append(bands.keys(s))
                            of.append(np.full(len(key[-1]), doc, np.int64))
                        if len(known) > KNOWN:
                            known.clear()
                key, of = np.concatenate(key), np.concatenate(of)
                yield rows(key, of, None, None)
                doc = np.array(own, np.int64)
                yield rows(spread(doc), doc, np.array(sizes, np.int64), bits)
                if pairs:
                    a, b = np.array(pairs, np.int64).T
                    yield rows(spread(b), a, b, [bits[0][:0]] * len(pairs))

    def spread(doc):
        return mix(doc.view(np.uint64) + np.uint64(3)).view(np.int64)

    def rows(key, a, b, bits):
        none = pa.nulls(len(key), pa.int64())
        marks = pa.nulls(len(key), pa.list_(pa.int64())) if bits is None else _lists(bits)
        return pa.RecordBatch.from_pydict({"key": pa.array(key), "a": pa.array(a), "b": none if b is None else pa.array(b), "bits": marks})

    def first(batches):
        last, leader = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            other = np.array(batch.column("b").is_valid())
            done = batch.filter(pa.array(other))
            if done.num_rows:
                kind = np.where(np.diff(done.column("bits").offsets.to_numpy()) > 0, SIZE, PAIR).astype(np.int8)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(kind)} | {c: done.column(c) for c in ("key", "a", "b", "bits")})
            k, d = (batch.column(c).to_numpy()[~other] for c in ("key", "a"))
            if len(k):
                new = np.concatenate(([last is None or k[0] != last], k[1:] != k[:-1]))
                at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                lead = np.where(at < 0, leader, d[at])
                last, leader = k[-1], lead[-1]
                pair = ~new & (lead != d)
                n = int(pair.sum())
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(n, KEY, np.int8)), "key": pa.array(k[pair]), "a": pa.array(lead[pair]), "b": pa.array(d[pair]), "bits": pa.nulls(n, pa.list_(pa.int64()))})

    shape = "key long, a long, b long, bits array<long>"
    met = docs.select("doc_id", "text").mapInArrow(keys, shape)
    return met.repartition("key").sortWithinPartitions("key", "a").mapInArrow(first, "kind byte, " + shape)


def _sets(docs: DataFrame, ids: DataFrame, sets_of) -> DataFrame:
    """doc_id and set of the documents named in ``ids`` (and of a few others), from one pass over the texts."""
    held = key_filter(ids, "doc_id")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held.value, batch.column("doc_id").to_numpy())))
            if batch.num_rows:
                sets = [s.view(np.int64) for s in sets_of(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "s": _lists(sets)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame, sets_of, percent: int) -> DataFrame:
    """The distinct pairs (a, b) with whether they link. Sketches that differ in more bits than linked sets may in
    shingles settle most of the others, so that whole sets are made only where a link is likely."""
    x, y = (marks.select(F.col("doc_id").alias(k), F.col("size").alias(f"n{k}"), F.col("bits").alias(f"b{k}")) for k in "ab")
    apart = F.expr("aggregate(zip_with(ba, bb, (x, y) -> bit_count(x ^ y)), 0, (t, v) -> t + v)")
    near = apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    judged = materialize(pairs.select("a", "b").distinct().join(x, "a").join(y, "b").select("a", "b", near.alias("near")))
    likely = judged.where("near")
    sets = materialize(_sets(docs, likely.select(F.col("a").alias("doc_id")).union(likely.select("b")), sets_of))
    u, v = (sets.select(F.col("doc_id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    exact = likely.join(u, "a").join(v, "b").select("a", "b", (both * 100 >= percent * (F.size("sa") + F.size("sb") - both)).alias("linked"))
    found = materialize(exact.union(judged.where("not near").select("a", "b", F.lit(False).alias("linked"))))
    release(judged, sets)
    return found


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of ``doc_id``, itself if it has none."""
    found = labels.select(F.col("node").alias("doc_id"), F.col("component"))
    return rows.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _across(members: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sketches do not rule a link out, from (key, n, doc_id, component)
    and the sketches of ``marks``: all members of buckets of up to BLOCK, of larger ones in blocks, each of which meets each other block.

    A pair that shares several buckets is left to the least of them where that is known from the LEAST_KEYS least keys of
    both, so that similar documents do not come out once for every key they share."""

    def compare(batches):
        bands = Bands(percent)
        for run in _runs(batches, ("key", "i", "j"), ("own", "doc_id", "component", "size", "bits", "least")):
            i, j, key = run["i"][0], run["j"][0], run["key"][0]
            left, right = np.flatnonzero(run["own"] == i), np.flatnonzero(run["own"] == j)
            bits = np.stack(list(run["bits"])).view(np.uint64)
            out = []
            for x in left.tolist():
                y = right[(right > x) if i == j else slice(None)]
                y = y[run["component"][y] != run["component"][x]]
                total = run["size"][y] + run["size"][x]
                y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(1) <= total * (100 - bands.percent) // (100 + bands.percent)]
                mine = {k for k in run["least"][x].tolist() if k < key}
                out += [(run["doc_id"][x], run["doc_id"][k]) for k in y.tolist() if not mine.intersection(run["least"][k].tolist())]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    least = members.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))  # of one document
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(least, "doc_id").join(marks, "doc_id").withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("key", "i", "j", "own", "doc_id", "component", "size", "bits", "least")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def _rare_words(docs: DataFrame, ids: DataFrame, sets_of, percent: int) -> DataFrame:
    """(key, doc_id): of the fine parity words of the documents named in ``ids``, the D + 1 rarest of each in each band."""
    held = key_filter(ids, "doc_id")

    def run(batches):
        bands = Bands(percent, fine=True)
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held.value, batch.column("doc_id").to_numpy())))
            sets = sets_of(batch.column("text").to_pylist()) if batch.num_rows else ()
            words = [(doc, band, d + 1, key) for doc, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True) if len(s) for band, d, key in bands.words(s)]
            for at in range(0, len(words), 500):
                *heads, keys = zip(*words[at : at + 500], strict=True)
                heads = [np.repeat(np.array(h, np.int64), [len(k) for k in keys]) for h in heads]
                yield pa.RecordBatch.from_pydict({n: pa.array(h) for n, h in zip(("doc_id", "band", "keep", "key"), (*heads, np.concatenate(keys)), strict=True)})

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, band long, keep long, key long").distinct()
    rows = materialize(rows.join(ids.distinct(), "doc_id", "left_semi"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    words = rows.join(counts, "key").groupBy("doc_id", "band", "keep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("w"))  # of one document
    rare = words.select("doc_id", F.explode(F.slice("w", F.lit(1), F.col("keep").cast("int"))).alias("w")).where("w.n > 1")
    found = materialize(rare.select(F.col("w.key").alias("key"), "doc_id").distinct())
    release(rows)
    return found


def _rounds(members: DataFrame, links: DataFrame, labels: DataFrame, docs: DataFrame, marks: DataFrame, sets_of, percent: int, fine: bool = False) -> DataFrame:
    """Labels after rounds 2 and 3 over the buckets ``members`` (key, doc_id)."""
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(counts, "key"))
    if members.isEmpty():
        return labels
    shared = members.groupBy("doc_id").agg(F.sum("n").alias("shared"))
    lead = members.join(shared, "doc_id").groupBy("key").agg(F.max(F.struct("shared", -F.col("doc_id"), "doc_id")).alias("m")).select("key", F.col("m.doc_id").alias("lead"))
    own = _labelled(members, labels)
    to = _labelled(lead.withColumnRenamed("lead", "doc_id"), labels).select("key", F.col("doc_id").alias("lead"), F.col("component").alias("lead_component"))
    second = own.join(to, "key").where("component <> lead_component").select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b"))
    again = _verified(second, docs, marks, sets_of, percent)
    links = links.union(again.where("linked").select("a", "b"))
    labels = components(links)

    own = materialize(_labelled(members.select("key", "doc_id"), labels))
    mixed = own.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "n")
    mixed = materialize(mixed)
    near = mixed if fine else mixed.where(F.col("n") <= BLOCK)
    third = _across(materialize(own.join(near, "key")), marks, percent)
    found = _verified(third, docs, marks, sets_of, percent)
    links = links.union(found.where("linked").select("a", "b"))
    labels = components(links)
    large = mixed.where(F.col("n") > BLOCK)
    if not fine and not large.isEmpty():
        words = _rare_words(docs, own.join(large, "key").select("doc_id"), sets_of, percent)
        labels = _rounds(words, links, labels, docs, marks, sets_of, percent, True)
        release(words)
    release(members, again, own, mixed, found)
    return labels


def cluster(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``, which has doc_id and text."""
    return cluster_sets(docs, partial(shingle_sets, words=words), percent).withColumnRenamed("size", "n_shingles")


def cluster_sets(docs: DataFrame, sets_of: Callable[[list], Iterable[np.ndarray]], percent: int) -> DataFrame:
    """doc_id, size and component_id of every row of ``docs`` (doc_id, text), where ``sets_of`` gives for a list of texts
    the sorted distinct 64-bit hashes of each."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = materialize(_meet(named, sets_of, percent))
    buckets = met.where(F.col("kind") == KEY).select("key", "a", "b")
    equal = met.where(F.col("kind") == PAIR).select("a", "b")
    sizes = met.where(F.col("kind") == SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("size"), "bits")
    marks = sizes.where("size > 0")
    tried = _verified(buckets, named, marks, sets_of, percent)
    links = equal.union(tried.where("linked").select("a", "b"))
    labels = components(links)

    open_keys = buckets.join(tried.where("not linked"), ["a", "b"]).select("key").distinct()
    inside = materialize(buckets.join(open_keys, "key", "left_semi"))
    members = inside.select("key", F.col("b").alias("doc_id")).union(inside.select("key", "a").distinct()).distinct()
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    labels = _rounds(members.join(counts, "key", "left_semi"), links, labels, named, marks, sets_of, percent)
    release(tried, inside)
    out = _labelled(sizes.select("doc_id", "size"), labels).withColumnRenamed("component", "component_id")
    return out.union(_nameless(docs, sets_of))


def _nameless(docs: DataFrame, sets_of) -> DataFrame:
    """Sizes of the rows with a null id."""

    def run(batches):
        for batch in batches:
            n = [len(s) for s in sets_of(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(n), pa.int64()), "size": pa.array(n, pa.int64()), "component_id": pa.nulls(len(n), pa.int64())})

    return docs.where("doc_id is null").select("text").mapInArrow(run, "doc_id long, size long, component_id long")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Size and component of every document under links of 90 percent of three-word shingles."""
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
