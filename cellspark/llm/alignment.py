"""Which tokens of one vocabulary stand for which of another, counted over a corpus.

Two tokenizers, A (a byte-level BPE of the tokenizers library) and B (a sentencepiece model), encode a text; the byte
offsets where a token of each ends cut both encodings into groups. Every A and B token of a group are linked. An id
pair's count is the number of documents that hold it linked, over all documents.

Encoding. White space behind another character begins a new match of A's pattern, and no piece of B holds a space or a
line break behind another character; the same holds for a stop or comma behind a letter. So texts are cut there, each
stretch is encoded by itself, and a worker keeps a bounded cache of what it has seen. ``Aligner`` checks B's pieces and
A's kind and otherwise takes whole texts. B's model is
read without its prefix space, which is part of the stretch.

Counting. Each document's distinct pairs and their multiplicities are its postings; ``align`` gives them with the
document's figures, and they are written once. They are shuffled by A id, packed into blocks of many documents. A
cogroup, in the order of Spark's sort, which spills, reads first the counts of some A ids' pairs, with the maximum of
each A id, then their postings, block by block, and puts out what each gives its document; these are summed by document.
Counts are summed beforehand task by task, and bounded by the vocabularies, not by the corpus. An A id's postings may be
any number: its group is dealt to as many places as its postings need, each of which gets the counts again.

Null text, empty text, and texts that one of the tokenizers does not give back byte for byte: no tokens, all zeros, an
empty digest. Repeated rows and ids are documents of their own; ids may be null; no other column is read. A text of any
length goes through at once, in one task. Ties: all pairs with an A id's highest count are best. An empty table gives no
rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import _field
from .shared import materialize, mix, table
from .token_counts import byte_symbols

VOCABULARIES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE, SHORT, EXPANDED, LEARNED = 200_000, 400, 4096, 32
GROUPS, BLOCK, PART, PACKED = 16, 1 << 20, 2_000_000, 1 << 16

TOGETHER, DIFFERENT = 256, "!"
NOTHING = [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)

_aligners: dict[tuple[str, str], Aligner] = {}


class Kept(dict):
    """A cache of two generations: what is found in the one before moves into this one."""

    before: dict = {}

    def __missing__(self, key):
        self[key] = found = self.before[key]
        return found


class Aligner:
    """Encodes texts by two vocabularies and cuts them into groups; one for each worker and pair of files."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_b, "rb") as f:
            model = f.read()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model + _field(3, _field(3, 0)))  # no prefix space
        byte = {c: i for i, c in enumerate(byte_symbols())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in map(names.get, range(max(names) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        #: What stands for an id in a group's text: A and B ids inside a run, and at its end.
        self.said = [f"{i}{mark}" for n, mark in ((len(self.len_a), ","), (len(self.len_a), "|"), (len(self.len_b), ","), (len(self.len_b), ";")) for i in range(n)]
        self.said_from = np.cumsum([0, len(self.len_a), len(self.len_a), len(self.len_b)])
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        apart = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        apart = apart and not any(p[i] in "▁ \n" and p[i - 1] not in "▁ \n" for p, b in zip(pieces, self.bytes_b, strict=True) if len(b) > 1 for i in range(1, len(p)))
        apart = apart and not any("\n" in p for p in pieces)
        #: Up to the next space or line break that follows no white space.
        # Marks that begin a match of A and a piece of B behind a letter.
        marks = "".join(c for c in ".,;:!?" if not any(p[i] == c and p[i - 1].isalpha() for p in pieces for i in range(1, len(p))))
        words = rf"\s*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[{marks}])|" if marks else ""
        self.stretches = re.compile(words + r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+") if apart else re.compile(r"(?s).+")
        self.apart, self.cache = apart, Kept()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B; None where their bytes are not the text's."""
        a, b, raw = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text), text.encode("utf-8", "replace")
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else None

    def figures(self, stretches: list[str]) -> list[tuple[str, bytes, int]] | None:
        """Of each stretch: its groups as text, its pairs (A id << 32 | B id, then the multiplicity), packed, and the
        numbers of its A and B ids, as n_a << 32 | n_b. The stretches are encoded as one text; None where its bytes
        come out differently, or where one of them ends inside a group."""
        if (ids := self.encode("".join(stretches))) is None:
            return None
        a, b = (np.array(x, np.int64) for x in ids)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.cumsum([len(s.encode("utf-8", "replace")) for s in stretches])
        last = np.searchsorted(common, ends)
        if not np.array_equal(common[np.minimum(last, len(common) - 1)], ends):
            return None
        # Ids of A and of B before the end of each group, and of each group.
        to_a, to_b = (np.searchsorted(e, common) + 1 for e in (ends_a, ends_b))
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # The text: a group's A ids, then its B ids, each with what follows it.
        words = np.empty(len(a) + len(b), np.int64)
        kind_a, kind_b = np.zeros(len(a), np.int64), np.full(len(b), 2)
        kind_a[to_a - 1], kind_b[to_b - 1] = 1, 3
        words[np.arange(len(a)) + np.repeat(to_b - n_b, n_a)] = self.said_from[kind_a] + a
        words[np.arange(len(b)) + np.repeat(to_a, n_b)] = self.said_from[kind_b] + b
        said, upto = list(map(self.said.__getitem__, words.tolist())), (to_a + to_b)[last].tolist()
        # The pairs: every A id of a group with every B id.
        links, many = n_a * n_b, np.repeat(n_b, n_a)
        if links.max() > EXPANDED:
            pairs = [b"".join(multiplied(a[i - n : i].tolist(), b[j - m : j].tolist()) for i, n, j, m in zip(to_a[g:h].tolist(), n_a[g:h].tolist(), to_b[g:h].tolist(), n_b[g:h].tolist(), strict=True)) for g, h in zip([0, *(last[:-1] + 1).tolist()], (last + 1).tolist(), strict=True)]
        else:
            packed = np.ones((int(links.sum()), 2), np.int64)
            packed[:, 0] = np.repeat(a, many) << 32 | b[np.repeat(np.repeat(to_b - n_b, n_a) - np.cumsum(many) + many, many) + np.arange(len(packed))]
            packed, at = packed.tobytes(), (16 * np.cumsum(links)[last]).tolist()
            pairs = [packed[i:j] for i, j in zip([0, *at], at, strict=False)]
        sizes = (np.diff(to_a[last], prepend=0) << 32 | np.diff(to_b[last], prepend=0)).tolist()
        return [("".join(said[i:j])[:-1], p, n) for i, j, p, n in zip([0, *upto], upto, pairs, sizes, strict=False)]

    def learn(self, stretches: set[str]) -> None:
        """Put the figures of short stretches into the cache, those between white space and other characters together.
        What was in use last stays when the cache is full."""
        new = [s for s in stretches if len(s) <= SHORT and s not in self.cache and s not in self.cache.before]
        if len(self.cache) + len(new) > CACHE:
            older, self.cache = self.cache, Kept()
            older.before = {}
            self.cache.before = older
            new = [s for s in stretches if len(s) <= SHORT and s not in older]
        plain = [s for s in new if s[0] in " \n" and not s[-1].isspace()] if self.apart else []
        for lo in range(0, len(plain), TOGETHER):
            own = plain[lo : lo + TOGETHER]
            if (found := self.figures(own)) is None:
                found = map(self.alone, own)
            self.cache.update(zip(own, found, strict=True))
        self.cache.update((s, self.alone(s)) for s in set(new).difference(plain))

    def alone(self, stretch: str) -> tuple[str, bytes, int]:
        """A stretch's figures; where bytes differ, a mark that no text has."""
        return (self.figures([stretch]) or [(DIFFERENT, b"", 0)])[0]

    def align(self, stretches: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """Numbers of A ids, B ids, groups and links, the groups' digest, distinct pairs and their multiplicities of a
        text, from its stretches."""
        sha, pairs, numbers, groups = hashlib.sha256(), [], 0, 0
        for lo in range(0, len(stretches), CACHE // 2):
            own = stretches[lo : lo + CACHE // 2]
            try:
                found = list(map(self.cache.__getitem__, own))
            except KeyError:
                self.learn(set(own))
                found = [self.cache[s] if len(s) <= SHORT else self.alone(s) for s in own]
            said, packed, counts = zip(*found, strict=True)
            said = ";".join(said)
            if DIFFERENT in said:
                return NOTHING
            numbers += sum(counts)
            groups += said.count("|")
            sha.update((";" * (lo > 0) + said).encode())
            both = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            pairs.append(summed(both[:, 0], both[:, 1]))
        keys, times = pairs[0] if len(pairs) == 1 else summed(*map(np.concatenate, zip(*pairs, strict=True)))
        return [numbers >> 32, numbers & 0xFFFFFFFF, groups, int(times.sum())], sha.hexdigest(), keys, times


def multiplied(a: list[int], b: list[int]) -> bytes:
    """Distinct pairs of a group's ids, each followed by its multiplicity, packed."""
    of_a, of_b = Counter(a), Counter(b)
    return array("q", [v for x, m in of_a.items() for y, n in of_b.items() for v in (x << 32 | y, m * n)]).tobytes()


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values, in whole numbers."""
    if (values == 1).all():
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values[:0]


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's aligner."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
        gc.freeze()  # what lasts as long as the worker need not be looked through again
    return _aligners[path_a, path_b]


def default_vocabularies() -> tuple[str, str]:
    """Paths of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARIES[0]), public_tokenizers.path(VOCABULARIES[1])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(list(map(len, parts))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def align(docs: DataFrame, carry=("doc_id",), paths: tuple[str, str] | None = None) -> DataFrame:
    """The columns of ``carry``; n_a, n_b, n_groups, n_links and groups_sha256 of column ``text``; ``pairs``
    (A id << 32 | B id, ascending) and ``times``, the links of each."""
    path_a, path_b = paths or default_vocabularies()
    names = "n_a", "n_b", "n_groups", "n_links"

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            stretches = [own.stretches.findall(" " + t) if t else None for t in batch.column("text").to_pylist()]
            for lo in range(0, len(stretches), LEARNED):
                own.learn(set().union(*filter(None, stretches[lo : lo + LEARNED])))
            found = [own.align(s) if s else NOTHING for s in stretches]
            numbers, digests, pairs, times = zip(*found, strict=True) if found else ((), (), (), ())
            out = {c: batch.column(c) for c in carry} | {n: pa.array([x[k] for x in numbers], pa.int64()) for k, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(out | {"groups_sha256": pa.array(digests, pa.string()), "pairs": _lists(list(pairs)), "times": _lists(list(times))})

    kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in docs.select(*carry).schema)
    schema = f"{kept}n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def _numbers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.repeat(np.arange(len(column)), np.diff(ends))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair) and whether n is the highest of its A id."""

    def run(batches):
        held, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for lo in range(0, len(keys), PACKED):
                part = keys[lo : lo + PACKED]
                yield pa.RecordBatch.from_pydict({"a": pa.array((part >> 32).astype(np.int32)), "b": pa.array((part & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n[lo : lo + PACKED])})

        for batch in batches:
            held.append(_numbers(batch.column(0))[0])
            size += len(held[-1])
            if size > 4 * BLOCK:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    counts = aligned.select("pairs").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # as many rows as B has ids at most


def _group(a: np.ndarray) -> np.ndarray:
    return (mix(a.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int32)


_PACKED = "group int, place int, kind int, keys binary, rows binary, first binary, second binary"


def _packed(group: int, place: int, kind: int, *parts: np.ndarray) -> tuple:
    return group, place, kind, *(np.ascontiguousarray(p).tobytes() for p in parts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _PACKED.split(", ")])


def _count_rows(counts: DataFrame, places: list[int]) -> DataFrame:
    """The counts of each group, in order of their keys, once for each of its places."""

    def run(batches):
        for batch in batches:
            a, b, n, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "best"))
            keys, groups = a.astype(np.int64) << 32 | b, _group(a)
            for g in np.unique(groups).tolist():
                own = groups == g
                row = _packed(g, 0, 0, keys[own], np.zeros(0, np.int64), n[own], best[own].astype(np.int64))
                for place in range(places[g]):
                    yield _batch([(g, place, *row[2:])])

    return counts.mapInArrow(run, _PACKED)


def _posting_rows(aligned: DataFrame, places: list[int]) -> DataFrame:
    """Postings of many documents, one packed row for each group; blocks take the places of their group in turn."""

    def run(batches):
        turn, held, size = 0, [], 0

        def out():
            keys, at, times, ids = [], [], [], []
            done = 0
            for batch in held:
                own, row = _numbers(batch.column("pairs"))
                keys.append(own)
                at.append(row + done)
                times.append(_numbers(batch.column("times"))[0])
                ids.append(batch.column("row").to_numpy(zero_copy_only=False))
                done += batch.num_rows
            keys, at, times, ids = map(np.concatenate, (keys, at, times, ids))
            groups = _group(keys >> 32)
            for g in range(GROUPS):
                own = np.flatnonzero(groups == g)
                if len(own):
                    k, d, t = keys[own], at[own].astype(np.int32), times[own]
                    order = np.argsort(k, kind="stable")
                    docs, d = np.unique(d, return_inverse=True)
                    k = np.diff(k[order], prepend=0)  # ascending: small differences pack well
                    yield _batch([_packed(g, (turn + g) % places[g], 1, k, np.diff(ids[docs], prepend=0), d[order].astype(np.int32), t[order])])

        for batch in batches:
            held.append(batch)
            size += len(batch.column("pairs").values)
            if size > BLOCK:
                yield from out()
                turn, held, size = turn + 1, [], 0
        if size:
            yield from out()

    return aligned.select("row", "pairs", "times").mapInArrow(run, _PACKED)


def contributions(aligned: DataFrame) -> DataFrame:
    """row, n_best and count_sum of each row of ``align``'s result (with column ``row``, its number) that has links."""
    counts = materialize(pair_counts(aligned))
    group = F.col("a")
    sums = counts.groupBy(group).agg(F.sum("n").alias("n"))

    def totals(batches):
        found = np.zeros(GROUPS, np.int64)
        for batch in batches:
            np.add.at(found, _group(batch.column("a").to_numpy(zero_copy_only=False)), batch.column("n").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"group": pa.array(np.arange(GROUPS, dtype=np.int32)), "n": pa.array(found)})

    found = {r["group"]: r["n"] for r in sums.mapInArrow(totals, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}  # GROUPS rows
    places = [1 + int(found.get(g, 0)) // PART for g in range(GROUPS)]

    def run(batches):
        at, held, keys, n, best = None, [], None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["group"], row["place"]) != at:
                    at, held, keys = (row["group"], row["place"]), [], None
                parts = [np.frombuffer(row[c], t) for c, t in zip(("keys", "rows", "first", "second"), ("<i8", "<i8", "<i8" if row["kind"] == 0 else "<i4", "<i8"), strict=True)]
                if row["kind"] == 0:
                    held.append(parts)
                    continue
                if keys is None:
                    keys, n, best = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
                    order = np.argsort(keys, kind="stable")
                    keys, n, best, held = keys[order], n[order], best[order], []
                own, ids, docs, times = np.cumsum(parts[0]), np.cumsum(parts[1]), parts[2], parts[3]
                where = np.searchsorted(keys, own)
                sums, bests = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                np.add.at(sums, docs, times * n[where])
                np.add.at(bests, docs, times * best[where])
                yield pa.RecordBatch.from_pydict({"row": pa.array(ids), "n_best": pa.array(bests), "count_sum": pa.array(sums)})

    both = _count_rows(counts, places).unionByName(_posting_rows(aligned, places))
    dealt = both.repartition("group", "place").sortWithinPartitions("group", "place", "kind")
    return dealt.mapInArrow(run, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_figures(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    aligned = materialize(align(numbered, ("row", "doc_id"), paths))
    given = contributions(aligned)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(given, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Links between two vocabularies for every whole document."""
    return link_figures(table(spark, sf_dir, "documents"))
