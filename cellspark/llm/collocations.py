"""Phrases of two to four words that hold together, counted exactly for each language.

Texts are lower-cased (A-Z), split into pieces and those into words. Passes:

1. Sketches. Every task hashes its words and word pairs, keyed by language, to cells and sends sums of cells, packed by
   ranges of cells; summed up, a cell at or over ``least`` is one bit. A cell's sum is an upper bound for all that fall
   into it, and a longer phrase is no more frequent than the pairs inside it. A second sketch takes the longer phrases
   whose pairs pass the first. The bits are two broadcasts of at most 2**CELL_BITS bits (32 MB) each. Fuller cells let
   more through, which costs work and changes nothing.
2. Automata. A task takes blocks of its shard's text. The words and phrases of a block that the sketch lets through
   become the patterns of a pyahocorasick automaton, with a space on both sides as guard; the text has one space around
   every word and a break between pieces, so overlapping matches all count and none crosses a piece. As every phrase at
   or over ``least`` passes the sketch in every block that holds it, counts are complete. Blocks bound both the automaton
   and the text in memory, whatever the size of the corpus.
3. Counts are summed by language and phrase, and only then is the threshold applied; scores, cuts and the check against
   longer phrases are joins of what is left.

A phrase's hash only groups occurrences inside a block; where the automaton counts otherwise than the hashes do, two
phrases had one hash, and the block's patterns are taken from the strings themselves.

Null text: no words. Null language: ``und``. Empty texts and texts of delimiters only add nothing; repeated rows count
each time, ids are not read. A text of any length is one block at most. Without a candidate, or on an empty table, the
result has no rows. Ties go by the order of the result: score, occurrences, phrase by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, mix, table

LEAST, MOST_WORDS, INSIDE, TOP = 30, 4, 80, 2000
CELL_BITS, RANGE_BITS = 28, 16
HASHED, SKETCHED, SCANNED = 1 << 19, 1 << 21, 4 << 20
SALTS = 8

#: Lower case; tabs are spaces, delimiters breaks.
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else 32 if x == 9 else 10 if x in b".,;:!?\n\x0b\x0c\r" else x for x in range(256))
_RUN = re.compile(rb"  +")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(texts: list[bytes]) -> bytes:
    """Texts as words with one space on either side; a break stands between pieces as a word of its own."""
    return _RUN.sub(b" ", b" " + b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ") + b" ")


class Hasher:
    """Hashes of the words of a normalised text by prefix sums of a polynomial."""

    def __init__(self):
        self.code = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            base = _ODD | np.uint64(1)
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, np.uint64(pow(int(base), -1, 1 << 64))))), dtype=np.uint64)

    def words(self, text: bytes, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words; a break's hash is 0."""
        raw = np.frombuffer(text, np.uint8)
        self._powers(len(raw))
        gaps = np.flatnonzero(raw == 32).astype(np.int32)
        starts, ends = gaps[:-1] + 1, gaps[1:]
        if len(starts) and starts[0] == ends[0]:  # nothing but a space
            return starts[:0], ends[:0], np.zeros(0, np.uint64)
        sums = np.cumsum(self.code[raw] * self.up[: len(raw)], dtype=np.uint64)
        found = mix((sums[ends - 1] - sums[starts - 1]) * self.down[starts] + np.uint64(salt)) | np.uint64(1)
        found[(ends - starts == 1) & (raw[starts] == 10)] = 0
        return starts, ends, found


def longer(found: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of ``n`` words from each word on, from those of n - 1; 0 where the piece ends before."""
    last = hashes[n - 1 :]
    found = found[: len(last)]
    return np.where((found != 0) & (last != 0), mix(found * _ODD + last) | np.uint64(1), np.uint64(0))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, its texts) of a batch."""
    langs = batch.column("lang").dictionary_encode()
    at, texts = langs.indices.to_numpy(zero_copy_only=False), batch.column("text").cast(pa.binary()).to_pylist()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        if own := [t for i in np.flatnonzero(at == k) if (t := texts[i])]:
            yield lang, own


def _blocks(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run by itself."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def _salt(lang: str) -> int:
    return int(mix(np.frombuffer((lang.encode() + b"\1" * 8)[: (len(lang.encode()) + 8) // 8 * 8], "<u8") * _ODD).sum())


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def cell_bits(docs: DataFrame, text: str = "text") -> int:
    """Logarithm of the cells of a sketch: about one for every four bytes of text, 2**CELL_BITS at most."""
    size = docs.agg(F.sum(F.octet_length(text).cast("decimal(38,0)"))).first()[0] or 0
    return min(CELL_BITS, max(RANGE_BITS, int(size // 4).bit_length()))


def _open(words: np.ndarray, first, second, bits: int, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes of the phrases of n words from each word on, which of them may be frequent): words and pairs by the
    first sketch, longer phrases by their pairs and, where it is there, the second sketch."""
    own, through, pairs = words, None, None
    for n in range(1, most_words + 1):
        own = longer(own, words, n) if n > 1 else own
        if n <= 2:
            through = (own != 0) if first is None else _lets_through(first, bits, own)
            pairs = through
        else:
            through = through[: len(own)] & pairs[n - 2 : n - 2 + len(own)]
            if second is not None:
                at = np.flatnonzero(through)
                through[at] = _lets_through(second, bits, own[at])
        yield n, own, through


def sketch(source: DataFrame, bits: int, least: int = LEAST, most_words: int = 2, first=None):
    """A broadcast bit map of 2**bits cells: those whose words and word pairs (column ``lang`` and ``text``) come to
    ``least`` together; with the ``first`` sketch those of the longer phrases whose pairs pass it."""
    spark, top = source.sparkSession, min(255, least)
    if least > top:
        raise ValueError("a cell counts to 255")

    def send(cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(np.concatenate(cells), return_counts=True)
        n = np.minimum(n, top).astype(np.uint8)
        ranges, first = np.unique(at >> RANGE_BITS, return_index=True)
        ends = np.append(first[1:], len(at))
        low = (at & ((1 << RANGE_BITS) - 1)).astype("<u2")
        for lo in range(0, len(ranges), 512):
            part = slice(lo, lo + 512)
            packed = [low[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(first[part], ends[part], strict=True)]
            yield pa.RecordBatch.from_pydict({"range": pa.array(ranges[part].astype(np.int32)), "packed": pa.array(packed, pa.binary())})

    def cells(batches):
        hasher, held, size = Hasher(), [], 0
        for batch in batches:
            for lang, texts in _by_language(batch):
                for block in _blocks(texts, HASHED):
                    words = hasher.words(normal(block), _salt(lang))[2]
                    for n, own, through in _open(words, first and first.value, None, bits, most_words):
                        if (n > 2) == (first is not None):
                            held.append((own[through] >> np.uint64(64 - bits)).astype(np.uint32))
                            size += len(held[-1])
                    if size > SKETCHED:
                        yield from send(held)
                        held, size = [], 0
        if size:
            yield from send(held)

    def summed(batches):
        at, sums = None, np.zeros(1 << RANGE_BITS, np.uint16)

        def out():
            return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for k, packed in zip(batch.column("range").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if k != at:
                    if at is not None:
                        yield out()
                    at, sums = k, np.zeros(1 << RANGE_BITS, np.uint16)
                n = len(packed) // 3
                low = np.frombuffer(packed, "<u2", n)
                sums[low] = np.minimum(sums[low] + np.frombuffer(packed, np.uint8, n, 2 * n), top)
        if at is not None:
            yield out()

    parts = source.mapInArrow(cells, "range int, packed binary").repartition("range").sortWithinPartitions("range")
    found = parts.mapInArrow(summed, "range int, bits binary").toArrow()  # 2**bits bits at most
    out = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << RANGE_BITS - 3
    for k, b in zip(found.column("range").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[k * width : (k + 1) * width] = np.frombuffer(b, np.uint8)
    return spark.sparkContext.broadcast(out)


def _lets_through(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    cell = hashes >> np.uint64(64 - bits)
    return (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 != 0) & (hashes != 0)


def _phrases(text: bytes, spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray | None]:
    """One guarded pattern for each hash of ``spans`` (starts, ends, hashes) and how often the hash occurs."""
    patterns, counts = [], []
    for starts, ends, hashes in spans:
        _, first, n = np.unique(hashes, return_index=True, return_counts=True)
        patterns += [text[a - 1 : b + 1].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        counts.append(n)
    return patterns, np.concatenate(counts)


def _matches(text: str, patterns: list[str]) -> np.ndarray:
    """Overlapping matches of each pattern."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        automaton.add_word(p, i)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int32), minlength=len(patterns))


def scan(text: bytes, words: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, second: np.ndarray | None, bits: int, most_words: int) -> tuple[list[str], np.ndarray]:
    """(phrase, occurrences) of all phrases of a normalised text that the sketches let through."""
    starts, ends, hashes = words
    spans = []
    for n, own, through in _open(hashes, first, second, bits, most_words):
        at = np.flatnonzero(through)
        spans.append((starts[at], ends[at + n - 1], own[at]))
    patterns, counts = _phrases(text, spans)
    if not patterns:
        return [], np.zeros(0, np.int64)
    whole = text.decode()
    found = _matches(whole, patterns) if len(set(patterns)) == len(patterns) else None
    if found is None or not np.array_equal(found, counts):  # two phrases with one hash
        patterns = list({text[a - 1 : b + 1].decode() for s, e, _ in spans for a, b in zip(s.tolist(), e.tolist(), strict=True)})
        found = _matches(whole, patterns)
    return [p[1:-1] for p in patterns], found


def occurrences(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase and f of every phrase of 1 to ``most_words`` words with f >= ``least``; besides one row for each
    language with a null phrase, whose f counts its words."""
    source, bits = _source(docs, text, lang), cell_bits(docs, text)
    first = sketch(source, bits, least, min(2, most_words))
    second = sketch(source, bits, least, most_words, first) if most_words > 2 else None

    def count(held: dict[str, list[bytes]], hasher: Hasher) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            sizes = 0
            for block in _blocks(texts, SCANNED):
                plain = normal(block)
                parts = [hasher.words(plain, _salt(lang))] if len(plain) <= HASHED else list(_cut(plain, hasher, lang))
                words = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                sizes += int((words[2] != 0).sum())
                phrases, n = scan(plain, words, first.value, second and second.value, bits, most_words)
                for lo in range(0, len(phrases), 20_000):
                    part = phrases[lo : lo + 20_000]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part)), "phrase": pa.array(part, pa.string()), "f": pa.array(n[lo : lo + 20_000])})
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "phrase": pa.array([None], pa.string()), "f": pa.array([sizes])})

    def run(batches):
        hasher, held, size = Hasher(), {}, 0
        for batch in batches:
            for lang, texts in _by_language(batch):
                held.setdefault(lang, []).extend(texts)
                size += sum(map(len, texts))
            if size > SCANNED:
                yield from count(held, hasher)
                held, size = {}, 0
        yield from count(held, hasher)

    found = source.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return found.where(F.col("phrase").isNull() | (F.col("f") >= least))


def _cut(plain: bytes, hasher: Hasher, lang: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of a long normalised text by parts of about HASHED bytes, which bounds the arrays of bytes."""
    at = 0
    while at < len(plain) - 1:
        end = len(plain) if len(plain) - at <= HASHED else plain.find(b" ", at + HASHED) + 1 or len(plain)
        starts, ends, hashes = hasher.words(plain[at:end], _salt(lang))
        yield starts + at, ends + at, hashes
        at = end - 1


def _whole(f) -> Column:
    return F.col(f).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, inside: int = INSIDE, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n and score of all candidates that no longer one holds ``inside`` percent of."""
    counts = materialize(occurrences(docs, least, most_words, text, lang))
    words = F.split("phrase", " ")
    singles = counts.where(F.col("phrase").isNotNull())
    found = singles.where(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))

    def parts(size) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))

    # What a longer candidate holds.
    longer = found.where(F.size("words") > 2).select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), parts))).alias("phrase"))
    above = longer.groupBy("lang", "phrase").agg(F.max("a").alias("above"))

    # A first part may be that of very many candidates; its count is dealt to SALTS places.
    cuts = found.select("lang", "phrase", "a", F.size("words").alias("size"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"),
    )
    dealt = singles.where(F.size(words) < most_words).select("lang", "phrase", "f", F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    firsts, rests = dealt.toDF("lang", "first", "l", "salt"), dealt.toDF("lang", "rest", "r", "salt")
    cuts = cuts.join(firsts, ["lang", "first", "salt"]).join(rests, ["lang", "rest", "salt"])
    score = F.expr("(CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    cuts = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    kept = best.join(above, ["lang", "phrase"], "left").where(F.coalesce(_whole("above") * 100 < _whole("a") * inside, F.lit(True)))
    totals = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of each language, with their rank; tasks leave out before the shuffle what cannot
    be among them."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rank = F.row_number().over(order)
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations of all documents."""
    return ranked(collocations(table(spark, sf_dir, "documents")))
