"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and become template tokens: numbers (digits or number words) are <num>, units behind a
number are <unit>, numbers with a unit attached are <measure>, capitalised words that do not open a sentence are <name>,
all others are their lower case; signs of arithmetic beside a number are words too. Windows of SIZE template tokens with a plain word among them are joined by hash
with those of the benchmark; items with fewer tokens (at least LEAST) are one window of their length. A window of slots
alone would be any row of numbers; literal windows compare those. Whether a word opens
a sentence depends on what stands before it, so a window whose first word is capitalised is joined in both readings; the
other reading than the item's takes the same word only. Matched windows on
one diagonal of a document and an item are put together. Their slots must be consistent: within a type each value of the
item stands for one value of the document and the other way round. An item has leaked where consistent windows cover
at least COVER of its tokens; with all values equal the leak is exact, else the question is re-parameterised.

Besides, windows of SIZE literal tokens (lower-cased words less outer punctuation, signs such as + included) are joined by
hash, whatever their kinds; an item with fewer is one window, also of a single token. An item whose literal windows cover
at least COVER of its tokens on one diagonal has leaked exactly.

The windows of both tables are rows, and they meet in an equi-join of their hashes. A window of a document becomes a row
only if it passes a filter of fixed size made of all windows of the benchmark, so hardly any other is shuffled; it
takes the kinds and hashes of its tokens along. Hits are put together by text and item, and equal texts are one text: each
is looked at once in a task and merged across tasks, and all its rows get its result. Neither the benchmark nor the hits
pass through the driver. Tokens, windows and texts are compared as 64-bit hashes.

Null and empty texts match nothing; null item ids are ignored. Rows are kept
one for one, repeated rows and ids included; repeated items count once in item_ids. An empty benchmark flags nothing.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import key_filter, materialize, may_hold, mix

SIZE, LEAST, COVER = 8, 3, 0.5
LITERAL = np.uint64(0x6C62272E07BB0142)
KNOWN = 200_000  # words and texts that a task remembers
#: Number words and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert tausend deux trois quatre cinq sept huit neuf dix vingt cent mille dos tres cuatro cinco seis siete ocho nueve diez veinte cien mil".split()
)
UNITS = frozenset(
    "mm cm m km mg g kg t ml l mph kmh s ms min h hz khz mhz ghz kb mb gb tb w kw mw v kv a j kj cal kcal pa bar k c f in ft yd mi oz lb lbs percent % "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros degree degrees".split()
)
PLAIN, NUM, UNIT, MEASURE, NAME = range(5)
SIGN, SIGNS = -2, frozenset("+-*/=<>^×÷")
_kind_hash = np.array([0] + [xxhash.xxh64_intdigest(f"<{k}>") for k in ("num", "unit", "measure", "name")], np.uint64)
_number = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_measure = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|%)")
_OUTER = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~«»“”„"
_edges = re.compile(r"^[\W_]+|[\W_]+$")


class Words(dict):
    """Ids of words, and by id: kind, whether capitalised, whether it may be a unit, whether it ends a sentence, hash."""

    def __init__(self):
        super().__init__()
        self.traits, self.hashes = array("b"), array("Q")

    def __missing__(self, word: str) -> int:
        bare = word.strip(_OUTER)
        if bare.isalpha():  # most words: no number and no unit attached
            low = bare.lower()
            kind = NUM if low in NUMBER_WORDS else PLAIN
            return self._add(word, low, kind, kind == PLAIN and bare[0].isupper() and bare[1:] == bare[1:].lower(), low in UNITS)
        bare = word if _number.fullmatch(word) else _edges.sub("", word)
        low = bare.lower()
        kind = (SIGN if SIGNS.issuperset(word) else -1) if not bare else NUM if _number.fullmatch(bare) or low in NUMBER_WORDS else MEASURE if (m := _measure.fullmatch(bare)) and m[2].lower() in UNITS else PLAIN
        unit = low in UNITS or word == "%"
        if word == "%":
            kind, low = PLAIN, "%"
        capital = bare[:1].isupper() and bare[1:] == bare[1:].lower() and kind == PLAIN
        return self._add(word, low, kind, capital, unit)

    def _add(self, word: str, low: str, kind: int, capital: bool, unit: bool) -> int:
        self[word] = at = len(self.hashes)
        self.traits.extend((kind, capital, unit, word.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":")))
        self.hashes.append(xxhash.xxh64_intdigest(word if kind < 0 else low.rstrip(".,:/") if kind == NUM else low))
        return at

    def template(self, text: str):
        """(ids, kinds, hashes) of the template tokens of a text, and the hashes of its literal tokens."""
        if len(self) > KNOWN:
            self.clear()
            self.__init__()
        words = text.split()
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        own = np.frombuffer(self.traits, np.int8).reshape(-1, 4)[ids]
        hashes = np.frombuffer(self.hashes, np.uint64)
        opens = np.ones(len(ids), bool)
        opens[1:] = own[:-1, 3] > 0
        real, literal, sign = own[:, 0] >= 0, hashes[ids], own[:, 0] == SIGN
        if sign.any():
            number = own[:, 0] == NUM
            beside = np.append(number[1:], False) | np.append(False, number[:-1])
            real |= sign & beside
        ids, own, opens = ids[real], own[real], opens[real]
        kind = np.maximum(own[:, 0], PLAIN)
        kind[(own[:, 1] > 0) & ~opens] = NAME
        after = np.zeros(len(ids), bool)
        after[1:] = kind[:-1] == NUM
        kind[(own[:, 2] > 0) & after & (own[:, 0] == PLAIN)] = UNIT
        return ids, kind, np.where(kind == PLAIN, hashes[ids], _kind_hash[kind]), literal


def doubled(hashes: np.ndarray, most: int) -> list[np.ndarray]:
    """The hashes of each run of 1, 2, 4, ... tokens, up to ``most``."""
    out, width = [hashes], 1
    while 2 * width <= most:
        out.append(mix(out[-1][:-width] * np.uint64(3) + out[-1][width:]))
        width *= 2
    return out


def composed(runs: list[np.ndarray], size: int) -> np.ndarray:
    """The hash of each window of ``size`` tokens, put together from those of its runs of ``doubled``."""
    n = len(runs[0]) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, at = np.full(n, size, np.uint64), 0
    for k, run in enumerate(runs):
        if size >> k & 1:
            out = mix(out * np.uint64(3) + run[at : at + n])
            at += 1 << k
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window."""
    return composed(doubled(hashes, size), size)


def _literal(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of literal tokens."""
    return mix(windows(hashes, size) ^ LITERAL)


def _item(words: Words, text: str):
    """Windows of an item: (hash, literal, place, size, tokens of the item, kinds, hashes of the tokens)."""
    ids, kind, hashes, literal = words.template(text)
    if not len(literal):
        return
    plain = np.frombuffer(words.hashes, np.uint64)[ids]
    capital = (np.frombuffer(words.traits, np.int8).reshape(-1, 4)[ids, 1] > 0) & ((kind == PLAIN) | (kind == NAME))
    size = min(SIZE, len(literal))
    for place, h in enumerate(_literal(literal, size).tolist()):
        yield h, True, place, size, len(literal), b"", b""
    if len(kind) < LEAST:
        return
    size = min(SIZE, len(kind))
    for place, h in enumerate(windows(hashes, size).tolist()):
        part = slice(place, place + size)
        own, rest = kind[part] == PLAIN, (place, size, len(kind), kind[part].astype(np.int8).tobytes(), plain[part].tobytes())
        if own.any():
            yield h, False, *rest
        if capital[place] and (own[1:].any() or not own[0]):  # the other reading has a plain word
            other = hashes[part].copy()
            other[0] = _kind_hash[NAME] if own[0] else plain[place]
            yield int(windows(other, size)[0]), False, *rest


_ITEM = {"hash": pa.int64(), "literal": pa.bool_(), "at": pa.int32(), "size": pa.int32(), "n": pa.int32(), "kinds": pa.binary(), "tokens": pa.binary(), "item_id": pa.int64()}
_HIT = {"text_hash": pa.int64(), "bytes": pa.int64(), "hash": pa.int64(), "place": pa.int32(), "own_kinds": pa.binary(), "own_tokens": pa.binary()}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _columns(schema: dict[str, pa.DataType], rows: list[tuple]):
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns, strict=True)})


def item_windows(benchmark: DataFrame) -> DataFrame:
    """One row for each window of the benchmark (item_id, text)."""

    def run(batches):
        words = Words()
        for batch in batches:
            items = zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            yield _columns(_ITEM, [(_signed(h), *rest, item) for item, text in items for h, *rest in _item(words, text)])

    named = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return named.mapInArrow(run, "hash long, literal boolean, at int, size int, n int, kinds binary, tokens binary, item_id long").distinct()


def _hits(texts: DataFrame, known, sizes: list[tuple[bool, int]]) -> DataFrame:
    """Windows of ``texts`` (text_hash, bytes, text) that might be the benchmark's."""

    def run(batches):
        words, seen = Words(), set()
        for batch in batches:
            rows = []
            for key, n, text in zip(*(batch.column(c).to_pylist() for c in ("text_hash", "bytes", "text")), strict=True):
                if not text or not sizes or (key, n) in seen:
                    continue
                if len(seen) > KNOWN:
                    seen.clear()
                seen.add((key, n))
                ids, kind, hashes, literal = words.template(text)
                plain = np.frombuffer(words.hashes, np.uint64)[ids]
                runs = doubled(hashes, SIZE), doubled(literal, SIZE)
                found = [mix(composed(runs[1], size) ^ LITERAL) if is_literal else composed(runs[0], size) for is_literal, size in sizes]
                ends, found = np.cumsum(list(map(len, found))), np.concatenate(found)
                held = np.flatnonzero(may_hold(known.value, found))
                which = np.searchsorted(ends, held, side="right")
                for h, w, at in zip(found[held].tolist(), which.tolist(), (held - np.concatenate(([0], ends))[which]).tolist(), strict=True):
                    is_literal, size = sizes[w]
                    part = slice(at, at + size)
                    own = (b"", b"") if is_literal else (kind[part].astype(np.int8).tobytes(), plain[part].tobytes())
                    rows.append((key, n, _signed(h), at, *own))
            yield _columns(_HIT, rows)

    return texts.mapInArrow(run, "text_hash long, bytes long, hash long, place int, own_kinds binary, own_tokens binary").distinct()


def _judge(rows: list[dict]) -> tuple[float, bool] | None:
    """(share of the item's tokens, exact) of the hits of one text and item, if it leaked."""
    lines: dict[tuple[bool, int], list[dict]] = defaultdict(list)
    for r in rows:
        lines[r["literal"], r["place"] - r["at"]].append(r)
    best = None
    for (literal, _), own in lines.items():
        n, places = own[0]["n"], {}
        for r in own:
            at = range(r["at"], r["at"] + r["size"])
            sides = zip(r["kinds"], np.frombuffer(r["tokens"], np.uint64).tolist(), r["own_kinds"], np.frombuffer(r["own_tokens"], np.uint64).tolist(), strict=True)
            places.update(dict.fromkeys(at) if literal else zip(at, sides, strict=True))
        if len(places) < COVER * n:
            continue
        there, back, exact, fits = {}, {}, True, True
        for kind, token, own_kind, own_token in () if literal else places.values():
            if kind != own_kind:  # the other reading of a first word
                fits &= token == own_token
            elif kind != PLAIN:
                mine, theirs = (kind, token), (kind, own_token)
                fits &= there.setdefault(mine, theirs) == theirs and back.setdefault(theirs, mine) == mine
                exact &= mine == theirs
        if fits:
            found = (len(places) / n, exact)
            best = found if best is None else max(best, found)
    return best


def _leaked(hits: DataFrame) -> DataFrame:
    """(text_hash, bytes, item_id, coverage, exact) of the leaks among joined windows."""
    names = ("text_hash", "bytes", "item_id")
    shape = {"text_hash": pa.int64(), "bytes": pa.int64(), "item_id": pa.int64(), "coverage": pa.float64(), "exact": pa.bool_()}

    def run(batches):
        held, key = [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = tuple(r[c] for c in names)
                if own != key:
                    if held and (found := _judge(held)):
                        out.append((*key, *found))
                    held, key = [], own
                held.append(r)
            yield _columns(shape, out)
        if held and (found := _judge(held)):
            yield _columns(shape, [(*key, *found)])

    dealt = hits.repartition(*names).sortWithinPartitions(*names)  # the hits of one text and one item
    return dealt.mapInArrow(run, "text_hash long, bytes long, item_id long, coverage double, exact boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, carry=("doc_id",)) -> DataFrame:
    """The columns of ``carry``, item_ids (leaked items), exact_ids (those with equal values) and coverage (the largest)
    for each row of ``docs``."""
    key = {"text_hash": F.xxhash64("text"), "bytes": F.octet_length("text").cast("long")}
    items = materialize(item_windows(benchmark))
    sizes = sorted((r["literal"], r["size"]) for r in items.select("literal", "size").distinct().collect())  # 2 * SIZE at most
    texts = docs.select(*(c.alias(n) for n, c in key.items()), "text")
    met = _hits(texts, key_filter(items.select("hash"), "hash"), sizes).join(items, "hash")
    found = _leaked(met).groupBy(*key).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),  # of one text
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("exact_ids"),
        F.max("coverage").alias("coverage"),
    )
    rows = docs.select(F.struct(*carry).alias("row"), *(c.alias(n) for n, c in key.items()))
    none = F.array().cast("array<long>")
    lists = [F.coalesce(c, none).alias(c) for c in ("item_ids", "exact_ids")]
    return rows.join(materialize(found), list(key), "left").select("row.*", *lists, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that leaked into every document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = leaks(docs, benchmark)
    return found.withColumn("contaminated", F.size("item_ids") > 0)
