"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from a hash of its code point, so any script has vectors and no
table is kept. A trigram is bound as roll(a, 2) * roll(b, 1) * c, a text is the sum (bundle) of its trigrams, and a
language prototype is the sum of all learned texts of that language, each scaled to one length so that very long ones do
not drown the others. A text gets the language whose prototype has the largest cosine with it.

Bundling is linear, so texts become vectors through one product of a count matrix and the vectors of the distinct
trigrams at hand. Scaled texts are rounded to whole numbers and sums are exact: the model does not depend on the order
of the rows.

Letters are the code points of Unicode's letter categories, lower-cased; any run of others is one space.
Null texts, and texts without a letter, are ``und`` with score 0. Without learned rows every text is ``und``.
Rows are kept one for one: repeated rows and repeated ids get one result each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out

DIM = 1024
GROUP_DOCS, GROUP_CHARS, BATCH = 256, 1_000_000, 1_000
LENGTH = 1 << 20  # of a learned text; sums of up to 2**33 texts stay exact in doubles
UNKNOWN = "und"
#: Of the least score that counts as a learned language (least_scores).
NOISE, QUANTILE, SHARE, BAND_ROWS, BIN = 3.0, 0.01, 0.5, 20, 0.001

_vectors: dict[tuple[int, int], np.ndarray] = {}
_letters = np.full(0x110000, -1, np.int32)


def letter_vector(point: int, dim: int) -> np.ndarray:
    """The +1/-1 vector of a code point."""
    if (point, dim) not in _vectors:
        bits = np.frombuffer(hashlib.shake_128(point.to_bytes(4, "little")).digest(dim // 8), np.uint8)
        _vectors[point, dim] = (np.unpackbits(bits).astype(np.int8) * 2 - 1).astype(np.float32)
    return _vectors[point, dim]


def _symbols(text: str) -> np.ndarray:
    """Lower-cased letters of a text as code points, every other character as 32."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _letters[points]
    if (found < 0).any():
        for p in np.unique(points[found < 0]):
            low = chr(p).lower()
            _letters[p] = ord(low if len(low) == 1 else chr(p)) if chr(p).isalpha() else 32
        found = _letters[points]
    return found


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The symbols of a text: letters, runs of others as one 32, one 32 at either end. Texts of more than GROUP_CHARS
    come in pieces, each of which repeats the last two symbols before it, so that every trigram is in one piece."""
    tail, edge = np.array([32], np.int32), np.array([32], np.int32)
    for at in range(0, max(1, len(text)), GROUP_CHARS):
        last = at + GROUP_CHARS >= len(text)
        s = np.concatenate((tail, _symbols(text[at : at + GROUP_CHARS]), edge[: int(last)]))
        space = s == 32
        s = s[~(space & np.concatenate(([False], space[:-1])))]
        yield s
        tail = s[-2:]


def _groups(texts: list) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, symbols) in groups of bounded size."""
    group, chars = [], 0
    for row, text in enumerate(texts):
        for s in _pieces(text or ""):
            if len(s) >= 3:
                group.append((row, s))
                chars += len(s)
            if len(group) >= GROUP_DOCS or chars >= GROUP_CHARS:
                yield group
                group, chars = [], 0
    if group:
        yield group


def _counted(group: list[tuple[int, np.ndarray]], keys: list[int], n_keys: int, dim: int) -> np.ndarray:
    """Bundles of a group: row k sums the bound trigrams of the symbols whose key is k."""
    lengths = np.array([len(s) for _, s in group])
    points, sym = np.unique(np.concatenate([s for _, s in group]), return_inverse=True)
    a = len(points)
    code = (sym[:-2].astype(np.int64) * a + sym[1:-1]) * a + sym[2:]
    last = np.cumsum(lengths)[:-1]  # trigrams that cross from one text into the next do not count
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        inside[last - back] = False
    code, key = code[inside], np.repeat(np.array(keys), lengths - 2)
    if a**3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(code, minlength=a**3))
        place = np.zeros(a**3, np.int64)
        place[grams] = np.arange(len(grams))
        place = place[code]
    else:
        grams, place = np.unique(code, return_inverse=True)
    base = np.stack([letter_vector(int(p), dim) for p in points])
    out = np.zeros((n_keys, dim))
    for at in range(0, len(grams), 8192):  # bounds the memory of a group with many trigrams
        g = grams[at : at + 8192]
        bound = np.roll(base, 2, 1)[g // (a * a)] * np.roll(base, 1, 1)[g // a % a] * base[g % a]
        here = (place >= at) & (place < at + len(g))
        counts = np.bincount(key[here] * len(g) + place[here] - at, minlength=n_keys * len(g)).reshape(n_keys, len(g))
        out += counts.astype(np.float32) @ bound
    return out


def bundle(texts: list, dim: int = DIM, grams: np.ndarray | None = None) -> np.ndarray:
    """A hypervector for each text; zeros where there is no trigram. Numbers of trigrams are added to ``grams``."""
    out = np.zeros((len(texts), dim))
    for group in _groups(texts):
        if grams is not None:
            np.add.at(grams, [r for r, _ in group], [len(s) - 2 for _, s in group])
        rows = sorted({r for r, _ in group})
        out[rows] += _counted(group, [rows.index(r) for r, _ in group] if len(rows) < 2 else list(np.searchsorted(rows, [r for r, _ in group])), len(rows), dim)
    return out


def _small(batches) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH rows: a row's vector takes more memory than a short text."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def scaled(h: np.ndarray) -> np.ndarray:
    """Bundles of one LENGTH, in whole numbers; zeros stay."""
    norm = np.linalg.norm(h, axis=1, keepdims=True)
    return np.rint(h * (LENGTH / np.where(norm == 0, 1, norm)))


def prototypes(labelled: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Language prototypes from columns text and lang: every row counts, partial sums leave each task."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in _small(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            v = scaled(bundle(batch.column("text").to_pylist(), dim))
            for name in set(langs):
                total[name] = total.get(name, 0) + v[langs == name].sum(0)
        for name, row in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "v": pa.array([row.tolist()], pa.list_(pa.float64()))})

    rows = (
        labelled.select("text", "lang").where("text is not null and lang is not null")
        .mapInArrow(sums, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    )
    found: dict[str, np.ndarray] = {}
    for r in rows:  # one number for each language and dimension, whatever the size of the corpus
        found.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    return dict(sorted(found.items()))


def identify(docs: DataFrame, model: dict[str, np.ndarray], dim: int = DIM, carry: tuple[str, ...] = ("doc_id",), sizes: bool = False) -> DataFrame:
    """Columns of ``carry``, lang_pred and score (the cosine, at least 0) for each row of ``docs``, which has ``text``;
    with ``sizes`` also band, the logarithm to base 2 of the text's number of trigrams, rounded down (0: one or none)."""
    names = list(model)
    protos = np.stack([v / (np.linalg.norm(v) or 1) for v in model.values()]) if names else np.zeros((0, dim))

    def predict(batches):
        for batch in _small(batches):
            texts = batch.column("text").to_pylist()
            cos = np.zeros((len(texts), max(1, len(names))))
            grams = np.zeros(len(texts), np.int64)
            if names:
                h = bundle(texts, dim, grams)
                norm = np.linalg.norm(h, axis=1, keepdims=True)
                cos = h @ protos.T / np.where(norm == 0, 1, norm)
            best = cos.argmax(1)
            known = [bool(names) and t is not None and any(map(str.isalpha, t)) for t in texts]
            out = {c: batch.column(c) for c in carry}
            out["lang_pred"] = pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string())
            out["score"] = pa.array([min(1.0, max(0.0, float(row[b]))) if k else 0.0 for row, b, k in zip(cos, best, known, strict=True)], pa.float64())
            if sizes:
                out["band"] = pa.array([max(1, int(n)).bit_length() - 1 for n in grams], pa.int32())
            yield pa.RecordBatch.from_pydict(out)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(predict, f"{kept}, lang_pred string, score double" + ", band int" * sizes)


def least_scores(labelled: DataFrame, model: dict[str, np.ndarray], dim: int = DIM) -> list[float]:
    """By band, the least score of a text in a learned language: SHARE of the QUANTILE of the scores of labelled texts
    (columns text and lang) that get their own label, and at least NOISE standard deviations of unrelated texts' cosine.
    Long texts score far higher than short ones, so each band has its own; one of fewer than BAND_ROWS texts takes that
    of the band below. Every labelled row counts; what is collected is a histogram of bounded size."""
    found = identify(labelled.where("text is not null and lang is not null"), model, dim, ("lang",), sizes=True)
    rows = found.where("lang = lang_pred").groupBy("band", F.floor(F.col("score") / BIN).alias("bin")).agg(F.count("*").alias("n")).collect()
    floor = NOISE / dim**0.5
    least = []
    for band in range(64):
        own = sorted((r["bin"], r["n"]) for r in rows if r["band"] == band)
        total, below = sum(n for _, n in own), 0
        least.append(least[-1] if least else floor)
        if total >= BAND_ROWS:
            for at, n in own:
                below += n
                if below > QUANTILE * total:
                    least[-1] = max(floor, SHARE * at * BIN)
                    break
    return least


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = prototypes(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
