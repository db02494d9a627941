"""Exact token counts at every prefix by dynamic programming over token boundaries.

A BPE encoding is valid exactly when each token, and each pair of neighbours taken alone, merges to itself. So the last
token before position i is the one token t ending there that stands next to the last token before t's start, and the
count at i is the count at that start plus one. One pass over a word gives the count at each of its prefixes, both
unterminated (as the inside of a longer word) and with the end-of-word mark (as the last word of a prefix). Counts of
words add up, so a text's table, the count at each of its prefixes, is the sum of what its words' tables say.
``prefix_tokens`` makes the table, one whole number for each code point, to be stored; ``n_tokens``, ``cut_chars`` and
``fits`` are expressions over it, which answer truncation and budget questions without encoding again.

The vocabulary is a tokenizers JSON file: NFC, white space runs, lower case; words by the file's split pattern; byte-
level symbols; merges with an end-of-word suffix. Strings of the special tokens inside a text count as one each, which
is the library's default. Prefixes are those of the normalised text.

Null text: as empty (0 tokens, 0 bytes). Rows are kept one for one, repeated rows and ids included; other columns are
not read. Words of any length go through the same pass; each worker's cache of words is bounded.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 600_000

_counters: dict[str, Counter] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, other = [], 0x100
    for b in range(256):
        out.append(chr(b if b in prints else other))
        other += b not in prints
    return out


class Counter:
    """Prefix counts by the vocabulary of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.rank = {t: rank for rank, t in self.merges.values()}
        self.halves = {t: pair for pair, (_, t) in self.merges.items()}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        #: Every end of a token's symbols: the tokens of just these symbols, inside a word and at its end (-1: none).
        self.ends: dict[str, tuple[int, int]] = {}
        for t, i in self.ids.items():
            last = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            body = t.removesuffix(self.suffix) if last else t
            inside, whole = self.ends.get(body, (-1, -1))
            self.ends[body] = (inside, i) if last else (i, whole if self.suffix else i)
            for k in range(1, len(body)):
                self.ends.setdefault(body[k:], (-1, -1))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.symbol = byte_symbols()
        self.pair: dict[int, bool] = {}
        self.prefix: dict[str, bytes] = {}  # a word's table, two bytes a prefix
        self.total: dict[str, int] = {}
        self.kinds = np.full(0x110000, 2, np.uint8)

    def _symbols(self, token: int) -> list[int]:
        name = self.names[token]
        end = self.suffix if self.suffix and name.endswith(self.suffix) and len(name) > len(self.suffix) else ""
        body = name.removesuffix(end) if end else name
        return [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + end]]

    def _merge(self, seq: list[int]) -> list[int]:
        """Merge the best pair, leftmost first, until none is left."""
        while len(seq) > 1:
            rank, at = min((self.merges.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)))
            if rank == 1 << 60:
                break
            seq = [*seq[:at], self.merges[seq[at], seq[at + 1]][1], *seq[at + 2 :]]
        return seq

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one end of a token while it is merged: (token so far, rank of the merge that takes it)."""
        if (found := self.spines.get((token, side))) is None:
            found, above, at = [], 1 << 60, token
            while True:
                found.append((at, above))
                if at not in self.halves:
                    break
                above, at = self.rank[at], self.halves[at][side]
            self.spines[token, side] = found = found[::-1]
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses from one token into the next: the ends that face each other are followed in the
        order of their merges; a crossing pair wins where its rank comes before the left end's merge, or not after the
        right end's, as of equal ranks the leftmost goes first."""
        a, b, i, j = self._spine(left, 1), self._spine(right, 0), 0, 0
        while True:
            (x, upx), (y, upy) = a[i], b[j]
            cross = self.merges.get((x, y))
            if cross is not None and cross[0] < upx and cross[0] <= upy:
                return False
            if upx == upy == 1 << 60:
                return True
            if upx <= upy:
                i += 1
            else:
                j += 1

    def _fits(self, left: int, token: int) -> bool:
        """Whether token follows left (-1: begins a word) in an encoding."""
        key = left << 20 | token
        if (found := self.pair.get(key)) is None:
            if len(self.pair) > 4 * CACHE:
                self.pair.clear()
            found = self.pair[key] = self._merge(self._symbols(token)) == [token] if left < 0 else self._apart(left, token)
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of each prefix of a word, by code points, as if the prefix ended the text."""
        raw = word.encode("utf-8", "replace")
        s = "".join(map(self.symbol.__getitem__, raw))
        ends, pair, fits = self.ends, self.pair, self._fits
        last, inner, out = [-1] * (len(s) + 1), [0] * (len(s) + 1), []
        for i in range(1, len(s) + 1):
            inside = i < len(s)  # the last of a word has no inner token
            whole = not inside or raw[i] & 0xC0 != 0x80  # a prefix ends here
            for k in range(i - 1, -1, -1):
                found = ends.get(s[k:i])
                if found is None:
                    break
                t, w = found
                before = last[k]
                if inside and t >= 0 and ((ok := pair.get(before << 20 | t)) or ok is None and fits(before, t)):
                    last[i], inner[i], inside = t, inner[k] + 1, False
                if whole and w >= 0 and ((ok := pair.get(before << 20 | w)) or ok is None and fits(before, w)):
                    out.append(inner[k] + 1)
                    whole = False
                if not (inside or whole):
                    break
        if len(word) == 3 and word[0] == "'":  # two thirds of a contraction are two words
            out[1] = self.word(word[0])[-1] + self.word(word[1])[-1] if self.words.findall(word[:2]) != [word[:2]] else out[1]
        return tuple(out)

    def learn(self, words) -> None:
        """Put the tables of words into the cache. A word of over 65,535 tokens has a total only."""
        new = {w for w in words if w not in self.total}
        if len(self.total) + len(new) > CACHE:
            self.total.clear()
            self.prefix.clear()
            new = set(words)
        for w in new:
            counts = self.word(w)
            self.total[w] = counts[-1]
            if max(counts) < 1 << 16:
                self.prefix[w] = np.array(counts, np.uint16).tobytes()

    def normal(self, text: str) -> str:
        """NFC, then lower case code point by code point."""
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(normalised part, whether it is a special token)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield self.normal(text[at : m.start()]), False
            yield m[0], True
            at = m.end()
        yield self.normal(text[at:]), False

    def count(self, text: str) -> int:
        """Tokens of the whole text: the count at its last prefix."""
        n = 0
        for part, special in self.parts(text):
            if special:
                n += 1
                continue
            for at in range(0, len(words := self.words.findall(part)), CACHE // 4):
                block = words[at : at + CACHE // 4]
                try:
                    n += sum(map(self.total.__getitem__, block))
                except KeyError:
                    self.learn(block)
                    n += sum(map(self.total.__getitem__, block))
        return n

    def table(self, text: str) -> np.ndarray:
        """Tokens of each prefix of the normalised text, by code points, the empty prefix first."""
        if self.special and self.special.search(text):
            return np.array(self.walk(text), np.int32)
        text = self.normal(text)
        words = self.words.findall(text)
        out, at, before, total = np.zeros(len(text) + 1, np.int32), [], [], 0
        inside: list[np.ndarray] = []
        for lo in range(0, len(words), CACHE // 4):
            block = words[lo : lo + CACHE // 4]
            try:
                own = list(map(self.prefix.__getitem__, block))
            except KeyError:
                self.learn(block)
                if any(w not in self.prefix for w in block):
                    return np.array(self.walk(text), np.int32)
                own = list(map(self.prefix.__getitem__, block))
            inside.append(np.frombuffer(b"".join(own), np.uint16).astype(np.int32))
            at.append(np.array(list(map(len, own)), np.int64) // 2)
        if not words:
            return out
        inner, lengths = np.concatenate(inside), np.concatenate(at)
        ends = np.cumsum(lengths)
        totals = np.cumsum(inner[ends - 1])
        before = np.concatenate(([0], totals[:-1])).astype(np.int32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = self._solid(points)
        if int(solid.sum()) != len(inner):  # something besides white space stands between words
            return np.array(self.walk(text), np.int32)
        out[1:][solid] = inner + np.repeat(before, lengths)
        gap = np.flatnonzero(~solid)
        done = np.searchsorted(ends, np.cumsum(solid)[gap], side="right")
        out[1:][gap] = np.concatenate(([0], totals))[done]
        return out

    def _solid(self, points: np.ndarray) -> np.ndarray:
        """Which code points are no white space to the split pattern."""
        kind = self.kinds[points]
        if (kind == 2).any():
            for p in np.unique(points[kind == 2]):
                self.kinds[p] = self.words.match(chr(p)) is not None
            kind = self.kinds[points]
        return kind == 1

    def walk(self, text: str) -> list[int]:
        """``table`` word by word, which special tokens and words of very many tokens need."""
        out, before, open_part = [0], 0, ""
        for part, special in self.parts(text):
            if special:  # a part of the string is ordinary text behind what precedes it
                start = out[-1] - sum(self.word(w)[-1] for w in self.words.findall(open_part))
                for j in range(1, len(part)):
                    out.append(start + sum(self.word(w)[-1] for w in self.words.findall(open_part + self.normal(part[:j]))))
                before += 1
                out.append(before)
                open_part = ""
                continue
            at, open_part = 0, part
            for m in self.words.finditer(part):
                out += [before] * (m.start() - at)
                counts = self.word(m[0])
                out += [before + c for c in counts]
                before += counts[-1]
                at = m.end()
            out += [before] * (len(part) - at)
        return out


def counter(path: str) -> Counter:
    """This process's counter."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def default_vocabulary() -> str:
    """Path of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _mapped(docs: DataFrame, carry, path: str | None, name: str, kind: str, column) -> DataFrame:
    path = path or default_vocabulary()

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {name: column(own, texts)})

    kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in docs.select(*carry).schema)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, f"{kept}{name} {kind}")


def count_tokens(docs: DataFrame, carry=("doc_id",), path: str | None = None) -> DataFrame:
    """The columns of ``carry`` and ``n_tokens``, where no table is wanted."""
    return _mapped(docs, carry, path, "n_tokens", "long", lambda own, texts: pa.array([own.count(t or "") for t in texts], pa.int64()))


def prefix_tokens(docs: DataFrame, carry=("doc_id",), path: str | None = None) -> DataFrame:
    """The columns of ``carry`` and ``prefix_tokens array<int>``: the count at every prefix, the empty one first."""

    def column(own, texts):
        tables = [own.table(t or "") for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(t) for t in tables]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables) if tables else np.zeros(0, np.int32)))

    return _mapped(docs, carry, path, "prefix_tokens", "array<int>", column)


def n_tokens(table: str = "prefix_tokens") -> Column:
    """Tokens of the whole text, from its table."""
    return F.element_at(table, -1).cast("long")


def fits(budget: int, table: str = "prefix_tokens") -> Column:
    """Whether the whole text has at most ``budget`` tokens, from its table."""
    return n_tokens(table) <= budget


def cut_chars(budget: int, table: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens (0 or more), from the table."""
    last = F.array_position(F.reverse(F.transform(table, lambda c: c <= budget)), True)
    return F.when(fits(budget, table), F.size(table) - 1).otherwise(F.size(table) - last).cast("long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document, whether it goes over the limit, and where it would have to be cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    tables = prefix_tokens(docs, ("doc_id", "n_bytes"))
    return tables.select("doc_id", "n_bytes", n_tokens().alias("n_tokens"), (~fits(LIMIT)).alias("over_limit"), cut_chars(LIMIT).alias("cut_chars"))
