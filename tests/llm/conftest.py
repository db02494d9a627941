import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

TEXTS = [
    "The quick brown fox jumps over the lazy dog. It was a good day for all of us.",
    "The quick brown fox jumps over the lazy dog. It was a good day for all of us.",
    None,
    "",
    "   \n\t ",
    "12345 !!! ???",
    "one",
    "Der schnelle braune Fuchs springt über den faulen Hund und die Katze ist nicht da.",
    "日本語のテキスト ÀÉÎ ſß İstanbul Σίσυφος",
    "ab" * 40_000,
    "x " * 30_000,
    "<|endoftext|> don't we'll <|start",
]


@pytest.fixture
def odd(spark):
    """Null ids, null, empty and long texts, copies, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, ""), (7, TEXTS[7]), (7, "another text under the same id")]
    df = spark.createDataFrame([(i, t, "en" if t and i != 7 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "kind", "row", "bucket", "tail", "doc", "hash", "ids", "score", "component", "a", "b"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture
def none(odd):
    return odd.limit(0)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def linked(sets, percent):
    """Least id reachable by links of sets, by comparing all."""
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            u, v = find(a), find(b)
            up[max(u, v)] = min(u, v)
    return {i: find(i) for i in sets}


def classes(texts, k, percent):
    """``linked`` for shingles."""
    return linked({i: shingles(t, k) for i, t in texts.items()}, percent)


def kept_bytes(texts, n=100):
    """(kept bytes, removed, spans) by id, by a set of all strings seen."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if w in seen:
                gone[s : s + n] = b"\1" * n
            else:
                seen.add(w)
        spans = sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (bytes(b for b, g in zip(raw, gone, strict=True) if not g), sum(gone), spans)
    return out
