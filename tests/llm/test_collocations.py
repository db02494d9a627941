"""Collocations, held against counting by hand; the query also has SQL."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellspark.llm import collocations, queries


def brute(rows, least, most_words=4, inside=80, top=2000):
    words_of, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for d in ",;:!?\n\x0b\x0c\r":
            low = low.replace(d, ".")
        for piece in low.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            words_of[lang] += len(words)
            for n in range(1, most_words + 1):
                for i in range(len(words) - n + 1):
                    f[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, own in f.items():
        found, scored = {p: a for p, a in own.items() if len(p) > 1 and a >= least}, []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            held = any(100 * b >= inside * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not held:
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words_of[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    words = ["the", "The", "of", "ünd", "日本", "a", "b", "<x>", "don't", "w\x1c", "é", "-"] + [f"r{i}" for i in range(200)]
    gaps = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "; ", "?!", "\x0b", "\x0c", " : "]
    out = []
    for i in range(300):
        own = "".join(draw.choice(words[:12] if draw.random() < 0.8 else words) + (" " if draw.random() < 0.8 else draw.choice(gaps)) for _ in range(draw.randrange(60)))
        out.append((own, draw.choice(["en", "de", None, ""])))
    return out + [(None, "en"), ("", None), (" .,\n", "xx"), ("one two three four " * 500, "en"), ("AB ab " * 20_000, "zz")]


@pytest.mark.parametrize("least,top", [(30, 2000), (5, 2000), (5, 7)])
def test_collocations_are_brute_force(spark, texts, least, top):
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    assert rows_of(collocations.ranked(collocations.collocations(df, least), top)) == brute(texts, least, top=top)


def test_a_full_sketch_and_small_blocks_change_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "CELL_BITS", collocations.RANGE_BITS)
    for name in ("HASHED", "SKETCHED", "SCANNED"):
        monkeypatch.setattr(collocations, name, 3000)
    df = spark.createDataFrame(texts, "text string, lang string")
    monkeypatch.setattr(collocations, "_lets_through", lambda bitmap, bits, hashes: hashes != 0)
    assert rows_of(collocations.ranked(collocations.collocations(df, 5))) == brute(texts, 5)


def test_phrases_of_one_hash_are_told_apart():
    plain = collocations.normal([b"a b c a b d"])
    starts, ends, hashes = collocations.Hasher().words(plain, 0)
    every = np.full(1 << 13, 255, np.uint8)
    same = np.where(hashes == hashes[2], hashes[5], hashes)  # c and d
    phrases, n = collocations.scan(plain, (starts, ends, same), every, None, 16, 2)
    assert dict(zip(phrases, n.tolist(), strict=True)) == {"a": 2, "b": 2, "c": 1, "d": 1, "a b": 2, "b c": 1, "c a": 1, "b d": 1}


def test_parts_of_a_long_text_have_the_same_words():
    plain, hasher = collocations.normal([b"word other " * 200_000]), collocations.Hasher()
    parts = [np.concatenate(x) for x in zip(*collocations._cut(plain, hasher, "en"), strict=True)]
    for a, b in zip(parts, hasher.words(plain, collocations._salt("en")), strict=True):
        assert np.array_equal(a, b)


def test_scores_pass_64_bits(spark):
    big = 6 * 10**12
    counts = [("en", "x y", big), ("en", "x", big), ("en", "y", big + 1), ("en", None, 3 * big)]
    import cellspark.llm.collocations as own

    given, own.occurrences = own.occurrences, lambda *a, **b: spark.createDataFrame(counts, "lang string, phrase string, f long")
    try:
        found = own.collocations(None).collect()
    finally:
        own.occurrences = given
    assert [(r["phrase"], r["score"]) for r in found] == [("x y", 2_000_000 * big // (2 * big + 1))]


def test_odd_rows(odd, none):
    assert collocations.ranked(collocations.collocations(none)).count() == 0
    rows = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert rows_of(collocations.ranked(collocations.collocations(odd, 2))) == brute(rows, 2)


def test_query_matches_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.oracle_sql()['op11_collocations']})").fetchall()
    assert rows_of(queries.queries()["op11_collocations"](spark, sf)) == sorted(want)
