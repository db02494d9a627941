"""Links between two vocabularies, held against the libraries on whole texts and a count of all pairs."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.llm import alignment


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path_a, path_b = alignment.default_vocabularies()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def whole(coders, text):
    """Groups of a text's ids by encoding it at once; None where bytes differ."""
    a, b = coders
    raw = (" " + text).encode()
    byte = {c: i for i, c in enumerate(alignment.byte_symbols())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None

    def ends(parts):
        out, n = [], 0
        for p in parts:
            n += len(p)
            out.append(n)
        return out

    at_a, at_b = ends(of_a), ends(of_b)
    out, i, j = [], 0, 0
    for cut in sorted(set(at_a) & set(at_b)):
        x, y = i, j
        while i < len(at_a) and at_a[i] <= cut:
            i += 1
        while j < len(at_b) and at_b[j] <= cut:
            j += 1
        out.append((ids_a[x:i], ids_b[y:j]))
    return out


def brute(coders, texts):
    """The query's figures for texts in their order, by listing every link."""
    groups = [whole(coders, t) if t else None for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] if g else [] for g in groups]
    count = Counter(p for own in links for p in set(own))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for g, own in zip(groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g) if g else None
        out.append((
            sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(own), sum(count[p] == highest[p[0]] for p in own),
            sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ))
    return out


ODD = [
    " leading", "trailing ", "two  spaces\n\nand lines\n", "tab\t in\r\nlines \r x", "▁ literal", "a▁b", "日本語 のテキスト", "😀 👩‍👩‍👧 ok", " x  y　z", "\x1c \x1d a",
    "don't we'll I'VE", "</s><s> <unk> <|endoftext|>", "x" * 900, "ab" * 3000 + " cd", "1234567 89,10", "\x00 nul", "é ﬁ ①", " ", "\n", "   \n ", "}\r\n );\r x", "naïve ÀÉÎ ſß",
]


def rows(df):
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return [tuple(r[c] for c in names) for r in df.orderBy("doc_id").collect()]


def test_figures_are_brute_force(spark, coders):
    draw, alphabet = random.Random(7), "ab eE \n\t.,'1é日😀\r▁ "
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randrange(1, 60))) for _ in range(300)] + ["the same text of all"] * 40 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows(alignment.link_figures(df)) == brute(coders, texts)


def test_figures_of_a_table_are_brute_force(spark, sf_dir, coders):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    assert rows(alignment.op12_alignment(spark, sf_dir)) == brute(coders, texts)


def test_many_places_give_the_same(spark, sf_dir, coders, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 500)
    monkeypatch.setattr(alignment, "BLOCK", 2000)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    assert rows(alignment.link_figures(df)) == brute(coders, texts)


def test_large_groups_are_multiplied(coders, monkeypatch):
    found = np.frombuffer(alignment.multiplied([1, 1, 2] * 5, [7, 8] * 5), np.int64)
    assert dict(zip(found[::2].tolist(), found[1::2].tolist(), strict=True)) == {1 << 32 | 7: 50, 1 << 32 | 8: 50, 2 << 32 | 7: 25, 2 << 32 | 8: 25}
    own = alignment.aligner(*alignment.default_vocabularies())
    texts = [" eauouon. naïve", " 日本語のテキスト", " éé", " xyzzy\nabc"]
    few = own.figures(texts)
    monkeypatch.setattr(alignment, "EXPANDED", 0)
    for x, y in zip(few, own.figures(texts), strict=True):
        sums = [alignment.summed(*np.frombuffer(p[1], np.int64).reshape(-1, 2).T) for p in (x, y)]
        assert x[0] == y[0] and x[2] == y[2] and all(np.array_equal(u, v) for u, v in zip(*sums, strict=True))


def test_a_small_cache_gives_the_same(spark, sf_dir, coders, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 50)
    monkeypatch.setattr(alignment, "_aligners", {})
    own = alignment.aligner(*alignment.default_vocabularies())
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).collect()] + ODD
    for t in filter(None, texts):
        want = whole(coders, t)
        numbers, digest = own.align(own.stretches.findall(" " + t))[:2]
        assert numbers[:3] == [sum(len(a) for a, _ in want or []), sum(len(b) for _, b in want or []), len(want or [])]
        assert bool(digest) == bool(want)


def test_odd_rows(odd, none):
    assert alignment.link_figures(none).count() == 0
    got = alignment.link_figures(odd)
    assert got.count() == odd.count()
    empty = {tuple(r) for r in got.where(F.col("doc_id").isin(2, 3)).drop("doc_id").collect()}
    assert empty == {(0,) * 6 + ("",)}
