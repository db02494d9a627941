"""Language ID, BPE, quality, token counts, URL filter, decontamination."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.llm import byte_bpe, decontamination, language_id, quality, token_counts, url_filter

from .conftest import TEXTS


def test_language_of_odd_rows(odd, none):
    model = language_id.prototypes(odd)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in rows) and got[0]["lang_pred"] == "en"
    assert language_id.prototypes(none) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_language_vectors_are_bundles_of_bound_letters():
    d = 256
    v = {c: language_id.letter_vector(ord(c), d) for c in " ab"}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b a", " a "))
    assert np.array_equal(language_id.bundle(["Ab, 1 A"], d)[0], want)
    assert np.array_equal(language_id.bundle(["", None, "Ab, 1 A"], d)[2], want)


def test_language_of_very_long_texts(monkeypatch):
    """A text in pieces has the bundle of the whole."""
    text = "Ab, 1 A ünd so weiter und  so fort. " * 50
    want = language_id.bundle([text, None, "ab"], 128)
    for n in (1, 2, 37, 1000):
        monkeypatch.setattr(language_id, "GROUP_CHARS", n)
        assert np.array_equal(language_id.bundle([text, None, "ab"], 128), want)


def test_language_is_brute_force(spark):
    """Prototypes are sums of bundles, the prediction is the largest cosine, and only letters are letters."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("a house in the wood", "en"), ("der hund und die katze", "de"), ("das haus im wald", "de"), ("le chat et le chien", "fr")])]
    model = language_id.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 256)
    sums = {lang: sum(np.rint(h / np.linalg.norm(h) * 2**20) for h in language_id.bundle([t for _, t, k in rows if k == lang], 256)) for lang in ("en", "de", "fr")}
    assert all(np.array_equal(model[k], v) for k, v in sums.items()) and len(model) == 3
    texts = ["the wood", "die hunde", "le chien", "²½①", "Ⅷ 12", "x", "日本"]
    cos = lambda a, b: a @ b / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1)
    got = {r["text"]: r for r in language_id.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model, 256, ("text",)).collect()}
    for t in texts:
        own = {k: cos(language_id.bundle([t], 256)[0], v) for k, v in sums.items()}
        best = max(sorted(own), key=own.get)
        if t in ("²½①", "Ⅷ 12"):
            assert (got[t]["lang_pred"], got[t]["score"]) == ("und", 0)
        else:
            assert abs(got[t]["score"] - max(0.0, own[best])) < 1e-9 and got[t]["lang_pred"] == best


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    p = language_id.op1_language_id(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert p.where("lang = lang_pred").count() / p.count() > 0.95


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_bpe_is_the_library(odd, none, library):
    rows = byte_bpe.encode(odd.select("doc_id", "text", "ids"), ("doc_id", "text")).collect()
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in rows) and len(rows) == odd.count()
    back = byte_bpe.decode(byte_bpe.encode(odd, ("text",)), ("text", "ids")).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.digests(none).count() == 0
    r = byte_bpe.digests(odd).where("doc_id = 0").first()
    ids = library.encode_ordinary(odd.where("doc_id = 0").first()["text"])
    assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_bpe_of_random_text(library):
    own, rng = byte_bpe.encoder(*byte_bpe.default_vocabulary()), random.Random(5)
    for _ in range(500):
        s = "".join(rng.choice("aAé ß\n\t'sdre 12٣!?.日\u3000\xa0\x1c\x85ll\r\u200b") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(own.encode(s), "<i4").tolist() == library.encode_ordinary(s)


def test_bpe_of_a_vocabulary_with_an_unreachable_token(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"abc"]
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    own = byte_bpe.Encoder(str(tmp_path / "v"), r"\w+|\W+")
    assert np.frombuffer(own.encode("abc abcd"), "<i4").tolist() == [256, 32, 97, 98, 99, 100]


def test_quality(spark, sf_dir, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    rows = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").collect()
    assert np.mean([(r["score"] >= 0.7) == r["label"] for r in rows]) > 0.9
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    scores = quality.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    flat = quality.fit(none, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, flat).collect()} == {0.5}
    ones = quality.fit(docs, labels.withColumn("label", F.lit(1)))
    assert all(r["score"] > 0.9 for r in quality.score(odd, ones).collect())
    assert quality.score(none, model).count() == 0


def test_quality_learns_nothing_from_held_out_rows(spark, tmp_path):
    """Scores stay as they are when labels of held-out rows, languages and sources change; repeated labels count each."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") % 10_000)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    for name, d, x in (
        ("one", docs, labels.unionByName(labels)),
        ("two", docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")}), labels.unionByName(labels).withColumns({"quality": F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")).cast(labels.schema["quality"].dataType)})),
    ):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        x.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    one, two = ({r["doc_id"]: r for r in quality.op3_quality(spark, f"{tmp_path}/{n}").collect()} for n in ("one", "two"))
    assert one.keys() == two.keys() and all(one[i]["score"] == two[i]["score"] for i in one)
    assert all(r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in one.items())


def test_quality_features_by_a_plain_reading():
    for text in ("Ab cd! 12\n\nthe the end.", "", None, "é É 日本 x,y", "a  b\tc\u3000d", "!!!??"):
        got, t = dict(zip(quality.FEATURES, quality.features(text), strict=True)), text or ""
        words, lines = t.split(), [x for x in t.split("\n") if x]
        letters, solid = [c for c in t if c.isalpha()], max(1, sum(not c.isspace() for c in t))
        marks = [c for c in t if not (c.isalpha() or c.isdigit() or c.isspace())]
        m, k = max(1, len(words)), max(1, len(lines))
        want = {
            "log_chars": np.log1p(len(t)), "letters": len(letters) / solid, "upper": sum(c.isupper() for c in letters) / max(1, len(letters)), "digits": sum(c.isdigit() for c in t) / solid,
            "symbols": len(marks) / solid, "mean_word": solid / m, "distinct_words": len(set(words)) / m, "top_word": max((words.count(w) for w in words), default=0) / m,
            "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, "log_line": np.log1p(max(1, len(t)) / k), "distinct_lines": len(set(lines)) / k,
            "ended_lines": sum(x[-1] in ".!?" for x in lines) / k, "short_words": sum(len(w) < 3 for w in words) / m, "capital_words": sum(w[0].isupper() for w in words) / m,
        }
        assert all(abs(got[n] - v) < 1e-9 for n, v in want.items()), (text, got, want)


def boosted(x, y):
    """The model's main effects by rows and loops: each step fits one feature's binned gradient by three greedy cuts."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in x.T]
    share = (y.sum() + 1) / (len(y) + 2)
    total = np.full(len(y), np.log(share / (1 - share)))
    bins = [np.array([sum(e < v for e in own) for v in c]) for own, c in zip(edges, x.T, strict=True)]
    for _ in range(quality.ROUNDS):
        for b, own in zip(bins, edges, strict=True):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            parts = [(0, len(own) + 1)]
            fit = lambda lo, hi: (g[(b >= lo) & (b < hi)].sum(), h[(b >= lo) & (b < hi)].sum())
            worth = lambda lo, hi: (lambda s: s[0] ** 2 / (s[1] + quality.PENALTY))(fit(lo, hi))
            for _ in range(3):
                gains = [(worth(lo, c) + worth(c, hi) - worth(lo, hi), lo, hi, c) for lo, hi in parts for c in range(lo + 1, hi)]
                best = max(gains, key=lambda v: v[0], default=(0,))
                if best[0] <= 1e-9:
                    break
                parts.remove(best[1:3])
                parts += [(best[1], best[3]), (best[3], best[2])]
            for lo, hi in parts:
                s = fit(lo, hi)
                total[(b >= lo) & (b < hi)] += quality.RATE * s[0] / (s[1] + quality.PENALTY)
    return total


def test_quality_is_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "BINS", 6)
    monkeypatch.setattr(quality, "ROUNDS", 5)
    monkeypatch.setattr(quality, "PAIRS", 0)
    rng = np.random.default_rng(3)
    x = rng.random((120, 3))
    y = (x[:, 0] + 0.3 * rng.random(120) > 0.6).astype(float)
    assert np.allclose(quality.Model(x, y).score(x), 1 / (1 + np.exp(-boosted(x, y))), atol=1e-9)


def test_additive_score_is_the_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    m = quality.Model(x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float))
    fine, rough = m._bins(x)
    total = m.bias + sum(t[b] for t, b in zip(m.tables, fine, strict=True)) + sum(t[rough[a], rough[b]] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-total)))
    assert np.mean((m.score(x) > 0.5) == ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5))) > 0.9


def test_token_counts_are_the_library(odd, none):
    from tokenizers import Tokenizer

    path = token_counts.default_vocabulary()
    lib, own = Tokenizer.from_file(path), token_counts.Counter(path)
    count = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    rows = token_counts.count_tokens(odd, ("doc_id", "text")).collect()
    assert all(r["n_tokens"] == count(r["text"] or "") for r in rows) and len(rows) == odd.count()
    assert token_counts.count_tokens(none).count() == 0
    rng = random.Random(2)
    pieces = ["'", "r", "re", "ll", "'ve", "é", "e\u0301", "Σ", "İ", " ", "\n", "12", "!", "?!", "the", "ing", "日", "hello"]
    for _ in range(150):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        n = own.normal(s)
        assert own.table(s).tolist() == own.walk(s) == [count(n[:j]) for j in range(len(n) + 1)]
        assert own.count(s) == count(s)
    special = "hello <|endoftext|> world<|endoftext|>"
    assert own.count(special) == count(special) == own.table(special)[-1]


def test_truncation(spark):
    """Questions about budgets are answered from the stored table alone."""
    rows = [(1, "hello wonderful world"), (2, None), (3, "a b c d"), (4, ""), (5, "x" * 70_000), (6, "日本 <|endoftext|> \u3000 z")]
    table = token_counts.prefix_tokens(spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id",))
    own = token_counts.counter(token_counts.default_vocabulary())
    for budget in (0, 2, 3, 2048):
        got = {r["doc_id"]: r for r in table.select("doc_id", token_counts.n_tokens().alias("n"), token_counts.fits(budget).alias("fits"), token_counts.cut_chars(budget).alias("cut")).collect()}
        for i, t in rows:
            walked = own.walk(t or "")
            assert (got[i]["n"], got[i]["cut"]) == (walked[-1], max(j for j, c in enumerate(walked) if c <= budget))
            assert got[i]["n"] == own.count(t or "") and got[i]["fits"] == (walked[-1] <= budget)


URLS = [
    ("http://a.ORG/x?q=/z", "a.org", "/x", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://b.example.org/en/19#t", "b.example.org", "/en/19", "example.org/en/1", "block"), ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), ("http://x.com/de", "x.com", "/de", None, None), ("http://org", "org", "", None, None),
    ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://c.com?x=1/fr/", "c.com", "", None, None), ("a://b://c.org/", "b:", "//c.org/", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "r") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "r")], "page_id long, url string, rule string")
    rows = sorted(url_filter.judge(df).collect(), key=lambda r: r["page_id"])
    assert len(rows) == len(URLS) + 1
    for r in rows:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.where("url = 'nothing'")).collect()} == {"allow"}


def test_url_models_separate_what_rules_do(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good, bad = (lambda: word("aeioumnl")), (lambda: word("xzqkwj45"))
    rows = [(i, f"http://{good()}.org/{good()}" if i % 2 else f"http://{bad()}.com/de/{bad()}") for i in range(600)]
    rows += [(1000 + i, f"http://{good()}.net/{good()}" if i % 2 else f"http://{bad()}.net/{bad()}") for i in range(200)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert np.mean([(r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in out]) > 0.95


def test_url_counts_are_exact(spark):
    """Ratios are those of counts kept by n-gram in dictionaries, also with more n-grams than 2**18."""
    rng = random.Random(9)
    urls = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(6000)] + ["", "é"]
    kinds = [i % 3 // 2 for i in range(len(urls))]
    table = url_filter._count(spark.createDataFrame(list(zip(urls, kinds, strict=True)), "url string, kind int")).toPandas().sort_values("key")
    keys, counts = table["key"].to_numpy(), table[["bad", "good"]].to_numpy(float).T.copy()
    want = [{}, {}]
    grams = lambda raw: [(k, raw[i - k : i], raw[i : i + 1]) for i in range(4, len(raw)) for k in range(5)]
    for u, kind in zip(urls, kinds, strict=True):
        for k, context, byte in grams(b"\0" * 4 + u.encode()):
            for key in ((k, context, byte), (k, context)):
                want[kind][key] = want[kind].get(key, 0) + 1
    assert len(keys) == len(set(want[0]) | set(want[1])) > 1 << 18 and counts.sum() == sum(map(len, map(str.encode, urls))) * 10
    some = [*urls[:20], "not seen before", "", None]
    for u, got in zip(some, url_filter._ratio(keys, counts, some), strict=True):
        raw, total = b"\0" * 4 + (u or "").encode(), 0.0
        for kind in (0, 1):
            p = 0.0
            for k, context, byte in grams(raw):
                p = ((want[kind].get((k, context, byte), 0)) + 2 * (p if k else 1 / 256)) / (want[kind].get((k, context), 0) + 2)
                total += (2 * kind - 1) * np.log(p) * (k == 4)
        assert abs(got - total / max(1, len(raw) - 4)) < 1e-9


def test_url_judgement_is_brute_force(spark, monkeypatch):
    """Models, ratios, the threshold and all verdicts by dictionaries; the join of blocks gives the same."""
    rng = random.Random(12)
    hosts = ["a.org", "b.com", "c.net", "example.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'es', 'x'])}/{''.join(rng.choice('abcdeé') for _ in range(rng.randint(0, 9)))}" for _ in range(400)] + [None, "", "no scheme", "http://x/" + "long" * 50_000]
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)] + [(7, urls[7])] * 30
    monkeypatch.setattr(url_filter, "BLOCK", 40)
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).collect()
    assert len(got) == len(rows)
    allowed = {r for r, v in url_filter.RULES if v == "allow"}
    of = {}
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r, _ in url_filter.RULES if (lambda n, p: (host.lower() == n or host.lower().endswith("." + n)) and path.startswith(p))(r.split("/")[0], "/" + r.split("/", 1)[1])]
        of[u] = max(fits, key=len, default=None)
    counts = [{}, {}]
    grams = lambda raw: [(k, raw[i - k : i], raw[i : i + 1]) for i in range(4, len(raw)) for k in range(5)]
    test = lambda u: zlib.crc32((u or "").encode()) % 4 == 0
    for _, u in rows:
        if of[u] and not test(u):
            for k, context, byte in grams(b"\0" * 4 + u.encode()):
                for key in ((k, context, byte), (k, context)):
                    counts[of[u] in allowed][key] = counts[of[u] in allowed].get(key, 0) + 1
    ratio = {}
    for u in of:
        raw, total = b"\0" * 4 + (u or "").encode(), 0.0
        for kind in (0, 1):
            p = 0.0
            for k, context, byte in grams(raw):
                p = (counts[kind].get((k, context, byte), 0) + 2 * (p if k else 1 / 256)) / (counts[kind].get((k, context), 0) + 2)
                total += (2 * kind - 1) * np.log(p) * (k == 4)
        ratio[u] = total / max(1, len(raw) - 4)
    tested = [(ratio[u], of[u] in allowed) for _, u in rows if of[u] and test(u)]
    error = lambda e: sum(r < e for r, g in tested if g) / sum(g for _, g in tested) + sum(r >= e for r, g in tested if not g) / sum(not g for _, g in tested)
    rest = [r for r in got if r["rule"] is None]
    edge = (min([r["ratio"] for r in rest if r["verdict"] == "allow"], default=9.0) + max([r["ratio"] for r in rest if r["verdict"] == "block"], default=-9.0)) / 2
    assert all((r["verdict"] == "allow") == (r["ratio"] >= edge) for r in rest)
    assert all(r["verdict"] == ("allow" if r["rule"] in allowed else "block") for r in got if r["rule"])
    assert any(error(x) <= min(error(e) for e, _ in tested) + 1e-9 for x in np.arange(edge - 0.5, edge + 0.5, 0.005))
    want = sorted((i is None, i or 0, round(ratio[u], 9)) for i, u in rows)
    assert sorted((r["page_id"] is None, r["page_id"] or 0, round(r["ratio"], 9)) for r in got) == want


QUESTION = "Then Alice bought 12 apples for 3 dollars each at the corner market and later sold 5 of them to Bob"


def leaked(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: (r["item_ids"], r["exact_ids"]) for r in decontamination.leaks(docs, bench).collect()}


def test_decontamination(spark):
    changed = "so: Then Carol bought 40 apples for 7 dollars each at the corner market and later sold 9 of them to Dave ok"
    clash = changed.replace("sold 9", "sold 40")
    texts = [f"intro words here. {QUESTION}. and more", changed, clash, QUESTION.upper(), None, "", "a clean text about markets and apples and other things", "tiny item now"]
    got = leaked(spark, texts, [(1, QUESTION), (2, "tiny item now"), (3, "x"), (None, "nothing at all to see here today folks"), (4, None), (1, QUESTION)])
    assert got == {0: ([1], [1]), 1: ([1], []), 2: ([], []), 3: got[3], 4: ([], []), 5: ([], []), 6: ([], []), 7: ([2], [2])}
    assert leaked(spark, texts[:1], []) == {0: ([], [])}
    assert leaked(spark, [], [(1, QUESTION)]) == {}


def test_decontamination_of_items_without_plain_words(spark):
    """Verbatim copies of sums, names and very short items leak, and so does a short item behind a line without a stop."""
    items = [(1, "Compute 12 + 7 * 3 - 4 / 2 = 9"), (2, "At 9:30 Alice Smith paid Bob Jones 45 dollars for 3 kg"), (3, "What is the capital of the Netherlands"), (4, "Zyx 77"), (5, "Where did Alice go with 3 apples")]
    texts = [f"so here: {items[0][1]}. and more", f"well {items[1][1]}, he said", f"Quiz\n{items[2][1]}", "we saw zyx 77 there", "Quiz\nWhere did Carol go with 8 apples",
             "Compute 12 - 7 * 3 + 4 / 2 = 9", "Quiz\nBob is the capital of the Netherlands", "Quiz\nSay did Carol go with 8 apples", "zyx 78 and 77 zyx"]
    assert leaked(spark, texts, items) == {0: ([1], [1]), 1: ([2], [2]), 2: ([3], [3]), 3: ([4], [4]), 4: ([5], [])} | {i: ([], []) for i in (5, 6, 7, 8)}


def test_decontamination_of_other_numbers_and_names_among_few_plain_words(spark):
    items = [(1, "Compute 12 + 7 * 3 - 4 / 2 = 9"), (2, "At 9:30 Alice Smith paid Bob Jones 45 dollars for 3 kg"), (3, "12 7 3 4 2 9 8 1")]
    texts = ["then compute 40 + 9 * 2 - 6 / 3 = 5 now", "At 8:15 Carol White paid Dave Green 70 dollars for 9 kg", "At 8:15 Carol White paid Carol Green 70 dollars for 9 kg",
             "compute 40 - 9 * 2 + 6 / 3 = 5 now", "1 2 3 4 5 6 7 8 9 10", "see 12 7 3 4 2 9 8 1 there", "a table - 3 - 4 - 5 - 6 - 7 - 8 of rows"]
    assert leaked(spark, texts, items) == {0: ([1], []), 1: ([2], []), 5: ([3], [3])} | {i: ([], []) for i in (2, 3, 4, 6)}


def test_decontamination_of_several_items_and_odd_rows(spark, odd, none):
    items = [(i, f"item number {w} speaks of {w} and nothing else but {w} in the whole wide world of words") for i, w in enumerate(("apple", "pear", "plum", "fig"))]
    texts = [t for _, t in items] + [items[0][1] + " then " + items[3][1]] + [items[2][1]] * 40
    one = leaked(spark, texts, items)
    assert one[4] == ([0, 3], [0, 3]) and all(one[i] == ([2], [2]) for i in range(5, 45))
    bench = spark.createDataFrame([(7, TEXTS[0])] * 3 + [(8, "over the lazy dog")], "item_id long, text string")
    found = decontamination.leaks(odd, bench, ("doc_id", "text", "key", "row")).collect()
    assert len(found) == odd.count()
    assert all((r["item_ids"] == [7, 8]) == (r["text"] == TEXTS[0]) and r["row"] == "row" for r in found)
    assert decontamination.leaks(none, bench).count() == 0
    long = spark.createDataFrame([(None, "filler words " * 400_000 + QUESTION), (1, "filler words " * 10)], "doc_id long, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontamination.leaks(long, spark.createDataFrame([(1, QUESTION)], "item_id long, text string")).collect()} == {None: [1], 1: []}


def test_decontamination_joins_through_a_full_filter(spark, monkeypatch):
    """What the filter lets through for nothing does not match in the join."""
    items = [(1, QUESTION), (2, "What is the capital of the Netherlands")]
    texts = [QUESTION, "Quiz\nWhat is the capital of the Netherlands", "nothing of it", "a clean text about markets and apples and other things"]
    want = leaked(spark, texts, items)
    monkeypatch.setattr(decontamination, "key_filter", lambda df, c: df.sparkSession.sparkContext.broadcast(np.full(1 << 20, ~np.uint64(0))))
    assert leaked(spark, texts, items) == want and want[0] == ([1], [1]) and want[3] == ([], [])


def test_decontamination_finds_whole_passages(spark, sf_dir):
    import re

    norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontamination.op5_decontamination(spark, sf_dir).collect()}
    assert got == {d: {i for i, t in items.items() if t in text} for d, text in docs.items()}
