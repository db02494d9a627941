"""Suffix dedup, n-gram join, sharding, spot signatures, components, the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellspark.llm import graph, ngram_join, queries, sharding, spotsigs, suffix_dedup

from .conftest import TEXTS, classes, kept_bytes, linked, shingles


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def repetitive(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    out = {}
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            at = rng.randint(0, len(p) - 1)
            t += p[at:] + p[: rng.randint(0, len(p))]
        out[i] = t if i % 9 else (out.get(i - 1) or t)
    out |= {n: None, n + 1: "", n + 2: "a" * 1000, n + 3: "ab" * 400, n + 4: "a" * 150, n + 5: passage[0][:100]}
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_brute_force(spark, seed, hot, monkeypatch):
    texts = repetitive(seed)
    rows = suffix_dedup.remove(frame(spark, texts), hot_from=hot).collect()
    want = kept_bytes(texts)
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in rows} == want
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_suffix_dedup_of_very_long_texts_in_parts(monkeypatch):
    rng = random.Random(7)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = suffix_dedup.parse([raw])
    starts = np.concatenate([whole[1][i] + np.arange(whole[2][i] + 1) for i in range(len(whole[1]))])
    assert np.array_equal(np.sort(starts), np.arange(len(raw) - 99))
    assert (whole[2] < 69).all() and (whole[3] <= 68).all() and (whole[3] >= whole[2]).all()


def test_suffix_dedup_of_odd_rows(odd, none):
    rows = suffix_dedup.remove(odd, ("doc_id", "text", "row", "doc")).collect()
    assert len(rows) == odd.count() and {r["row"] for r in rows} == {"row"}
    assert all(bytes(r["kept"]) == (r["text"] or "").encode() for r in rows if len((r["text"] or "").encode()) < 100)
    assert suffix_dedup.remove(none).count() == 0


def near_copies(seed, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out, i = {}, 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out[i] = " ".join(t)
            i += 1
    out |= {i: None, i + 1: "", i + 2: "only", i + 3: "ONLY", i + 4: "two words", i + 5: "two\vwords"}
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join_is_brute_force(spark, k, percent):
    texts = near_copies(k * percent)
    rows = ngram_join.cluster(frame(spark, texts), k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(texts, k, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(shingles(t, k)) for i, t in texts.items()}


def test_ngram_join_of_a_family_without_a_centre(spark, monkeypatch):
    """Copies that are far from each other but share most buckets with an original go through all rounds."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = {1000: " ".join(base)}
    for i in range(60):
        t = list(base)
        for j in rng.sample(range(150), rng.randint(1, 6)):
            t[j] = f"e{i}.{j}"
        texts[i] = " ".join(t)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = ngram_join.cluster(frame(spark, texts), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(texts, 3, 90)


@pytest.mark.parametrize(("share", "percent"), [(0.75, 80), (0.8, 90)])
def test_ngram_join_of_documents_with_much_in_common(spark, monkeypatch, share, percent):
    """Documents that share a passage but do not link, among them some that do, in buckets larger than a block."""
    rng = random.Random(int(100 * share) + percent)
    n = 120
    passage = [f"p{i}" for i in range(int(n * share))]
    texts, i = {}, 0
    while len(texts) < 90:
        own = [f"o{i}.{j}" for j in range(n - len(passage))]
        texts[i] = " ".join(passage + own)
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = f"x{i}"
            texts[i + 1] = " ".join(passage + own)
        i += 2
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rare = []
    plain = ngram_join._rare_words
    monkeypatch.setattr(ngram_join, "_rare_words", lambda *a: rare.append(1) or plain(*a))
    rows = ngram_join.cluster(frame(spark, texts), 2, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(texts, 2, percent) and rare


def test_rare_words_miss_no_link():
    """Of 4 (D + 1) words linked sets share all but D, so the D + 1 rarest of each have one in common."""
    rng = np.random.default_rng(14)
    for percent in (80, 90):
        bands = ngram_join.Bands(percent, fine=True)
        for n in (3, 10, 45, 400):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = next(d for d in range(n, -1, -1) if 100 * (n - d) >= percent * (n + d))
            b = np.unique(np.concatenate((a[d:], rng.integers(0, 1 << 63, d).astype(np.uint64))))
            x, y = ({band: (most, key) for band, most, key in bands.words(s)} for s in (a, b))
            assert set(x) & set(y)
            for band in set(x) & set(y):
                assert len(np.intersect1d(x[band][1], y[band][1])) >= len(x[band][1]) - x[band][0] and len(x[band][1]) == 4 * (x[band][0] + 1)


def test_parity_words_bound_the_difference():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90):
        bands = ngram_join.Bands(percent)
        for n in [*range(1, 60), 500, 3000]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = next(d for d in range(n, -1, -1) if 100 * (n - d) >= percent * (n + d))
            b = np.unique(np.concatenate((a[d:], rng.integers(0, 1 << 63, d).astype(np.uint64))))
            for other in (b, a[: max(1, -(-percent * n // 100))]):
                if 100 * len(np.intersect1d(a, other)) >= percent * len(np.union1d(a, other)):
                    assert len(np.intersect1d(bands.keys(a), bands.keys(other))), (percent, n)
            assert np.bitwise_count(ngram_join.sketch(a) ^ ngram_join.sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_ngram_join_of_odd_rows(odd, none):
    rows = ngram_join.cluster(odd).collect()
    assert len(rows) == odd.count()
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert got[1, 16] == 0 and got[2, 0] == 2 and got[3, 0] == 3 and got[None, 16] is None
    assert ngram_join.cluster(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (100, 101)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 5000])
def test_sharding_law(spark, n):
    rows = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.lit("c").alias("shard_key"))
    got = sharding.assign(rows).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and (n == 0 or max(counts.values()) - min([counts.get(s, 0) for s in range(16)]) <= 1)
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_sharding_of_odd_rows(odd, none):
    rows = sharding.assign(odd).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {*odd.columns, "shard", "slot"}
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1 and sharding.assign(none).count() == 0


def test_sharding_of_repeated_rows(spark, monkeypatch):
    """Rows equal in all columns, and rows that share a key, spread like others."""
    monkeypatch.setattr(sharding, "PART", 7)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 5).when(F.col("id") < 2000, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 500, 1).otherwise(F.col("id")).alias("size"))
    got = sharding.assign(rows).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 3000 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sum(r["doc_id"] == 5 and r["size"] == 1 for r in got) == 500


def test_a_changed_text_does_not_move_its_document(spark):
    """Where shards have room, only the key decides; a key of most rows is still cut into buckets."""
    rows = spark.range(5000).select((F.col("id") * 7).alias("doc_id"), F.lit("c").alias("text"))
    changed = rows.withColumn("text", F.when(F.col("doc_id") % 35 == 0, F.lit("other")).otherwise(F.col("text")))
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.assign(df, slack=1.0).collect()} for df in (rows, changed))
    assert one == two
    hot = rows.union(spark.range(20_000).select(F.lit(-1).cast("long"), F.col("id").cast("string")))
    got = sharding.assign(hot).collect()
    counts = Counter(r["shard"] for r in got)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got) == 25_000 and max(counts.values()) - min(counts.values()) <= 1


def test_sharding_moves_little(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"))
    moved = {}
    for slack in (0.0, 0.25):
        a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(rows, s, slack=slack).collect()} for s in (16, 17))
        moved[slack] = sum(a[i] != b[i] for i in a) / len(a)
    assert moved[0.0] < 0.15 and moved[0.25] < 0.08
    places, owners = sharding.ring(16)
    more, more_owners = sharding.ring(17)
    assert {(p, o) for p, o in zip(places, owners, strict=True)} <= {(p, o) for p, o in zip(more, more_owners, strict=True)}


def sequential(keys, places, owners, bounds):
    """Shard of each key (arc, hash): rounds over the arcs, key by key, on to the next place where a shard is full."""
    arcs = {a: sorted(h for x, h in keys if x == a) for a in range(len(places))}
    load, out = [0] * len(bounds), {}
    for step in range(len(places)):
        for arc, waiting in arcs.items():
            shard = owners[(arc + step) % len(owners)]
            while waiting and load[shard] < bounds[shard]:
                out[arc, waiting.pop(0)] = shard
                load[shard] += 1
    return out


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_sharding_plan_is_the_sequential_rule(slack):
    rng = random.Random(3)
    owners = [rng.randrange(4) for _ in range(12)]
    keys = [(rng.choice((0, 3, 3, 3, 7, rng.randrange(12))), i * 10 + rng.randrange(10)) for i in range(180)]
    bounds = sharding.bounds_of(len(keys), 4, slack)
    want = sequential(keys, owners, owners, bounds)
    runs = sharding.plan([sum(a == x for a, _ in keys) for x in range(12)], owners, bounds)
    for arc, own in enumerate(runs):
        shards = [s for s, n in own for _ in range(n)]
        assert shards == [want[arc, h] for a, h in sorted(keys) if a == arc]


def test_sharding_is_the_sequential_ring(spark):
    """Row by row, with ranks taken over several buckets of each arc."""
    rows = spark.range(900).select((F.col("id") * 13).alias("doc_id"))
    cell, own = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(False)), 64 - sharding.CELL_BITS), F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("1")), 32)
    places, owners = sharding.ring(5, 3)
    keys = {r["doc_id"]: (sharding.place_of(r["c"], places), r["c"] << 32 | r["h"]) for r in rows.select("doc_id", cell.alias("c"), own.alias("h")).collect()}
    want = sequential(list(keys.values()), places, owners, sharding.bounds_of(900, 5))
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(rows, 5, 3).collect()}
    assert got == {d: want[k] for d, k in keys.items()}


def test_spot_signatures():
    assert len(spotsigs.signatures(None)) == 0 == len(spotsigs.signatures(""))
    assert len(spotsigs.signatures("!!!")) == 1 and len(spotsigs.signatures("plain words")) == 2
    a = spotsigs.signatures("the cat sat on the mat near a dog house")
    assert np.array_equal(a, spotsigs.signatures("The CAT sat, on the mat near a dog house!"))
    assert spotsigs.likeness(a, a) == 1 and spotsigs.likeness(a, a[:0]) == 0 and spotsigs.likeness(a[:0], a[:0]) == 1


def test_spot_edits_are_brute_force(spark, odd, none):
    texts = {i * 3: t for i, t in enumerate(TEXTS * 3)}
    order = sorted(texts)
    for rows in (1, 5, 1000):
        beside = spark.createDataFrame([(d, -d) for d in order if d % 2], "doc_id long, class_id long")
        got = {r["doc_id"]: r for r in spotsigs.edits(frame(spark, texts), rows, beside=beside).collect()}
        assert set(got) == set(order) and all(r["class_id"] == (-d if d % 2 else None) for d, r in got.items())
        for i, d in enumerate(order):
            t, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
            new = spotsigs.edited(t, after)
            s, e, x = (spotsigs.signatures(v) for v in (t, new, after))
            assert got[d]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[d]["n_chars"] == len(t)
            assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (spotsigs.packed(s), spotsigs.packed(e))
            assert (got[d]["near_edited"], got[d]["near_next"]) == (spotsigs.likeness(s, e), spotsigs.likeness(s, x))
    assert spotsigs.edits(odd).count() == odd.count() and spotsigs.edits(none).count() == 0
    assert spotsigs.edits(frame(spark, {5: "one text"})).first()["near_next"] == 1


@pytest.mark.parametrize("nulls", [0, 1])
def test_spot_edits_of_large_ids_are_whole(spark, nulls):
    """Ids that doubles cannot tell apart, beside a null id."""
    ids = [2**53 + 2 * i + 1 for i in range(39)] + [2**62 + i for i in range(7)] + [-(2**60) - i for i in range(5)]
    rows = [(d, f"the text of {i} and a house of the {i % 5} town") for i, d in enumerate(ids)] + [(None, "a text")] * nulls
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, two = (sorted(map(tuple, spotsigs.edits(df, n).collect()), key=str) for n in (2, 1000))
    assert one == two and sorted(r[0] for r in one if r[0] is not None) == sorted(ids) and len(one) == len(rows)


def test_spot_edits_carry_classes_of_all_rows(spark, odd):
    rows = spotsigs.edits(odd, 3, beside=spotsigs.classes(odd).where("doc_id is not null").distinct()).collect()
    assert len(rows) == odd.count() and {r["class_id"] for r in rows if r["doc_id"] is None} == {None}
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0: 0, 1: 0, 2: 2}


def test_spot_classes_are_brute_force(spark, odd, none):
    texts = {i: f"the {t} and a {t} of the end" if t else t for i, t in near_copies(8).items()}
    sets = {i: frozenset(spotsigs.signatures(t).tolist()) for i, t in texts.items()}
    want = linked(sets, 80)
    got = {r["doc_id"]: r for r in spotsigs.classes(frame(spark, texts)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want and len(set(want.values())) < len([s for s in sets.values() if s])
    assert all(r["n_signatures"] == len(sets[i]) for i, r in got.items())
    assert spotsigs.classes(odd).count() == odd.count() and spotsigs.classes(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(name, spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_suffix_dedup_of_odd_rows_is_brute_force(spark):
    """Null and repeated ids, equal rows, very long texts cut into blocks, and runs of one letter."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400))
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000)) + passage + "z" * 900
    rows = [(5, passage), (5, passage + "x"), (5, passage), (None, passage[:150]), (None, passage[100:300]), (7, long), (9, long[1500:2700]), (9, None), (-3, "q" + passage[50:260]), (11, "z" * 300)]
    got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ("doc_id", "text")).collect()
    distinct = list(dict.fromkeys(rows))
    ties = {t: r["h"] for t in {t for _, t in rows} for r in spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t").alias("h")).collect()}
    order = sorted(distinct, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    want = {order[i]: v for i, v in kept_bytes({i: t for i, (_, t) in enumerate(order)}).items()}
    assert len(got) == len(rows)
    assert all((bytes(r["kept"]), r["n_removed"], r["n_spans"]) == want[r["doc_id"], r["text"]] for r in got)


def test_suffix_dedup_in_small_blocks(spark, monkeypatch):
    """Cuts of long texts between blocks change nothing."""
    texts = repetitive(5, 12)
    texts[99] = "".join(texts[i] or "" for i in range(12)) * 2
    want = kept_bytes(texts)
    for size in (100, 137, 1000):
        monkeypatch.setattr(suffix_dedup, "BYTES", size)
        docs = [p for b in [pa.RecordBatch.from_pydict({"text": list(texts.values())})] for _, part in suffix_dedup._blocks([b], "text") for p in part]
        starts = Counter((row, at + j) for row, at, piece in docs for j in range(len(piece) - 99))
        raw = [(t or "").encode() for t in texts.values()]
        assert starts == Counter((i, j) for i, r in enumerate(raw) for j in range(len(r) - 99))
    monkeypatch.undo()
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove(frame(spark, texts)).collect()} == {i: k for i, (k, _, _) in want.items()}


def test_suffix_ranks_are_the_order_of_the_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 900).astype(np.uint8)
    data[300:520] = data[:220]
    at = np.arange(801)
    strings = [data[i : i + 100].tobytes() for i in at]
    place = {s: i for i, s in enumerate(sorted({data[i : i + 100].tobytes() for i in range(801)}))}
    assert suffix_dedup.ranks(data, at).tolist() == [place[s] for s in strings]


def test_runs_of_one_letter_are_one_row(spark):
    df = spark.createDataFrame([(1, "a" * 100_000)], "doc long, text string").withColumn("tie", F.lit(0).cast("long"))
    assert suffix_dedup._phrases(df).count() < 10


def test_pipeline_is_brute_force(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from cellspark.llm.shared import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        columns = docs.columns
        docs = materialize(stage(spark, docs, sf_dir))
        after[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
        if name == "language":
            assert set(after[name]) == set(before)
        if name == "near_duplicates":
            assert set(after[name]) == {i for i, c in classes(before, 5, 80).items() if i == c}
        if name == "repeats":
            want = {i: k.decode("utf-8", "ignore") for i, (k, _, _) in kept_bytes(before).items()}
            assert {i: r["text"] for i, r in after[name].items()} == {i: t for i, t in want.items() if t.strip(" ")}
    assert set(after["tokens"]) == set(after["decontaminated"]) and all(r["round_trip"] for r in after["tokens"].values())


def test_pipeline_of_odd_and_no_rows(spark, odd, none, sf_dir):
    """Null ids and texts, letterless, empty, long and repeated rows, and clashing column names, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    before = odd.select("doc_id", "text").collect()
    docs, left = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        left[name] = [(r["doc_id"], r["text"] if name != "tokens" else r["n_tokens"]) for r in docs.collect()]
        assert name == "tokens" or docs.columns == odd.columns
    assert not any(t is None or not any(map(str.isalpha, t)) for _, t in left["language"]) and (0, TEXTS[0]) in left["language"]
    assert Counter(left["language"]) <= Counter((r["doc_id"], r["text"]) for r in before)
    kept = {i for i, _ in left["near_duplicates"]}
    assert (0, TEXTS[0]) in left["near_duplicates"] and 1 not in kept and (None, TEXTS[0]) in left["near_duplicates"]
    assert Counter(left["near_duplicates"]) <= Counter(left["language"]) and all(t.strip() for _, t in left["repeats"])
    assert Counter(i for i, _ in left["tokens"]) == Counter(i for i, _ in left["decontaminated"]) <= Counter(i for i, _ in left["repeats"])
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0 and (name == "tokens" or docs.columns == none.columns)


def test_pipeline_drops_leaked_documents_and_codes_the_rest(spark, sf_dir, tmp_path):
    """The last two stages against the tokenizer's library and planted benchmark items."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tiktoken

    from cellspark.llm import byte_bpe

    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, f"{clean[i]} {t} {clean[i + 1]}") for i, t in enumerate(items)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.decontaminated(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(8))
    path, pattern = byte_bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in corpus_pipeline.tokens(spark, kept, sf_dir).collect():
        assert (r["ids"], r["n_tokens"], r["round_trip"]) == (library.encode_ordinary(clean[r["doc_id"]]), len(r["ids"]), True)


def test_pipeline_drops_unlearned_languages(spark, sf_dir):
    """Foreign scripts and random letters of 20 to 2,000 words, without a label, go; labelled documents stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = []
    for low, high in ((0x430, 0x44F), (0xAC00, 0xD7A3), (0x3B1, 0x3C9), (97, 122)):
        for n in [20] * 15 + [200] * 10 + [2000] * 5:
            text = " ".join("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 9))) for _ in range(n))
            planted.append((10**9 + len(planted), text, None, "s", len(text)))
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, both, sf_dir).select("doc_id").collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= kept
    assert len([i for i in kept if i >= 10**9]) <= 0.02 * len(planted)
