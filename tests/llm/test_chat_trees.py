"""Reply trees, held against walking each tree by hand; the query also has SQL."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellspark.llm import chat_trees, queries

KIND = "tree string, node long, parent long, role string, text string, score double"
HARD = ["", "\\", "\\\\", "[INST]", "[\\INST]", "[/INST]</s>", "<\\/s>", "[[INST]]", "<</s>>", "</s>\n[INST]user[/INST]", "\\[INST]\\", "[", "[/", "</", "日本\\n", "[\\\\INST]"]


@pytest.mark.parametrize("text", HARD + ["".join(random.Random(i).choices("[]/INST\\<s>", k=40)) for i in range(200)])
def test_escapes_are_undone(text):
    said = chat_trees.escape(text)
    assert chat_trees.unescape(said) == text
    assert not any(c in said for c in (chat_trees.OPEN, chat_trees.MIDDLE, chat_trees.END))
    whole, a, b = chat_trees.turn(text, text)
    assert list(chat_trees.read(whole + whole)) == [(text, text)] * 2
    assert chat_trees.unescape(whole[a:b]) == text


def brute(rows, best, mean):
    """(tree, rank, turns) of the best paths."""
    by_id = {r[1]: r for r in rows}
    parents = {r[2] for r in rows}
    trees = {}
    for r in rows:
        if r[1] in parents:
            continue
        path, at = [r], r
        while at[2] in by_id:
            at = by_id[at[2]]
            path.append(at)
        total = sum(x[5] for x in path)
        trees.setdefault(r[0], []).append((-(total / len(path) if mean else total), r[1], [(x[3], x[4]) for x in reversed(path)]))
    return sorted((t, i + 1, p) for t, own in trees.items() for i, (_, _, p) in enumerate(sorted(own, key=lambda x: x[:2])[:best]))


def forest(n, trees, seed):
    draw, rows = random.Random(seed), []
    for i in range(n):
        t = draw.randrange(trees) if draw.random() < 0.6 else 0
        own = [r for r in rows if r[0] == f"t{t}"]
        parent = draw.choice(own[-3:] if draw.random() < 0.7 else own)[1] if own else None
        rows.append((f"t{t}", i * 7, parent, draw.choice(["user", "assistant"]), f"said {i} {draw.choice(HARD)}", float(draw.randrange(8))))
    return rows


def turns_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["tree"], r["rank"], r["path"]), {})[r["place"]] = (r["role"], r["text"])
    return sorted((t, k, [own[i] for i in range(len(own))]) for (t, k, _), own in out.items())


@pytest.mark.parametrize("best,mean,unique", [(1, True, False), (3, False, True), (None, True, False)])
def test_paths_are_brute_force(spark, best, mean, unique):
    rows = forest(400, 6, 5)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), KIND).repartition(4)
    assert turns_of(chat_trees.chosen_paths(df, best, mean, unique)) == brute(rows, best, mean)


def test_deep_chain_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat_trees, "STRETCH", 200)
    rows = [("t", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"{i} [INST] \\ {'x' * (i % 30)}", 0.0) for i in range(1000)]
    found = chat_trees.format_paths(chat_trees.chosen_paths(spark.createDataFrame(rows, KIND).repartition(6))).collect()
    assert len(found) == 1
    whole = found[0]["formatted"]
    assert list(chat_trees.read(whole)) == [(r[3], r[4]) for r in rows]
    assert [chat_trees.unescape(whole[a:b]) for a, b in found[0]["loss_spans"]] == [r[4] for r in rows if r[3] == "assistant"]


def test_odd_trees(spark):
    rows = [
        ("a", 1, None, "user", "root", 1.0), ("a", 2, 1, None, None, None), ("a", 3, 99, "user", "orphan", 5.0),  # 99 is none
        ("a", None, 1, "user", "no node", 9.0), ("a", 1, None, "zuser", "twin", 0.0),  # the twin of node 1 is a leaf
        ("c", 10, 12, "user", "x", 1.0), ("c", 11, 10, "user", "y", 1.0), ("c", 12, 11, "user", "z", 1.0), ("c", 13, 12, "user", "below", 1.0),  # a circle
        (None, 20, None, "user", "tree is null", 0.0),
    ]
    df = spark.createDataFrame(rows, KIND)
    got = chat_trees.chosen_paths(df.withColumn("path", F.lit("p")).withColumn("id", F.lit("i")).withColumn("up", F.lit("u")), None)
    leaves = {}
    for r in got.collect():
        leaves.setdefault(r["path"], {})[r["place"]] = r["text"]
    assert sorted([own[i] for i in range(len(own))] for own in leaves.values()) == [["orphan"], ["root", ""], ["root", "no node"], ["tree is null"], ["twin"]]
    assert chat_trees.chosen_paths(df.limit(0)).count() == 0
    assert chat_trees.format_paths(chat_trees.chosen_paths(df.limit(0))).count() == 0


def test_linear_rows_are_in_order(spark):
    rows = [(c, t, random.Random(c * 100 + t).choice(["user", "assistant", None]), f"{c} {t} </s>" if t % 5 else None) for c in (1, 2, 5) for t in range(40)]
    rows += [(1, 7, "user", "again"), (1, 7, "user", "again"), (None, 3, "user", "null conversation"), (None, None, "assistant", "null turn"), (9, 0, "assistant", "")]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "conv_id long, turn long, role string, text string").withColumn("node", F.lit(0)).withColumn("tree", F.lit("t"))
    got = {r["conv_id"]: r for r in chat_trees.digests(chat_trees.format_paths(chat_trees.chosen_paths(chat_trees.linear(df.repartition(7)), unique=True))).collect()}
    assert len(got) == 5
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=key)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_trees.linear(df.limit(0)).count() == 0


def test_query_matches_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    want = duck.sql(f"SELECT {names} FROM ({queries.oracle_sql()['op13_chat_trees']})").fetchall()
    got = [tuple(r) for r in queries.queries()["op13_chat_trees"](spark, sf).select(*names.split(", ")).collect()]
    assert sorted(got) == sorted(want)
