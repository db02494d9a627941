"""Conversations from reply trees.

Messages are nodes with a parent. Every leaf is the end of a path from a root; paths are ranked by score within their
tree, and each chosen one is formatted as one conversation.

Paths. Self-joins double the reach of each node's link upwards until it is at its root: the table of round k links nodes
with their ancestors 2**k above, and carries the score of the nodes between. A path of n nodes is then split in halves,
level by level, by the same tables, until every row is one node and its place; no more rows exist at any time than the
chosen paths have nodes, joins are by node, and a tree of a third of all rows, or of any depth, is spread like any other.

Template. A turn is ``[INST]role[/INST]text</s>`` and a line break. Inside roles and texts a backslash follows the first
character of a control string, and every backslash is doubled, so that ``read`` gives all turns back exactly. The loss
mask holds the spans (code points of the formatted text) of the learned role's texts, as escaped.

Formatting. Paths' turns are sorted by range, which deals a long path to several tasks; each makes stretches of the
formatted text of bounded size, and stretches are put together by path.

Ties: equal scores go by the leaf's node. Null text or role: empty. A parent that does not exist is none: the row is a
root. Of rows with one node id the least one (by parent, role, text) has the children, the others are leaves. Rows with
a null node are leaves as well. Rows on a circle of parents, or below one, have no root and are on no path. Rows in
``linear`` go by turn, then role, then text; nulls first; a null conversation is one of its own. An empty table gives no
rows. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, release, table

OPEN, MIDDLE, END = "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
STRETCH = 1 << 16

_CONTROL = re.compile(r"\\|\[(?=/?INST\])|<(?=/s>)")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    """A text without control strings, from which ``unescape`` makes the text again."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the text begins and ends."""
    head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def linear(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of linear conversations as trees without a fork: tree, node, parent, role, text, score.

    Nodes are numbered in the order of a sort by range; only the last row of each of its partitions reaches the driver."""
    kept = rows.select(F.col(conversation).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = ["tree", "turn", "role", "text"]
    spread = kept.withColumn("own", F.monotonically_increasing_id())  # parts equal rows
    ranged = spread.repartitionByRange(*order, "own").sortWithinPartitions(*order)
    numbered = materialize(ranged.select("tree", "role", "text", F.monotonically_increasing_id().alias("node"), F.spark_partition_id().alias("part")))
    ends = numbered.groupBy("part").agg(F.min("node").alias("first"), F.max_by(F.struct("tree", "node"), "node").alias("last")).orderBy("part").collect()  # a row for each partition
    before = [(e["first"], p["last"]["node"], p["last"]["tree"]) for p, e in zip(ends, ends[1:], strict=False)]
    kind = kept.schema["tree"].dataType.simpleString()
    heads = rows.sparkSession.createDataFrame(before, f"node long, prior long, prior_tree {kind}")
    # Within a partition the row before has the number before.
    prior = numbered.select((F.col("node") + 1).alias("node"), F.col("node").alias("prior"), F.col("tree").alias("prior_tree"))
    above = prior.unionByName(heads)
    linked = numbered.join(above, "node", "left")
    parent = F.when(F.col("prior").isNotNull() & F.col("tree").eqNullSafe(F.col("prior_tree")), F.col("prior"))
    return linked.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _numbered(messages: DataFrame, unique: bool) -> tuple[DataFrame, DataFrame]:
    """Texts (id, role, text), where id is a number of the row's own, and links (id, up, tree, node, score), where up is
    the parent's id. Nodes that are unique and not null are their own numbers."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    if unique:
        rows = messages.select(F.col("node").alias("id"), "tree", "node", "parent", role, text, score)
        known = rows.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    else:
        rows = materialize(messages.select("tree", "node", "parent", role, text, score, F.monotonically_increasing_id().alias("id")))
        least = F.min(F.struct("parent", "role", "text", "id"))["id"]
        known = rows.where(F.col("node").isNotNull()).groupBy("node").agg(least.alias("up")).withColumnRenamed("node", "parent")
    below, columns = rows.select("id", "tree", "node", "parent", "score"), ["id", "up", "tree", "node", "score"]
    links = below.where(F.col("parent").isNotNull()).join(known, "parent", "left").select(columns)
    roots = below.where(F.col("parent").isNull()).withColumn("up", F.lit(None).cast("long")).select(columns)  # no key, no shuffle
    return rows.select("id", "role", "text"), materialize(links.unionByName(roots))


def _jumps(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of rounds 0, 1, ...: id, up (2**k above) and the sum of scores of the nodes from id to below up; and
    of every node that has a root: id, steps above it and the sum of scores from it to the root."""
    level = materialize(rows.where("up IS NOT NULL").select("id", "up", "score"))
    done = rows.where("up IS NULL").select("id", F.lit(0).cast("long").alias("steps"), "score")
    levels, n, k = [], rows.count(), 0
    while 1 << k <= n and level.head(1):
        levels.append(level)
        # A node whose link of this round ends at a settled node is settled with it.
        done = materialize(done.unionByName(level.join(done.select(F.col("id").alias("up"), "steps", F.col("score").alias("above")), "up").select("id", (F.col("steps") + (1 << k)).alias("steps"), (F.col("score") + F.col("above")).alias("score"))))
        upper = level.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("score").alias("above"))
        level = materialize(level.join(upper, "up").select("id", F.col("far").alias("up"), (F.col("score") + F.col("above")).alias("score")))
        k += 1
    release(level)
    return levels, done


def chosen_paths(messages: DataFrame, best: int | None = 1, mean: bool = True, unique: bool = False) -> DataFrame:
    """path (number of its leaf), tree, rank, place (0 at the root), role, text: the turns of the ``best`` paths of each
    tree by the mean, or the sum, of their nodes' scores; all paths if None.

    ``messages`` has tree, node, parent, role, text and score. A tree of many leaves is ranked task by task first."""
    texts, links = _numbered(messages, unique)
    levels, settled = _jumps(links)
    inner = links.where("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
    leaves = links.select("id", "tree", "node").join(inner, "id", "left_anti").join(settled, "id")
    by = F.col("score") / (F.col("steps") + 1) if mean else F.col("score")
    order = Window.partitionBy("tree").orderBy(F.desc("by"), "node", "id")
    ranked = leaves.withColumn("by", by).withColumn("rank", F.row_number().over(order))
    paths = materialize((ranked if best is None else ranked.where(F.col("rank") <= best)).select("id", "tree", "rank", "steps"))
    # Stretches of paths: n nodes from one on upwards. Each level halves those longer than its reach.
    parts = paths.select(F.col("id").alias("path"), "id", F.col("steps").alias("place"), (F.col("steps") + 1).alias("n"))
    for k, level in reversed(list(enumerate(levels))):
        half = F.lit(1 << k).cast("long")
        ups = level.select(F.col("id").alias("from"), "up")
        met = parts.join(ups, (F.col("id") == F.col("from")) & (F.col("n") > half), "left")
        as_it_is = F.struct("id", "place", "n")
        lower = F.struct("id", "place", half.alias("n"))
        upper = F.struct(F.col("up").alias("id"), (F.col("place") - half).alias("place"), (F.col("n") - half).alias("n"))
        parts = met.select("path", F.explode(F.when(F.col("up").isNull(), F.array(as_it_is)).otherwise(F.array(lower, upper))).alias("part")).select("path", "part.*")
    found = parts.select("path", "id", "place").join(texts, "id")
    return found.join(paths.select(F.col("id").alias("path"), "tree", "rank"), "path").select("path", "tree", "rank", "place", "role", "text")


def format_paths(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """tree, path, rank, formatted and loss_spans (begin and end of each learned text) of each path of
    ``chosen_paths``."""
    kind = turns.schema["tree"].dataType.simpleString()

    def run(batches):
        at, row, texts, spans, size = None, None, [], [], 0

        def out():
            return pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds, strict=True)} | {"stretch": pa.array(["".join(texts)], pa.string()), "spans": pa.array([spans], pa.list_(pa.list_(pa.int64())))})

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("tree", "path", "rank", "place")]
            for found in batch.to_pylist():
                if found["path"] != at or size >= STRETCH:
                    if texts:
                        yield out()
                    at, row, texts, spans, size = found["path"], {c: found[c] for c in ("tree", "path", "rank", "place")}, [], [], 0
                own, a, b = turn(found["role"], found["text"])
                if found["role"] == learned:
                    spans.append([size + a, size + b])
                texts.append(own)
                size += len(own)
        if texts:
            yield out()

    ranged = turns.repartitionByRange("path", "place").sortWithinPartitions("path", "place")
    stretches = ranged.mapInArrow(run, f"tree {kind}, path long, rank int, place long, stretch string, spans array<array<bigint>>")
    whole = stretches.groupBy("path").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct("place", "stretch", "spans"))).alias("parts"),
    )
    before = F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i), 0L, (n, q) -> n + length(q.stretch)))")
    moved = F.expr("flatten(transform(parts, (p, i) -> transform(p.spans, s -> transform(s, x -> x + before[i]))))")
    return whole.withColumn("before", before).select("tree", "path", "rank", F.array_join("parts.stretch", "").alias("formatted"), moved.alias("loss_spans"))


def digests(formatted: DataFrame, tree: str = "conv_id") -> DataFrame:
    """What ``formatted`` reads back as: the turns, and the text under the loss mask."""
    kind = formatted.schema["tree"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in spans:
                    said = unescape(text[a:b])
                    loss.update(said.encode())
                    chars += len(said)
                out.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[tree, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, f"{tree} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def adversary(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    said = f"{END}{OPEN} ok {MIDDLE}"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def op13_chat_trees(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(adversary(spark))
    return digests(format_paths(chosen_paths(linear(rows), unique=True)))
