"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again
as the next one's docs. All but the last return the columns of the documents.

1. language: documents without a letter, or unlike every language prototype, go. How like a document must be is read
   from the scores of the labelled documents of its length (language_id.least_scores).
2. near duplicates: of each component of five-word shingles at a similarity of 0.8 the least id stays.
3. repeats: bytes in 100-byte strings that start earlier too go; documents of which only white space is left go.
4. decontamination: documents into which a benchmark item leaked go.
5. tokens: byte-level BPE ids, with a check of the round trip.

Rows with null ids or null texts: a null text has no letter and goes at the first stage; a null id is kept by the second
stage and comes first in the third. Repeated ids are one document for the second stage, all or none of whose rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.llm import byte_bpe, decontamination, language_id, ngram_join, suffix_dedup
from cellspark.llm.shared import bounded_batches, materialize

WORDS, PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column's name is in the way."""
    return docs.select(F.struct("*").alias("row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own labels name."""
    bounded_batches(spark)
    model = language_id.prototypes(docs)
    least = language_id.least_scores(docs, model)
    found = language_id.identify(_packed(docs), model, carry=("row",), sizes=True)
    enough = F.col("score") >= F.element_at(F.array(*map(F.lit, least)), F.col("band") + 1)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & enough).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bounded_batches(spark)
    gone = ngram_join.cluster(docs, WORDS, PERCENT).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand earlier in the corpus."""
    bounded_batches(spark)
    left = suffix_dedup.remove(docs, tuple(docs.columns), as_text=True)
    kept = left.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept")))
    return kept.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item."""
    bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.leaks(_packed(docs), benchmark, ("row",))
    return found.where(F.size("item_ids") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back."""
    bounded_batches(spark)
    coded = byte_bpe.encode(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text"), ("doc_id", "sha"), round_trip=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
