"""A corpus pipeline: documents go through five of the corpus operators, each stage's table feeding the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterlab.llm.decontaminate import contaminated
from rasterlab.llm.line_dedup import dedup_lines
from rasterlab.llm.near_dedup import near_duplicates
from rasterlab.llm.packing import pack
from rasterlab.llm.shared import shared_dir
from rasterlab.llm.toxicity import labelled, score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled documents outside the held-out fold.

    A null or empty text is scored by the bias alone and stays; a row without an id is scored as any other. Repeated
    rows have one score and go or stay together. Columns besides those of documents are dropped, also ones named
    ``score`` or ``predicted``.
    """
    weights = train(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, weights).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus; one of which nothing is left goes.

    Null and empty texts stay as they are. The first row by id keeps a passage, a null id coming first; rows equal in
    id and text keep or lose the same lines. ``n_chars`` is counted anew where lines went. Other columns are dropped.
    """
    cut = dedup_lines(docs).where("removed_lines = 0 or text rlike '[^\\\\s]'")
    return cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Texts that share an id are one document: all stay or all go; of rows equal in id and text one stays. Rows without
    an id all stay, as do null and empty texts. Other columns are dropped.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct().hint("merge")  # as many as documents
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"])
    return rows.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each text is judged by itself, also where rows have no id or share one. Null and blank texts contain nothing and
    stay; clean repeated rows stay as often as they occur. Other columns are dropped.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key"))
    return docs.join(found, bad, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens; those whose id is divisible by 20 are the queries.

    A null or empty text is its end id alone; a row without an id is packed with a null one, a repeated row as often as
    it occurs. Columns besides id and text are ignored.
    """
    return pack(docs, every=20).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier's scores and the tokenizer's ids are beyond SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; each stage's is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
