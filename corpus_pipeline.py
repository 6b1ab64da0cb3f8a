"""Corpus pipeline: from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that its successor works on, with all their
columns; the last one returns the packed pieces with their token ids.  Every stage takes null ids and texts, repeated
rows, empty tables and further columns; what it does with them stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import settled, table
from riftline.llm.mixing import mixed_documents
from riftline.llm.near_dup import near_duplicates
from riftline.llm.packing import pack
from riftline.llm.quality import keep_good
from riftline.llm.secrets import redact_secrets
from riftline.llm.wordbpe import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; null and empty texts are scored as empty ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


#: Per cent of shared shingles from which the pipeline takes documents for copies; op2's own threshold is higher.
DEDUP_THRESHOLD = 80


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id.

    Rows without an id can't be told apart and stay.  Of rows that share an id, exact repetitions of a kept one go,
    those with another text are near copies of their own or stay.
    """
    marked = near_duplicates(docs, threshold=DEDUP_THRESHOLD, mark="hash").where("kept")
    kept = marked.select(F.col("doc_id").alias("id"), "hash").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # the columns may have any name
    rows = docs.select(whole, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    one = rows.join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; documents without any, and null texts, are unchanged."""
    cleaned = redact_secrets(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as its source's target asks for; documents without words are not taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into pieces and packs them into sequences of 2048 tokens.

    Each piece has its token ids, and the number of its row, which tells copies of a document apart; a null id stays null.
    """
    return pack(docs, vocabulary_path(), with_ids=True)


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the classifier nor the tokenizer, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
