"""A training-corpus pipeline over the documents table: filter, deduplicate, mix and pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.common import free_name, materialize
from verdictlake.llm.linededup import line_dedup
from verdictlake.llm.mixing import mix_sources
from verdictlake.llm.neardup import near_duplicates
from verdictlake.llm.packing import pack
from verdictlake.llm.quality import quality_cascade, rules
from verdictlake.llm.queries import vocabulary

#: Words that a document must have to stay; short clean documents are no junk.
LEAST_WORDS = 3
#: A character that isn't white space of the contracts.
WORD = "[^\\x20\\x09-\\x0D]"


def apart(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) in the columns of docs, where columns of docs that have the names the stage adds are kept as they are."""
    moved = {}
    for c in docs.columns:
        if c.lower() in names:
            moved[c] = free_name(docs, f"__{c}")
            docs = docs.withColumnRenamed(c, moved[c])
    columns, back = docs.columns, {v: k for k, v in moved.items()}
    return stage(docs).select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a quality rule rejects; null and empty texts are rejected.  Repeated rows stay as they are."""
    return apart(docs, ("rejected_by",), lambda d: quality_cascade(d, rules(LEAST_WORDS)).filter(F.col("rejected_by").isNull()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and the documents of which nothing is left.

    A null text becomes the empty one; rows with a null id keep all lines, rows with equal ids are one document.
    """
    kept = lambda d: line_dedup(d).filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return apart(docs, ("n_lines", "n_dropped"), lambda d: kept(d).withColumn("n_chars", F.length("text").cast("long")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates: five words, similarity 0.8.

    Texts without words have no duplicates and stay; so do rows with a null id.
    """
    found = near_duplicates(docs, k=5, num=80, den=100, symbols=96)
    gone = materialize(found.filter(~F.col("kept")).select("doc_id"), "near-gone")
    return docs.join(gone, "doc_id", "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources weigh as the roots of their sizes."""
    return mix_sources(docs, source="source", keys=("doc_id",), alpha=0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack(docs, vocabulary=vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("source mixing", mix), ("packing", packing)]

#: Signatures and tokens aren't in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
