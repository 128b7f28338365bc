"""The training-data pipeline over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
in the shared folder and reads it again as the next stage's docs.

Stages read the columns of documents and leave others out, whatever their names; tables
without rows give none. Repeated rows are documents of their own until the Jaccard stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import shared_dir, small, table
from tidelane.llm.decontaminate import decontaminate
from tidelane.llm.jaccard import jaccard_join
from tidelane.llm.linededup import line_dedup
from tidelane.llm.mixing import mix_sources
from tidelane.llm.quality import with_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has too few words, and goes; null
    ids and sources stay as they are, and repeated rows stay or go together."""
    return with_quality(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, of which the first stays; those that lose every word go,
    and n_chars is counted again. Null texts lose nothing and stay. Repeated rows are one document here."""
    lines = line_dedup(docs.select(*COLUMNS)).filter("n_dropped = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return lines.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id, once if its
    row is repeated. Rows without a doc_id stay."""
    docs = docs.select(*COLUMNS)
    leads = jaccard_join(docs).filter("doc_id = class_id OR doc_id IS NULL").groupBy(F.col("doc_id").alias("lead")).agg(F.count("*").alias("n"))
    led = docs.join(small(leads), docs["doc_id"].cast("long").eqNullSafe(F.col("lead")))
    once = F.expr("n = 1 OR doc_id IS NULL")
    return led.filter(once).select(*COLUMNS).union(led.filter(~once).select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found, at any similarity from the threshold on: ties
    don't matter. Null and short texts match nothing, and stay; repeated rows stay or go together.
    A benchmark without usable items keeps every document."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the mixture, with their domain, tokens and how often. Texts without words, and
    nulls, are never taken; a null language or source is a leaf of its own."""
    return mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The Jaccard stage's classes are the outcome of an iterative join, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
