"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns
of documents. `run` applies them to the whole table, each stage written as Parquet into the
shared folder and read again, so a lost executor costs no more than a stage.

Rows without an id stay in the near-duplicate stage, as they can't be told apart; repeated rows
stay or go together. Null and empty texts fail the quality rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import decontaminate, jaccard, line_templates, mixing, quality_rules
from tracklake.llm.cluster import ensure_checkpoint_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the adaptive thresholds of their language and source."""
    return quality_rules.filter_documents(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines whose template recurs and first stands elsewhere; n_chars follows."""
    out = line_templates.strip(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a 5-word shingle similarity of 0.8 or more the one with the smallest id."""
    stays = jaccard.join(docs, width=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stays, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with the columns of documents and the copy's number."""
    return mixing.repeat(mixing.mix(docs), docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_recurring_lines),
    ("near duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix),
]

#: Entropy balancing and its rounding aren't expressible in SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
