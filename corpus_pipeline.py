"""Cleaning a corpus in stages, each an operator of ``framewise.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents with their columns,
whatever further columns there are and whatever they are called. No stage needs a doc_id or a text that is not null, nor
doc_ids that differ; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import decontaminate, jaccard, mixing, queries, toxicity
from framewise.llm.common import Workspace, free_name, one_row_each, table, with_row_key, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; each row by its text alone, null ones as empty."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), Workspace(spark, "drop-toxic")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links connect, one: five words and a similarity of 0.8. It is the one with the smallest
    doc_id, or, of groups that hold rows without a doc_id or with a shared one, one of those rows; rows that are equal in
    doc_id and text leave one. Null, empty and blank texts are linked with nothing and stay."""
    work, key = Workspace(spark, "one-of-each"), free_name(docs, "_key")
    keyed = with_row_key(docs, work, key)
    groups = jaccard.join_components(keyed.select(F.col(key).alias("doc_id"), "text"), work, k=5, num=80)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key))
    return one_row_each(without(keyed, gone, work, key), key, work).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, rows without a doc_id or with a shared one each for itself."""
    work, key = Workspace(spark, "drop-leaks"), free_name(docs, "_key")
    keyed = with_row_key(docs, work, key)
    leaks = decontaminate.contained_items(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), work)
    return without(keyed, leaks.select(F.col("doc_id").alias(key)), work, key).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by rates that bring the qualities of texts to target shares of nine tenths of the words. No rate is
    above one, as copies were just removed; a share that this leaves unmet is logged as a warning."""
    work = Workspace(spark, "mix")
    fitted = mixing.fit_rates(docs, table(spark, sf_dir, "labels"), work, {"quality=1": 0.9, "quality=0": 0.1}, "concat('quality=', quality)", 0.9, most=1.0)
    return mixing.kept(docs, fitted, work)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in a content-addressed store; returns what is read back."""
    return queries.token_store(docs, Workspace(spark, "store-tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing to target weights", mix),
    ("token store", store_tokens),
]

#: Models can't be said in SQL; tests/llm/test_pipeline.py holds each stage, as run here, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
