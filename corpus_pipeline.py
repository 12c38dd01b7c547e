"""From raw documents to a training mix: quality, exact copies, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents that are kept, with the columns they came with;
its result is written to the shared folder and read again by the next stage. The last stage repeats documents and adds
copy and shuffle_key. A document of null id passes the stage for near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostlens.llm import decontaminate, exact, minhash, mixing, quality
from hostlens.llm.common import Scope, dropped, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject. Null texts are scored as empty; without labels all stay."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the smallest id; null counts as empty, a null id as the largest."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id. Null ids stay; rows that repeat an id stay or go together."""
    copies = minhash.near_duplicates(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(copies, docs["doc_id"] == copies["doc_id"], "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts and null ids stay."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts so that small sources gain weight, in a random order. A null source is a source; empty texts are drawn like others of it."""
    return mixing.mix(docs)


STAGES = [("quality", good_quality), ("exact", exact_copies), ("near", near_copies), ("decontaminate", benchmark_leaks), ("mix", source_mix)]

#: The trained classifier, near duplicates and edit distances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Scope() as scope:  # a stage's own tables, and the documents that it read, go once its result is written
            out = scope.keep(stage(spark, docs, sf_dir))
        dropped(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
