"""An append-only sink with a ledger: a batch that is replayed adds nothing, and half a batch is never seen.

Rows lie in one folder a batch. The ledger has an entry for a batch once its rows are there in full; a reader takes only what the ledger lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.sources.folders import exists


def appender(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each batch once, whatever is replayed. An attempt that broke off before its entry is overwritten."""

    def add(batch: DataFrame, number: int) -> None:
        spark, entry = batch.sparkSession, f"{folder}/ledger/batch={number}"
        if not exists(spark, f"{entry}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            spark.range(1).select(F.lit(number).alias("entry")).write.mode("overwrite").json(entry)

    return add


def appended(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All appended rows with `batch`. A folder to which nothing has been appended is an empty table."""
    schema = f"{schema}, batch bigint"
    if not exists(spark, f"{folder}/ledger"):
        return spark.createDataFrame([], schema)
    entries = spark.read.schema("entry bigint, batch bigint").json(f"{folder}/ledger").select("batch")
    return spark.read.schema(schema).parquet(f"{folder}/rows").join(entries, "batch", "left_semi")


def log_lines(rows: DataFrame, order: str) -> DataFrame:
    """(host_id, line_no, line): each host's log in the order in which its lines were appended. rows: appended() rows with host_id, line and the order within a batch."""
    at = Window.partitionBy("host_id").orderBy("batch", order)
    return rows.select("host_id", F.row_number().over(at).cast("bigint").alias("line_no"), "line")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows that update each other, the one of the last batch for each key: the current table behind an update stream."""
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_r"))
    return found.select(*keys, "_r.*")
