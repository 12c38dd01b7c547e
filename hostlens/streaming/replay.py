"""A table as a stream: its rows arrive in several batches of files, and each batch is one run of a query that goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from hostlens.sources.folders import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for stateful streams: RocksDB state, and no more state partitions than there are cores (their number is fixed by the first run)."""
    out = spark.newSession()
    out.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, 1))))
    out.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return out


def by_order(rows: DataFrame, column: str, n: int) -> list[DataFrame]:
    """n batches in the order of a number."""
    cuts = rows.approxQuantile(column, [i / n for i in range(1, n)], 0.01)
    bounds = list(zip([None, *cuts], [*cuts, None]))
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col(column) > int(lo)) & (F.lit(True) if hi is None else F.col(column) <= int(hi))
    return [rows.filter(inside(lo, hi)) for lo, hi in bounds] if cuts else [rows]


def by_hash(rows: DataFrame, column: str, n: int) -> list[DataFrame]:
    """n batches in no order: late rows are in each of them."""
    return [rows.filter(F.pmod(F.xxhash64(column), F.lit(n)) == i) for i in range(n)]


def replay(spark: SparkSession, batches: Iterable[DataFrame], start: Callable[[DataFrame, str], DataStreamWriter]) -> None:
    """Writes each batch to one folder and runs the query over what is new. start: (stream of the folder's rows, checkpoint) -> writer.

    Every run takes up the state of the one before, as after a restart.
    """
    session, folder, checkpoint = state_session(spark), shared_folder(spark), shared_folder(spark)
    for i, batch in enumerate(batches):
        batch.write.parquet(f"{folder}/{i:06d}")
        stream = session.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(folder)
        start(stream, checkpoint).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
