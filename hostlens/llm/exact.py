"""Exact deduplication by a distributed content sort.

Rows are range-partitioned by sampled splitters on the normalised text (its first characters, a digest of all its bytes, then
the id) and sorted externally inside each range, so equal texts lie next to each other; each row is then compared in
full with its predecessor. Among texts that begin alike any fixed order will do: the digest keeps splitters short however long
the texts and their common beginnings are. The key ends in the id, so a group of copies of any size is cut over as many ranges as
it needs. Groups that a range border cuts are joined by a few numbers for each range; whole texts of
two border rows are compared only where their digests and lengths agree, pair by pair.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, partitions, written

#: Sampled keys for each range border.
OVERSAMPLE = 30
#: Ranges for each shuffle partition: hashing ranges to partitions evens out.
RANGES = 4
PREFIX = 48
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """One space for each run of ASCII white space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _borders(keys: DataFrame, draw: Column, n_rows: int, ranges: int) -> Column:
    """Borders of equally filled ranges as a constant array of keys (a, b, c).

    From a bounded sample: about ranges x OVERSAMPLE keys of under 300 bytes, which Spark deals to tasks by range; each task cuts its own keys into
    RANGES parts, and one key for each range comes to the driver. The array is one literal of the plan, however many ranges there are.
    """
    share = min(1.0, ranges * OVERSAMPLE / max(n_rows, 1))
    # a hash of id and raw text decides, so that a rerun draws the same sample, and only what is drawn is normalised
    drawn = written(keys.filter(F.pmod(draw, F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("_key"))
    dealt = drawn.repartitionByRange(max(ranges // RANGES, 1), "_key").withColumn("_part", F.spark_partition_id())
    tiles = dealt.withColumn("_tile", F.ntile(RANGES).over(Window.partitionBy("_part").orderBy("_key")))
    # a key that begins the first range of all is no border, but does no harm
    got = sorted({tuple(r[0]) for r in tiles.groupBy("_part", "_tile").agg(F.min("_key")).select("min(_key)").collect()})
    return F.from_json(F.lit(json.dumps([dict(zip("abc", k)) for k in got])), "array<struct<a:string,b:string,c:bigint>>")


def _range_of(key: Column, borders: Column, ranges: int) -> Column:
    """The number of borders <= key, by binary search."""
    middle = lambda s: ((s.lo + s.hi) / 2).cast("int")
    step = lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
        F.when(F.get(borders, middle(s)) <= key, F.struct((middle(s) + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), middle(s).alias("hi")))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ranges.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi")), step).lo


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    * Null text is the empty text; empty texts are equal to each other.
    * keep_id is the smallest id of the group. Repeated rows (same id and text) are members of
      the group; exactly one row of a group has kept = true.
    * A null id sorts last: it stays only if the whole group has null ids.
    * Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    raw = docs.select(column(id_col).cast("bigint").alias("_id"), column(text_col).alias("_text"))
    rows = raw.select("_id", "_text", normalised(F.col("_text")).alias("_norm")).withColumn("_sha", F.sha2("_norm", 256))
    order_id = F.coalesce("_id", F.lit(LAST))
    key = F.struct(F.substring("_norm", 1, PREFIX).alias("a"), F.col("_sha").alias("b"), order_id.alias("c"))
    ranges = partitions(docs.sparkSession) * RANGES
    borders = _borders(rows.select("_id", "_text", key.alias("_key")), F.xxhash64(F.lit(7), "_id", "_text"), docs.count(), ranges)
    rows = rows.select("_id", "_norm", "_sha", _range_of(key, borders, ranges).alias("_bucket"))

    # inside a range: sort, compare each row in full with the one before it
    order = Window.partitionBy("_bucket").orderBy(F.substring("_norm", 1, PREFIX), "_sha", "_norm", order_id)
    rows = rows.select("*", F.lag("_norm").over(order).alias("_before"), F.lead("_norm").over(order).alias("_after"), F.row_number().over(order).alias("_at"))
    # the text itself is needed further only at the borders of a range
    border = F.when(F.col("_before").isNull() | F.col("_after").isNull(), F.col("_norm"))
    rows = rows.select("_id", "_sha", F.length("_norm").alias("_chars"), "_bucket", "_at", (~F.col("_norm").eqNullSafe(F.col("_before"))).alias("_new"), F.col("_before").isNull().alias("_first"), F.col("_after").isNull().alias("_last"), border.alias("_norm"))
    rows = written(rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(Window.partitionBy("_bucket").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))))

    runs = rows.groupBy("_bucket", "_run").agg(
        F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"), F.max("_first").alias("_opens"), F.max("_last").alias("_closes"), F.max("_sha").alias("_sha"), F.max("_chars").alias("_chars")
    )
    # at most two runs of each range can go on in a neighbouring range: a digest and some numbers for each of them
    line = Window.orderBy("_bucket", "_run")
    outer = runs.filter("_opens or _closes").select("_bucket", "_run", "_keep", "_size", F.lag(F.struct("_bucket", "_sha", "_chars")).over(line).alias("_p"), "_sha", "_chars")
    alike = outer.filter((F.col("_p._bucket") != F.col("_bucket")) & (F.col("_p._sha") == F.col("_sha")) & (F.col("_p._chars") == F.col("_chars"))).select("_bucket", F.col("_p._bucket").alias("_other"))
    opening, closing = rows.filter("_first").select("_bucket", F.col("_norm").alias("_a")), rows.filter("_last").select(F.col("_bucket").alias("_other"), F.col("_norm").alias("_b"))
    met = alike.join(opening, "_bucket").join(closing, "_other").filter("_a = _b").select("_bucket", F.lit(True).alias("_met"))
    # only the opening run of a range goes on from the range before
    outer = outer.join(met, "_bucket", "left").withColumn("_goes_on", F.coalesce(F.col("_met") & (F.col("_p._bucket") != F.col("_bucket")), F.lit(False)))
    outer = outer.withColumn("_chain", F.sum((~F.col("_goes_on")).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("_chain")
    outer = outer.select("_bucket", "_run", F.min("_keep").over(chain).alias("_chain_keep"), F.sum("_size").over(chain).alias("_chain_size"), "_goes_on")
    runs = runs.select("_bucket", "_run", "_keep", "_size").join(outer, ["_bucket", "_run"], "left")
    runs = runs.select("_bucket", "_run", F.coalesce("_chain_keep", "_keep").alias("_keep"), F.coalesce("_chain_size", "_size").alias("_size"), F.coalesce("_goes_on", F.lit(False)).alias("_goes_on"))
    return rows.join(runs, ["_bucket", "_run"]).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_new") & ~F.col("_goes_on")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, with the columns they came with, whatever their names; of rows that repeat id and text, one."""
    id_of = lambda c: F.coalesce(c.cast("bigint"), F.lit(LAST)).alias("_id")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(id_of(column(id_col)), F.col("text_sha256").alias("_sha")).distinct()
    row = F.struct(*[column(c) for c in docs.columns]).alias("_row")
    rows = docs.select(row, id_of(column(id_col)), F.sha2(normalised(column(text_col)), 256).alias("_sha"))
    out = rows.join(kept, ["_id", "_sha"], "left_semi")
    if not docs.groupBy(column(id_col)).count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["_id", "_sha"])
    return out.select(*[column(c, "_row").alias(c) for c in docs.columns])
