"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate = target share x total size / own size. A document's
count is a Poisson draw with that mean, by inversion of a number hashed from (seed, doc_id); the
document is exploded by its count, and all copies are put into one random global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, partitions, uniform, written

#: Rates above this are drawn as a sum of equal parts, so that exp(-rate) stays exact.
PART = 30.0
#: The sum of PART-sized Poisson terms beyond this count is below 2^-60.
TERMS = 120
#: Rates of at most so many sources are broadcast; of more, a source's rows are dealt to SALTS parts.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: Weights to twelve decimals: smaller ones count as none in the sum only.
WEIGHT = "decimal(38,12)"


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, group_col: str = "source", text_col: str = "text") -> DataFrame:
    """(_source, _mass, _rate): the size of each source in characters and its mean repetition rate.

    weights: source -> target weight (absent sources: 0, their documents go); None: the
    weight of a source is its size to the given power, which lifts small sources. The result holds about
    epochs x total characters. Weights are summed as decimals, so that their order doesn't matter. A null source is a
    source of its own (named ""). A source without characters has rate 0.
    """
    name = F.coalesce(column(group_col).cast("string"), F.lit("")).alias("_source")
    sizes = docs.select(name, F.coalesce(F.length(column(text_col)), F.lit(0)).cast("bigint").alias("n")).groupBy("_source").agg(F.sum("n").alias("_mass"))
    if weights is None:
        share = F.when(F.col("_mass") > 0, F.pow(F.col("_mass").cast("double"), F.lit(power))).otherwise(0.0)
    else:
        share = F.lit(0.0)
        for k, w in weights.items():
            share = F.when(F.col("_source") == k, float(w)).otherwise(share)
        share = F.when(F.col("_mass") > 0, share).otherwise(0.0)
    sizes = sizes.withColumn("_w", share)
    total = sizes.agg(F.sum("_mass").alias("_total"), F.sum(F.col("_w").cast(WEIGHT)).cast("double").alias("_weight"))  # one row
    rate = F.when((F.col("_mass") > 0) & (F.col("_weight") > 0), F.col("_w") / F.col("_weight") * F.col("_total") * epochs / F.col("_mass")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(total)).select("_source", "_mass", rate.alias("_rate"))


def poisson_count(rate: Column, seed: int, key: Column) -> Column:
    """A Poisson draw with the given mean for each key: the number of terms k with CDF(k) <= u."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    mean = rate / parts

    def one(u: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))
        step = lambda s, i: F.when(u < s.cdf, s).otherwise(F.struct((s.k + 1).alias("k"), (s.p * mean / (s.k + 1)).alias("p"), (s.cdf + s.p * mean / (s.k + 1)).alias("cdf")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s.k)

    # nearly always one part and a handful of terms: short series without a loop
    u0 = uniform(F.lit(seed), key, F.lit(0))
    many = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, j: n + one(uniform(F.lit(seed), key, j)))
    p = [F.exp(-mean)]
    cdf = [p[0]]
    for k in range(1, 9):
        p.append(p[-1] * mean / k)
        cdf.append(cdf[-1] + p[-1])
    short = F.lit(None).cast("int")
    for k in reversed(range(9)):
        short = F.when(u0 < cdf[k], k).otherwise(short)
    return F.when(rate <= 0, 0).otherwise(F.coalesce(F.when(rate <= 3.0, short), many))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 42, group_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, each repeated by its Poisson count, in a random global order.

    Adds copy (1 to count) and shuffle_key, a random digest: rows are dealt to partitions by its
    first digits and sorted by it inside each partition, so the copies of a hot source spread evenly.
    A count depends on seed and doc_id alone: repeated rows get equal counts; a null id draws as an
    id of its own. Null or empty texts belong to their source and are drawn at its rate. An empty
    table gives an empty result. Columns named copy or shuffle_key are replaced; all others pass, whatever their names.
    """
    rates = written(repetition_rates(docs, weights, power, epochs, group_col, text_col).select("_source", "_rate"))
    source = F.coalesce(column(group_col).cast("string"), F.lit(""))
    key = F.coalesce(column(id_col).cast("string"), F.lit("null"))
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    # the row is one column, so that no name of it can clash
    named = docs.select(F.struct(*[column(c) for c in kept]).alias("_row"), source.alias("_source"), key.alias("_key"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = named.join(F.broadcast(rates), "_source")  # a name and a number for each source, their count checked
    else:
        # texts of a hot source meet its rate in many tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = named.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(rates.withColumn("_salt", salts), ["_source", "_salt"])
    drawn = joined.withColumn("_n", poisson_count(F.col("_rate"), seed, F.col("_key")))
    copies = drawn.filter("_n > 0").select("_row", "_key", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    copies = copies.withColumn("_at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), "_key", F.col("_copy").cast("string"))))
    dealt = copies.repartition(partitions(docs.sparkSession), F.substring("_at", 1, 8)).sortWithinPartitions("_at")
    return dealt.select(*[column(c, "_row").alias(c) for c in kept], F.col("_copy").cast("bigint").alias("copy"), F.col("_at").alias("shuffle_key"))
