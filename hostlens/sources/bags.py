"""Snapshots as property bags: one table of (host_id, class, seq, properties) for all classes, properties a VARIANT.

A machine reports a class as rows of named values, which may lack any of them or have another type than expected. Typed tables are read out
of the bags by name, class by class; the classes are partition folders, so that a scan of one class opens no other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions import bags as b

from .tables import SCHEMAS

BAG = "host_id bigint, seq bigint, properties variant, class string"


def _fields(name: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) for x in SCHEMAS[name].split(", ")]


def to_json(table: DataFrame) -> Column:
    """A typed table's columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns if c not in ("host_id", "seq")]))


def bag_rows(table: DataFrame, name: str, properties: Column | None = None) -> DataFrame:
    """A typed table as bag rows: (host_id, class, seq, properties) with properties as JSON text."""
    return table.select("host_id", F.lit(name).alias("class"), "seq", (to_json(table) if properties is None else properties).alias("properties"))


def parsed(rows: DataFrame) -> DataFrame:
    """Bag rows of JSON text as VARIANT; text that is no JSON is a bag without properties."""
    return rows.select("host_id", "seq", F.coalesce(F.try_parse_json("properties"), F.parse_json(F.lit("{}"))).alias("properties"), "class")


def variant_rows(table: DataFrame, name: str) -> DataFrame:
    """A typed table as bag rows whose properties are VARIANT at once: no JSON is written and parsed. Nulls are null properties."""
    properties = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in table.columns if c not in ("host_id", "seq")]))
    return table.select("host_id", "seq", properties.alias("properties"), F.lit(name).alias("class"))


def write_bags(rows: DataFrame, folder: str) -> None:
    """Bag rows as Parquet, one folder a class; JSON text is parsed."""
    (parsed(rows) if dict(rows.dtypes)["properties"] == "string" else rows).write.partitionBy("class").parquet(folder)


def read_bags(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BAG).parquet(folder)


class BagTables(Mapping):
    """Typed tables out of bags, class by class. A class that no machine has is an empty table, and so is a name that isn't a class."""

    def __init__(self, bags: DataFrame):
        self.bags = bags

    def __getitem__(self, name: str) -> DataFrame:
        read = {"string": b.text, "int": b.integer, "bigint": b.integer, "boolean": b.truth}
        bag = F.col("properties")
        columns = [(b.unsigned(bag, c) if t == "bigint" else read[t](bag, c)).cast(t).alias(c) for c, t in _fields(name)]
        return self.bags.filter(F.col("class") == name).select("host_id", "seq", *columns)

    def __iter__(self):
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)
