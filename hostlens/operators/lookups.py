"""Build sides of the device lookups: one row for each (host, key), chosen by input order with a map-side combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.devices import disk_media
from hostlens.functions.values import cim_date, integer, key, once, text


def pnp_codes(pnp_entity: DataFrame) -> DataFrame:
    """(host_id, key, error_code): of the rows of one device the last counts; an absent code is 0."""
    rows = once(pnp_entity, "_id", text(F.col("pnp_device_id"))).select("host_id", key(F.col("_id")).alias("key"), "seq", integer(F.col("error_code")).alias("error_code"))
    return rows.filter("key <> ''").groupBy("host_id", "key").agg(F.max_by("error_code", "seq").alias("error_code"))


def driver_records(signed_driver: DataFrame, zone_minutes: int = 0) -> DataFrame:
    """(host_id, key, driver_version, driver_date, driver_provider): of the rows of one device the first counts."""
    rows = once(signed_driver, "_id", text(F.col("device_id"))).select("host_id", key(F.col("_id")).alias("key"), "seq", F.struct("driver_version", "driver_date", "provider").alias("r")).filter("key <> ''")
    first = rows.groupBy("host_id", "key").agg(F.min_by("r", "seq").alias("r"))
    # texts are cleaned once a device, not once a row
    return first.select("host_id", "key", text(F.col("r.driver_version")).alias("driver_version"), cim_date(F.col("r.driver_date"), zone_minutes).alias("driver_date"), text(F.col("r.provider")).alias("driver_provider"))


def disk_kinds(physical_disk: DataFrame) -> DataFrame:
    """(host_id, key, kind) by the disk's name: of the rows with a kind the last counts."""
    rows = once(physical_disk, "_id", text(F.col("friendly_name"))).select("host_id", key(F.col("_id")).alias("key"), "seq", disk_media(integer(F.col("media_type")), integer(F.col("bus_type"))).alias("kind"))
    return rows.filter("key <> '' and kind <> ''").groupBy("host_id", "key").agg(F.max_by("kind", "seq").alias("kind"))


def first_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """The first row of each host by input order."""
    return rows.groupBy("host_id").agg(F.min_by(F.struct(*columns), "seq").alias("r")).select("host_id", "r.*")
