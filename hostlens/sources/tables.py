"""The inventory tables: one explicit schema for each class of snapshot rows, and readers that never infer a schema.

Every table has host_id (one machine of the fleet) and seq (the order in which the machine listed its rows).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = "host_id bigint, seq bigint, "
SCHEMAS = {
    "pnp_entity": "name string, pnp_device_id string, pnp_class string, error_code int, service string, manufacturer string",
    "signed_driver": "device_id string, driver_version string, driver_date string, provider string",
    "operating_system": "caption string, version string, architecture string",
    "computer_system": "manufacturer string, model string, total_physical_memory bigint",
    "processor": "name string, manufacturer string, cores int, threads int, max_mhz int",
    "video_controller": "name string, adapter_compat string, adapter_ram bigint, driver_version string, driver_date string, pnp_device_id string, hres int, vres int, error_code int",
    "physical_memory": "bank_label string, slot string, capacity bigint, speed int, configured_clock int, manufacturer string, part_number string, smbios_type int",
    "disk_drive": "model string, bus string, size_bytes bigint, media_type string, pnp_device_id string",
    "physical_disk": "friendly_name string, media_type int, bus_type int",
    "network_adapter": "name string, manufacturer string, mac string, conn_status int, speed bigint, pnp_device_id string, physical_adapter boolean",
    "sound_device": "name string, manufacturer string, pnp_device_id string, error_code int",
    "base_board": "manufacturer string, product string, version string",
    "bios": "manufacturer string, version string, release_date string",
    "desktop_monitor": "name string, manufacturer string, pnp_device_id string, width int, height int",
    "usb_controller": "name string, manufacturer string, pnp_device_id string, error_code int",
    "registry_value": "view int, key_path string, value_name string, value string",
    "file_presence": "path string",
    "runtime_dir": "dir_name string",
    "update": "title string, is_installed boolean, update_type string, is_hidden boolean, is_downloaded boolean",
    "install_attempt": "component_key string, exit_code int",
    "download_progress": "download_id bigint, done_bytes bigint, total_bytes bigint, at timestamp",
}


def schema(name: str) -> str:
    return _KEYS + SCHEMAS[name]


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order; absent ones are null, others go."""
    fields = [x.split(" ") for x in schema(name).split(", ")]
    return df.selectExpr(*[f"cast(`{c}` as {t}) as `{c}`" if c in df.columns else f"cast(null as {t}) as `{c}`" for c, t in fields])


def read(spark: SparkSession, folder: str, name: str, source: str = "parquet") -> DataFrame:
    """One table of a folder of snapshots, Parquet or JSON; a class that a machine does not have is an empty table."""
    try:
        frame = spark.read.format(source).schema(schema(name)).load(f"{folder}/{name}")
        return conform(frame, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema(name))


def read_all(spark: SparkSession, folder: str, source: str = "parquet") -> dict[str, DataFrame]:
    return {name: read(spark, folder, name, source) for name in SCHEMAS}


def read_tolerant(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of one table of JSON lines, of which some may be damaged; what can be read is kept.

    A field of another type than expected is null, its row stays. A line that is no JSON, or that has no host_id or seq, is a reject: (file, line). A file
    that breaks off gives the rows before the break. A missing class is an empty table.
    """
    try:
        lines = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(f"{folder}/{name}").select("value", "_metadata.file_path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema(name)), spark.createDataFrame([], "file string, line string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}
    found = lines.filter(F.trim("value") != "").select("value", "file_path", F.from_json("value", f"{schema(name)}, _damaged string", options).alias("r"))
    whole = F.coalesce(F.col("r.host_id").isNotNull() & F.col("r.seq").isNotNull(), F.lit(False))
    return conform(found.filter(whole).select("r.*"), name), found.filter(~whole).select(F.col("file_path").alias("file"), F.col("value").alias("line"))


def read_in_order(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a snapshot that has no seq: rows count in the order of their files' names and, in a file, as they lie in it.

    seq is the file's place times 2^40 plus the row's. The files are numbered from their names alone; a missing class is an empty table.
    """
    try:
        rows = spark.read.schema(schema(name)).parquet(f"{folder}/{name}").select("*", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema(name))
    files = sorted(rows.inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])
    place = spark.createDataFrame([(f.rsplit("/", 1)[-1], i) for i, f in enumerate(files)], "file string, place bigint")
    # the names are broadcast, never the rows: by their compressed size Spark would take whole tables to the driver
    found = rows.withColumn("file", F.element_at(F.split("file_path", "/"), -1)).join(F.broadcast(place), "file")
    return conform(found.withColumn("seq", F.shiftleft("place", 40) + F.col("row_index")), name)
