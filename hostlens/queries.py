"""One query for each group of inventory operators, over the derived tables, and DuckDB SQL that was written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions import bags as b
from hostlens.functions import devices as d
from hostlens.functions import values as v
from hostlens.operators import lookups
from hostlens.plans import components as c
from hostlens.plans import inventory as inv
from hostlens.plans import reports as r
from hostlens.sources import bags, classes
from hostlens.sources.derived import Derived
from hostlens.sources.folders import shared_folder
from hostlens.sources.tables import read_in_order, read_tolerant
from hostlens.streaming import ledger, replay
from hostlens.streaming.progress import CHANGE, progress_changes, progress_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Derived], DataFrame]) -> Callable[[Derived], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
    return f


def _hosts(t: Derived) -> DataFrame:
    return t["computer_system"].select("host_id").distinct()


def _resolved(rows: DataFrame, t: Derived) -> DataFrame:
    return inv.resolve(rows, lookups.pnp_codes(t["pnp_entity"]), lookups.driver_records(t["signed_driver"]))


@query
def pnp_last_wins(t):
    return lookups.pnp_codes(t["pnp_entity"])


@query
def driver_first_wins(t):
    return lookups.driver_records(t["signed_driver"])


@query
def network_scan(t):
    return _resolved(inv.network(t), t).drop("src_ord")


@query
def typed_inventory(t):
    return inv.typed_inventory(t)


@query
def problem_devices(t):
    return inv.problem_devices(t)


@query
def full_inventory(t):
    return r.grouped(inv.full_inventory(t)).withColumn("pos", F.col("pos").cast("bigint"))


@query
def health_class(t):
    code = F.coalesce("error_code", F.lit(0))
    return t["pnp_entity"].select("host_id", "seq", code.alias("error_code"), d.classify(code).alias("health"), d.health_title(d.classify(code)).alias("title"), d.health_mark(d.classify(code)).alias("mark"), d.needs_attention(d.classify(code)).alias("attention"))


@query
def code_text(t):
    code = F.coalesce("error_code", F.lit(0))
    return t["pnp_entity"].groupBy(code.alias("error_code")).agg(F.count(F.lit(1)).alias("n")).withColumn("description", d.describe(F.col("error_code")))


@query
def category_summary(t):
    return r.category_summary(inv.full_inventory(t))


@query
def overview_tiles(t):
    return r.overview_tiles(inv.full_inventory(t), c.component_states(_hosts(t), t))


@query
def problem_page(t):
    return r.problem_page(inv.full_inventory(t))


@query
def problem_count(t):
    return r.problem_count(inv.full_inventory(t))


@query
def attention_only(t):
    return r.grid(inv.full_inventory(t), only_problems=True)


@query
def grid_state(t):
    return r.grid_state(inv.full_inventory(t), only_problems=True)


@query
def driver_summary(t):
    rows = lookups.driver_records(t["signed_driver"])
    return rows.withColumn("summary", d.driver_summary(F.col("driver_version"), F.col("driver_date"), F.col("driver_provider")))


@query
def vendor_detect(t):
    rows = t["video_controller"]
    none = F.lit("")
    return rows.select(
        "host_id", "seq", d.gpu_vendor(F.col("pnp_device_id"), F.col("adapter_compat"), F.col("name")).alias("vendor"), d.gpu_vendor(none, F.col("adapter_compat"), F.col("name")).alias("by_words"),
        d.gpu_vendor(none, F.col("adapter_compat"), F.col("name"), True).alias("by_strict_words"),
    )


@query
def gpu_list(t):
    return r.gpu_list(inv.gpus(t))


@query
def basic_display(t):
    return _resolved(inv.graphics(t), t).select("host_id", "seq", "error_code", "health", "health_text", "detail", d.basic_adapter(F.col("name")).alias("basic"))


@query
def memory_text(t):
    return inv.memory(t).select("host_id", "seq", "name", "manufacturer", "detail")


@query
def disk_media(t):
    return lookups.disk_kinds(t["physical_disk"])


@query
def disk_text(t):
    return _resolved(inv.storage(t), t).select("host_id", "seq", "name", "detail", "error_code", "driver_version")


@query
def cpu_text(t):
    return inv.processors(t).select("host_id", "seq", "name", "detail", "error_code")


@query
def pnp_class_map(t):
    rows = t["pnp_entity"].groupBy("pnp_class").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("pnp_class", "n", d.pnp_category(F.col("pnp_class")).alias("category"), d.category_title(d.pnp_category(F.col("pnp_class"))).alias("title"))


@query
def conn_status(t):
    return t["network_adapter"].select("host_id", "seq", d.connection(v.integer(F.col("conn_status"), -1)).alias("status"))


@query
def cim_date(t):
    raw = F.col("driver_date")
    return t["signed_driver"].select("host_id", "seq", v.cim_date(raw).alias("utc"), v.cim_date(raw, 180).alias("east"))


@query
def normalize_str(t):
    return t["pnp_entity"].select("host_id", "seq", v.text(F.col("name")).alias("name"), v.text(F.col("manufacturer")).alias("manufacturer"), v.key(v.text(F.col("pnp_device_id"))).alias("key"))


@query
def normalize_int(t):
    raw = F.col("value")
    return t["registry_value"].select("host_id", "seq", v.integer(raw, -1).alias("as_int"), v.unsigned(F.concat(F.lit("-"), raw)).alias("as_unsigned"), v.unsigned(raw).alias("positive"))


@query
def system_rows(t):
    rows = r.summary_values(inv.system_rows(inv.system_summary(t)))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def primary_gpu(t):
    return inv.system_summary(t).select("host_id", "os_name", "ram_gb", "logical_cores", "primary_gpu")


@query
def headless_report(t):
    return r.text_report(inv.full_inventory(t), inv.system_rows(inv.system_summary(t)), inv.gpus(t), c.component_states(_hosts(t), t))


@query
def component_state(t):
    return c.component_states(_hosts(t), t).select("host_id", "component_key", "state", "version")


@query
def component_default_tick(t):
    return c.component_rows(c.component_states(_hosts(t), t)).select("host_id", "component_key", "state_title", "ticked")


@query
def selected_components(t):
    """Components that a host's attempts chose: their rows as listed."""
    rows = c.component_rows(c.component_states(_hosts(t), t)).select("host_id", "component_key", "display_name", "state_title", "ticked")
    return c.selected(rows, t["install_attempt"])


@query
def runtime_max_version(t):
    return c.dotnet_desktop(t["runtime_dir"]).select("host_id", "version")


@query
def framework_version(t):
    release = (F.col("o_orderkey") * 7 + 515000).cast("int")
    return t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select("o_orderkey", release.alias("release"), c.framework_version(release).alias("version"))


@query
def install_tally(t):
    return c.install_tally(t["install_attempt"], c.catalog(t.spark))


@query
def update_filter(t):
    return c.update_counts(t["update"])


@query
def hresult_class(t):
    code = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (*c.POLICY_CODES, c.NO_RIGHTS, 5, 0x80240022)]), (F.col("seq") % 6 + 1).cast("int"))
    return t["install_attempt"].select("host_id", "seq", c.error_class(code).alias("class"))


@query
def progress_changes_batch(t):
    return progress_changes(t["download_progress"])


QUERIES["progress_changes"] = QUERIES.pop("progress_changes_batch")


@query
def progress_streamed(t):
    """The events as a stream of three batches, and a last row without a download, with which the watermark passes the end."""
    events = t["download_progress"].select("download_id", "seq", "done_bytes", "total_bytes", "at")
    idle, folder = 400, shared_folder(t.spark)
    end = events.agg((F.max("at") + F.make_dt_interval(F.lit(idle + 1))).alias("at")).select(
        *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns[:-1]], "at"
    )

    def start(stream: DataFrame, checkpoint: str):
        return progress_stream(stream, f"{idle} days").writeStream.outputMode("append").format("parquet").option("path", folder)

    replay.replay(t.spark, [*replay.by_order(events, "seq", 3), end], start)
    return t.spark.read.schema(CHANGE + ", shown int").parquet(folder)


def _appended(t: Derived, batches: list[DataFrame], made: Callable[[DataFrame], DataFrame], mode: str) -> tuple[str, DataFrame]:
    """The ledger's folder and its rows after a stream of the batches."""
    folder, schema = shared_folder(t.spark), made(batches[0]).schema
    replay.replay(t.spark, batches, lambda stream, checkpoint: made(stream).writeStream.outputMode(mode).foreachBatch(ledger.appender(folder)))
    return folder, ledger.appended(t.spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


@query
def pnp_streamed(t):
    """Device codes kept up by a stream whose batches come in no order: the last row by seq counts, however late another one comes."""
    rows = t["pnp_entity"].select("host_id", "seq", "pnp_device_id", "error_code")
    return ledger.latest(_appended(t, replay.by_hash(rows, "seq", 3), lookups.pnp_codes, "update")[1], "host_id", "key")


@query
def driver_streamed(t):
    """Driver records kept up by such a stream: the first row by seq counts, also if it comes last."""
    rows = t["signed_driver"].select("host_id", "seq", "device_id", "driver_version", "driver_date", "provider")
    return ledger.latest(_appended(t, replay.by_hash(rows, "seq", 3), lookups.driver_records, "update")[1], "host_id", "key")


@query
def log_append(t):
    """Log lines of install attempts, appended batch by batch; the first batch is replayed at the end and adds nothing."""
    attempts = t["install_attempt"]
    line = F.format_string("%s: %d", F.col("component_key"), F.col("exit_code"))
    made = lambda rows: rows.select("host_id", "seq", line.alias("line"))
    batches = replay.by_order(attempts, "seq", 3)
    folder, rows = _appended(t, batches, made, "append")
    ledger.appender(folder)(made(batches[0]), 0)
    return ledger.log_lines(rows, "seq")


@query
def bag_inventory(t):
    """All typed scans out of one table of property bags."""
    names = ("pnp_entity", "signed_driver", "video_controller", "network_adapter", "sound_device", "usb_controller", "desktop_monitor", "physical_memory", "disk_drive", "physical_disk", "processor", "base_board", "bios")
    folder = shared_folder(t.spark)
    rows = None
    for name in names:
        table = t[name]
        if name == "processor":  # numbers as fractions and texts
            table = table.withColumns({"cores": F.col("cores") + 0.25, "threads": F.col("threads").cast("string")})
        if name == "base_board":  # a text as a list of one
            table = table.withColumn("manufacturer", F.array("manufacturer"))
        bag = bags.variant_rows(table, name)
        rows = bag if rows is None else rows.unionByName(bag)
    bags.write_bags(rows, folder)
    return inv.typed_inventory(bags.BagTables(bags.read_bags(t.spark, folder)))


@query
def bag_values(t):
    """Properties of every type, and bags that are no JSON."""
    rows = bags.parsed(t.raw("bag_line").withColumn("class", F.lit("")))
    bag = F.col("properties")
    return rows.select("host_id", "seq", b.text(bag, "Name").alias("name"), b.integer(bag, "Code", -1).alias("code"), b.unsigned(bag, "Code").alias("positive"), b.text(bag, "Absent").alias("absent"))


@query
def tolerant_disks(t):
    """A table of JSON lines, some of them damaged: the rows that can be read, and the others as they are."""
    folder = shared_folder(t.spark)
    t.raw("disk_line").select("line").write.text(f"{folder}/physical_disk")
    rows, rejects = read_tolerant(t.spark, folder, "physical_disk")
    return rows.withColumn("reject", F.lit(None).cast("string")).unionByName(rejects.select(F.col("line").alias("reject")), allowMissingColumns=True)


@query
def class_scan(t):
    """Processors out of a namespace of several classes, by the data source."""
    folder = shared_folder(t.spark)
    rows = bags.bag_rows(t["processor"], "processor").unionByName(bags.bag_rows(t["bios"], "bios")).unionByName(bags.bag_rows(t["physical_memory"], "physical_memory"))
    rows.write.partitionBy("class").parquet(folder)
    classes.register(t.spark)
    tables = bags.BagTables(bags.parsed(t.spark.read.format("host_classes").load(folder)))
    return inv.processors(tables).select("host_id", "seq", "name", "detail", "error_code")


ZONES = ("America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC")


@query
def cim_date_zones(t):
    """Dates near midnight where the machine is; two of the zones have daylight saving."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("host_id") % 4 + 1).cast("int"))
    at = lambda clock: F.concat(F.substring("driver_date", 1, 8), F.lit(clock))
    return t["signed_driver"].select("host_id", "seq", v.cim_date_in(at("043000.000000+000"), zone).alias("early"), v.cim_date_in(at("003000.000000+120"), zone).alias("late"), v.cim_date_in(F.col("driver_date"), zone).alias("plain"))


@query
def report_files(t):
    """The text reports of all hosts written to a few files and read back line by line."""
    folder = shared_folder(t.spark)
    r.write_report_files(QUERIES["headless_report"](t.spark, t.sf_dir), folder, 2_000)
    return r.read_report_files(t.spark, folder)


@query
def keys_without_case(t):
    """Device ids that end in letters whose cases differ in length, grouped by key."""
    letter = F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("seq") % len(LETTERS) + 1).cast("int"))
    return t["pnp_entity"].select("host_id", v.key(F.concat(v.text(F.col("pnp_device_id")), letter)).alias("key")).groupBy("host_id", "key").agg(F.count(F.lit(1)).alias("n"))


LETTERS = ("ß", "SS", "ss", "ſ", "S", "s", "ᾳ", "ᾼ", "ŉ", "é", "É", "ǆ")


@query
def inventory_without_seq(t):
    """The inventory of snapshots that list their rows in order and number none of them."""
    folder, tables = shared_folder(t.spark), {}
    for name in ("pnp_entity", "signed_driver", "video_controller", "network_adapter", "sound_device", "usb_controller", "desktop_monitor", "physical_memory", "disk_drive", "physical_disk", "processor", "base_board", "bios"):
        t[name].repartitionByRange(max(3, t.parts(name)), "host_id", "seq").sortWithinPartitions("host_id", "seq").drop("seq").write.parquet(f"{folder}/{name}")
        tables[name] = read_in_order(t.spark, folder, name)
    return r.grouped(inv.full_inventory(tables)).withColumn("pos", F.col("pos").cast("bigint")).drop("seq")


@query
def selected_tally(t):
    """The tally over the components that are ticked at first."""
    ticked = c.component_rows(c.component_states(_hosts(t), t)).filter("ticked")
    return c.install_tally(t["install_attempt"], c.catalog(t.spark), ticked)


@query
def component_downloads(t):
    """What a run over the components that are ticked at first would fetch on each host."""
    return c.downloads(c.component_rows(c.component_states(_hosts(t), t)), c.catalog(t.spark))
