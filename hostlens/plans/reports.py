"""Reports over the inventory: totals, pages and the text report, as DataFrames with explicit positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.functions import devices as d
from hostlens.functions.values import justified


def category_summary(inventory: DataFrame) -> DataFrame:
    """Totals by host and category, with the category's position in the host's order."""
    rows = inventory.groupBy("host_id", "category").agg(
        F.count(F.lit(1)).alias("devices"), F.count_if(d.needs_attention(F.col("health"))).alias("problems"), F.count_if(F.col("health") == "NeedsDriver").alias("missing_drivers")
    )
    return rows.withColumn("title", d.category_title(F.col("category")))


def grouped(inventory: DataFrame) -> DataFrame:
    """Inventory rows with `pos`, their place in the host's list by category, then in order of appearance."""
    order = Window.partitionBy("host_id").orderBy("category", "src_ord", "seq", "pnp_device_id")
    return inventory.withColumn("pos", F.row_number().over(order))


def grid(inventory: DataFrame, only_problems: bool = False) -> DataFrame:
    """The hardware page: category, name, state and driver of each device; optionally only those that need attention."""
    rows = inventory.filter(d.needs_attention(F.col("health"))) if only_problems else inventory
    summary = d.driver_summary(F.col("driver_version"), F.col("driver_date"), F.col("driver_provider"))
    return rows.select("host_id", "src_ord", "seq", d.category_title(F.col("category")).alias("title"), "name", "health_text", summary.alias("driver"))


def grid_state(inventory: DataFrame, only_problems: bool = False) -> DataFrame:
    """Rows shown for each host, and which message an empty page has."""
    shown = F.count_if(d.needs_attention(F.col("health"))) if only_problems else F.count(F.lit(1))
    rows = inventory.groupBy("host_id").agg(shown.alias("shown"))
    return rows.withColumn("message", F.when(F.col("shown") > 0, "").when(F.lit(only_problems), "no_problems").otherwise("no_devices"))


def overview_tiles(inventory: DataFrame, components: DataFrame) -> DataFrame:
    """The four counts of each host, and whether all is well."""
    tiles = inventory.groupBy("host_id").agg(F.count(F.lit(1)).alias("devices"), F.count_if(d.needs_attention(F.col("health"))).alias("problems"), F.count_if(F.col("health") == "NeedsDriver").alias("missing_drivers"))
    missing = components.groupBy("host_id").agg(F.count_if(F.col("state") == "Missing").alias("missing_components"))
    out = tiles.join(missing, "host_id", "left").fillna(0, ["missing_components"])
    return out.withColumn("all_good", (F.col("problems") == 0) & (F.col("missing_components") == 0))


def summary_values(rows: DataFrame) -> DataFrame:
    """Rows of the system summary as shown: a dash for what is not known."""
    return rows.withColumn("value", F.coalesce(F.nullif("value", F.lit("")), F.lit(d.NONE)))


def problem_page(inventory: DataFrame) -> DataFrame:
    """The driver page: devices without a driver or with an error, not those that are switched off."""
    return inventory.filter(d.on_driver_page(F.col("health"))).select("host_id", "src_ord", "seq", "name", "health_text", "error_code")


def problem_count(inventory: DataFrame) -> DataFrame:
    """(host_id, shown): rows of the driver page for each host of the inventory."""
    return inventory.groupBy("host_id").agg(F.count_if(d.on_driver_page(F.col("health"))).alias("shown"))


def gpu_list(gpus: DataFrame) -> DataFrame:
    shown = d.driver_summary(F.col("driver_version"), F.col("driver_date"), F.lit(""))
    return gpus.select("host_id", "seq", "name", "vendor_name", "vendor_url", shown.alias("driver"), F.col("vendor_url").isNotNull().alias("has_link"))


# Headings of the text report.
HEADINGS = {1: "--- Система ---", 3: "--- Оборудование ({} устройств) ---", 5: "--- Проблемные устройства: {} ---", 7: "--- Видеокарты ---", 9: "--- Компоненты ---"}


def text_report(inventory: DataFrame, system_rows: DataFrame, gpus: DataFrame, components: DataFrame) -> DataFrame:
    """(host_id, line_no, line): the report of each host. A line's place is (section, a, b, c) until the last step numbers them."""

    def lines(rows: DataFrame, section: int, line: Column, a: Column | int = 0, b: Column | int = 0, c: Column | int = 0) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return rows.select("host_id", F.lit(section).alias("section"), *[as_column(x).cast("bigint").alias(n) for n, x in (("a", a), ("b", b), ("c", c))], line.alias("line"))

    health, host = F.col("health"), Window.partitionBy("host_id")
    in_order = ("category", "src_ord", "seq", "pnp_device_id")
    heading = lambda k, n: F.concat(F.lit(HEADINGS[k].split("{}")[0]), F.col(n).cast("string"), F.lit(HEADINGS[k].split("{}")[1]))
    device = F.concat(
        F.lit("   ["), d.health_mark(health), F.lit("] "), "name", F.lit("  ("), d.health_title(health), F.lit(")"), F.when(F.col("detail") == "", "").otherwise(F.concat(F.lit("  — "), "detail"))
    )
    problem = F.concat(F.lit("   ! "), "name", F.lit(": "), "health_text", F.lit(" (код "), F.col("error_code").cast("string"), F.lit(")"))
    # the inventory is read once: a host's first row brings the headings, a category's first row its title
    rows = inventory.withColumns({
        "_first": F.row_number().over(host.orderBy(*in_order)) == 1, "_opens": F.row_number().over(Window.partitionBy("host_id", "category").orderBy(*in_order[1:])) == 1,
        "n": F.count(F.lit(1)).over(host), "problems": F.count_if(d.needs_attention(health)).over(host),
    })

    def place(when: Column, section: int, line: Column, a: Column | int = 0, b: Column | int = 0, c: Column | int = 0) -> Column:
        at = [x.cast("bigint").alias(n) if isinstance(x, Column) else F.lit(x).cast("bigint").alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
        return F.when(when, F.struct(F.lit(section).alias("section"), *at, line.alias("line")))

    placed = F.array(
        *[place(F.col("_first"), k, heading(k, n) if n else F.lit(HEADINGS[k])) for k, n in ((1, ""), (3, "n"), (5, "problems"), (7, ""), (9, ""))],
        place(F.col("_opens"), 4, F.concat(F.lit("["), d.category_title(F.col("category")), F.lit("]")), F.col("category"), -1),
        place(F.lit(True), 4, device, F.col("category"), F.col("src_ord"), F.col("seq")),
        place(d.needs_attention(health), 6, problem, F.col("src_ord"), F.col("seq")),
    )
    version = F.when(F.col("driver_version") == "", "?").otherwise(F.col("driver_version"))
    out = rows.select("host_id", F.explode(F.array_compact(placed)).alias("_l")).select("host_id", "_l.*")
    for p in (
        lines(system_rows, 2, F.concat(F.lit("  "), justified(F.col("title"), 12), F.lit(": "), "value"), F.col("pos")),
        lines(gpus, 8, F.concat(F.lit("   "), "name", F.lit(" — "), "vendor_name", F.lit(", драйвер "), version, F.lit(" "), "driver_date"), F.col("seq")),
        lines(components, 10, F.concat(F.lit("   ["), justified(F.col("state"), 9), F.lit("] "), "display_name"), F.col("catalog_pos")),
    ):
        out = out.unionByName(p)
    order = Window.partitionBy("host_id").orderBy("section", "a", "b", "c", "line")
    return out.select("host_id", F.row_number().over(order).cast("bigint").alias("line_no"), "line")


def write_text_report(report: DataFrame, path: str) -> None:
    """One folder for each host, its lines in order in one text file."""
    report.repartition("host_id").sortWithinPartitions("host_id", "line_no").select("host_id", "line").write.partitionBy("host_id").text(path)


#: So many lines of report files come to one task.
TASK_LINES = 250_000


def write_report_files(report: DataFrame, path: str, lines: int = 1_000_000) -> None:
    """The reports of all hosts in files of about so many lines, a host's report in one of them, and a manifest.

    path/lines/file=<n>: text files of host, line number and line, separated by tabs, in order. path/manifest: (host_id, file, first_line, n_lines), first_line from 1.
    The number of files follows from the number of lines, not of hosts; one task writes many of them, since each task sends the driver an account of its own.
    """
    total = report.count()
    files = max(1, -(-total // lines))
    tasks = min(files, max(report.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_LINES)))
    rows = report.withColumn("file", F.pmod(F.xxhash64("host_id"), F.lit(files)))
    text = F.concat_ws("\t", F.col("host_id").cast("string"), F.col("line_no").cast("string"), "line")
    dealt = rows.repartition(tasks, "file").sortWithinPartitions("file", "host_id", "line_no")
    dealt.select("file", text.alias("value")).write.partitionBy("file").text(f"{path}/lines")
    sizes = rows.groupBy("file", "host_id").agg(F.count(F.lit(1)).alias("n_lines"))
    before = Window.partitionBy("file").orderBy("host_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("host_id", "file", (F.coalesce(F.sum("n_lines").over(before), F.lit(0)) + 1).alias("first_line"), "n_lines").write.parquet(f"{path}/manifest")


def read_report_files(spark: SparkSession, path: str, hosts: DataFrame | None = None) -> DataFrame:
    """(host_id, line_no, line) of all reports, or of these hosts: then only the files that the manifest names are opened."""
    rows = spark.read.schema("value string, file bigint").text(f"{path}/lines")
    if hosts is not None:
        wanted = spark.read.parquet(f"{path}/manifest").join(hosts.select("host_id"), "host_id", "left_semi")
        rows = rows.join(wanted.select("file").distinct(), "file", "left_semi")
    part = F.split("value", "\t", 3)
    out = rows.select(part[0].cast("bigint").alias("host_id"), part[1].cast("bigint").alias("line_no"), part[2].alias("line"))
    return out if hosts is None else out.join(hosts.select("host_id"), "host_id", "left_semi")
