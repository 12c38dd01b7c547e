"""The full inventory of a fleet: typed scans in a fixed order, then devices with a problem that no scan has reported."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions import devices as d
from hostlens.functions.values import cim_date, gib, integer, key, once, parts, tenths, text, unsigned
from hostlens.operators.lookups import disk_kinds, driver_records, first_rows, pnp_codes

DEVICE = "host_id src_ord seq category name manufacturer detail pnp_device_id error_code health health_text driver_version driver_date driver_provider".split()
DRIVER = ("driver_version", "driver_date", "driver_provider")
SEPARATOR = "  ·  "
Tables = Mapping[str, DataFrame]


def _device(rows: DataFrame, src_ord: int, category: int | Column, keyed: bool = False, driven: bool = False, **columns: Column | str) -> DataFrame:
    """The shared schema: what a scan does not set is empty, code -1, working.

    keyed: code and health come from the lookup by device id; driven: so does the driver.
    """
    defaults = {c: F.lit("") for c in DEVICE} | {"error_code": F.lit(-1), "health": F.lit("Ok"), "health_text": F.lit(d.WORKS)}
    fixed = {"host_id": F.col("host_id"), "seq": F.col("seq"), "src_ord": F.lit(src_ord), "category": category if isinstance(category, Column) else F.lit(category)}
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    if keyed:
        given["pnp_device_id"] = F.col("pnp_device_id")
    device_key = key(F.col("pnp_device_id")) if keyed else F.lit(None).cast("string")
    return rows.select(*[(defaults | given | fixed)[c].alias(c) for c in DEVICE], device_key.alias("key"), F.lit(driven).alias("driven"))


def resolve(rows: DataFrame, codes: DataFrame, drivers: DataFrame) -> DataFrame:
    """Looks up code and driver of all rows of _device() at once: both build sides and the rows have one partitioning, (host_id, key)."""
    found = rows.join(codes.withColumnRenamed("error_code", "_code"), ["host_id", "key"], "left")
    found = found.join(drivers.select("host_id", "key", *[F.col(c).alias(f"_{c}") for c in DRIVER]), ["host_id", "key"], "left")
    keyed, code = F.col("key").isNotNull(), F.coalesce("_code", F.lit(0))
    basic = keyed & (F.col("health") == "NeedsDriver")  # an adapter on a basic driver: its own state and text stand
    out = {
        "error_code": F.when(keyed, code).otherwise(F.col("error_code")), "health": F.when(keyed & ~basic, d.device_health(code)).otherwise(F.col("health")),
        "health_text": F.when(keyed & ~basic, d.device_health_text(code)).otherwise(F.col("health_text")),
    } | {c: F.when(F.col("driven"), F.coalesce(f"_{c}", F.lit(""))).otherwise(F.col(c)) for c in DRIVER}
    return found.select(*[out[c].alias(c) if c in out else F.col(c) for c in DEVICE])


def _clean(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: text(F.col(n)) for n in names})


def processors(t: Tables) -> DataFrame:
    detail = d.cpu_detail(integer(F.col("cores")), integer(F.col("threads")), integer(F.col("max_mhz")))
    return _device(t["processor"], 0, 0, name=text(F.col("name")), manufacturer=text(F.col("manufacturer")), detail=detail)


def gpus(t: Tables, strict_vendor: bool = False, zone_minutes: int = 0) -> DataFrame:
    """(host_id, seq, name, pnp_device_id, driver_version, driver_date, vendor, vendor_name, vendor_url, hres, vres) of every adapter."""
    r = _clean(t["video_controller"], "name", "pnp_device_id", "adapter_compat", "driver_version")
    vendor = d.gpu_vendor(F.col("pnp_device_id"), F.col("adapter_compat"), F.col("name"), strict_vendor)
    date = cim_date(F.col("driver_date"), zone_minutes)
    r = r.select("host_id", "seq", "name", "pnp_device_id", "driver_version", date.alias("driver_date"), vendor.alias("vendor"), integer(F.col("hres")).alias("hres"), integer(F.col("vres")).alias("vres"))
    return r.withColumns({"vendor_name": d.vendor_name(F.col("vendor")), "vendor_url": d.vendor_page(F.col("vendor"))})


def graphics(t: Tables, strict_vendor: bool = False, zone_minutes: int = 0) -> DataFrame:
    """An adapter that runs on a basic driver needs its own, whatever its code says; the code stays. Version and date are its own."""
    basic = d.basic_adapter(F.col("name"))
    return _device(
        gpus(t, strict_vendor, zone_minutes), 1, 1, keyed=True, name=F.col("name"), manufacturer=F.col("vendor_name"), detail=d.resolution(F.col("hres"), F.col("vres")),
        health=F.when(basic, "NeedsDriver").otherwise("Ok"), health_text=F.when(basic, d.BASIC_TEXT).otherwise(d.WORKS), driver_version=F.col("driver_version"), driver_date=F.col("driver_date"),
    )


def memory(t: Tables) -> DataFrame:
    r = _clean(t["physical_memory"], "slot", "part_number", "manufacturer")
    name = d.memory_name(unsigned(F.col("capacity")), integer(F.col("smbios_type")), integer(F.col("configured_clock")), integer(F.col("speed")))
    return _device(r, 2, 2, name=name, manufacturer=F.col("manufacturer"), detail=parts(SEPARATOR, F.col("slot"), F.col("part_number")))


def storage(t: Tables) -> DataFrame:
    """Disks, with the kind of medium by their name."""
    r = _clean(t["disk_drive"], "model", "bus", "pnp_device_id")
    r = r.withColumn("key", key(F.col("model"))).join(disk_kinds(t["physical_disk"]), ["host_id", "key"], "left").drop("key")
    detail = parts(SEPARATOR, d.disk_size(unsigned(F.col("size_bytes"))), F.coalesce("kind", F.lit("")), F.col("bus"))
    return _device(r, 3, 3, keyed=True, driven=True, name=F.col("model"), detail=detail)


def network(t: Tables) -> DataFrame:
    """Physical adapters with a device id."""
    r = _clean(t["network_adapter"].filter("physical_adapter"), "name", "manufacturer", "mac", "pnp_device_id").filter("pnp_device_id <> ''")
    detail = parts(SEPARATOR, d.connection(integer(F.col("conn_status"), -1)), F.col("mac"))
    return _device(r, 4, 4, keyed=True, driven=True, name=F.col("name"), manufacturer=F.col("manufacturer"), detail=detail)


def _plain(rows: DataFrame, src_ord: int, category: int, driven: bool) -> DataFrame:
    r = _clean(rows, "name", "manufacturer", "pnp_device_id")
    return _device(r, src_ord, category, keyed=True, driven=driven, name=F.col("name"), manufacturer=F.col("manufacturer"))


def audio(t: Tables) -> DataFrame:
    return _plain(t["sound_device"], 5, 5, True)


def boards(t: Tables) -> DataFrame:
    r = _clean(t["base_board"], "manufacturer", "product", "version")
    return _device(r, 6, 6, name=text(F.concat_ws(" ", "manufacturer", "product")), manufacturer=F.col("manufacturer"), detail=F.col("version"), health_text=d.NONE)


def firmware(t: Tables, zone_minutes: int = 0) -> DataFrame:
    r = _clean(t["bios"], "manufacturer", "version")
    return _device(r, 7, 7, name=F.col("version"), manufacturer=F.col("manufacturer"), detail=cim_date(F.col("release_date"), zone_minutes), health_text=d.NONE)


def monitors(t: Tables) -> DataFrame:
    """Monitors with a name; their drivers are not looked up."""
    return _plain(t["desktop_monitor"].filter(text(F.col("name")) != ""), 8, 8, False)


def usb(t: Tables) -> DataFrame:
    return _plain(t["usb_controller"], 9, 9, True)


def _scans(t: Tables, strict_vendor: bool, zone_minutes: int) -> DataFrame:
    scans = [processors(t), graphics(t, strict_vendor, zone_minutes), memory(t), storage(t), network(t), audio(t), boards(t), firmware(t, zone_minutes), monitors(t), usb(t)]
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


def typed_inventory(t: Tables, codes: DataFrame | None = None, drivers: DataFrame | None = None, strict_vendor: bool = False, zone_minutes: int = 0) -> DataFrame:
    """All typed scans, duplicates kept."""
    codes = pnp_codes(t["pnp_entity"]) if codes is None else codes
    drivers = driver_records(t["signed_driver"], zone_minutes) if drivers is None else drivers
    return resolve(_scans(t, strict_vendor, zone_minutes), codes, drivers)


def reported_keys(t: Tables) -> DataFrame:
    """(host_id, key) of the devices that typed scans report; only the id columns of their sources are read."""
    named = t["desktop_monitor"].filter(text(F.col("name")) != "")
    rows = [t["video_controller"], t["disk_drive"], t["network_adapter"].filter("physical_adapter"), t["sound_device"], named, t["usb_controller"]]
    out = None
    for r in rows:
        k = once(r, "_id", text(F.col("pnp_device_id"))).select("host_id", key(F.col("_id")).alias("key"))
        out = k if out is None else out.union(k)
    return out.filter("key <> ''")


def problem_devices(t: Tables, drivers: DataFrame | None = None, zone_minutes: int = 0) -> DataFrame:
    """Devices with a code above 0 that no typed scan reports; of several rows of one device the first such row."""
    drivers = driver_records(t["signed_driver"], zone_minutes) if drivers is None else drivers
    rows = _clean(t["pnp_entity"], "pnp_device_id").filter("pnp_device_id <> '' and error_code > 0").withColumn("key", key(F.col("pnp_device_id")))
    rows = rows.join(reported_keys(t), ["host_id", "key"], "left_anti")
    first = F.min_by(F.struct("seq", "pnp_device_id", "name", "pnp_class", "error_code", "manufacturer"), "seq")
    rows = rows.groupBy("host_id", "key").agg(first.alias("r")).join(drivers, ["host_id", "key"], "left").select("host_id", "r.*", *DRIVER)
    rows = _clean(rows, "name", "pnp_class", "manufacturer").fillna("", list(DRIVER))
    code = F.col("error_code")
    out = _device(
        rows, 10, d.pnp_category(F.col("pnp_class")), name=F.when(F.col("name") == "", d.NO_NAME).otherwise(F.col("name")), manufacturer=F.col("manufacturer"), pnp_device_id=F.col("pnp_device_id"),
        error_code=code, health=d.classify(code), health_text=d.describe(code), **{c: F.col(c) for c in DRIVER},
    )
    return out.select(DEVICE)


def full_inventory(t: Tables, strict_vendor: bool = False, zone_minutes: int = 0) -> DataFrame:
    """Typed scans and problem devices. A host's order is (src_ord, seq).

    Each source is read once: devices and the aggregated device codes meet in one full join, whose rows without a device
    are those that no scan has reported.
    """
    code = integer(F.col("error_code"))
    failed = F.col("error_code") > 0
    pnp = once(t["pnp_entity"], "_id", text(F.col("pnp_device_id"))).select("host_id", key(F.col("_id")).alias("key"), "seq", code.alias("code"), F.when(failed, F.col("seq")).alias("failed"), F.struct("seq", "pnp_device_id", "name", "pnp_class", "error_code", "manufacturer").alias("r"))
    pnp = pnp.filter("key <> ''").groupBy("host_id", "key").agg(F.max_by("code", "seq").alias("_code"), F.min_by("r", "failed").alias("_r"), F.min("failed").alias("_failed"))
    found = _scans(t, strict_vendor, zone_minutes).join(pnp, ["host_id", "key"], "full").filter("src_ord is not null or _failed is not null")
    found = found.join(driver_records(t["signed_driver"], zone_minutes).withColumnsRenamed({c: f"_{c}" for c in DRIVER}), ["host_id", "key"], "left")

    keyed, known = F.col("key").isNotNull(), F.coalesce("_code", F.lit(0))
    basic = keyed & (F.col("health") == "NeedsDriver")  # an adapter on a basic driver: its own state and text stand
    device = {c: F.col(c) for c in DEVICE} | {
        "error_code": F.when(keyed, known).otherwise(F.col("error_code")), "health": F.when(keyed & ~basic, d.device_health(known)).otherwise(F.col("health")),
        "health_text": F.when(keyed & ~basic, d.device_health_text(known)).otherwise(F.col("health_text")),
    } | {c: F.when(F.col("driven"), F.coalesce(f"_{c}", F.lit(""))).otherwise(F.col(c)) for c in DRIVER}
    raw = {c: text(F.col(f"_r.{c}")) for c in ("name", "pnp_class", "manufacturer", "pnp_device_id")}
    failed_code = F.col("_r.error_code")
    problem = {c: F.lit("") for c in DEVICE} | {
        "host_id": F.col("host_id"), "src_ord": F.lit(10), "seq": F.col("_r.seq"), "category": d.pnp_category(raw["pnp_class"]), "name": F.when(raw["name"] == "", d.NO_NAME).otherwise(raw["name"]),
        "manufacturer": raw["manufacturer"], "pnp_device_id": raw["pnp_device_id"], "error_code": failed_code, "health": d.classify(failed_code), "health_text": d.describe(failed_code),
    } | {c: F.coalesce(f"_{c}", F.lit("")) for c in DRIVER}
    return found.select(*[F.when(F.col("src_ord").isNotNull(), device[c]).otherwise(problem[c]).alias(c) for c in DEVICE])


def system_summary(t: Tables) -> DataFrame:
    """One row for each host that any of the sources knows; what is not known is empty."""
    os = first_rows(t["operating_system"], "caption", "version", "architecture")
    os = os.select("host_id", F.replace(text(F.col("caption")), F.lit("Microsoft "), F.lit("")).alias("os_name"), text(F.col("version")).alias("os_version"), text(F.col("architecture")).alias("os_architecture"))
    pc = first_rows(t["computer_system"], "manufacturer", "model", "total_physical_memory")
    pc = pc.select("host_id", text(F.col("manufacturer")).alias("manufacturer"), text(F.col("model")).alias("model"), gib(unsigned(F.col("total_physical_memory"))).alias("ram_gb"))
    cpu = first_rows(t["processor"], "name", "threads")
    cpu = cpu.select("host_id", text(F.col("name")).alias("cpu_name"), integer(F.col("threads")).alias("logical_cores"))
    gpu = first_rows(_clean(t["video_controller"], "name"), "name").select("host_id", F.col("name").alias("primary_gpu"))
    out = os.join(pc, "host_id", "full").join(cpu, "host_id", "full").join(gpu, "host_id", "full")
    return out.fillna("", ["os_name", "os_version", "os_architecture", "manufacturer", "model", "cpu_name", "primary_gpu"]).fillna(0, ["logical_cores", "ram_gb"])


# Titles of the summary's rows.
SUMMARY_TITLES = ("Система", "Версия", "Компьютер", "Процессор", "Память", "Видеокарта")


def system_rows(summary: DataFrame) -> DataFrame:
    """(host_id, pos, title, value): the six rows of a summary, in order."""
    values = [
        F.concat("os_name", F.lit(" ("), "os_architecture", F.lit(")")), F.col("os_version"), text(F.concat_ws(" ", "manufacturer", "model")), F.col("cpu_name"),
        F.concat(tenths(F.col("ram_gb")), F.lit(" ГБ")), F.col("primary_gpu"),
    ]
    rows = F.array(*[F.struct(F.lit(title).alias("title"), v.alias("value")) for title, v in zip(SUMMARY_TITLES, values)])
    return summary.select("host_id", F.posexplode(rows).alias("pos", "r")).select("host_id", "pos", "r.title", "r.value")
