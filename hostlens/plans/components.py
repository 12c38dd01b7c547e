"""Installable components: catalog, state from host snapshots, install attempts and driver updates, as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.functions.values import percent

CATALOG_SCHEMA = "catalog_pos int, component_key string, display_name string, description string, url string, file_name string, silent_args string, success_exit_codes array<int>, fallback_url string, recommended boolean"
# The catalog.
CATALOG = [
    (0, "vcredist_x64", "Visual C++ 2015–2022 Redistributable (x64)", "C/C++ библиотеки, нужны множеству программ и игр.", "https://aka.ms/vs/17/release/vc_redist.x64.exe", "vc_redist.x64.exe", "/install /quiet /norestart", [0, 3010, 1638, 1641], None, True),
    (1, "vcredist_x86", "Visual C++ 2015–2022 Redistributable (x86)", "32-битные C/C++ библиотеки (нужны даже на 64-бит Windows).", "https://aka.ms/vs/17/release/vc_redist.x86.exe", "vc_redist.x86.exe", "/install /quiet /norestart", [0, 3010, 1638, 1641], None, True),
    (2, "directx", "DirectX Runtime (June 2010 / D3DX)", "Легаси-компоненты DirectX (d3dx9, XInput, XAudio) для игр.", "https://download.microsoft.com/download/1/7/1/1718CCC4-6315-4D8E-9543-8E28A4E18C4C/dxwebsetup.exe", "dxwebsetup.exe", "/Q", [0], "https://www.microsoft.com/en-us/download/details.aspx?id=35", True),
    (3, "dotnet8_desktop", ".NET 8 Desktop Runtime (x64)", "Рантайм для современных приложений WPF/WinForms.", "https://aka.ms/dotnet/8.0/windowsdesktop-runtime-win-x64.exe", "windowsdesktop-runtime-8-x64.exe", "/install /quiet /norestart", [0, 3010, 1638], None, False),
]
RUNTIMES_KEY = "SOFTWARE\\Microsoft\\VisualStudio\\14.0\\VC\\Runtimes\\"
LEGACY_DLL = ("C:\\Windows\\System32\\d3dx9_43.dll", "C:\\Windows\\SysWOW64\\d3dx9_43.dll")
STATE_TITLES = {"Installed": "Установлено", "Missing": "Не установлено", "Unknown": "Неизвестно"}
POLICY_CODES, NO_RIGHTS = (0x8024500C, 0x8024002B, 0x8024401C), 0x80070005
NETFX_48, NETFX_481 = 528040, 533320


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def vc_runtime(registry_value: DataFrame, arch: str) -> DataFrame:
    """(host_id, state, version): installed if either registry view says so, the 64-bit view first, whose version counts."""
    rows = registry_value.filter(F.col("key_path") == RUNTIMES_KEY + arch)
    views = rows.groupBy("host_id", "view").agg(
        F.max(F.when(F.col("value_name") == "Installed", F.coalesce(F.col("value").try_cast("int"), F.lit(0)))).alias("installed"), F.max(F.when(F.col("value_name") == "Version", F.col("value"))).alias("version")
    )
    best = views.filter("installed = 1").groupBy("host_id").agg(F.max_by(F.coalesce("version", F.lit("")), "view").alias("version"))
    return best.select("host_id", F.lit("Installed").alias("state"), "version")


def legacy_directx(file_presence: DataFrame) -> DataFrame:
    found = file_presence.filter(F.upper("path").isin(*[p.upper() for p in LEGACY_DLL])).select("host_id").distinct()
    return found.select("host_id", F.lit("Installed").alias("state"), F.lit("").alias("version"))


def dotnet_desktop(runtime_dir: DataFrame, major: str = "8") -> DataFrame:
    """(host_id, state, version): the greatest version as text, so 8.0.9 is above 8.0.10. Case does not count."""
    rows = runtime_dir.filter(F.col("dir_name").startswith(f"{major}."))
    return rows.groupBy("host_id").agg(F.max_by("dir_name", F.upper("dir_name")).alias("version")).select("host_id", F.lit("Installed").alias("state"), "version")


def framework_version(release: Column) -> Column:
    """The 4.8 line from its release number; null below it."""
    return F.when(release >= NETFX_481, "4.8.1").when(release >= NETFX_48, "4.8")


def component_states(hosts: DataFrame, tables: Mapping[str, DataFrame], components: DataFrame | None = None) -> DataFrame:
    """(host_id, component_key, catalog_pos, display_name, recommended, state, version) of each host and component.

    A component that no detector knows is Unknown. hosts: host_id of every host; the catalog is a handful of rows.
    """
    spark = hosts.sparkSession
    components = catalog(spark) if components is None else components
    found = {
        "vcredist_x64": vc_runtime(tables["registry_value"], "x64"), "vcredist_x86": vc_runtime(tables["registry_value"], "x86"),
        "directx": legacy_directx(tables["file_presence"]), "dotnet8_desktop": dotnet_desktop(tables["runtime_dir"]),
    }
    states = None
    for name, rows in found.items():
        rows = rows.withColumn("component_key", F.lit(name))
        states = rows if states is None else states.unionByName(rows)
    rows = components.select("catalog_pos", "component_key", "display_name", "recommended").collect()
    every = hosts.select("host_id", F.explode(F.array(*[F.struct(F.lit(r.component_key).alias("component_key"), F.lit(r.catalog_pos).alias("catalog_pos"), F.lit(r.display_name).alias("display_name"), F.lit(r.recommended).alias("recommended")) for r in rows])).alias("c")).select("host_id", "c.*")
    default = F.when(F.col("component_key").isin(*found), "Missing").otherwise("Unknown")
    out = every.join(states, ["host_id", "component_key"], "left")
    return out.select("host_id", "component_key", "catalog_pos", "display_name", "recommended", F.coalesce("state", default).alias("state"), F.coalesce("version", F.lit("")).alias("version"))


def component_rows(states: DataFrame) -> DataFrame:
    """As listed: the state's title, and whether the row is ticked at first."""
    title = F.create_map(*[F.lit(x) for pair in STATE_TITLES.items() for x in pair])
    return states.withColumns({"state_title": F.try_element_at(title, F.col("state")), "ticked": F.col("recommended") & (F.col("state") != "Installed")})


def selected(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the components that their host has chosen, each once. keys: (host_id, component_key); unknown keys choose nothing."""
    return rows.join(keys.select("host_id", "component_key"), ["host_id", "component_key"], "left_semi")


def downloads(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(host_id, component_key, description, url, file_name, silent_args, fallback_url) of the ticked rows of component_rows(): what a run would fetch and start."""
    known = components.select("component_key", "description", "url", "file_name", "silent_args", "fallback_url")
    return rows.filter("ticked").select("host_id", "component_key").join(F.broadcast(known), "component_key").select("host_id", *known.columns)  # the catalog: a handful of rows


def install_tally(attempts: DataFrame, components: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Each attempt with its success and the running counts of its host: done, ok and whole percent.

    chosen: (host_id, component_key); other attempts of the host are then neither listed nor counted.
    """
    if chosen is not None:
        attempts = attempts.join(chosen.select("host_id", "component_key"), ["host_id", "component_key"], "left_semi")
    known = components.select("component_key", "success_exit_codes")
    rows = attempts.join(F.broadcast(known), "component_key", "left")  # the catalog: a handful of rows
    rows = rows.withColumn("success", F.coalesce(F.array_contains("success_exit_codes", F.col("exit_code")), F.lit(False)))
    so_far = Window.partitionBy("host_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("host_id")
    rows = rows.withColumns({"done": F.count(F.lit(1)).over(so_far), "ok": F.count_if(F.col("success")).over(so_far), "_n": F.count(F.lit(1)).over(whole)})
    return rows.select("host_id", "seq", "component_key", "exit_code", "success", "done", "ok", percent(F.col("done"), F.col("_n")).alias("percent"))


def driver_updates(updates: DataFrame) -> DataFrame:
    """Updates that a search offers: drivers that are neither installed nor hidden."""
    return updates.filter("not is_installed and update_type = 'Driver' and not is_hidden")


def update_counts(updates: DataFrame) -> DataFrame:
    """(host_id, found, installed): installed counts what was downloaded and so handed to the installer."""
    return driver_updates(updates).groupBy("host_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("is_downloaded").alias("installed"))


def error_class(code: Column) -> Column:
    """The class of an unsigned 32-bit result code: blocked by policy, no rights, or the code in eight hex digits."""
    return F.when(code.isin(*POLICY_CODES), "policy_blocked").when(code == NO_RIGHTS, "no_rights").otherwise(F.concat(F.lit("0x"), F.lpad(F.hex(code), 8, "0")))
