"""Inventory tables derived from the star-schema test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SCHEMAS, conform

_HOSTS = "(SELECT s_suppkey AS host_id, s_nationkey AS nation FROM supplier) h"

#: In this order; each may read the ones before it.
SQL = {
    "pnp_entity": """
SELECT b % 100 AS host_id, o_orderkey AS seq,
  CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 2 = 1 THEN lower(id0) ELSE id0 END AS pnp_device_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'Display' WHEN 1 THEN 'Net' WHEN 2 THEN 'MEDIA'
    WHEN 3 THEN 'USB' WHEN 4 THEN 'HIDClass' ELSE 'Ports' END AS pnp_class,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 IN (0, 1) THEN o_orderkey % 57 ELSE 0 END AS error_code,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(chr(9), ' dev ', cast(o_orderkey AS string), ' ') END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('maker ', cast(o_orderkey % 9 AS string)) END AS manufacturer
FROM (SELECT *, concat('PCI', chr(92), 'VEN_', CASE b % 5 WHEN 0 THEN '10DE' WHEN 1 THEN '1002'
    WHEN 2 THEN '8086' ELSE '15AD' END, '&DEV_', cast(b AS string)) AS id0
  FROM (SELECT *, o_orderkey - o_orderkey % 3 AS b FROM orders) q0) q""",
    "signed_driver": """
SELECT p.host_id, l_orderkey * 1000 + cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS bigint) AS seq,
  p.pnp_device_id AS device_id, concat('10.', cast(l_linenumber AS string), '.', cast(l_partkey AS string)) AS driver_version,
  CASE WHEN l_partkey % 7 = 0 THEN 'garbage' WHEN l_partkey % 9 = 0 THEN ''
    ELSE concat('20', cast(10 + l_suppkey % 15 AS string), '0', cast(1 + l_linenumber AS string), '15233000.000000', CASE WHEN l_suppkey % 3 = 0 THEN '-180' ELSE '+180' END) END AS driver_date,
  concat('vendor ', cast(l_suppkey % 5 AS string)) AS provider
FROM lineitem JOIN fx_pnp_entity p ON l_orderkey = p.seq WHERE (p.seq - p.seq % 3) % 7 <> 3""",
    "video_controller": """
SELECT host_id, seq, pnp_device_id,
  CASE seq % 11 WHEN 0 THEN 'Microsoft Basic Display Adapter' WHEN 1 THEN 'базовый видеоадаптер' WHEN 2 THEN 'GeForce 42'
    WHEN 3 THEN 'Radeon 7' WHEN 4 THEN 'Intel UHD' ELSE 'Remote Adapter' END AS name,
  CASE seq % 7 WHEN 0 THEN 'Intel Corporation' WHEN 1 THEN 'Acme' WHEN 2 THEN 'Intel' ELSE '' END AS adapter_compat,
  CASE WHEN seq % 8 = 0 THEN NULL ELSE concat('31.0.', cast(seq % 50 AS string)) END AS driver_version,
  CASE WHEN seq % 10 = 0 THEN NULL ELSE '20240229120000.000000+000' END AS driver_date,
  cast(CASE WHEN seq % 4 = 0 THEN 0 ELSE 1920 END AS int) AS hres, cast(1080 AS int) AS vres
FROM fx_pnp_entity WHERE pnp_class = 'Display'""",
    "network_adapter": """
SELECT host_id, seq, name, manufacturer, pnp_device_id, (seq % 4 <> 3) AS physical_adapter,
  cast(CASE WHEN seq % 11 = 10 THEN NULL ELSE seq % 11 END AS int) AS conn_status,
  CASE WHEN seq % 8 = 5 THEN '' ELSE concat('AA:', cast(seq AS string)) END AS mac
FROM fx_pnp_entity WHERE pnp_class = 'Net'""",
    "sound_device": "SELECT host_id, seq, name, manufacturer, pnp_device_id FROM fx_pnp_entity WHERE pnp_class = 'MEDIA' AND seq % 3 <> 2",
    "usb_controller": "SELECT host_id, seq, name, manufacturer, pnp_device_id FROM fx_pnp_entity WHERE pnp_class = 'USB' AND seq % 2 = 1",
    "desktop_monitor": "SELECT host_id, seq, CASE WHEN seq % 10 = 0 THEN '  ' ELSE name END AS name, manufacturer, pnp_device_id FROM fx_pnp_entity WHERE pnp_class = 'HIDClass' AND seq % 5 = 0",
    "physical_memory": """
SELECT p_partkey % 100 AS host_id, p_partkey AS seq, cast(p_size AS bigint) * 268435456 AS capacity,
  cast(CASE p_partkey % 6 WHEN 0 THEN 20 WHEN 1 THEN 21 WHEN 2 THEN 24 WHEN 3 THEN 26 WHEN 4 THEN 34 ELSE 0 END AS int) AS smbios_type,
  cast(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 3200 END AS int) AS configured_clock, cast(CASE WHEN p_partkey % 12 = 0 THEN 0 ELSE 2666 END AS int) AS speed,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS part_number, p_type AS slot
FROM part""",
    "disk_drive": """
SELECT p_partkey % 100 AS host_id, p_partkey AS seq, p_name AS model, cast(p_size AS bigint) * 500000000 AS size_bytes,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'SCSI' END AS bus, concat('SCSI', chr(92), 'DISK_', cast(p_partkey AS string)) AS pnp_device_id FROM part""",
    "physical_disk": """
SELECT p_partkey % 100 AS host_id, p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS friendly_name,
  cast(p_partkey % 6 AS int) AS media_type, cast(CASE WHEN p_partkey % 4 = 0 THEN 17 ELSE 11 END AS int) AS bus_type FROM part""",
    "processor": """
SELECT c_custkey % 100 AS host_id, c_custkey AS seq, c_name AS name, c_mktsegment AS manufacturer, cast(1200 + c_custkey % 40 * 50 AS int) AS max_mhz,
  cast(2 + c_custkey % 7 AS int) AS cores, cast(4 + c_custkey % 14 AS int) AS threads FROM customer""",
    "operating_system": f"""
SELECT host_id, cast(v AS bigint) AS seq, concat('Microsoft Windows ', cast(10 + v % 2 AS string), CASE WHEN host_id % 4 = 0 THEN ' Microsoft Edition' ELSE ' Pro' END) AS caption,
  concat('10.0.', cast(19000 + host_id AS string)) AS version, CASE WHEN host_id % 9 = 0 THEN '' ELSE '64-bit' END AS architecture
FROM {_HOSTS} CROSS JOIN (SELECT 2 AS v UNION ALL SELECT 1) t WHERE host_id % 10 <> 7""",
    "computer_system": f"""
SELECT host_id, cast(0 AS bigint) AS seq, CASE WHEN host_id % 5 = 0 THEN '' ELSE concat(' Maker', cast(nation AS string), ' ') END AS manufacturer,
  CASE WHEN host_id % 3 = 0 THEN NULL ELSE concat('Model ', cast(host_id AS string)) END AS model, host_id * 268435456 AS total_physical_memory FROM {_HOSTS}""",
    "base_board": f"SELECT host_id, cast(0 AS bigint) AS seq, CASE WHEN host_id % 4 = 0 THEN '' ELSE 'Board Co' END AS manufacturer, concat('B', cast(nation AS string)) AS product, 'rev 1' AS version FROM {_HOSTS}",
    "bios": f"SELECT host_id, cast(0 AS bigint) AS seq, 'Bios Co' AS manufacturer, concat('F', cast(host_id AS string)) AS version, concat('2023', CASE WHEN host_id % 2 = 0 THEN '0101003000' ELSE '1331003000' END, '.000000+060') AS release_date FROM {_HOSTS}",
    "registry_value": f"""
SELECT host_id, cast(v AS bigint) AS seq, cast(CASE WHEN v % 2 = 0 THEN 64 ELSE 32 END AS int) AS view,
  concat('SOFTWARE', chr(92), 'Microsoft', chr(92), 'VisualStudio', chr(92), '14.0', chr(92), 'VC', chr(92), 'Runtimes', chr(92), CASE WHEN v < 4 THEN 'x64' ELSE 'x86' END) AS key_path,
  CASE WHEN v % 4 < 2 THEN 'Installed' ELSE 'Version' END AS value_name,
  CASE WHEN v % 4 >= 2 THEN concat('v14.', cast(host_id + v AS string)) WHEN (host_id + v) % 3 = 0 THEN '1' WHEN host_id % 7 = 0 THEN 'x' ELSE '0' END AS value
FROM {_HOSTS} CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) t WHERE (host_id * 3 + v) % 5 <> 0""",
    "file_presence": f"""
SELECT host_id, cast(0 AS bigint) AS seq, concat('C:', chr(92), 'Windows', chr(92), CASE host_id % 3 WHEN 0 THEN 'System32' ELSE 'SysWOW64' END, chr(92), CASE WHEN host_id % 4 = 0 THEN 'other.dll' ELSE 'd3dx9_43.dll' END) AS path FROM {_HOSTS}""",
    "runtime_dir": """
SELECT s_suppkey AS host_id, cast(v AS bigint) AS seq, concat(cast(6 + (s_suppkey + v * v) % 4 AS string), '.0.', cast((s_suppkey * v) % 13 AS string)) AS dir_name
FROM supplier CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t""",
    "update": """
SELECT o_custkey % 100 AS host_id, o_orderkey AS seq, o_orderstatus = 'F' AS is_installed,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Software' ELSE 'Driver' END AS update_type,
  o_orderkey % 10 = 0 AS is_hidden, o_orderkey % 4 <> 0 AS is_downloaded FROM orders""",
    "install_attempt": """
SELECT o_custkey % 100 AS host_id, o_orderkey AS seq,
  CASE o_orderkey % 4 WHEN 0 THEN 'vcredist_x64' WHEN 1 THEN 'vcredist_x86' WHEN 2 THEN 'directx' ELSE 'dotnet8_desktop' END AS component_key,
  cast(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3010 WHEN 2 THEN 1638 WHEN 3 THEN 1641 ELSE 1603 END AS int) AS exit_code FROM orders""",
    "download_progress": """
SELECT cast(0 AS bigint) AS host_id, user_id AS download_id, event_id AS seq, cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) * 1000 AS done_bytes,
  cast(CASE WHEN user_id % 10 = 0 THEN -1 ELSE 100000 END AS bigint) AS total_bytes, ts AS at FROM events""",
    # raw lines and bags: text as a machine may send it, damaged and of unexpected types
    "disk_line": """
SELECT seq, CASE WHEN seq % 7 = 3 THEN substring(line, 1, length(line) - 4) ELSE line END AS line FROM (
  SELECT seq, concat('{"host_id": ', cast(host_id AS string), ', "seq": ', cast(seq AS string), ', "friendly_name": "', friendly_name, '", "media_type": ',
    CASE WHEN seq % 7 = 5 THEN '"oops"' ELSE cast(media_type AS string) END, ', "bus_type": ', cast(bus_type AS string), '}') AS line FROM fx_physical_disk) l""",
    "bag_line": """
SELECT host_id, seq, concat('{"Name": ', CASE seq % 7 WHEN 0 THEN '["a b", "c"]' WHEN 1 THEN '12' WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN '[]' WHEN 5 THEN '"' ELSE concat('"  maker ', cast(seq AS string), ' "') END,
  ', "Code": ', CASE seq % 11 WHEN 0 THEN concat(cast(seq AS string), '.5') WHEN 1 THEN '2.5e0' WHEN 2 THEN concat('" ', cast(seq AS string), ' "') WHEN 3 THEN '"1.5"' WHEN 4 THEN '-4' WHEN 5 THEN 'true' WHEN 6 THEN '99999999999'
    WHEN 7 THEN '[1]' WHEN 8 THEN '-0.5' WHEN 9 THEN '3.5' ELSE cast(seq AS string) END, '}') AS properties
FROM fx_pnp_entity""",
}
_BASE = ("supplier", "part", "customer", "orders", "lineitem", "events")
#: What the large ones are dealt by before a table is made of them: rows of one order, device or download stay together.
DEALT = {"orders": "o_orderkey div 3", "lineitem": "l_orderkey", "events": "user_id"}
#: So many rows of them come to one task, however large the table is.
TASK_ROWS = 250_000


def _needs(sql: str) -> tuple[list[str], list[str]]:
    return [t for t in _BASE if re.search(rf"\b{t}\b", sql)], [t for t in SQL if re.search(rf"\bfx_{t}\b", sql)]


class Derived(dict):
    """Table name -> DataFrame, made on first use. A table that the test data cannot fill is missing, as on a machine without that class."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._rows = spark, sf_dir, {}

    def _base(self, name: str) -> DataFrame:
        """A table of the test data; a large one in tasks of TASK_ROWS, which sorts and aggregates over it keep."""
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return rows.repartition(self._parts(name), F.expr(DEALT[name])) if name in DEALT else rows

    def _parts(self, name: str) -> int:
        if name not in self._rows:
            self._rows[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").count()  # from the files' footers
        return max(self.spark.sparkContext.defaultParallelism, -(-self._rows[name] // TASK_ROWS))

    def parts(self, name: str) -> int:
        """Into how many tasks a derived table goes, by the rows of the tables that it is made of."""
        base, derived = _needs(SQL[name])
        return max([self._parts(t) for t in base] + [self.parts(t) for t in derived])

    def _raw(self, name: str) -> DataFrame:
        base, derived = _needs(SQL[name])
        text = SQL[name].replace("{", "{{").replace("}", "}}")
        for t in base:
            text = re.sub(rf"\b{t}\b", f"{{{t}}}", text)
        for t in derived:
            text = re.sub(rf"\bfx_{t}\b", f"{{fx_{t}}}", text)
        frames = {t: self._base(t) for t in base} | {f"fx_{t}": self._raw(t) for t in derived}
        return self.spark.sql(text, **frames)

    def raw(self, name: str) -> DataFrame:
        """A table of lines or bags, as its SQL gives it."""
        return self._raw(name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = conform(self._raw(name), name) if name in SQL else self.spark.createDataFrame([], f"host_id bigint, seq bigint, {SCHEMAS[name]}")
        return self[name]


def with_clauses(*names: str) -> str:
    """The WITH clauses of these tables and of those that they read, as fx_<name>."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for t in _needs(SQL[name])[1]:
            add(t)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    return ",\n".join(f"fx_{n} AS ({SQL[n]})" for n in wanted)
