"""DuckDB SQL for the inventory queries, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from hostlens.functions import devices as d
from hostlens.plans.components import CATALOG, LEGACY_DLL, RUNTIMES_KEY, STATE_TITLES
from hostlens.plans.inventory import SUMMARY_TITLES
from hostlens.plans.reports import HEADINGS
from hostlens.sources.derived import with_clauses


def _q(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


def _case(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _s(x: str) -> str:
    """Trimmed text, null as empty."""
    return f"coalesce(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '')"


def _date(x: str, minutes: int = 0) -> str:
    return f"""coalesce(strftime(CASE WHEN regexp_full_match({x}, '[0-9]{{14}}\\.[0-9]{{6}}[+-][0-9]{{3}}')
      THEN try_strptime(substr({x}, 1, 14), '%Y%m%d%H%M%S') - to_minutes(cast(substr({x}, 22, 4) AS INT)) + to_minutes({minutes}) END, '%d.%m.%Y'), '')"""


def _classify(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 'Ok' WHEN {x} IN (22, 32, 44, 48) THEN 'Disabled' WHEN {x} IN (24, 45) THEN 'NotConnected' WHEN {x} IN (1, 18, 28, 31, 37, 39, 52) THEN 'NeedsDriver' ELSE 'Error' END"


def _describe(x: str) -> str:
    return f"coalesce((SELECT code_text FROM code_texts WHERE code_no = {x}), '{d.CODE_FALLBACK}' || {x})"


TEXTS = _rows("code_texts", "code_no, code_text", list(d.CODE_TEXTS.items()))
CATEGORY = _rows("category_titles", "category, category_title", list(enumerate(d.CATEGORY_TITLES)))
_ATTENTION = "health IN ('NeedsDriver', 'Error', 'Disabled')"
_SUMMARY = """CASE WHEN driver_version = '' AND driver_date = '' THEN '—' ELSE array_to_string(list_filter([CASE WHEN driver_version = '' THEN '' ELSE 'v' || driver_version END, driver_date, driver_provider], lambda x: x <> ''), '  ·  ') END"""


def _join(*columns: str) -> str:
    return f"array_to_string(list_filter([{', '.join(columns)}], lambda x: x <> ''), '  ·  ')"


CODES = f"""codes AS (SELECT host_id, upper({_s('pnp_device_id')}) AS key, coalesce(error_code, 0)::INT AS error_code FROM fx_pnp_entity
  WHERE {_s('pnp_device_id')} <> '' QUALIFY row_number() OVER (PARTITION BY host_id, upper({_s('pnp_device_id')}) ORDER BY seq DESC) = 1)"""
DRIVERS = f"""drivers AS (SELECT host_id, upper({_s('device_id')}) AS key, {_s('driver_version')} AS driver_version, {_date('driver_date')} AS driver_date, {_s('provider')} AS driver_provider FROM fx_signed_driver
  WHERE {_s('device_id')} <> '' QUALIFY row_number() OVER (PARTITION BY host_id, upper({_s('device_id')}) ORDER BY seq) = 1)"""
KINDS = f"""kinds AS (SELECT host_id, upper({_s('friendly_name')}) AS key, kind FROM (SELECT *, trim(CASE media_type WHEN 4 THEN 'SSD' WHEN 3 THEN 'HDD' ELSE '' END || CASE WHEN bus_type = 17 THEN ' NVMe' ELSE '' END) AS kind FROM fx_physical_disk) k
  WHERE kind <> '' AND {_s('friendly_name')} <> '' QUALIFY row_number() OVER (PARTITION BY host_id, upper({_s('friendly_name')}) ORDER BY seq DESC) = 1)"""


def _vendor(pnp: str, maker: str, name: str, ati: str = "contains(words, 'ATI')") -> str:
    return f"""(SELECT CASE WHEN vendor_id = '10DE' THEN 'NVIDIA' WHEN vendor_id = '1002' THEN 'AMD' WHEN vendor_id = '8086' THEN 'Intel'
    WHEN contains(words, 'NVIDIA') OR contains(words, 'GEFORCE') THEN 'NVIDIA' WHEN contains(words, 'AMD') OR contains(words, 'RADEON') OR {ati} THEN 'AMD'
    WHEN contains(words, 'INTEL') THEN 'Intel' ELSE 'Unknown' END FROM (SELECT regexp_extract(upper({pnp}), 'VEN_(.{{4}})', 1) AS vendor_id, upper({maker} || ' ' || {name}) AS words) w)"""


GPUS = f"""gpus AS (SELECT host_id, seq, {_s('name')} AS name, {_s('pnp_device_id')} AS pnp_device_id, {_s('driver_version')} AS driver_version, {_date('driver_date')} AS driver_date,
  {_vendor('pnp_device_id', 'adapter_compat', 'name')} AS vendor, hres, vres FROM fx_video_controller),
gpu_names AS (SELECT *, CASE vendor WHEN 'Unknown' THEN '{d.UNKNOWN}' ELSE vendor END AS vendor_name, {_case('vendor', d.VENDOR_PAGES, 'NULL')} AS vendor_url FROM gpus)"""
_CODED = f"CASE WHEN error_code > 0 THEN {_classify('error_code')} ELSE 'Ok' END AS health, CASE WHEN error_code > 0 THEN {_describe('error_code')} ELSE '{d.WORKS}' END AS health_text"
_NO_DRIVER = "'' AS driver_version, '' AS driver_date, '' AS driver_provider"
_LOOKED = "coalesce(c.error_code, 0) AS error_code"
_DRIVER = "coalesce(v.driver_version, '') AS driver_version, coalesce(v.driver_date, '') AS driver_date, coalesce(v.driver_provider, '') AS driver_provider"


def _looked_up(table: str, columns: str, where: str = "true") -> str:
    return f"""(SELECT t.host_id, t.seq, {columns}, {_s('t.pnp_device_id')} AS pnp_device_id, {_LOOKED}, {_DRIVER} FROM {table} t
    LEFT JOIN codes c ON c.host_id = t.host_id AND c.key = upper({_s('t.pnp_device_id')}) LEFT JOIN drivers v ON v.host_id = t.host_id AND v.key = upper({_s('t.pnp_device_id')}) WHERE {where}) u"""


_NAMED = f"{_s('t.name')} AS name, {_s('t.manufacturer')} AS manufacturer"
_DISK = "cast(round_even(size_bytes / 1e9::DOUBLE, 0) AS BIGINT) || ' ГБ'"
_CPU = "cores || ' ядер / ' || threads || ' потоков · ' || ((max_mhz + 50) // 100) // 10 || '.' || ((max_mhz + 50) // 100) % 10 || ' ГГц'"
_GIB = "regexp_replace(format('{:.1f}', round_even(capacity / 1073741824.0::DOUBLE, 1)), '\\.0$', '')"
_CLOCK = "CASE WHEN configured_clock > 0 THEN configured_clock ELSE speed END"
_MEMORY = f"{_GIB} || ' ГБ ' || {_case('smbios_type', {20: 'DDR', 21: 'DDR2', 24: 'DDR3', 26: 'DDR4', 34: 'DDR5'}, _q('RAM'))} || CASE WHEN {_CLOCK} > 0 THEN ' · ' || {_CLOCK} || ' МГц' ELSE '' END"
_CONNECTION = _case("coalesce(conn_status, -1)", d.CONNECTION, "''")
_BASIC = "(contains(upper(name), 'BASIC DISPLAY') OR contains(upper(name), 'STANDARD VGA') OR contains(upper(name), 'БАЗОВ'))"
_FIXED = f"-1 AS error_code, 'Ok' AS health, '{d.WORKS}' AS health_text, {_NO_DRIVER}"
_BOARD = f"-1 AS error_code, 'Ok' AS health, '—' AS health_text, {_NO_DRIVER}"
_COLUMNS = "host_id, seq, src_ord, category, name, manufacturer, detail, pnp_device_id, error_code, health, health_text, driver_version, driver_date, driver_provider"
_TAIL = "pnp_device_id, error_code, health, health_text, driver_version, driver_date, driver_provider"

GRAPHICS = f"""graphics AS (SELECT host_id, seq, name, vendor_name AS manufacturer, CASE WHEN hres > 0 AND vres > 0 THEN hres || '×' || vres ELSE '' END AS detail, pnp_device_id, error_code,
  CASE WHEN {_BASIC} THEN 'NeedsDriver' ELSE health END AS health, CASE WHEN {_BASIC} THEN '{d.BASIC_TEXT}' ELSE health_text END AS health_text, driver_version, driver_date, '' AS driver_provider, {_BASIC} AS basic
  FROM (SELECT *, {_CODED} FROM (SELECT g.*, {_LOOKED} FROM gpu_names g LEFT JOIN codes c ON c.host_id = g.host_id AND c.key = upper(g.pnp_device_id)) g1) g2)"""
_NETWORK = _looked_up("fx_network_adapter", _NAMED + ", t.mac AS mac, t.conn_status AS conn_status", f"t.physical_adapter AND {_s('t.pnp_device_id')} <> ''")
_STORAGE = _looked_up("(SELECT p.*, coalesce(k.kind, '') AS kind FROM fx_disk_drive p LEFT JOIN kinds k ON k.host_id = p.host_id AND k.key = upper(" + _s("p.model") + "))", f"{_s('t.model')} AS name, t.size_bytes AS size_bytes, t.kind AS kind, {_s('t.bus')} AS bus")
TYPED = f"""typed AS (
SELECT host_id, seq, 0 AS src_ord, 0 AS category, name, manufacturer, {_CPU} AS detail, '' AS pnp_device_id, {_FIXED} FROM fx_processor
UNION ALL SELECT host_id, seq, 1, 1, name, manufacturer, detail, {_TAIL} FROM graphics
UNION ALL SELECT host_id, seq, 2, 2, {_MEMORY}, '', {_join('slot', 'part_number')}, '', {_FIXED} FROM fx_physical_memory
UNION ALL SELECT host_id, seq, 3, 3, name, '', {_join(_DISK, 'kind', 'bus')}, {_TAIL} FROM (SELECT *, {_CODED} FROM {_STORAGE}) w
UNION ALL SELECT host_id, seq, 4, 4, name, manufacturer, {_join(_CONNECTION, _s('mac'))}, {_TAIL} FROM (SELECT *, {_CODED} FROM {_NETWORK}) w
UNION ALL SELECT host_id, seq, 5, 5, name, manufacturer, '', {_TAIL} FROM (SELECT *, {_CODED} FROM {_looked_up('fx_sound_device', _NAMED)}) w
UNION ALL SELECT host_id, seq, 6, 6, trim(manufacturer || ' ' || product), manufacturer, version, '', {_BOARD} FROM fx_base_board
UNION ALL SELECT host_id, seq, 7, 7, version, manufacturer, {_date('release_date')}, '', {_BOARD} FROM fx_bios
UNION ALL SELECT host_id, seq, 8, 8, name, manufacturer, '', pnp_device_id, error_code, health, health_text, {_NO_DRIVER} FROM (SELECT * EXCLUDE (driver_version, driver_date, driver_provider), {_CODED} FROM {_looked_up('fx_desktop_monitor', _NAMED, _s('t.name') + " <> ''")}) w
UNION ALL SELECT host_id, seq, 9, 9, name, manufacturer, '', {_TAIL} FROM (SELECT *, {_CODED} FROM {_looked_up('fx_usb_controller', _NAMED)}) w)"""
PROBLEMS = f"""problems AS (SELECT p.host_id, p.seq, 10 AS src_ord, {_case('upper(' + _s('p.pnp_class') + ')', d.PNP_CLASSES, '12')} AS category, CASE WHEN {_s('p.name')} = '' THEN '{d.NO_NAME}' ELSE {_s('p.name')} END AS name,
  {_s('p.manufacturer')} AS manufacturer, '' AS detail, p.id AS pnp_device_id, p.error_code::INT AS error_code, {_classify('p.error_code')} AS health, {_describe('p.error_code')} AS health_text, {_DRIVER}
  FROM (SELECT *, {_s('pnp_device_id')} AS id FROM fx_pnp_entity WHERE {_s('pnp_device_id')} <> '' AND error_code > 0
    AND NOT EXISTS (SELECT 1 FROM typed t WHERE t.host_id = fx_pnp_entity.host_id AND t.pnp_device_id <> '' AND upper(t.pnp_device_id) = upper({_s('fx_pnp_entity.pnp_device_id')}))
    QUALIFY row_number() OVER (PARTITION BY host_id, upper({_s('pnp_device_id')}) ORDER BY seq) = 1) p
  LEFT JOIN drivers v ON v.host_id = p.host_id AND v.key = upper(p.id))"""
FULL = f"inventory AS (SELECT {_COLUMNS} FROM typed UNION ALL SELECT {_COLUMNS} FROM problems)"
_STATES = {"vcredist_x64": 0, "vcredist_x86": 1, "directx": 2, "dotnet8_desktop": 3}
COMPONENTS = f"""{_rows('catalog', 'catalog_pos, component_key, display_name, recommended', [(x[0], x[1], x[2], x[9]) for x in CATALOG])},
installed AS (
  SELECT host_id, 'vcredist_' || arch AS component_key, coalesce(arg_max(coalesce(version, ''), view), '') AS version FROM (
    SELECT host_id, view, regexp_extract(key_path, 'x[0-9]+$') AS arch, max(CASE WHEN value_name = 'Installed' AND regexp_full_match(value, '-?[0-9]+') THEN cast(value AS INT) ELSE 0 END) AS on_it, max(CASE WHEN value_name = 'Version' THEN value END) AS version
    FROM fx_registry_value WHERE key_path IN ({_q(RUNTIMES_KEY + 'x64')}, {_q(RUNTIMES_KEY + 'x86')}) GROUP BY ALL) r WHERE on_it = 1 GROUP BY ALL
  UNION ALL SELECT DISTINCT host_id, 'directx', '' FROM fx_file_presence WHERE path IN {LEGACY_DLL!r}
  UNION ALL SELECT host_id, 'dotnet8_desktop', max(dir_name) FROM fx_runtime_dir WHERE starts_with(dir_name, '8.') GROUP BY host_id),
states AS (SELECT h.host_id, k.*, CASE WHEN i.component_key IS NULL THEN 'Missing' ELSE 'Installed' END AS state, coalesce(i.version, '') AS version
  FROM (SELECT DISTINCT host_id FROM fx_computer_system) h CROSS JOIN catalog k LEFT JOIN installed i ON i.host_id = h.host_id AND i.component_key = k.component_key)"""
COMPONENTS = COMPONENTS.replace("\\\\", "\\")
SYSTEM = f"""hosts AS (SELECT host_id FROM fx_operating_system UNION SELECT host_id FROM fx_computer_system UNION SELECT host_id FROM fx_processor UNION SELECT host_id FROM fx_video_controller),
os AS (SELECT * FROM fx_operating_system QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY seq) = 1), pc AS (SELECT * FROM fx_computer_system QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY seq) = 1),
cpu AS (SELECT * FROM fx_processor QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY seq) = 1), gpu AS (SELECT * FROM fx_video_controller QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY seq) = 1),
summary AS (SELECT h.host_id, replace({_s('os.caption')}, 'Microsoft ', '') AS os_name, {_s('os.version')} AS os_version, {_s('os.architecture')} AS os_architecture, {_s('pc.manufacturer')} AS manufacturer, {_s('pc.model')} AS model,
  coalesce(round_even(pc.total_physical_memory / 1073741824.0::DOUBLE, 1), 0) AS ram_gb, {_s('cpu.name')} AS cpu_name, coalesce(cpu.threads, 0) AS logical_cores, {_s('gpu.name')} AS primary_gpu
  FROM hosts h LEFT JOIN os USING (host_id) LEFT JOIN pc USING (host_id) LEFT JOIN cpu USING (host_id) LEFT JOIN gpu USING (host_id)),
summary_rows AS (SELECT host_id, pos, title, value FROM (SELECT host_id, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest([{', '.join(map(_q, SUMMARY_TITLES))}]) AS title,
  unnest([os_name || ' (' || os_architecture || ')', os_version, trim(manufacturer || ' ' || model), cpu_name, regexp_replace(format('{{:.1f}}', ram_gb), '\\.0$', '') || ' ГБ', primary_gpu]) AS value FROM summary) s)"""

DEVICE_TABLES = ("pnp_entity", "signed_driver", "video_controller", "network_adapter", "sound_device", "usb_controller", "desktop_monitor", "physical_memory", "disk_drive", "physical_disk", "processor", "base_board", "bios")
COMPONENT_TABLES = ("computer_system", "registry_value", "file_presence", "runtime_dir")
SYSTEM_TABLES = ("operating_system", "computer_system", "processor", "video_controller")


def _with(tables: tuple[str, ...], *clauses: str) -> str:
    return "WITH " + ",\n".join([with_clauses(*tables), *clauses]) + "\n"


_ALL = (TEXTS, CODES, DRIVERS, KINDS, GPUS, GRAPHICS, TYPED, PROBLEMS, FULL)
_TITLED = f"{_case('category', dict(enumerate(d.CATEGORY_TITLES)), 'NULL')} AS title"
_TILES = f"count(*) AS devices, count(*) FILTER ({_ATTENTION}) AS problems, count(*) FILTER (health = 'NeedsDriver') AS missing_drivers"
_PAD = lambda x, n: f"CASE WHEN length({x}) < {n} THEN rpad({x}, {n}, ' ') ELSE {x} END"
_MARKED = _case("health", d.HEALTH_MARKS, "'ERR'")
_HEALTH_TITLE = _case("health", d.HEALTH_TITLES, "''")
_DOWNLOADS = "CASE WHEN total_bytes > 0 THEN done_bytes * 100 // total_bytes ELSE -1 END"



def _zoned(x: str) -> str:
    """The date in the host's zone, by the zone rules of the other engine."""
    zone = "CASE host_id % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'Asia/Kolkata' ELSE 'UTC' END"
    return f"""coalesce(strftime(timezone({zone}, timezone('UTC', CASE WHEN regexp_full_match({x}, '[0-9]{{14}}\\.[0-9]{{6}}[+-][0-9]{{3}}')
      THEN try_strptime(substr({x}, 1, 14), '%Y%m%d%H%M%S') - to_minutes(cast(substr({x}, 22, 4) AS INT)) END)), '%d.%m.%Y'), '')"""


SQL = {
    "pnp_last_wins": _with(("pnp_entity",), CODES) + "SELECT * FROM codes",
    "driver_first_wins": _with(("signed_driver",), DRIVERS) + "SELECT * FROM drivers",
    "network_scan": _with(DEVICE_TABLES, *_ALL) + "SELECT * EXCLUDE (src_ord) FROM typed WHERE src_ord = 4",
    "typed_inventory": _with(DEVICE_TABLES, *_ALL) + "SELECT * FROM typed",
    "problem_devices": _with(DEVICE_TABLES, *_ALL) + f"SELECT {_COLUMNS} FROM problems",
    "full_inventory": _with(DEVICE_TABLES, *_ALL) + "SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY category, src_ord, seq, pnp_device_id) AS pos FROM inventory",
    "health_class": _with(("pnp_entity",)) + f"SELECT host_id, seq, error_code, health, {_HEALTH_TITLE} AS title, {_MARKED} AS mark, {_ATTENTION} AS attention FROM (SELECT *, {_classify('error_code')} AS health FROM (SELECT host_id, seq, coalesce(error_code, 0)::INT AS error_code FROM fx_pnp_entity) a) b",
    "code_text": _with(("pnp_entity",), TEXTS) + f"SELECT *, {_describe('error_code')} AS description FROM (SELECT coalesce(error_code, 0)::INT AS error_code, count(*) AS n FROM fx_pnp_entity GROUP BY 1) a",
    "category_summary": _with(DEVICE_TABLES, *_ALL) + f"SELECT host_id, category, {_TILES}, {_TITLED} FROM inventory GROUP BY host_id, category",
    "overview_tiles": _with(DEVICE_TABLES + COMPONENT_TABLES, *_ALL, COMPONENTS) + f"""SELECT *, problems = 0 AND missing_components = 0 AS all_good FROM (
      SELECT i.*, coalesce(m.n, 0) AS missing_components FROM (SELECT host_id, {_TILES} FROM inventory GROUP BY host_id) i LEFT JOIN (SELECT host_id, count(*) AS n FROM states WHERE state = 'Missing' GROUP BY host_id) m USING (host_id)) x""",
    "problem_page": _with(DEVICE_TABLES, *_ALL) + "SELECT host_id, src_ord, seq, name, health_text, error_code FROM inventory WHERE health IN ('NeedsDriver', 'Error')",
    "problem_count": _with(DEVICE_TABLES, *_ALL) + "SELECT host_id, count(*) FILTER (health IN ('NeedsDriver', 'Error')) AS shown FROM inventory GROUP BY host_id",
    "attention_only": _with(DEVICE_TABLES, *_ALL) + f"SELECT host_id, src_ord, seq, {_TITLED}, name, health_text, {_SUMMARY} AS driver FROM inventory WHERE {_ATTENTION}",
    "grid_state": _with(DEVICE_TABLES, *_ALL) + f"SELECT host_id, shown, CASE WHEN shown > 0 THEN '' ELSE 'no_problems' END AS message FROM (SELECT host_id, count(*) FILTER ({_ATTENTION}) AS shown FROM inventory GROUP BY host_id) x",
    "driver_summary": _with(("signed_driver",), DRIVERS) + f"SELECT *, {_SUMMARY} AS summary FROM drivers",
    "vendor_detect": _with(("video_controller",)) + f"""SELECT host_id, seq, {_vendor('pnp_device_id', 'adapter_compat', 'name')} AS vendor, {_vendor("''", 'adapter_compat', 'name')} AS by_words,
      {_vendor("''", 'adapter_compat', 'name', "regexp_matches(words, '(^|[^A-Z0-9_])ATI($|[^A-Z0-9_])')")} AS by_strict_words FROM fx_video_controller""",
    "gpu_list": _with(("video_controller",), GPUS) + f"SELECT host_id, seq, name, vendor_name, vendor_url, {_SUMMARY.replace('driver_provider', chr(39) * 2)} AS driver, vendor_url IS NOT NULL AS has_link FROM gpu_names",
    "basic_display": _with(("pnp_entity", "video_controller"), TEXTS, CODES, GPUS, GRAPHICS) + "SELECT host_id, seq, error_code, health, health_text, detail, basic FROM graphics",
    "memory_text": _with(("physical_memory",)) + f"SELECT host_id, seq, {_MEMORY} AS name, '' AS manufacturer, {_join('slot', 'part_number')} AS detail FROM fx_physical_memory",
    "disk_media": _with(("physical_disk",), KINDS) + "SELECT * FROM kinds",
    "disk_text": _with(DEVICE_TABLES, *_ALL) + "SELECT host_id, seq, name, detail, error_code, driver_version FROM typed WHERE src_ord = 3",
    "cpu_text": _with(("processor",)) + f"SELECT host_id, seq, name, {_CPU} AS detail, -1 AS error_code FROM fx_processor",
    "pnp_class_map": _with(("pnp_entity",)) + f"SELECT *, {_TITLED} FROM (SELECT pnp_class, count(*) AS n, {_case('upper(pnp_class)', d.PNP_CLASSES, '12')} AS category FROM fx_pnp_entity GROUP BY pnp_class) x",
    "conn_status": _with(("network_adapter",)) + f"SELECT host_id, seq, {_CONNECTION} AS status FROM fx_network_adapter",
    "cim_date": _with(("signed_driver",)) + f"SELECT host_id, seq, {_date('driver_date')} AS utc, {_date('driver_date', 180)} AS east FROM fx_signed_driver",
    "normalize_str": _with(("pnp_entity",)) + f"SELECT host_id, seq, {_s('name')} AS name, {_s('manufacturer')} AS manufacturer, upper({_s('pnp_device_id')}) AS key FROM fx_pnp_entity",
    "normalize_int": _with(("registry_value",)) + """SELECT host_id, seq, CASE WHEN regexp_full_match(value, '[0-9]+') THEN cast(value AS INT) ELSE -1 END AS as_int, 0 AS as_unsigned,
      CASE WHEN regexp_full_match(value, '[0-9]+') THEN cast(value AS BIGINT) ELSE 0 END AS positive FROM fx_registry_value""",
    "system_rows": _with(SYSTEM_TABLES, SYSTEM) + "SELECT host_id, pos, title, CASE WHEN value = '' THEN '—' ELSE value END AS value FROM summary_rows",
    "primary_gpu": _with(SYSTEM_TABLES, SYSTEM) + "SELECT host_id, os_name, ram_gb, logical_cores, primary_gpu FROM summary",
    "headless_report": _with(DEVICE_TABLES + COMPONENT_TABLES + ("operating_system",), *_ALL, COMPONENTS, SYSTEM) + f"""SELECT host_id, row_number() OVER (PARTITION BY host_id ORDER BY section, a, b, c, line COLLATE "C") AS line_no, line FROM (
      SELECT DISTINCT host_id, 1 AS section, 0 AS a, 0 AS b, 0 AS c, {_q(HEADINGS[1])} AS line FROM inventory
      UNION ALL SELECT host_id, 2, pos, 0, 0, '  ' || {_PAD('title', 12)} || ': ' || value FROM summary_rows
      UNION ALL SELECT host_id, 3, 0, 0, 0, {_q(HEADINGS[3].split('{}')[0])} || count(*) || {_q(HEADINGS[3].split('{}')[1])} FROM inventory GROUP BY host_id
      UNION ALL SELECT DISTINCT host_id, 4, category, -1, 0, '[' || {_TITLED.removesuffix(' AS title')} || ']' FROM inventory
      UNION ALL SELECT host_id, 4, category, src_ord, seq, '   [' || {_MARKED} || '] ' || name || '  (' || {_HEALTH_TITLE} || ')' || CASE WHEN detail = '' THEN '' ELSE '  — ' || detail END FROM inventory
      UNION ALL SELECT host_id, 5, 0, 0, 0, {_q(HEADINGS[5].split('{}')[0])} || count(*) FILTER ({_ATTENTION}) || {_q(HEADINGS[5].split('{}')[1])} FROM inventory GROUP BY host_id
      UNION ALL SELECT host_id, 6, src_ord, seq, 0, '   ! ' || name || ': ' || health_text || ' (код ' || error_code || ')' FROM inventory WHERE {_ATTENTION}
      UNION ALL SELECT DISTINCT host_id, 7, 0, 0, 0, {_q(HEADINGS[7])} FROM inventory
      UNION ALL SELECT host_id, 8, seq, 0, 0, '   ' || name || ' — ' || vendor_name || ', драйвер ' || CASE WHEN driver_version = '' THEN '?' ELSE driver_version END || ' ' || driver_date FROM gpu_names
      UNION ALL SELECT DISTINCT host_id, 9, 0, 0, 0, {_q(HEADINGS[9])} FROM inventory
      UNION ALL SELECT host_id, 10, catalog_pos, 0, 0, '   [' || {_PAD('state', 9)} || '] ' || display_name FROM states) x""".replace(' COLLATE "C"', ""),
    "component_state": _with(COMPONENT_TABLES, COMPONENTS) + "SELECT host_id, component_key, state, version FROM states",
    "component_default_tick": _with(COMPONENT_TABLES, COMPONENTS) + f"SELECT host_id, component_key, {_case('state', STATE_TITLES, 'NULL')} AS state_title, recommended AND state <> 'Installed' AS ticked FROM states",
    "selected_components": _with((*COMPONENT_TABLES, "install_attempt"), COMPONENTS) + f"""SELECT host_id, component_key, display_name, {_case('state', STATE_TITLES, 'NULL')} AS state_title, recommended AND state <> 'Installed' AS ticked
      FROM states WHERE (host_id, component_key) IN (SELECT (host_id, component_key) FROM fx_install_attempt)""",
    "runtime_max_version": _with(("runtime_dir",)) + "SELECT host_id, max(dir_name) AS version FROM fx_runtime_dir WHERE dir_name LIKE '8.%' GROUP BY host_id",
    "framework_version": "SELECT o_orderkey, release, CASE WHEN release >= 533320 THEN '4.8.1' WHEN release >= 528040 THEN '4.8' END AS version FROM (SELECT o_orderkey, cast(o_orderkey * 7 + 515000 AS INT) AS release FROM orders) x",
    "install_tally": _with(("install_attempt",)) + """SELECT *, cast(done * 100 // count(*) OVER (PARTITION BY host_id) AS INT) AS percent FROM (
      SELECT *, count(*) OVER w AS done, count(*) FILTER (success) OVER w AS ok FROM (
        SELECT host_id, seq, component_key, exit_code, CASE component_key WHEN 'directx' THEN exit_code = 0 WHEN 'dotnet8_desktop' THEN exit_code IN (0, 3010, 1638) ELSE exit_code IN (0, 3010, 1638, 1641) END AS success FROM fx_install_attempt) a
      WINDOW w AS (PARTITION BY host_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) b""",
    "update_filter": _with(("update",)) + "SELECT host_id, count(*) AS found, count(*) FILTER (is_downloaded) AS installed FROM fx_update WHERE NOT is_installed AND update_type = 'Driver' AND NOT is_hidden GROUP BY host_id",
    "hresult_class": _with(("install_attempt",)) + "SELECT host_id, seq, CASE WHEN seq % 6 < 3 THEN 'policy_blocked' WHEN seq % 6 = 3 THEN 'no_rights' WHEN seq % 6 = 4 THEN '0x00000005' ELSE '0x80240022' END AS class FROM fx_install_attempt",
    "progress_changes": _with(("download_progress",)) + f"""SELECT download_id, seq, done_bytes, total_bytes, cast(pct AS INT) AS pct, cast(greatest(0, least(100, pct)) AS INT) AS shown, is_final FROM (
      SELECT *, false AS is_final FROM (SELECT *, lag(pct, 1, -1) OVER (PARTITION BY download_id ORDER BY seq) AS before FROM (SELECT *, {_DOWNLOADS} AS pct FROM fx_download_progress) a) b WHERE pct <> before
      UNION ALL SELECT *, NULL, true FROM (SELECT *, {_DOWNLOADS} AS pct FROM fx_download_progress) c WHERE seq = (SELECT max(seq) FROM fx_download_progress e WHERE e.download_id = c.download_id)) x""",
    "log_append": _with(("install_attempt",)) + "SELECT host_id, row_number() OVER (PARTITION BY host_id ORDER BY seq) AS line_no, component_key || ': ' || exit_code AS line FROM fx_install_attempt",
    "bag_values": _with(("bag_line",)) + """SELECT host_id, seq,
        CASE WHEN bad THEN '' WHEN seq % 7 = 0 THEN 'a b, c' WHEN seq % 7 = 1 THEN '12' WHEN seq % 7 = 2 THEN 'True' WHEN seq % 7 IN (3, 4) THEN '' ELSE trim(json_extract_string(p, '$.Name')) END AS name,
        cast(CASE WHEN bad THEN -1 WHEN kind IN ('DOUBLE') THEN cast(round_even(cast(json_extract_string(p, '$.Code') AS DOUBLE), 0) AS BIGINT) WHEN kind = 'BOOLEAN' THEN 1
          WHEN kind = 'VARCHAR' THEN coalesce(try_cast(nullif(regexp_extract(json_extract_string(p, '$.Code'), '^ *(-?[0-9]+) *$', 1), '') AS INT), -1) WHEN kind = 'ARRAY' THEN -1
          WHEN seq % 11 = 6 THEN -1 ELSE cast(json_extract_string(p, '$.Code') AS BIGINT) END AS INT) AS code,
        CASE WHEN bad OR kind = 'ARRAY' THEN 0 WHEN kind = 'DOUBLE' THEN greatest(cast(round_even(cast(json_extract_string(p, '$.Code') AS DOUBLE), 0) AS BIGINT), 0) WHEN kind = 'BOOLEAN' THEN 1
          WHEN kind = 'VARCHAR' THEN coalesce(try_cast(nullif(regexp_extract(json_extract_string(p, '$.Code'), '^ *(-?[0-9]+) *$', 1), '') AS BIGINT), 0) ELSE greatest(cast(json_extract_string(p, '$.Code') AS BIGINT), 0) END AS positive,
        '' AS absent
      FROM (SELECT host_id, seq, NOT json_valid(properties) AS bad, CASE WHEN json_valid(properties) THEN properties ELSE '{}' END AS p, json_type(CASE WHEN json_valid(properties) THEN properties ELSE '{}' END, '$.Code') AS kind FROM fx_bag_line) b""",
    "tolerant_disks": _with(("physical_disk", "disk_line")) + """SELECT CASE WHEN ok THEN host_id END AS host_id, CASE WHEN ok THEN d.seq END AS seq, CASE WHEN ok THEN friendly_name END AS friendly_name, CASE WHEN ok AND d.seq % 7 <> 5 THEN media_type END AS media_type,
        CASE WHEN ok THEN bus_type END AS bus_type, CASE WHEN NOT ok THEN line END AS reject FROM (SELECT *, seq % 7 <> 3 AS ok FROM fx_physical_disk) d JOIN fx_disk_line l ON l.seq = d.seq""",
    "cim_date_zones": _with(("signed_driver",)) + f"""SELECT host_id, seq, {_zoned("(substr(driver_date, 1, 8) || '043000.000000+000')")} AS early, {_zoned("(substr(driver_date, 1, 8) || '003000.000000+120')")} AS late, {_zoned('driver_date')} AS plain FROM fx_signed_driver""",
}
_TICKED = "SELECT (host_id, component_key) FROM states WHERE recommended AND state <> 'Installed'"
SQL |= {
    # letters that are equal without case, one by one: ss and SS, the long s and s, one pair of Greek letters, e with an accent, a digraph
    "keys_without_case": _with(("pnp_entity",)) + f"""SELECT host_id, upper({_s('pnp_device_id')}) || CASE seq % 12 WHEN 0 THEN 'ß' WHEN 1 THEN 'SS' WHEN 2 THEN 'SS' WHEN 3 THEN 'S' WHEN 4 THEN 'S' WHEN 5 THEN 'S' WHEN 6 THEN 'ᾼ' WHEN 7 THEN 'ᾼ' WHEN 8 THEN 'ŉ' WHEN 9 THEN 'É' WHEN 10 THEN 'É' ELSE 'Ǆ' END AS key,
      count(*) AS n FROM fx_pnp_entity GROUP BY ALL""",
    "inventory_without_seq": f"SELECT * EXCLUDE (seq) FROM ({SQL['full_inventory']}) x",
    "selected_tally": _with((*COMPONENT_TABLES, "install_attempt"), COMPONENTS) + f"""SELECT *, cast(done * 100 // count(*) OVER (PARTITION BY host_id) AS INT) AS percent FROM (
      SELECT *, count(*) OVER w AS done, count(*) FILTER (success) OVER w AS ok FROM (
        SELECT host_id, seq, component_key, exit_code, CASE component_key WHEN 'directx' THEN exit_code = 0 WHEN 'dotnet8_desktop' THEN exit_code IN (0, 3010, 1638) ELSE exit_code IN (0, 3010, 1638, 1641) END AS success
        FROM fx_install_attempt WHERE (host_id, component_key) IN ({_TICKED})) a
      WINDOW w AS (PARTITION BY host_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) b""",
    "report_files": SQL["headless_report"],
    # What the catalog says of each component.
    "component_downloads": _with(COMPONENT_TABLES, COMPONENTS) + f"""SELECT host_id, x.* FROM (SELECT host_id, component_key AS k FROM states WHERE (host_id, component_key) IN ({_TICKED})) s JOIN (VALUES
      ('vcredist_x64', 'C/C++ библиотеки, нужны множеству программ и игр.', 'https://aka.ms/vs/17/release/vc_redist.x64.exe', 'vc_redist.x64.exe', '/install /quiet /norestart', NULL),
      ('vcredist_x86', '32-битные C/C++ библиотеки (нужны даже на 64-бит Windows).', 'https://aka.ms/vs/17/release/vc_redist.x86.exe', 'vc_redist.x86.exe', '/install /quiet /norestart', NULL),
      ('directx', 'Легаси-компоненты DirectX (d3dx9, XInput, XAudio) для игр.', 'https://download.microsoft.com/download/1/7/1/1718CCC4-6315-4D8E-9543-8E28A4E18C4C/dxwebsetup.exe', 'dxwebsetup.exe', '/Q', 'https://www.microsoft.com/en-us/download/details.aspx?id=35'))
      x(component_key, description, url, file_name, silent_args, fallback_url) ON x.component_key = s.k""",
}
SQL |= {"progress_streamed": SQL["progress_changes"], "pnp_streamed": SQL["pnp_last_wins"], "driver_streamed": SQL["driver_first_wins"], "bag_inventory": SQL["typed_inventory"], "class_scan": SQL["cpu_text"]}
