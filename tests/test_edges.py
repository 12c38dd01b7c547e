"""Rows worked out by hand from the rules."""

from pyspark.sql import functions as F

from hostlens.functions import devices as d
from hostlens.functions import values as v
from hostlens.operators import lookups
from hostlens.plans import components as c
from hostlens.plans import inventory as inv
from hostlens.plans import reports as r
from hostlens.sources.tables import SCHEMAS, conform, read, schema


class Tables(dict):
    """Missing tables are empty."""

    def __init__(self, spark, **rows):
        super().__init__({k: conform(spark.createDataFrame(x[1], "host_id bigint, seq bigint, " + x[0]), k) for k, x in rows.items()})
        self.spark = spark

    def __missing__(self, name):
        return self.spark.createDataFrame([], schema(name))


PNP = "pnp_device_id string, error_code int, name string, pnp_class string"


def test_scalars(spark):
    cases = [
        (v.gib(F.lit(8858370048)), 8.2), (v.gb(F.lit(2500000000)), 2.0), (v.tenths(F.lit(16.0)), "16"), (v.tenths(F.lit(15.9)), "15.9"),
        (v.text(F.lit("\t\u00a0 a b \u2003")), "a b"), (v.text(F.lit(None).cast("string")), ""), (v.joined_text(F.array(F.lit("a"), F.lit("b"))), "a, b"),
        (v.integer(F.lit("abc"), -1), -1), (v.integer(F.lit("42")), 42), (v.rounded_integer(F.lit(2.5)), 2), (v.unsigned(F.lit("-3")), 0), (v.unsigned(F.lit("x")), 0),
        (v.cim_date(F.lit("20240301003000.000000+060")), "29.02.2024"), (v.cim_date(F.lit("20240301003000.000000+060"), 60), "01.03.2024"), (v.cim_date(F.lit("20241331003000.000000+060")), ""),
        (v.cim_date(F.lit("garbage")), ""), (v.cim_date(F.lit("")), ""), (v.percent(F.lit(1), F.lit(-1)), -1), (v.percent(F.lit(199), F.lit(200)), 99), (v.clamp(F.lit(-1)), 0), (v.clamp(F.lit(101)), 100),
        (v.justified(F.lit("abc"), 5), "abc  "), (v.justified(F.lit("abcdef"), 5), "abcdef"),
        (d.cpu_detail(F.lit(4), F.lit(8), F.lit(3250)), "4 ядер / 8 потоков · 3.3 ГГц"), (d.classify(F.lit(56)), "Error"), (d.describe(F.lit(56)), "Код проблемы 56"), (d.device_health(F.lit(-5)), "Ok"),
        (d.classify(F.lit(45)), "NotConnected"), (d.health_mark(F.lit("NotConnected")), "ERR"), (d.needs_attention(F.lit("NotConnected")), False), (d.needs_attention(F.lit("Disabled")), True),
        (d.on_driver_page(F.lit("Disabled")), False), (d.gpu_vendor(F.lit("PCI\\ven_10de&x"), F.lit("Intel"), F.lit("")), "NVIDIA"), (d.gpu_vendor(F.lit(""), F.lit("Intel Corporation"), F.lit("")), "AMD"),
        (d.gpu_vendor(F.lit(""), F.lit("Intel Corporation"), F.lit(""), True), "Intel"), (d.gpu_vendor(F.lit(""), F.lit("Intel"), F.lit("")), "Intel"), (d.gpu_vendor(F.lit("VEN_10D"), F.lit(""), F.lit("GeForce")), "NVIDIA"),
        (d.gpu_vendor(F.lit("VEN_10D"), F.lit(""), F.lit("x")), "Unknown"), (d.vendor_page(F.lit("Unknown")), None),
        (d.driver_summary(F.lit(""), F.lit(""), F.lit("X")), "—"), (d.driver_summary(F.lit("1"), F.lit(""), F.lit("X")), "v1  ·  X"),
        (d.disk_media(F.lit(4), F.lit(17)), "SSD NVMe"), (d.disk_media(F.lit(0), F.lit(17)), "NVMe"), (d.disk_media(F.lit(3), F.lit(11)), "HDD"), (d.disk_media(F.lit(0), F.lit(11)), ""),
        (d.connection(F.lit(1)), ""), (d.connection(F.lit(7)), "Кабель не подключён"), (d.pnp_category(F.lit("hdc")), 3), (d.pnp_category(F.lit(None).cast("string")), 12), (d.resolution(F.lit(0), F.lit(5)), ""),
        (d.memory_name(F.lit(17179869184), F.lit(26), F.lit(0), F.lit(2666)), "16 ГБ DDR4 · 2666 МГц"), (d.memory_name(F.lit(17179869184), F.lit(1), F.lit(0), F.lit(0)), "16 ГБ RAM"),
        (c.error_class(F.lit(0x8024500C)), "policy_blocked"), (c.error_class(F.lit(0x80070005)), "no_rights"), (c.error_class(F.lit(5)), "0x00000005"),
        (c.framework_version(F.lit(528040)), "4.8"), (c.framework_version(F.lit(533320)), "4.8.1"), (c.framework_version(F.lit(5)), None),
    ]
    got = spark.range(1).select(*[column.alias(f"x{i}") for i, (column, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_code_last_wins_and_absent_is_zero(spark):
    t = Tables(spark, pnp_entity=(PNP, [(1, 1, "A", 28, None, None), (1, 2, "a", None, None, None), (1, 3, "", 5, None, None), (2, 1, "A", 22, None, None)]))
    assert {(x.host_id, x.key): x.error_code for x in lookups.pnp_codes(t["pnp_entity"]).collect()} == {(1, "A"): 0, (2, "A"): 22}


def test_driver_first_wins(spark):
    t = Tables(spark, signed_driver=("device_id string, driver_version string", [(1, 1, "x", "2"), (1, 2, "X", "1"), (1, 0, None, "9")]))
    assert [(x.key, x.driver_version, x.driver_date) for x in lookups.driver_records(t["signed_driver"]).collect()] == [("X", "2", "")]


def test_disk_kind_last_known_wins(spark):
    t = Tables(spark, physical_disk=("friendly_name string, media_type int, bus_type int", [(1, 1, "D", 4, 17), (1, 2, "d", 3, 11), (1, 3, "d", 0, 11)]))
    assert [(x.key, x.kind) for x in lookups.disk_kinds(t["physical_disk"]).collect()] == [("D", "HDD")]


def test_problem_is_first_row_above_zero_once(spark):
    t = Tables(spark, pnp_entity=(PNP, [(1, 0, "A", 0, "zero", "Net"), (1, 1, "A", 28, " ", "Net"), (1, 2, "a", 22, "second", "Net"), (1, 3, "B", 10, "typed", "USB")]), usb_controller=("pnp_device_id string, name string", [(1, 1, "b", "u")]))
    got = inv.problem_devices(t).collect()
    assert [(x.name, x.error_code, x.health, x.category) for x in got] == [(d.NO_NAME, 28, "NeedsDriver", 4)]


def test_typed_duplicates_stay_and_take_looked_up_codes(spark):
    row = (1, 1, "a", "u", 99)
    t = Tables(spark, pnp_entity=(PNP, [(1, 1, "A", 45, "x", "USB")]), usb_controller=("pnp_device_id string, name string, error_code int", [row, row]))
    got = inv.full_inventory(t).collect()
    assert [(x.error_code, x.health, x.src_ord) for x in got] == [(45, "NotConnected", 9)] * 2


def test_basic_adapter_keeps_code(spark):
    t = Tables(spark, video_controller=("name string, pnp_device_id string", [(1, 1, "Microsoft Basic Display Adapter", "g"), (1, 2, "Other", "h"), (1, 3, "Other", None)]), pnp_entity=(PNP, [(1, 1, "H", 22, "", "Display")]))
    got = {x.seq: (x.error_code, x.health) for x in inv.typed_inventory(t).collect()}
    assert got == {1: (0, "NeedsDriver"), 2: (22, "Disabled"), 3: (0, "Ok")}


def test_devices_without_id_have_code_minus_one(spark):
    t = Tables(spark, processor=("name string, cores int, threads int, max_mhz int", [(1, 1, None, None, None, None)]), base_board=("product string", [(1, 1, "P")]))
    assert {(x.name, x.error_code, x.health_text) for x in inv.typed_inventory(t).collect()} == {("", -1, d.WORKS), ("P", -1, "—")}


def test_states(spark):
    key = c.RUNTIMES_KEY
    t = Tables(
        spark, runtime_dir=("dir_name string", [(1, 1, "8.0.9"), (1, 2, "8.0.10"), (1, 3, "80.1"), (2, 1, "80.1")]), file_presence=("path string", [(1, 1, "c:\\windows\\syswow64\\D3DX9_43.DLL")]),
        registry_value=("view int, key_path string, value_name string, value string", [(1, 1, 64, key + "x64", "Installed", "0"), (1, 2, 32, key + "x64", "Installed", "1"), (1, 3, 32, key + "x64", "Version", "v32"), (2, 1, 64, key + "x86", "Installed", "x")]),
    )
    hosts = spark.createDataFrame([(1,), (2,)], "host_id bigint")
    extra = c.catalog(spark).union(spark.createDataFrame([(9, "other", "Other", None, None, None, None, [0], None, True)], c.CATALOG_SCHEMA))
    rows = c.component_rows(c.component_states(hosts, t, extra))
    got = {(x.host_id, x.component_key): (x.state, x.version, x.ticked) for x in rows.collect()}
    assert got[1, "dotnet8_desktop"] == ("Installed", "8.0.9", False) and got[2, "dotnet8_desktop"] == ("Missing", "", False)
    assert got[1, "vcredist_x64"] == ("Installed", "v32", False) and got[2, "vcredist_x86"] == ("Missing", "", True)
    assert got[1, "directx"][0] == "Installed" and got[1, "other"] == ("Unknown", "", True)


def test_exit_codes(spark):
    attempts = spark.createDataFrame([(1, 1, "vcredist_x64", 3010), (1, 2, "directx", 3010), (1, 3, "nobody", 0)], "host_id bigint, seq bigint, component_key string, exit_code int")
    got = [(x.success, x.ok, x.percent) for x in c.install_tally(attempts, c.catalog(spark)).orderBy("seq").collect()]
    assert got == [(True, 1, 33), (False, 1, 66), (False, 1, 100)]


def test_summary_of_unknown_host(spark):
    t = Tables(spark, video_controller=("name string", [(3, 2, "second"), (3, 1, " first ")]))
    rows = r.summary_values(inv.system_rows(inv.system_summary(t))).orderBy("pos").collect()
    assert [x.value for x in rows] == [" ()", "—", "—", "—", "0 ГБ", "first"]


def test_missing_class_is_empty_and_formats_read(spark, tmp_path):
    assert read(spark, str(tmp_path), "bios").columns == schema("bios").replace(" bigint", "").replace(" string", "").split(", ")
    spark.createDataFrame([(1, 1, "dev")], "host_id bigint, seq bigint, name string").write.json(f"{tmp_path}/pnp_entity")
    row = read(spark, str(tmp_path), "pnp_entity", "json").first()
    assert (row.name, row.error_code) == ("dev", None)
    assert all(read(spark, str(tmp_path / "no"), n).count() == 0 for n in list(SCHEMAS)[:3])


def test_report_files(spark, tmp_path):
    report = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "host_id bigint, line_no bigint, line string")
    r.write_text_report(report, f"{tmp_path}/out")
    assert [x.value for x in spark.read.text(f"{tmp_path}/out/host_id=1").collect()] == ["a", "b"]


def test_report_files_are_few_and_read_back(spark, tmp_path):
    """A thousand hosts in few files; one host's report opens one of them."""
    report = spark.range(1000).selectExpr("id AS host_id", "explode(sequence(1, 3 + id % 4)) AS n").selectExpr("host_id", "cast(n AS bigint) AS line_no", "concat('host ', host_id, char(9), 'line ', n) AS line")
    r.write_report_files(report, f"{tmp_path}/out", lines=1000)
    files = list((tmp_path / "out" / "lines").rglob("*.txt"))
    assert len(files) == 5
    key = lambda x: (x.host_id, x.line_no, x.line)
    back = r.read_report_files(spark, f"{tmp_path}/out")
    assert sorted(map(key, back.collect())) == sorted(map(key, report.collect()))
    one = spark.createDataFrame([(17,)], "host_id bigint")
    assert sorted(map(key, r.read_report_files(spark, f"{tmp_path}/out", one).collect())) == sorted(map(key, report.filter("host_id = 17").collect()))
    for m in spark.read.parquet(f"{tmp_path}/out/manifest").filter("host_id < 20").collect():
        (file,) = (tmp_path / "out" / "lines" / f"file={m.file}").glob("*.txt")
        lines = file.read_text(encoding="utf-8").splitlines()[m.first_line - 1 : m.first_line - 1 + m.n_lines]
        assert lines == [f"{m.host_id}\t{i}\thost {m.host_id}\tline {i}" for i in range(1, 4 + m.host_id % 4)]


def test_keys_without_case(spark):
    """Letter by letter: no letter becomes two. One exchange for grouping, as before."""
    same = [("abc", "ABC"), ("é", "É"), ("ſ", "s"), ("ᾳ", "ᾼ"), ("ς", "Σ"), ("ǆ", "ǅ")]
    apart = [("ß", "SS"), ("ß", "ss"), ("ŉ", "ʼn"), ("ﬁ", "fi"), ("K", "k"), ("ﬀ", "FF")]
    rows = spark.createDataFrame([(*p, i < len(same)) for i, p in enumerate(same + apart)], "a string, b string, same boolean")
    assert [r.a + r.b for r in rows.filter((v.key(F.col("a")) == v.key(F.col("b"))) != F.col("same")).collect()] == []
    t = Tables(spark, pnp_entity=(PNP, [(1, 1, "straße", 28, None, None), (1, 2, "STRASSE", 22, None, None), (1, 3, "STRAßE", 45, None, None)]))
    codes = lookups.pnp_codes(t["pnp_entity"])
    assert codes._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {x.key: x.error_code for x in codes.collect()} == {"STRAßE": 45, "STRASSE": 22}


def test_rows_without_seq_count_in_file_order(spark, tmp_path):
    from hostlens.sources.tables import read_in_order

    for i, part in enumerate([[(1, "A", 1), (1, "a", 2)], [(1, "A", 3), (2, "A", 4)]]):
        spark.createDataFrame(part, "host_id bigint, pnp_device_id string, error_code int").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        (file,) = (tmp_path / f"w{i}").glob("*.parquet")
        (tmp_path / "pnp_entity").mkdir(exist_ok=True)
        (tmp_path / "pnp_entity" / f"{1 - i}.parquet").write_bytes(file.read_bytes())  # the second part is the first file
    rows = read_in_order(spark, str(tmp_path), "pnp_entity")
    assert [r.error_code for r in rows.orderBy("seq").collect()] == [3, 4, 1, 2]
    assert {(x.host_id, x.error_code) for x in lookups.pnp_codes(rows).collect()} == {(1, 2), (2, 4)}
    assert read_in_order(spark, str(tmp_path), "bios").count() == 0


def test_tally_of_chosen_components(spark):
    attempts = spark.createDataFrame([(1, 1, "vcredist_x64", 0), (1, 2, "directx", 0), (1, 3, "vcredist_x64", 5), (2, 1, "directx", 0)], "host_id bigint, seq bigint, component_key string, exit_code int")
    chosen = spark.createDataFrame([(1, "vcredist_x64"), (1, "vcredist_x64"), (3, "directx")], "host_id bigint, component_key string")
    got = [(x.host_id, x.seq, x.done, x.ok, x.percent) for x in c.install_tally(attempts, c.catalog(spark), chosen).orderBy("seq").collect()]
    assert got == [(1, 1, 1, 1, 50), (1, 3, 2, 1, 100)]
