"""Raw property bags, damaged tables, the class data source, and dates by zone."""

import gzip
import json
import re

from pyspark.sql import functions as F

from hostlens.functions import bags as b
from hostlens.functions import values as v
from hostlens.plans import inventory as inv
from hostlens.sources import bags, classes
from hostlens.sources.tables import SCHEMAS, read_in_order, read_tolerant


def bag(spark, *texts):
    rows = spark.createDataFrame([(1, i, t, "c") for i, t in enumerate(texts)], "host_id bigint, seq bigint, properties string, class string")
    return bags.parsed(rows).orderBy("seq")


def test_values_of_any_type(spark):
    cases = {
        "{}": ("", -1, 0), '{"x": null}': ("", -1, 0), "no json": ("", -1, 0), '{"x": ["a ", "b"]}': ("a , b", -1, 0), '{"x": []}': ("", -1, 0), '{"x": [null, "b"]}': (", b", -1, 0),
        '{"x": " t\\t"}': ("t", -1, 0), '{"x": true}': ("True", 1, 1), '{"x": false}': ("False", 0, 0), '{"x": 2.5}': ("2.5", 2, 2), '{"x": 3.5}': ("3.5", 4, 4), '{"x": 1e3}': ("1000.0", 1000, 1000), '{"x": -0.5}': ("-0.5", 0, 0),
        '{"x": "17"}': ("17", 17, 17), '{"x": " 18 "}': ("18", 18, 18), '{"x": "1.5"}': ("1.5", -1, 0), '{"x": -4}': ("-4", -4, 0), '{"x": 99999999999}': ("99999999999", -1, 99999999999), '{"x": {"y": 1}}': ('{"y":1}', -1, 0), '{"x": ""}': ("", -1, 0),
    }
    p = F.col("properties")
    got = bag(spark, *cases).select(b.text(p, "x"), b.integer(p, "x", -1), b.unsigned(p, "x")).collect()
    assert {t: tuple(r) for t, r in zip(cases, got)} == cases
    truth = bag(spark, '{"x": true}', '{"x": 0}', '{"x": "true"}', '{"x": "?"}', "{}").select(b.truth(p, "x").alias("t")).collect()
    assert [r.t for r in truth] == [True, False, True, None, None]


def test_bags_of_all_classes_round_trip(spark, tmp_path):
    """What a typed table says comes back out of its bag; missing classes are empty."""
    rows = bag(spark, json.dumps({"name": "n", "pnp_device_id": ["p", "q"], "error_code": "28", "more": 1})).withColumn("class", F.lit("usb_controller"))
    tables = bags.BagTables(rows)
    assert [tuple(r) for r in tables["usb_controller"].collect()] == [(1, 0, "n", "", "p, q", 28)]
    assert all(tables[n].count() == 0 for n in ("bios", "processor")) and set(tables) == set(SCHEMAS)
    assert [(r.name, r.error_code) for r in inv.typed_inventory(tables).collect()] == [("n", 0)]


def test_a_scan_of_one_class_opens_no_other(spark, tmp_path):
    folder = f"file://{tmp_path}/bags"
    rows = spark.createDataFrame([(1, c, 0, '{"name": "n"}') for c in ("bios", "processor")], "host_id bigint, class string, seq bigint, properties string")
    bags.write_bags(rows, folder)
    found = bags.read_bags(spark, folder).filter("class = 'processor'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(class" in plan and found.count() == 1


def test_tolerant_scan(spark, tmp_path):
    line = lambda i, **more: json.dumps({"host_id": 1, "seq": i, "friendly_name": f"d{i}", "media_type": 4, "bus_type": 17} | more)
    (tmp_path / "physical_disk").mkdir()
    good = [line(i) for i in range(5)]
    (tmp_path / "physical_disk" / "a.json").write_text("\n".join([good[0], good[1][:-3], "", "rubbish", line(2, media_type="oops", extra=1), json.dumps({"seq": 9}), "[1, 2]"]) + "\n", encoding="utf-8")
    whole = gzip.compress("\n".join(line(i) for i in range(100, 20000)).encode())
    (tmp_path / "physical_disk" / "b.json.gz").write_bytes(whole[: len(whole) // 2])
    rows, rejects = read_tolerant(spark, f"file://{tmp_path}", "physical_disk")
    found = {r.seq: r for r in rows.collect()}
    assert found[0].media_type == 4 and found[2].media_type is None and found[2].friendly_name == "d2" and 1 not in found
    kept = [s for s in found if s >= 100]  # the rows before the break
    assert kept == list(range(100, 100 + len(kept))) and 5_000 < len(kept) < 19_900
    lines = [r.line for r in rejects.filter("file like '%a.json'").collect()]
    assert sorted(lines) == sorted([good[1][:-3], "rubbish", '{"seq": 9}', "[1, 2]"])
    rows, rejects = read_tolerant(spark, f"file://{tmp_path}", "bios")
    assert rows.count() == rejects.count() == 0 and rows.columns[:2] == ["host_id", "seq"]


def test_class_source_reads_only_asked_classes(spark, tmp_path):
    rows = spark.createDataFrame([(h, c, s, json.dumps({"name": f"{c}{s}"})) for h in (1, 2) for c in ("bios", "processor", "update") for s in range(3)], "host_id bigint, class string, seq bigint, properties string")
    rows.repartition(2).write.partitionBy("class").parquet(f"{tmp_path}/ns")
    classes.register(spark)
    for path in (f"{tmp_path}/ns", f"file://{tmp_path}/ns"):
        source = spark.read.format("host_classes").load(path)
        assert source.count() == 18
        one = source.filter("class = 'bios' and host_id = 2")
        files = len(list((tmp_path / "ns" / "class=bios").glob("*.parquet")))
        assert one.rdd.getNumPartitions() == files
        assert sorted((r.host_id, r["class"], r.seq) for r in one.collect()) == [(2, "bios", s) for s in range(3)]
        # the condition on the class is the source's, the one on the host is Spark's
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Filter" in plan and "host_id" in plan.split("Filter", 1)[1].split("\n")[0] and "bios" not in plan.split("Filter", 1)[1].split("\n")[0]
        assert source.filter("class in ('bios', 'none')").count() == 6 and source.filter("class = 'none'").count() == 0
        assert source.filter("class = 'bios' and class = 'update'").count() == 0
    assert spark.read.format("host_classes").load(f"{tmp_path}/nothing").count() == 0


def test_dates_by_zone(spark):
    # worked out by hand: New York is UTC-5, from 10 March to 3 November 2024 UTC-4; Berlin UTC+1, from 31 March to 27 October UTC+2
    cases = [
        ("20240309043000.000000+000", "America/New_York", "08.03.2024"), ("20240311043000.000000+000", "America/New_York", "11.03.2024"), ("20240330223000.000000+000", "Europe/Berlin", "30.03.2024"),
        ("20240331223000.000000+000", "Europe/Berlin", "01.04.2024"), ("20240101003000.000000+060", None, "31.12.2023"), ("20240101003000.000000+060", "Europe/Berlin", "01.01.2024"), ("20241331003000.000000+000", "UTC", ""),
        ("20240230003000.000000+000", "UTC", ""), ("garbage", "UTC", ""), (None, "UTC", ""), ("20240101250000.000000+000", "UTC", ""),
    ]
    df = spark.createDataFrame([(i, a, z) for i, (a, z, _) in enumerate(cases)], "i int, a string, z string")
    for zone in ("UTC", "America/New_York"):  # the session's zone doesn't count
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.d for r in df.select("i", v.cim_date_in(F.col("a"), F.col("z")).alias("d")).orderBy("i").collect()] == [w for *_, w in cases]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_without_seq_are_never_broadcast(spark, tmp_path):
    """Only the names of files are: a small compressed table may be large in the driver."""
    spark.range(1000).selectExpr("id % 7 AS host_id", "'b' AS manufacturer").repartition(3).write.parquet(f"{tmp_path}/bios")
    rows = read_in_order(spark, f"file://{tmp_path}", "bios")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
    assert rows.select("seq").distinct().count() == 1000


def test_bags_are_read_in_methods_that_the_jvm_compiles(spark, tmp_path, capsys):
    """A method of over 8,000 bytes stays interpreted, however many rows it reads."""
    folder = f"file://{tmp_path}/bags"
    rows = spark.createDataFrame([(1, 0, "n", 28)], "host_id bigint, seq bigint, name string, error_code int").withColumn("pnp_device_id", F.array(F.lit("p"), F.lit(None)))
    bags.write_bags(bags.variant_rows(rows, "video_controller"), folder)
    table = bags.BagTables(bags.read_bags(spark, folder))["video_controller"]
    table.explain("codegen")
    assert all(int(x) < 8000 for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))
    assert [(r.name, r.error_code, r.pnp_device_id, r.driver_date) for r in table.collect()] == [("n", 28, "p, ", "")]


def test_white_space_of_any_script_goes(spark):
    """The characters that text() looks for at the ends are those of the pattern."""
    ends = spark.range(0x10000).filter("id < 55296 or id > 57343").select(F.lit("a").alias("a"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = ends.filter(v.text(F.concat("c", "a", "c")) != F.regexp_replace(F.concat("c", "a", "c"), r"(?U)^\s+|\s+$", ""))
    assert found.count() == 0 and ends.filter(v.text(F.concat("c", "a")) == "a").count() == len(v.WHITE)
