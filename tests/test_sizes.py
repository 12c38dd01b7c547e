"""What one task holds doesn't grow with the tables."""

import pytest

from hostlens.operators import lookups
from hostlens.plans import reports
from hostlens.sources import derived

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["signed_driver", "pnp_entity", "download_progress"])
def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch, name):
    """More rows are more tasks, however few shuffle partitions the session has; the rows stay the same."""
    whole = derived.Derived(spark, SF)[name]
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(derived, "TASK_ROWS", 100)
    small = derived.Derived(spark, SF)
    plan = small[name]._jdf.queryExecution().executedPlan().toString()
    assert f", {small.parts(name)}), REPARTITION_BY_NUM" in plan and small.parts(name) > spark.sparkContext.defaultParallelism
    assert sorted(map(str, small[name].collect())) == want


def test_report_files_are_many_to_a_task(spark, tmp_path):
    """Every task sends the driver an account of what it wrote; files don't each take a task."""
    report = spark.range(4000).selectExpr("id div 10 AS host_id", "id % 10 AS line_no", "concat('line ', id) AS line")
    reports.write_report_files(report, f"file://{tmp_path}/r", 20)
    parts = {f.name.split("-")[1] for f in tmp_path.glob("r/lines/file=*/part-*")}
    assert 0 < len(parts) <= spark.sparkContext.defaultParallelism and len(list(tmp_path.glob("r/lines/file=*"))) > 100
    assert sorted(map(tuple, reports.read_report_files(spark, f"file://{tmp_path}/r").collect())) == sorted(map(tuple, report.collect()))


def test_a_device_id_is_cleaned_once_a_row(spark):
    """Neither a condition on the key nor the key itself repeats the text that it is made of."""
    rows = spark.createDataFrame([(1, 2, " a ", "1", None, "p"), (1, 1, "A", "2", None, "p"), (1, 0, " ", "3", None, "p")], "host_id bigint, seq bigint, device_id string, driver_version string, driver_date string, provider string")
    found = lookups.driver_records(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(device_id") == 1
    assert [(r.key, r.driver_version) for r in found.collect()] == [("A", "2")]
