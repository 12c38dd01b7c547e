"""The ledger sink and lookups over arriving snapshots."""

import random

from hostlens.operators import lookups
from hostlens.sources.folders import exists
from hostlens.streaming import ledger, replay

SCHEMA = "host_id bigint, seq bigint, line string"


def test_replayed_and_broken_batches_add_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    assert ledger.appended(spark, folder, SCHEMA).count() == 0
    add = ledger.appender(folder)
    one, two = (spark.createDataFrame(rows, SCHEMA) for rows in ([(1, 2, "b"), (1, 1, "a"), (2, 1, "x")], [(1, 1, "c")]))
    add(one, 0)
    add(one, 0)
    # the rows of batch 1 are there, its entry isn't: an attempt that broke off
    two.unionByName(one).write.parquet(f"{folder}/rows/batch=1")
    lines = lambda: [(r.host_id, r.line_no, r.line) for r in ledger.log_lines(ledger.appended(spark, folder, SCHEMA), "seq").orderBy("host_id", "line_no").collect()]
    assert lines() == [(1, 1, "a"), (1, 2, "b"), (2, 1, "x")]
    add(two, 1)
    add(one, 1)
    assert lines() == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x")]
    assert exists(spark, f"{folder}/ledger/batch=1/_SUCCESS")


def test_a_restarted_stream_appends_each_row_once(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, i, f"l{i}") for i in range(20)], SCHEMA)
    calls = []

    def start(stream, checkpoint):
        add = ledger.appender(folder)

        def twice(batch, number):
            add(batch, number)
            add(batch, number)
            calls.append(number)

        return stream.writeStream.foreachBatch(twice)

    replay.replay(spark, replay.by_hash(rows, "seq", 3), start)
    assert calls == [0, 1, 2]
    assert sorted(r.line for r in ledger.appended(spark, folder, SCHEMA).collect()) == sorted(f"l{i}" for i in range(20))


def arriving(spark, tmp_path, batches, made):
    folder = f"file://{tmp_path}/updates"
    schema = made(batches[0]).schema
    replay.replay(spark, batches, lambda stream, checkpoint: made(stream).writeStream.outputMode("update").foreachBatch(ledger.appender(folder)))
    return ledger.latest(ledger.appended(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)), "host_id", "key")


def test_last_and_first_win_however_late(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(1, 2), s, rng.choice(["A", "a", "b", "B ", "", None]), rng.choice([None, 0, 28, 45])) for s in range(60)]
    schema = "host_id bigint, seq bigint, pnp_device_id string, error_code int"
    whole = spark.createDataFrame(rows, schema)
    rng.shuffle(rows)
    batches = [spark.createDataFrame(rows[i::4], schema) for i in range(4)]
    by_key = lambda df: sorted(map(tuple, df.select("host_id", "key", "error_code").collect()))
    assert by_key(arriving(spark, tmp_path, batches, lookups.pnp_codes)) == by_key(lookups.pnp_codes(whole))
    driver = lambda df: df.selectExpr("host_id", "seq", "pnp_device_id AS device_id", "cast(seq AS string) AS driver_version", "cast(null AS string) AS driver_date", "'p' AS provider")
    version = lambda df: sorted(map(tuple, df.select("host_id", "key", "driver_version").collect()))
    got = arriving(spark, tmp_path / "d", batches, lambda df: lookups.driver_records(driver(df)))
    assert version(got) == version(lookups.driver_records(driver(whole)))
