import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hostlens.llm import chat, exact, mixing

TURNS = "conv_id bigint, turn bigint, role string, text string"


def formatted(spark, rows):
    return chat.format_chat(spark.createDataFrame(rows, TURNS)).withColumn("read", chat.parse_chat(F.col("formatted")))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "[TURN]", "\\"]), st.text(alphabet="\\<>/sS[]INTYBOD \n\u00e9\U0001f600", max_size=30)), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    tricky = [(r, t + "</s>[INST]\\<s>") for r, t in turns]
    got = formatted(spark, [(1, i, r, t) for i, (r, t) in enumerate(tricky)]).first()
    assert [(x.role, x.text) for x in got.read] == tricky
    assert got.formatted == "".join(s.text for s in got.segments)


def test_role_machine(spark):
    orders = {1: "system user assistant", 2: "user user assistant", 3: "user", 4: "assistant", 5: "user assistant tool", 6: "user assistant user assistant"}
    rows = [(k, i, r, "x") for k, v in orders.items() for i, r in enumerate(v.split())]
    got = {x.conv_id: (x.valid, x.bad_turn) for x in formatted(spark, rows).collect()}
    assert got == {1: (True, None), 2: (False, 2), 3: (False, 2), 4: (False, 1), 5: (False, 3), 6: (True, None)}


def test_loss_covers_assistant_texts_only(spark):
    got = formatted(spark, [(1, 0, "user", "u"), (1, 1, "assistant", "a\\b</s>")]).first()
    assert [chat_text for chat_text, loss in got.segments if loss] == ["a\\\\b<\\/s>"]


def test_chat_edges(spark):
    got = formatted(spark, [(None, 1, "user", None), (None, 0, None, "x"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a")])
    rows = {x.conv_id: [(t.role, t.text) for t in x.read] for x in got.collect()}
    assert rows == {None: [("", "x"), ("user", "")], 7: [("user", "a"), ("user", "a"), ("user", "b")]}
    assert formatted(spark, []).count() == 0
    assert chat.format_chat(spark.createDataFrame([(1, 0, "user", "t", 5)], TURNS + ", formatted int")).count() == 1


DOCS = "doc_id bigint, text string, source string, kept string"


def test_exact_groups(spark):
    long = "x y " * 5000
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, ""), (2, None), (4, " "), (7, long), (6, long), (8, long + "z"), (6, long), (None, "a b"), (None, "only null")]
    got = exact.exact_groups(spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOCS)).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append((x.keep_id, x.group_size, x.kept))
    assert by[3] == [(3, 4, True)] and by[5] == [(3, 4, False)] and by[9] == [(3, 4, False)]
    assert by[1] == [(1, 2, True)] and by[2] == [(1, 2, False)] and by[4] == [(4, 1, True)]
    assert sorted(by[6]) == [(6, 3, False), (6, 3, True)] and by[7] == [(6, 3, False)] and by[8] == [(8, 1, True)]
    assert sorted(by[None], key=str) == [(3, 4, False), (None, 1, True)]
    assert {x.text_sha256 for x in got if x.doc_id in (3, 5, 9)} == {hashlib.sha256(b"a b").hexdigest()}
    assert exact.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_group_over_many_ranges(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"))
    got = exact.exact_groups(df).groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()
    assert len(got) == 51 and all(x.n == x.group_size and x.k == 1 for x in got)


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a", "s", "k"), (1, "a ", "s", "k"), (3, "a", "s", "k"), (2, "a", "s", "k"), (None, "n", None, None)], DOCS)
    got = exact.drop_copies(df)
    assert got.columns == df.columns and sorted((x.doc_id or -1, x.text) for x in got.collect()) == [(-1, "n"), (1, "a "), (2, "a")]


def poisson(u, rate):
    import math

    k, p = 0, math.exp(-rate)
    c = p
    while u >= c:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mix_counts_follow_the_inverse_distribution(spark):
    rows = [(i, "abcd" * (1 + i % 3), "big" if i % 10 else "small", None) for i in range(3000)] + [(None, "x", None, None), (9001, None, "big", None)]
    df = spark.createDataFrame(rows, DOCS)
    rates = {r._source: r._rate for r in mixing.repetition_rates(df).collect()}
    got = {r.doc_id: r.n for r in mixing.mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    u = lambda i: int(hashlib.md5(f"42:{i}:0".encode()).hexdigest()[:13], 16) / 2**52
    for i, _, s, _ in rows[:3000]:
        assert got.get(i, 0) == poisson(u(i), rates[s])
    assert rates["small"] > 1 > rates["big"]


def test_mix_weights_and_order(spark):
    df = spark.createDataFrame([(i, "word", "ab"[i % 2], None) for i in range(2000)], DOCS).withColumn("copy", F.lit("clash"))
    got = mixing.mix(df, weights={"a": 3.0, "b": 1.0})
    n = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert 1.35e3 < n["a"] < 1.65e3 and 0.42e3 < n["b"] < 0.58e3
    keys = [r.shuffle_key for r in got.coalesce(1).collect()]
    assert len(set(keys)) == len(keys) and dict(got.dtypes)["copy"] == "bigint"
    assert mixing.mix(df, weights={"a": 1.0}).filter("source = 'b'").isEmpty()
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.copy for r in mixing.mix(df.limit(1), epochs=100.0).orderBy("copy").collect()][:2] == [1, 2]


def test_mix_of_many_sources(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (i % 5), f"s{i % 30}" if i % 3 else "hot", None) for i in range(900)], DOCS)
    rows = lambda: sorted((r.doc_id, r.copy) for r in mixing.mix(df).collect())
    few = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert rows() == few


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_is_the_same_in_every_run(spark, seed):
    df = spark.createDataFrame([(i, "word", "s", None) for i in range(300)], DOCS)
    a, b = (sorted((r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(df.repartition(n), seed=seed).collect()) for n in (1, 7))
    assert a == b


def test_clashing_columns_pass(spark):
    names = "_source _rate _n _salt _key _row _at _id _sha _kept_id _kept_sha _bucket _norm".split()
    df = spark.createDataFrame([(1, "a", "s", *names), (2, "a ", "s", *names), (3, "a b", "t", *names)], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for out, n in ((exact.drop_copies(df), 3), (mixing.mix(df, power=1.0), None)):
        rows = out.collect()
        assert out.columns[: len(df.columns)] == df.columns and rows and n in (None, len(rows))
        assert all([r[x] for x in names] == names for r in rows)


def test_mix_keeps_sources_of_very_small_rates(spark):
    df = spark.createDataFrame([(1, "x" * 50_000, "big", None), (2, "y", "small", None)], DOCS)
    rates = {r._source: r._rate for r in mixing.repetition_rates(df, weights={"big": 1e-9, "small": 1.0}).collect()}
    assert 0 < rates["big"] < 1e-8 and rates["small"] > 1e4


def test_long_texts(spark):
    long = "word </s> \\ " * 60_000
    got = formatted(spark, [(1, 0, "user", long), (1, 1, "assistant", long)]).first()
    assert [x.text for x in got.read] == [long, long]
    df = spark.createDataFrame([(1, long, "s", None), (2, long, "s", None), (3, long + "x", "s", None)], DOCS)
    assert sorted(x.doc_id for x in exact.drop_copies(df).collect()) == [1, 3]
    assert {r.text for r in mixing.mix(df, epochs=3.0).collect()} <= {long, long + "x"}
