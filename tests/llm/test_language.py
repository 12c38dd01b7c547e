"""Languages by compression: held-out accuracy, and cases worked out by hand."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from hostlens.llm import language
from hostlens.llm.queries import op11_language

ENDS = {"aa": "ing tion ed the and of with er est".split(), "bb": "ung keit sch der die und mit zu ein".split(), "cc": "ción ado los las que por para mente ar".split()}


def written_in(lang, n, rng):
    return " ".join("".join(rng.choice(ENDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    return [(i, written_in(lang, rng.choice([8, 40, 400]), rng), lang) for i, lang in enumerate(random.Random(5).choices(list(ENDS), [8, 1, 1], k=600))]


def test_held_out_texts(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.train(df.filter("doc_id % 3 <> 0"))
    assert model.langs == ("aa", "bb", "cc")
    got = {r.doc_id: r for r in language.identify(df.filter("doc_id % 3 = 0"), model).collect()}
    want = {i: lang for i, _, lang in docs if i % 3 == 0}
    assert got.keys() == want.keys()
    assert sum(got[i].lang_pred == want[i] for i in want) / len(want) >= 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.margin and r.rejected == (r.margin < language.REJECT) for r in got.values())


def test_model_does_not_depend_on_partitions(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert language.train(df.repartition(1)) == language.train(df.repartition(5))


def test_odd_rows(spark, docs):
    rng = random.Random(6)
    long = written_in("bb", 300_000, rng)
    assert len(long) > 2_000_000
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 + 34 = \u00bd ...", "aa"), (903, long, None), (904, "x", "bb"), (None, written_in("cc", 50, rng), "cc"), (905, written_in("aa", 30, rng), None), (905, written_in("aa", 30, rng), None)]
    df = spark.createDataFrame([(*r, "k", "s") for r in docs + odd], "doc_id long, text string, lang string, `lang_pred` string, `a.b` string")
    model = language.train(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect() if r.doc_id is None or r.doc_id >= 900]
    by_id = dict((i, p) for i, p, _ in got)
    assert [by_id[i] for i in (900, 901, 902, 903, 905, None)] == ["und"] * 3 + ["bb", "aa", "cc"] and by_id[904] in model.langs
    assert len(got) == len(odd) and all(s == 0 for i, p, s in got if p == "und")


def test_no_labels_and_empty_tables(spark, docs):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model == language.Model((), (), ()) and [r.lang_pred for r in language.identify(df, model).collect()] == ["und"]
    one = language.train(spark.createDataFrame([(1, "some text", ""), (2, "", "")], "doc_id long, text string, lang string"))
    assert one.langs == ("",) and [(r.lang_pred, r.score) for r in language.identify(df, one).collect()] == [("", 1.0)]
    assert language.identify(df.limit(0), one).count() == 0


def test_query(spark):
    """Whole table, held-out accuracy, and the contract's columns."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_language(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= 0.98


def test_labels_of_held_out_rows_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    other = docs.withColumn("lang", F.when(part == 2, "zz").otherwise(F.col("lang")))
    assert language.train(other.filter(part != 2)) == language.train(docs.filter(part != 2))
