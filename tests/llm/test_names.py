"""Columns of any name pass every stage of the pipeline, and every operator that keeps its input's columns."""

import corpus_pipeline
import pytest

from hostlens.llm import decontaminate, pii, quality

NAMES = ["a.b", "with `quote`", "class_id", "_row", "_text", "_c1", "doc id", "item_id", "rep", "score", "_id", "_dropped", "кто"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("names")
    texts = [(i, f"a text of several words number {i % 9} that is neither short nor long " * (1 + i % 3) + "marked with these five others" * (i % 9 == 3)) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 5, *[f"{n}{i}" for n in NAMES]) for i, t in texts], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n.replace('`', '``')}` string" for n in NAMES]]))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "marked with these five others")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, str(folder)


def holds(docs, out):
    """The input's columns in order, and in each row the values that came with its id."""
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    at = {n: i for i, n in enumerate(out.columns)}
    assert rows and all(r[at[n]] == f"{n}{r[at['doc_id']]}" for r in rows for n in NAMES)
    return {r[at["doc_id"]] for r in rows}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tables, name):
    docs, folder = tables
    holds(docs, dict(corpus_pipeline.STAGES)[name](spark, docs, folder))


def test_operators(spark, tables):
    docs, folder = tables
    assert holds(docs, decontaminate.remove_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))) == {i for i in range(60) if i % 9 != 3} | {60, 61}
    holds(docs, quality.filter_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert holds(docs, pii.redact(pii.find_pii(docs)).drop("pii")) == set(range(62))
