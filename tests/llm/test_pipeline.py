import corpus_pipeline
import pytest
from hostlens.llm import queries

from oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    check(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


def test_stages_against_plain_python(spark, tmp_path):
    """What each stage keeps of a small corpus, worked out a document at a time."""
    import math
    import random
    import re
    from collections import defaultdict

    import pyarrow as pa
    from hostlens.llm import quality
    from test_chat_mix_exact import poisson
    from test_near import classes, edited, far_from_threshold, least_distance, plain, text

    draw = random.Random(3)
    items = [(i, text(n)) for i, n in enumerate((12, 25, 40))]
    docs = far_from_threshold([(i, t) for i, t in enumerate([text(draw.randint(30, 90)) for _ in range(30)])])
    n = 100
    for _, t in docs[:12]:
        docs += [(n, t), (n + 1, t.replace(" ", "  \n")), (n + 2, edited(t, 1))]
        n += 3
    docs += [(300 + i, f"{text(20)} {x} {text(20)}") for i, x in items] + [(310 + i, f"{text(20)} {edited(x, 2)} {text(20)}") for i, x in items]
    docs += [(400 + i, "|| $$ BUY!!! ## && " * (i + 1)) for i in range(12)] + [(500, ""), (501, None), (502, "one two")]
    labels = [(d, int(d < 400), 0) for d, _ in docs]
    source = lambda d: "big" if d % 7 else "small"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame([(d, t, "en", source(d), len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    stages, got = dict(corpus_pipeline.STAGES), {}
    rows = frame
    for name in stages:
        rows = stages[name](spark, rows, str(tmp_path)).cache()
        got[name] = sorted(r.doc_id for r in rows.collect())

    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = [(d, t or "") for d, t in docs if model.score(quality.statistics(pa.array([t or ""])))[0] >= 0.3]
    assert got["quality"] == sorted(d for d, _ in kept) and {d for d, _ in kept} >= {d for d, _ in docs if d < 400} and not {d for d, _ in kept} & set(range(400, 412))
    groups = defaultdict(list)
    for d, t in kept:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    kept = [(d, t) for d, t in kept if d in {min(g) for g in groups.values()}]
    assert got["exact"] == sorted(d for d, _ in kept)
    near = classes(kept)
    kept = [(d, t) for d, t in kept if near[d] == d]
    assert got["near"] == sorted(d for d, _ in kept)
    kept = [(d, t) for d, t in kept if all(least_distance(plain(t), plain(x)) > 0.2 * len(plain(x)) for _, x in items)]
    assert got["decontaminate"] == sorted(d for d, _ in kept)
    mass = defaultdict(int)
    for d, t in kept:
        mass[source(d)] += len(t)
    weight = sum(math.sqrt(m) for m in mass.values())
    rate = {k: math.sqrt(m) / weight * sum(mass.values()) / m for k, m in mass.items()}
    import hashlib

    u = lambda d: int(hashlib.md5(f"42:{d}:0".encode()).hexdigest()[:13], 16) / 2**52
    assert got["mix"] == sorted(d for d, _ in kept for _ in range(poisson(u(d), rate[source(d)])))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == got["mix"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen[name] = out.count()
        if name != "mix":
            assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").isEmpty() and out.count() == out.select("doc_id").distinct().count()
            assert 0.3 * docs.count() < seen[name] <= docs.count()
        docs = out
    assert set(out.columns) == {*out.columns[:-2], "copy", "shuffle_key"} and seen["mix"] > 0


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, similarity string"
    for rows in ([], [(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (None, "null id", "en", "s", 7, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()
