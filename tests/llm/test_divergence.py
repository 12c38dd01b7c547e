"""The source audit against plain Python and SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from hostlens.llm import divergence
from hostlens.llm.queries import ORACLES, op12_divergence

from oracle import check, connect

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(docs, min_docs, top=50):
    seen, groups = defaultdict(Counter), {}
    for text, lang, source in docs:
        terms = [t.translate(SMALL) for t in TERM.findall(text or "")]
        seen[lang or ""].update(set(terms))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
    out = []
    for lang in seen:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        v = len(kept)

        def shares(count, kept=kept, v=v):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * v) for t in kept}

        of = {s: c for (x, s), c in groups.items() if x == lang}
        p, q = {s: shares(c) for s, c in of.items()}, shares(sum(of.values(), Counter()))
        for s in of:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:n])]
    return sorted(out)


def corpus(n=240):
    rng = random.Random(3)
    words = ["ab", "Ab", "é", "É", "x y", "straße", "\U0001f600", "a", "b", "c", "的", "Z"] + [f"{a}{b}" for a in "pqrst" for b in "uvwxy"]
    docs = []
    for i in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "S", None, ""])
        some = words if source == "s0" else words[len(str(source)) % 5 :]
        text = "".join(rng.choice(some) + rng.choice([" ", "-", "9", "\n", "  ", "_", "\x00", "@"]) for _ in range(rng.choice([0, 1, 5, 60])))
        docs.append((rng.choice([text, text, text.upper()]), rng.choice(["l", "l", "m", None]), source))
    docs += [("ab ab", "alone", "one")] * 40 + [("rare", "few", "a"), ("words", "few", "b")] + [(None, "l", "silent"), ("  ", "m", "silent"), ("1234", "few", "c")]
    return docs + [("ab é " * 50_000 + "p" * 3_000_000, "l", "long")]


def audit(spark, docs, **options):
    df = spark.createDataFrame([(*d, 7, "t") for d in docs], "text string, lang string, source string, n long, `a.b` string").repartition(3)
    return sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("block", [divergence.BLOCK, 7])
def test_against_plain_python(spark, block):
    docs = corpus()
    got = audit(spark, docs, block=block, min_docs=12)
    assert got == brute(docs, 12)
    assert {(r[1], r[2], r[4]) for r in got if r[0] == "few"} == {(s, "pair", 0) for s in "abc"}
    assert any(r[1] == "silent" and r[2] == "pair" and r[4] > 0 for r in got)


def test_small_holds_and_buckets_change_nothing(spark, monkeypatch):
    docs = corpus(120)
    want = audit(spark, docs, min_docs=5)
    assert want == brute(docs, 5)
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "POSTINGS", 10)
    assert audit(spark, docs, min_docs=5) == want


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, c = 3 * 10**13, 10**13 + 7
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(1000)).alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (c + 5) // (n + 5000)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0


def test_query_against_sql(spark):
    check(spark, connect("/root/testdata/sf0.01"), op12_divergence, ORACLES["op12_divergence"], "/root/testdata/sf0.01")
