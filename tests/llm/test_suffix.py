"""Repeats and their removal against brute force over all strings of the least length."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from hostlens.llm import suffix

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefg\u00e9\u00fc") for _ in range(rng.randint(2, 9))) for _ in range(300)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    lines, passages, docs = [text(20) for _ in range(6)], [text(80) for _ in range(2)], []
    for i in range(60):
        docs.append((i * 3, " ".join(rng.choice([text(rng.randint(1, 40)), rng.choice(lines), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))))
    docs += [(1000 + i, docs[i][1]) for i in range(10)]
    docs += [(2000, ""), (2001, "a" * 500), (2002, "ab" * 300), (2003, "x" + "a" * 150), (2004, "\x00" * 300), (2005, None), (2006, docs[0][1][:99])]
    docs += [(3000 + i, docs[5][1][: rng.randint(50, 200)] + text(2) + docs[5][1][60:]) for i in range(15)]
    return docs


def brute(docs, length=100):
    first, out = {}, {}
    for d, t in sorted((d, (t or "").encode()) for d, t in docs):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], (d, i))
    for d, t in ((d, (t or "").encode()) for d, t in docs):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (d, i):
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("split,hot", [(8_000, 0.02), (3, 0.02), (3, 0.001)])
def test_removal(spark, monkeypatch, split, hot):
    if hot < 0.01:  # nearly every repeated anchor counts as hot
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SAMPLE", 40)
        monkeypatch.setattr(suffix, "HEAVY", 5)
    docs = documents()
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, start string")
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4]).decode()) for r in suffix.remove_repeats(df, keep_text=False, split=split).collect()}
    assert got == brute(docs)


def test_repeats_are_equal_passages_with_all_occurrences(spark):
    docs = documents()
    texts = {d: (t or "").encode() for d, t in docs}
    groups = defaultdict(list)
    for r in suffix.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        groups[r.repeat].append(r)
    places, complete = defaultdict(set), set()
    for d, t in texts.items():
        for i in range(len(t) - 99):
            places[t[i : i + 100]].add((d, i))
    for rows in groups.values():
        passages = {texts[r.doc_id][r.start : r.start + r.length] for r in rows}
        assert len(passages) == 1 and len(rows) > 1 and sum(r.first for r in rows) == 1
        assert [r for r in rows if r.first] == [min(rows, key=lambda r: (r.doc_id, r.start))]
        listed = {(r.doc_id, r.start) for r in rows}
        length = rows[0].length
        passage = passages.pop()
        for i in range(length - 99):  # a window whose occurrences are all in this repeat
            if {(d, p - i) for d, p in places[passage[i : i + 100]]} == listed:
                complete.add(passage[i : i + 100])
    assert complete == {w for w, p in places.items() if len(p) > 1}


@pytest.mark.parametrize("split,hot", [(3, 0.02), (3, 0.001), (8_000, 0.001)])
def test_repeats_of_common_anchors_list_all_copies(spark, monkeypatch, split, hot):
    if hot < 0.01:
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SAMPLE", 40)
        monkeypatch.setattr(suffix, "HEAVY", 5)
    passage = text(40)
    docs = documents() + [(5000 + i, f"{text(30)} {passage} {text(30)}") for i in range(12)]
    docs += [(6000 + i, docs[-1 - i % 4][1]) for i in range(12)]
    texts = {d: (t or "").encode() for d, t in docs}
    groups, places = defaultdict(set), defaultdict(set)
    for r in suffix.repeats(spark.createDataFrame(docs, "doc_id long, text string"), split=split).collect():
        groups[r.repeat].add((r.doc_id, r.start, r.length))
    for d, t in texts.items():
        for i in range(len(t) - 99):
            places[t[i : i + 100]].add((d, i))
    complete = set()
    for rows in groups.values():
        assert len({texts[d][a : a + n] for d, a, n in rows}) == 1
        d, a, n = next(iter(rows))
        for i in range(n - 99):
            window = texts[d][a + i : a + i + 100]
            if {(x, p - i) for x, p in places[window]} == {(x, p) for x, p, _ in rows}:
                complete.add(window)
    assert len(complete) == sum(len(p) > 1 for p in places.values())


def test_edges(spark):
    schema = "doc_id long, text string"
    assert suffix.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "b" * 120), (1, "a" * 120), (None, "a" * 120), (2, None)], schema)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffix.remove_repeats(rows).collect()}
    assert got[2] == (0, b"") and got[None] == (120, b"")


def test_rows_of_one_id_are_documents_of_their_own(spark):
    same = text(60)
    rows = [(1, "b" * 120), (1, "a" * 120), (None, "a" * 120), (None, same), (2, None), (3, same), (3, same), (3, text(60)), (9, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in suffix.remove_repeats(df).collect())
    n, one = len(same.encode()), brute([(1, "a" * 120)])[1]
    whole = lambda i: (str(i), n, n)
    want = [("1", 120, 120 - one[1])] * 2 + [("2", 0, 0), whole(3), ("3", n, 0), ("3", len(rows[7][1].encode()), len(rows[7][1].encode())), ("9", n, 0), ("None", 120, 0), ("None", n, 0)]
    assert got == sorted(want)
    found = suffix.repeats(df).filter(f"length = {n}").collect()
    assert sorted(str(r.doc_id) for r in found) == ["3", "3", "9", "None"] and [r.doc_id for r in found if r.first] == [3]


def test_long_repeats_are_one(spark):
    passage, other = text(900), text(2000)
    docs = [(1, f"{text(30)} {passage} {text(30)}"), (2, f"{text(10)} {passage} {text(30)}"), (3, f"{passage} {text(40)}"), (4, other), (5, "x" + other), (6, text(200))]
    groups = defaultdict(set)
    for r in suffix.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        groups[r.repeat].add((r.doc_id, r.start, r.length))
    n = len(other.encode())
    assert {(4, 0, n), (5, 1, n)} in groups.values() and len(groups) <= 4
    (long,) = [g for g in groups.values() if {d for d, *_ in g} == {1, 2, 3}]
    texts = {d: t.encode() for d, t in docs}
    assert len({texts[d][a : a + k] for d, a, k in long}) == 1 and passage.encode() in texts[1][min(long)[1] :][: min(long)[2]]


def test_interval_tree():
    # banana: suffixes a, ana, anana, banana, na, nana
    assert sorted(suffix.prefix_intervals(np.array([0, 1, 3, 0, 0, 2]), 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]
    assert suffix.prefix_intervals(np.array([0, 5, 5]), 5) == [(5, 0, 2)] and suffix.prefix_intervals(np.zeros(0), 1) == []
