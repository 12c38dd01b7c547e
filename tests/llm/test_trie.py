"""The conversation trie against plain Python and SQL."""

import hashlib
import random
import zlib

import pytest

from hostlens.llm import trie
from hostlens.llm.queries import ORACLES, op13_trie

from oracle import check, connect


def trunc_mod(a, b):
    return a - int(a / b) * b


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = (convs.get(c - trunc_mod(c, 100), [])[:h] + own[h:])
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[b] for b in below) or 1
        saved[n] = sum(saved[b] for b in below) + (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), len(children.get(n, [])), leaves[n], saved[n], sha([c for c in m if len(convs[c]) == len(n)])) for n, m in nodes.items()
    )


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations():
    """A hot first turn with branches at several depths, one long shared beginning, copies, prefixes of others, and odd rows."""
    rng = random.Random(8)
    rows = []
    for c in range(0, 900):
        n = rng.choice([1, 2, 3, 6, 9])
        turns = [("user" if i % 2 == 0 else "assistant", rng.choice(["hi", "é\U0001f600", "yes " * 5])) for i in range(n)]
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", rng.choice("ab"))] + turns
        if c % 7 == 0:
            turns = [("user", f"line {i}") for i in range(14)] + turns[:1]
        if c % 11 == 0:
            turns = [("user", "same"), ("assistant", "copy")] * 4
        if c % 100 or c % 300 == 0:  # some families have no head
            rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(907, None, "user", None), (907, None, None, "x"), (907, 1, "", ""), (907, 1, "", ""), (-205, 0, "user", "below"), (-205, 1, "user", "zero"), (-205, 2, "user", "z"), (-200, 0, "a", "b")]
    rows += [(10**15 + 3, i, "user", f"t{i}") for i in range(3)] + [(5003, i, "user", "t" * i) for i in range(400)]
    return rows + [(None, 0, "user", "nobody")]


@pytest.mark.parametrize("subtrie,task", [(trie.SUBTRIE, trie.TASK), (60, 40), (3, 5)])
def test_against_plain_python(spark, subtrie, task, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "conv_id long, turn long, role string, text string, depth string, `a.b` string").repartition(3)
    monkeypatch.setattr(trie.prefix_trie, "__defaults__", (subtrie, task))
    want = brute(rebuilt(rows))
    assert rows_of(trie.conversation_trie(df)) == want
    assert min(x[0] for x in want if x[1] == 0) == -205 and any(x[1] == 0 and x[7] != trie.EMPTY_SHA for x in want)  # turnless ones end at the root


def test_a_very_long_conversation_and_text(spark):
    rows = [(c, i, "user", "q" if i else "text " * 200_000) for c in (5001, 5002) for i in range(3000 + c % 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(trie.conversation_trie(df)) == brute(rebuilt(rows))


def test_empty_table_and_only_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    # of a single turn nothing is left
    assert zlib.crc32(b"1") % 6 >= 1
    got = rows_of(trie.conversation_trie(spark.createDataFrame([(1, 0, "user", "x")], schema)))
    assert got == [(1, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    check(spark, connect(f"/root/testdata/{sf}"), op13_trie, ORACLES["op13_trie"], f"/root/testdata/{sf}")
