"""Prefix trie of conversations: which beginnings are shared, by how many, and how much text a shared prefix would save.

A turn becomes a digest and a length before anything is exchanged; the digest of a prefix chains those of its turns. Conversations
that are alike in full are one sequence with a weight. Sequences are dealt by a hash of their first turn, and each task builds
tries of nodes with a dictionary of children and sums them up from the leaves, without recursion. A first turn with too many turns
behind it is no task's work: its node is summed up by Spark and its sequences are dealt again by their next turn, and so on. Turns that all of them
share are one step of this. Totals then go up from subtries to those upper nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Turns of one subtrie at most, and of a task's subtries together, on average. A subtrie of more turns is dealt again by the next turn; a single sequence isn't.
SUBTRIE, TASK = 4_000, 50_000
#: Conversations whose ids are close (by this many low bits) are joined to one text before a node's ids are digested: at most 2^13 ids.
NEAR_BITS = 13
ROOT = b"\0" * 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: A rebuilt conversation starts with up to SHARED - 1 turns of the one whose id is the next lower multiple of FAMILY.
FAMILY, SHARED = 100, 6

NODE = "prefix binary, up binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): turns in order, from 1; null turns first, ties by role, then by the digest of role and text. Rows of null conv_id are in no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("bigint").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.filter("conv_id is not null").select("conv_id", F.row_number().over(order).cast("bigint").alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, chars) of the rebuilt conversations: the first h turns of conversation c - c % 100, then c's own turns after its first h, h being crc32(c) % 6.

    turns: as numbered() gives them. A conversation of which nothing is left has no row.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv_id", "base")
    ids = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    first = heads.join(ids, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    known = heads.groupBy("base").agg(F.count(F.lit(1)).alias("known"))
    own = turns.select("*", base.alias("base"), h.alias("h")).filter("pos > h").join(known, "base", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("known", F.lit(0)))).alias("depth"), "digest", "chars")
    return first.unionByName(own)


def _chained(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, prefix, first, chars): the digest of the turns up to here, and that of the first turn alone; a stream over each conversation's sorted turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, prefix, first = None, ROOT, ROOT
        for batch in batches:
            prefixes, firsts = [], []
            for c, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                new = c != conv
                conv, prefix = c, hashlib.blake2b((ROOT if new else prefix) + digest, digest_size=16).digest()
                first = prefix if new else first
                prefixes.append(prefix)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefixes, pa.binary()), pa.array(firsts, pa.binary()), batch.column(3)], ["conv_id", "depth", "prefix", "first", "chars"])

    rows = rows.select("conv_id", "depth", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.mapInArrow(run, "conv_id bigint, depth bigint, prefix binary, first binary, chars bigint")


def _ends(whole: DataFrame) -> DataFrame:
    """(whole, ends_sha256): the digest of the ids of the conversations of each sequence, in order. Ids are joined piece by piece, and the pieces of a sequence are a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, nodes, digests = None, None, [], []
        for batch in batches:
            for whole, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if whole == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = whole, hashlib.sha256(ids.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["whole", "ends_sha256"])
                nodes, digests = [], []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["whole", "ends_sha256"])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = whole.groupBy("whole", F.shiftright("conv_id", NEAR_BITS).alias("near")).agg(ids.alias("ids"))
    return pieces.repartition("whole").sortWithinPartitions("whole", "near").mapInArrow(run, "whole binary, ends_sha256 string")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries of one task."""
    rows = rows.sort_values(["seq", "depth"], kind="stable")
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    parent, first, count, depth, chars, prefix, up, above = [], [], [], [], [], [], [], []
    node = seq = None
    columns = (rows[c].tolist() for c in ("seq", "depth", "prefix", "chars", "weight", "key", "up", "top_id"))
    for s, d, p, n_chars, weight, key, over, top_id in zip(*columns):
        fresh = s != seq
        mine = tops if fresh else children[node]
        at = mine.get(p)
        if at is None:  # sequences come in the order of their ids: the first one here is the least
            at = mine[p] = len(children)
            children.append({})
            for column, x in zip((parent, first, count, depth, chars, prefix, up, above), (-1 if fresh else node, s, 0, d, n_chars, p, over if fresh else None, top_id if fresh else first[node])):
                column.append(x)
        count[at] += weight
        node, seq = at, s
    leaves, saved = [0 if c else 1 for c in children], [(n - 1) * c for n, c in zip(count, chars)]
    for at in range(len(children) - 1, -1, -1):  # a node comes after its parent: children are summed up before it
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    return pd.DataFrame({"prefix": prefix, "up": up, "conv_id": first, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved})


def prefix_trie(turns: DataFrame, subtrie: int = SUBTRIE, task: int = TASK) -> DataFrame:
    """One row for each node: conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, depth, digest, chars) with depths 1, 2, ... in each conversation, or depth 0 alone for one without turns (its other columns don't count).
    Conversations are told apart by 256-bit digests of turns and chained 128-bit digests of prefixes; texts are not exchanged.

    * An empty table has no nodes. Conversations without turns end at the root. An id's digits are digested as they are, negative ones too.
    * A sequence is held by one task in full: some 200 bytes a turn. No other group is: what more than `subtrie` turns share is split.
    """
    spark = turns.sparkSession
    whole_of = lambda rows: rows.groupBy("conv_id").agg(F.max_by("prefix", "depth").alias("whole"))
    chained = written(_chained(turns.filter("depth > 0")))
    none = turns.filter("depth = 0").select("conv_id", F.lit(ROOT).alias("whole"))
    whole = written(whole_of(chained).unionByName(none))
    sequences = written(whole.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")))
    root_id = sequences.agg(F.min("conv_id")).first()[0]

    rows = chained.join(sequences.select("conv_id", "weight"), "conv_id").select(F.col("conv_id").alias("seq"), "depth", "prefix", "chars", "weight", F.col("first").alias("key"), F.lit(ROOT).alias("up"), F.lit(root_id).cast("bigint").alias("top_id"), F.lit(1).cast("bigint").alias("head"))
    rows = written(rows)
    forests, chains = [], []
    while True:
        sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("depth") == F.col("head")).alias("n_seqs"), F.min("seq").alias("first_id")))
        total = sizes.agg(F.sum("n_rows")).first()[0] or 0
        big = sizes.filter((F.col("n_rows") > subtrie) & (F.col("n_seqs") > 1)).select("key", "n_seqs", "first_id")
        more = not big.isEmpty()
        small = rows.join(big, "key", "left_anti") if more else rows
        bucket = F.pmod(F.xxhash64("key"), F.lit(max(partitions(spark), total // task + 1)))
        forests.append(written(small.drop("head").groupBy(bucket.alias("_bucket")).applyInPandas(_tries, NODE)))
        if not more:
            break
        # turns that all sequences of a key share, from its head on: one chain of nodes
        rows = rows.join(big, "key")
        at = rows.groupBy("key", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("prefix").alias("lo"), F.max("prefix").alias("hi"), F.max("n_seqs").alias("n_seqs"))
        last = at.filter("lo <> hi or n < n_seqs").groupBy("key").agg((F.min("depth") - 1).alias("last"))
        rows = written(rows.join(last, "key"))
        chains.append(written(rows.filter("depth <= last").groupBy("key", "up", "top_id", "head", "last", "depth", "prefix").agg(F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.max("chars").alias("chars"))))
        after = rows.filter("depth = last + 1").select("seq", F.col("prefix").alias("_next"))
        rows = written(rows.filter("depth > last").join(after, "seq").select("seq", "depth", "prefix", "chars", "weight", F.col("_next").alias("key"), F.col("key").alias("up"), F.col("first_id").alias("top_id"), (F.col("last") + 1).alias("head")))

    # totals go up, chain by chain
    tops = lambda nodes: nodes.filter("up is not null").select("up", "n_leaves", "saved_tokens")
    summed = (F.count(F.lit(1)).alias("_n"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_saved"))
    nodes, below = forests[-1], tops(forests[-1])
    for chain, forest in zip(reversed(chains), reversed(forests[:-1])):
        kids = below.groupBy(F.col("up").alias("key")).agg(*summed)
        from_end = Window.partitionBy("key").orderBy(F.desc("depth"))
        is_head = F.col("depth") == F.col("head")
        upper = written(chain.join(kids, "key").select(
            "prefix", F.when(is_head, F.col("up")).alias("up"), "conv_id", "depth", F.when(is_head, F.col("top_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(F.col("depth") == F.col("last"), F.col("_n")).otherwise(1).cast("bigint").alias("n_children"), "n_leaves", (F.col("_saved") + F.sum((F.col("n_convs") - 1) * F.col("chars")).over(from_end)).alias("saved_tokens"),
        ))
        nodes, below = nodes.unionByName(upper).unionByName(forest), tops(upper).unionByName(tops(forest))
    root = sequences.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")).filter("conv_id is not null").crossJoin(below.agg(*summed))  # two single rows
    root = root.select(
        F.lit(ROOT).alias("prefix"), F.lit(None).cast("binary").alias("up"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
        F.col("_n").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce("_saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
    )
    out = nodes.unionByName(root).join(_ends(whole), F.col("prefix") == F.col("whole"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of the rebuilt conversations of (conv_id, turn, role, text). Null role or text is empty; rows of null conv_id are left out; other columns are ignored."""
    turns = written(numbered(conversations))
    out = written(rebuilt(turns))
    left = turns.select("conv_id").distinct().join(out.select("conv_id").distinct(), "conv_id", "left_anti")
    return prefix_trie(out.unionByName(left.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("chars"))))
