"""Repeated passages by an enhanced suffix array: a stack scan over its common-prefix intervals gives maximal repeats with all occurrences.

The array is sparse and distributed. In each window of `length` bytes the k-byte string with the
least hash is an anchor, so two equal passages of at least `length` bytes share an anchor at the
same place; only suffixes at anchors that occur twice are sorted, by Spark, by (anchor, bytes to the
right). Rows of equal surroundings are one row from then on. For each anchor the stack scan over the
longest common prefixes finds the intervals of rows that agree to the right; in each interval a second
scan over the bytes to the left finds the groups that agree that far and differ before and after it.

Anchors whose group would not fit in one task are exchanged for longer anchors in a few steps, the
last of which are the whole windows; those need no sorting, only a minimum for each key. Bytes that are not compared one by one
(equal surroundings, whole windows) are compared by two independent 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, partitions, written
from .words import mixed, plain_texts, ranges, slices

#: Bytes of the shortest passage that counts.
LENGTH = 100
#: Bytes of an anchor, level by level; the last level's anchors are whole windows.
ANCHORS = (20, 80, 100)
#: Anchors with more different surroundings than this go to the next level.
SPLIT = 8_000
#: Documents that a hash of the id draws to find anchors in more than HOT of all documents. This decides only how rows are dealt.
SAMPLE, HOT = 4000, 0.005
#: Tasks over which such an anchor's rows are dealt; a longer anchor's rows are dealt HEAVY or so to a task.
SALTS, HEAVY = 64, 40_000
#: Heavy longer anchors are broadcast up to this number of 16 bytes each, and joined beyond it.
BROADCAST_ANCHORS = 1_000_000
#: Rows that one scan holds at once, besides a group.
CHUNK = 8_000
#: Bytes of text at once in a task, or one longer text: about twenty numbers for each byte are held.
SLICE = 1 << 18

_rng = np.random.default_rng(3)
_SYMBOLS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
#: The digests' own numbers for each byte.
_SYMBOLS = _SYMBOLS, _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {}


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, SLICE)
        step = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
        _powers[which] = step(_BASES[which]), step(pow(_BASES[which], -1, 1 << 64))
    return _powers[which]


class Bytes:
    """The texts of a batch, one after the other, with two independent hashes of any part in constant time."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        texts = plain_texts(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = (offsets - offsets[0])[:-1], (offsets - offsets[0])[1:]
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
        powers, inverse = _power_tables(len(self.data) + 1, which)
        if which not in self.sums:
            self.sums[which] = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_SYMBOLS[which][self.data] * powers[: len(self.data)], out=self.sums[which][1:])
        sums = self.sums[which]
        return mixed((sums[hi] - sums[lo]) * inverse[lo])

    def anchors(self, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(document number, position in the batch) of the anchors of all windows, in order."""
        n, w = len(self.data), length - k + 1
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        at = np.arange(n - k + 1)
        h[at] = self.hashes(at, at + k) | np.uint64(1)
        least = _slide(h, w, np.minimum)
        # windows that cross the end of a text don't count
        valid = np.zeros(n + 1, np.int32)
        long = self.ends - self.starts >= length
        np.add.at(valid, self.starts[long], 1)
        np.add.at(valid, self.ends[long] - length + 1, -1)
        least[np.cumsum(valid[:-1]) <= 0] = 0
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least])
        position = np.flatnonzero(_slide(padded, w, np.maximum)[:n] == h)
        position = position[h[position] > 0]
        return np.searchsorted(self.ends, position, "right"), position


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over the w entries from each place on; the last w - 1 places are of fewer entries."""
    out, done, part, size = None, 0, x, 1
    while True:
        if w & 1:
            if out is None:
                out, done = part.copy(), size
            else:
                f(out[: len(x) - done], part[done:], out=out[: len(x) - done])
                done += size
        w >>= 1
        if not w:
            return out
        longer = part.copy()
        f(part[: len(x) - size], part[size:], out=longer[: len(x) - size])
        part, size = longer, 2 * size


ROWS = "h bigint, c bigint, d bigint, doc_id bigint, pos bigint, reach int, salt int, hot boolean"


def _rows(b: Bytes, ids: np.ndarray, doc: np.ndarray, position: np.ndarray, k: int, length: int, hot: dict | None = None) -> pa.RecordBatch:
    """Anchor, two digests of its surroundings, place; reach holds the bytes to the left and to the right that belong to them."""
    start, end = b.starts[doc], b.ends[doc]
    left, right = np.minimum(position - start, length - k), np.minimum(end - position, length)
    h = b.hashes(position, position + k)
    c, d = (mixed(b.hashes(position - left, position + right, i) + (left * 4096 + right).astype(np.uint64)) for i in (0, 1))
    salt, same = np.zeros(len(h), np.int32), np.zeros(len(h), bool)
    if hot and len(hot["anchors"]):
        inside = hot["anchors"][np.minimum(np.searchsorted(hot["anchors"], h), len(hot["anchors"]) - 1)] == h
        salt[inside] = 1 + (c[inside] % np.uint64(SALTS)).astype(np.int32)
        if len(hot["contexts"]):
            both = mixed(h) + c
            same = hot["contexts"][np.minimum(np.searchsorted(hot["contexts"], both), len(hot["contexts"]) - 1)] == both
    columns = [h.view(np.int64), c.view(np.int64), d.view(np.int64), ids[doc], position - start, (left * 4096 + right).astype(np.int32), salt, same]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in ROWS.split(", ")])


def _anchor_rows(docs: DataFrame, length: int, hot: dict | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            b = Bytes(batch.column(1))
            yield _rows(b, np.asarray(batch.column(0)), *b.anchors(ANCHORS[0], length), ANCHORS[0], length, hot)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def _hot(docs: DataFrame, length: int) -> dict:
    """Anchors, and anchors with equal surroundings, that occur in a share of HOT of a sample of the documents.

    At most 1 / HOT times the anchors of a document: the sample is bounded, and so is what comes to the driver.
    """
    n = docs.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = _anchor_rows(docs.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1), length, None)
    least = max(20, int(min(n, SAMPLE) * HOT))
    counts = drawn.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("h").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") >= least, F.col("c"))).alias("c")).filter(F.col("n") >= least).select("h", "c").collect()
    anchors = np.sort(np.array([r.h for r in common], np.int64).view(np.uint64))
    contexts = [(r.h, c) for r in common for c in r.c]
    h, c = np.array(contexts, np.int64).reshape(-1, 2).T.copy().view(np.uint64)
    return {"anchors": anchors, "contexts": np.sort(mixed(h) + c)}


SCANNED = "h c d doc_id pos reach first repeated spread common".split()


def _scanned(rows: DataFrame, split: int) -> DataFrame:
    """The rows that matter, with: first (of its surroundings), repeated (they occur more than once), spread (the anchor has several surroundings), common (too many for one task).

    Rows of hot surroundings are known beforehand: `hot` is set on all, `again` on all but the first.
    """
    order = Window.partitionBy("h", "salt").orderBy("c", "d", "doc_id", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = F.struct("c", "d")
    rows = rows.withColumn("_before", F.lag(both).over(order)).withColumn("_after", F.lead(both).over(order))
    rows = rows.withColumn("first", ~F.col("again") & (F.col("_before").isNull() | (F.col("_before") != both)))
    rows = rows.withColumn("_n", F.sum(F.col("first").cast("int")).over(whole))
    rows = rows.withColumn("repeated", F.col("hot") | ~F.col("first") | F.coalesce(F.col("_after") == both, F.lit(False))).withColumn("common", (F.col("salt") > 0) | (F.col("_n") > split))
    rows = rows.withColumn("spread", F.col("first") & ((F.col("_n") > 1) | F.col("common")))
    return rows.filter("repeated or spread").select(*SCANNED)


def _windows(rows: DataFrame) -> DataFrame:
    """_scanned() of the last level: a minimum for each whole window, combined before the shuffle, and a join that Spark can split."""
    firsts = rows.groupBy("h", "d").agg(F.min(F.struct("doc_id", "pos")).alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    found = rows.join(firsts, ["h", "d"]).withColumns({"first": F.struct("doc_id", "pos") == F.col("_f"), "repeated": F.lit(True), "spread": F.lit(False), "common": F.lit(False)})
    return found.select(*SCANNED)


def _salted(rows: DataFrame) -> DataFrame:
    """Rows of a longer anchor that is still very common are dealt by their surroundings, about HEAVY to a task."""
    rows = written(rows)
    heavy = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HEAVY))
    n = heavy.count()
    if not n:
        return rows
    found = rows.join(F.broadcast(heavy) if n <= BROADCAST_ANCHORS else heavy, "h", "left")
    return found.withColumn("salt", F.when(F.col("_n").isNull(), F.col("salt")).otherwise(1 + F.pmod("c", F.ceil(F.col("_n") / HEAVY))).cast("int")).drop("_n")


def _marked(rows: DataFrame) -> DataFrame:
    """Adds `again` to rows of hot surroundings that are not their first, and deals those out evenly: they need no comparison.

    The first ones are a minimum combined before the shuffle; up to BROADCAST_ANCHORS of them are broadcast.
    """
    firsts = rows.filter("hot").groupBy("h", "c", "d").agg(F.min(F.struct("doc_id", "pos")).alias("_f"))
    firsts = written(firsts).withColumnsRenamed({"h": "_h", "c": "_c", "d": "_d"})
    found = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ANCHORS else firsts, F.col("hot") & (rows.h == firsts._h) & (rows.c == firsts._c) & (rows.d == firsts._d), "left").withColumn("again", F.coalesce(F.struct("doc_id", "pos") != F.col("_f"), F.lit(False)))
    dealt = F.when(F.col("again"), SALTS + 1 + F.pmod(F.xxhash64("doc_id", "pos"), F.lit(1 << 20))).otherwise(F.col("salt")).cast("int")
    return found.withColumn("salt", dealt).drop("_h", "_c", "_d", "_f")


CONTEXTS = "h bigint, doc_id bigint, pos bigint, right binary, left binary, around bigint"


def _with_texts(spots: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text, at): the places of each document, beside its text."""
    at = spots.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "h", "around")).alias("at"))
    return docs.select("doc_id", "text").join(at, "doc_id").select("doc_id", "text", F.col("at.pos").alias("pos"), F.col("at.h").alias("h"), F.col("at.around").alias("around"))


def _places(batch: pa.RecordBatch) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts, text number, position in the batch, anchor, surroundings) of the rows of _with_texts()."""
    b = Bytes(batch.column(1))
    n = np.diff(np.asarray(batch.column(2).offsets))
    doc = np.repeat(np.arange(len(n)), n)
    return b, doc, b.starts[doc] + np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten()), np.asarray(batch.column(4).flatten())


def _cut(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, back: bool = False) -> pa.Array:
    """The parts [lo, hi) of data, or the same read backwards."""
    n = hi - lo
    step = ranges(n)
    at = np.repeat(hi - 1, n) - step if back else np.repeat(lo, n) + step
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


def _contexts(spots: DataFrame, docs: DataFrame, k: int, length: int) -> DataFrame:
    """The bytes around each place: to the right from the anchor's start, to the left backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            b, doc, position, h, around = _places(batch)
            for a in range(0, len(doc), CHUNK):
                d, p = doc[a : a + CHUNK], position[a : a + CHUNK]
                right = _cut(b.data, p, np.minimum(p + length, b.ends[d]))
                left = _cut(b.data, np.maximum(p - (length - k), b.starts[d]), p, back=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + CHUNK]), batch.column(0).take(pa.array(d)), pa.array(p - b.starts[d]), right, left, pa.array(around[a : a + CHUNK])], ["h", "doc_id", "pos", "right", "left", "around"])

    return _with_texts(spots, docs).mapInArrow(run, CONTEXTS)


def _longer(spots: DataFrame, docs: DataFrame, k: int, longer: int, length: int) -> DataFrame:
    """The windows around each anchor, dealt to longer anchors: windows that start at up to length - longer bytes before one."""
    step = length - longer + 1
    shifts = np.arange(0, length - k + 1, step) - (length - k) + step - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            b, doc, position, *_ = _places(batch)
            d = np.repeat(doc, len(shifts))
            p = (position[:, None] + shifts).ravel()
            inside = (p >= b.starts[d]) & (p + longer <= b.ends[d])
            d, p = d[inside], p[inside]
            p, unique = np.unique(p, return_index=True)
            for a in range(0, len(p), CHUNK):
                yield _rows(b, np.asarray(batch.column(0)), d[unique[a : a + CHUNK]], p[a : a + CHUNK], longer, length)

    return _with_texts(spots, docs).mapInArrow(run, ROWS)


def common_prefix(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Bytes that each row of a and b (padded to one width) have in common at their start."""
    same = a == b
    n = np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))
    return np.minimum(n, np.minimum(na, nb))


def prefix_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(value, first, last) of the maximal ranges of rows whose neighbours share `value` >= least bytes and not more throughout: the nodes of the
    common-prefix interval tree, children first. lcp[i] belongs to rows i - 1 and i."""
    out, stack = [], []
    for i, value in enumerate([*lcp[1:].tolist(), 0], 1):
        value = value if value >= least else 0
        first = i - 1
        while stack and stack[-1][0] > value:
            v, first = stack.pop()
            out.append((v, first, i - 1))
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    n = np.diff(offsets)
    out = np.zeros((len(column), max(width, 1)), np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    full = (n == width) & (n > 0)
    if full.any():
        out[full] = np.lib.stride_tricks.sliding_window_view(data, width)[offsets[:-1][full]]
    short = np.flatnonzero(~full)
    out[np.repeat(short, n[short]), ranges(n[short])] = data[np.repeat(offsets[:-1][short], n[short]) + ranges(n[short])]
    return out, n


def maximal_repeats(h: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, k: int, length: int, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, row, bytes to the left, bytes to the right) of the repeats of at least `length` bytes, each with all its rows; some groups at a time.

    Rows are sorted by (h, right). A group's rows agree in its bytes, follow differently (they come from different children of
    an interval) and are preceded differently (they are an interval of the rows sorted by what stands before them).

    With the rows' places in `order`, only what removal needs: rows that are not the first of their group, unless the bytes
    lie inside those of an earlier group of the same row. Children come before their parents, so that reach to the right only falls.
    """
    n = len(h)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(h[1:] == h[:-1], common_prefix(right[1:], right[:-1], n_right[1:], n_right[:-1]), 0)
    nodes = np.array(prefix_intervals(lcp, k), np.int64).reshape(-1, 3)
    two = nodes[nodes[:, 2] - nodes[:, 1] == 1]
    before = common_prefix(left[two[:, 1]], left[two[:, 2]], n_left[two[:, 1]], n_left[two[:, 2]])
    two, before = two[before + two[:, 0] >= length], before[before + two[:, 0] >= length]
    covered = np.full(n, -1)
    if order is None:
        yield np.repeat(np.arange(len(two)), 2), two[:, 1:].ravel(), np.repeat(before, 2), np.repeat(two[:, 0], 2)
    else:
        later = np.where(order[two[:, 1]] < order[two[:, 2]], two[:, 2], two[:, 1])
        covered[later] = before
        yield np.arange(len(two)), later, before, two[:, 0]
    by_left = np.lexsort((n_left, left.view(f"S{left.shape[1]}").ravel()))
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    held: list[tuple[np.ndarray, ...]] = []
    size, g = 0, len(two)
    for value, first, last in nodes[nodes[:, 2] - nodes[:, 1] > 1]:
        rows = np.arange(first, last + 1)
        child = np.concatenate([[0], np.cumsum(lcp[first + 1 : last + 1] == value)])
        sort = np.argsort(rank[first : last + 1])
        rows, child = rows[sort], child[sort]
        shared = np.zeros(len(rows), np.int64)
        shared[1:] = common_prefix(left[rows[1:]], left[rows[:-1]], n_left[rows[1:]], n_left[rows[:-1]])
        # values are one too high from here on, so that 0 shared bytes make an interval where the right side alone is long enough
        for v, a, b in prefix_intervals(shared + 1, max(length - value, 0) + 1):
            members = rows[a : b + 1]
            if (child[a : b + 1] == child[a]).all():
                continue
            if order is not None:
                members = members[(order[members] != order[members].min()) & (covered[members] < v - 1)]
                covered[members] = v - 1
            held.append((np.full(len(members), g), members, np.full(len(members), v - 1), np.full(len(members), value)))
            size, g = size + len(members), g + 1
            if size >= 4 * CHUNK:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


REPEATS = "repeat bigint, doc_id bigint, start bigint, length int, first boolean, around bigint, shift int"


def _trees(contexts: DataFrame, k: int, length: int, n_parts: int, pruned: bool) -> DataFrame:
    names = [x.split()[0] for x in REPEATS.split(", ")]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, doc, pos, around = (np.asarray(table.column(i)) for i in (0, 1, 2, 5))
        right, n_right = _padded(table.column(3).combine_chunks(), length)
        left, n_left = _padded(table.column(4).combine_chunks(), length - k)
        order = np.empty(len(h), np.int64)
        order[np.lexsort((pos, doc))] = np.arange(len(h))
        for group, row, before, after in maximal_repeats(h, right, n_right, left, n_left, k, length, order if pruned else None):
            start, size = pos[row] - before, before + after
            if pruned:
                columns = [group, doc[row], start, size.astype(np.int32), np.zeros(len(row), bool), around[row], np.zeros(len(row), np.int32)]
            else:
                by = np.lexsort((order[row], group))
                first = np.ones(len(by), bool)
                first[1:] = group[by][1:] != group[by][:-1]
                head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))] if len(by) else by
                name = mixed(mixed(doc[row][head].astype(np.uint64)) + (start[head] * 65536 + size[head]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                columns = [name.view(np.int64), doc[row][by], start[by], size[by].astype(np.int32), first, around[row][by], (n_left[row] - before)[by].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:  # all anchors but the last are complete
                table = pa.Table.from_batches(held).combine_chunks()
                h = np.asarray(table.column(0))
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if cut:
                    yield from found(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return contexts.repartition(n_parts, "h").sortWithinPartitions("h", "right").mapInArrow(run, REPEATS)


LAST = (1 << 63) - 1


def _documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """((doc_id, id, text), whether doc_id is the id): each row is a document; where ids repeat, doc_id is a number in the order of id and text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = F.coalesce("id", F.lit(LAST)).alias("doc_id")
    if rows.groupBy(own).count().filter("count > 1").isEmpty():
        return rows.select(own, "id", "text"), True
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.sha2("text", 256)]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(rows.select(F.monotonically_increasing_id().alias("doc_id"), "id", "text")), False


def _compact(docs: DataFrame, length: int, split: int, pruned: bool = False) -> DataFrame:
    """The repeats of _documents(), rows of equal surroundings as one: REPEATS.

    A repeat of equal surroundings (around is null) lists all of them; another repeat lists the first row of each
    of its surroundings `around`, shift bytes after their start. pruned: only occurrences that removal needs, without names.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    hot = _hot(docs, length)
    rows = _anchor_rows(docs, length, hot)
    rows = _marked(rows) if len(hot["contexts"]) else rows.withColumn("again", F.lit(False))
    out = []
    around = F.xxhash64("h", "c", "d")
    left, right = F.floor(F.col("reach") / 4096), F.col("reach") % 4096
    for level, k in enumerate(ANCHORS):
        scanned = written(_windows(rows) if k == length else _scanned(rows, split))
        # surroundings are shorter than a window only at the ends of a text, where no window has this anchor
        same = scanned.filter("repeated").filter(left + right >= length)
        out.append(same.select(around.alias("repeat"), "doc_id", (F.col("pos") - left).cast("bigint").alias("start"), (left + right).cast("int").alias("length"), "first", F.lit(None).cast("bigint").alias("around"), F.lit(0).alias("shift")))
        if k == length:
            break
        spots = scanned.filter("spread and not common").select("doc_id", "pos", "h", around.alias("around"))
        out.append(_trees(_contexts(spots, docs, k, length), k, length, n_parts, pruned))
        # removal needs no copies, which are known already; repeats need them in the groups of the longer anchors, too
        spots = scanned.filter("spread and common" if pruned else "common").select("doc_id", "pos", "h", around.alias("around"))
        if spots.isEmpty():
            break
        longer = ANCHORS[level + 1]
        rows = _longer(spots, docs, k, longer, length)
        rows = (rows if longer == length else _salted(rows)).withColumn("again", F.lit(False))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _joined(found: DataFrame) -> DataFrame:
    """Repeats whose occurrences are the same places a few bytes on, and that overlap or touch, as one repeat."""
    heads = found.groupBy("repeat").agg(F.min(F.struct("doc_id", "start")).alias("_h"), F.count(F.lit(1)).alias("_n"), F.max("length").alias("_length"))
    places = F.sum(F.xxhash64("doc_id", F.col("start") - F.col("_h.start")).cast("decimal(38,0)")).alias("_places")
    shapes = found.join(heads, "repeat").groupBy("repeat", "_h", "_n", "_length").agg(places)
    same = Window.partitionBy("_h.doc_id", "_n", "_places").orderBy("_h.start", F.desc("_length"), "repeat")
    end = F.col("_h.start") + F.col("_length")
    before = F.max(end).over(same.rowsBetween(Window.unboundedPreceding, -1))
    chained = shapes.withColumn("_opens", F.coalesce(F.col("_h.start") > before, F.lit(True)).cast("int")).withColumn("_chain", F.sum("_opens").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    of_chain = chained.groupBy(F.col("_h.doc_id").alias("_doc"), "_n", "_places", "_chain").agg(F.min_by("repeat", F.struct(F.col("_h.start"), -F.col("_length"), "repeat")).alias("repeat"), (F.max(end) - F.min("_h.start")).cast("int").alias("length"))
    return found.drop("length").join(of_chain.select("repeat", "length"), "repeat").select("repeat", "doc_id", "start", "length", "first")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """(repeat, doc_id, start, length, first): the repeated passages of at least `length` bytes with their occurrences, start in bytes of UTF-8.

    Each repeat is a group of equal passages; `first` marks the earliest by (doc_id, start). For each string of `length` bytes that occurs twice there is
    a repeat with all of its occurrences. A passage of any length is one repeat if all of it occurs at the same places; where an inner part of
    over `length` bytes occurs elsewhere, too, that part is a repeat of its own and the passage around it comes in parts.

    * Passages never cross documents and may overlap within one. Null text is the empty text.
    * Each row is a document. Rows with one id count in the order of their texts' hashes, equal texts in any order; null ids come last.
    * Other columns are ignored. An empty table gives an empty result.
    """
    with Scope() as scope:
        docs, unique = _documents(docs, id_col, text_col)
        found = written(_compact(docs, length, split))
        same, trees = found.filter("around is null"), found.filter("around is not null")
        copies = same.filter("not first").select(F.col("repeat").alias("around"), F.col("doc_id").alias("_doc"), F.col("start").alias("_start"))
        more = trees.join(copies, "around").select("repeat", F.col("_doc").alias("doc_id"), (F.col("_start") + F.col("shift")).alias("start"), "length", F.lit(False).alias("first"))
        columns = ["repeat", "doc_id", "start", "length", "first"]
        # a passage found at two of its anchors has one name, and its rows meet
        out = _joined(written(same.select(columns).unionByName(trees.select(columns)).unionByName(more).distinct()))
        if unique:
            out = out.withColumn("doc_id", F.when(F.col("doc_id") < F.lit(LAST), F.col("doc_id")))
        else:
            out = out.join(docs.select("doc_id", "id"), "doc_id").select("repeat", F.col("id").alias("doc_id"), "start", "length", "first")
        return scope.keep(out)


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split: int = SPLIT, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document without the bytes of repeats that are not their first occurrence.

    kept is the remaining bytes (a cut may fall inside a character), or with keep_text = False their SHA-256 in lowercase hex. The first
    occurrence of every passage stays. Edge cases as in repeats(); every input row has a row, also empty ones.
    """
    with Scope() as scope:
        rows, unique = _documents(docs, id_col, text_col)
        again = _compact(rows, length, split, pruned=True).filter("not first")
        # a row holds the spans of one document: no more than its length allows
        spans = scope.keep(again.groupBy("doc_id").agg(F.collect_list(F.struct("start", F.col("start") + F.col("length"))).alias("at")))
        rows = rows if unique else scope.keep(rows)
    joined = rows.join(spans, "doc_id", "left").select("id", "text", F.col("at.start").alias("lo"), F.col("at.col2").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * SLICE):
            texts = plain_texts(batch.column(1))
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
            start, end = (offsets - offsets[0])[:-1], (offsets - offsets[0])[1:]
            n = np.asarray(pc.fill_null(pc.list_value_length(batch.column(2)), 0))
            base = np.repeat(start, n)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, base + np.asarray(batch.column(2).flatten()), 1)
            np.add.at(edge, base + np.asarray(batch.column(3).flatten()), -1)
            gone = np.cumsum(edge[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[start[start < len(data)]] |= gone[start[start < len(data)]]  # a run ends with its document
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets - offsets[0]])
            parts = [data[s:e][~gone[s:e]].tobytes() for s, e in zip(start, end)]
            kept = parts if keep_text else [hashlib.sha256(p).hexdigest().encode() for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(end - start), pa.array(total(gone)), pa.array(total(opens)), pa.array(kept, pa.binary())], [x.split()[0] for x in REMOVED.split(", ")])

    return joined.mapInArrow(run, REMOVED)
