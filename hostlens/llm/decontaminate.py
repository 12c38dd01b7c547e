"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

The CGK embedding walks over a string, writes the current symbol at each step and moves on by a random bit
that depends on step and symbol; strings at a small edit distance stay, or fall back, in step, so their
outputs are at a small Hamming distance. Here the symbols are words. A walk starts at each word of
each document, and each hash table samples a few of its steps; so do the walks of the items, from
starts spread over the whole item. Runs of words complete them: of an item's m disjoint runs e edits leave at least m - e as they
are, so that any e + 1 of the runs find every match; the rarest e + 1 have an entry. What many items share, such as the head of a
prompt, is no entry then: neither as a run nor as a walk. Windows that meet an item in a table are verified by their exact
word edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, renamed
from .words import plain_texts, ranges, slices, split_words

#: An item is found where at most this share of its words is edited.
EDITS = 0.2
#: Independent walks; tables of each walk, by the number of first steps that they sample from; samples a table. Walks that fit no
#: longer table use the shortest ones. An item's walks start at every STRIDE-th of its words, in items of under
#: 2 x SHORT_ITEM words at every NEAR_STRIDE-th, under SHORT_ITEM at each; only items of under SHORTEST_ITEM words are in tables of under SHORT steps. Chosen so that the walks alone find 0.95 of the items at the limit (a test measures it); the runs find the rest.
WALKS, REACHES, SAMPLES = 3, (5, 5, 10, 10, 20, 20, 20, 40, 40, 40), 4
SHORT, FEW_SAMPLES = 10, 3
STRIDE, NEAR_STRIDE, SHORT_ITEM, SHORTEST_ITEM = 10, 3, 16, 12
#: Entries of one hash: walks that more of them share are left to the runs; runs get shorter, down to words, until none is shared by more.
COMMON = 32
#: Meetings that are looked at together.
MEETINGS = 1 << 19
#: Items held by each task at once: a block is at most this many texts.
BLOCK = 20_000
CHUNK = 1 << 15
SEED = 5

_table = np.arange(256, dtype=np.uint8)
_table[:128] = [ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)]
LETTERS = _table


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word among the distinct words, those, words in each text). ASCII marks separate words; case is ignored."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(LETTERS[data].tobytes()))
    return split_words(plain)


class Index:
    """The hash tables of a block of items. Bounded: for each item less than one entry a word in the runs, and WALKS x len(REACHES) a start in the walks."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int = 1):
        codes, self.words, counts = tokens(pa.array(texts, pa.string()))
        #: what walks and runs see of the items' words, by their numbers from 1: a 32-bit hash. Candidates only; matches are verified on the words
        self.seen = np.fromiter((0, *(xxhash.xxh32_intdigest(w) | 1 for w in self.words.to_pylist())), np.uint32, len(self.words) + 1)
        flat, cuts = self.seen[codes + 1] if len(codes) else np.zeros(0, np.uint32), np.cumsum(counts) - counts
        hashed = [flat[a : a + n] for a, n in zip(cuts, counts)]
        self.items = [codes[a : a + n] + 1 for a, n in zip(cuts, counts)]
        self.ids = np.array(ids, np.int64)
        rng = np.random.default_rng(SEED)
        self.steps = max(REACHES)
        self.odd = rng.integers(0, 1 << 32, (WALKS, self.steps), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.samples = [[np.sort(rng.choice(r, SAMPLES if r >= SHORT else FEW_SAMPLES, replace=False)) for r in REACHES] for _ in range(WALKS)]
        searched = [i for i, x in enumerate(self.items) if len(x) >= min_words]
        gap = np.zeros(self.steps + 1, np.uint32)
        padded = np.concatenate([gap, *(part for i in searched for part in (hashed[i], gap))])
        sizes = np.array([len(self.items[i]) for i in searched], np.int64)
        heads = np.cumsum(sizes + len(gap)) - sizes
        starts = [np.arange(0, n, STRIDE if n >= 2 * SHORT_ITEM else NEAR_STRIDE if n >= SHORT_ITEM else 1) for n in sizes]
        shift, item, head = self._spread(starts, searched, heads)
        end = head + counts[item]
        long, few = (np.array(x)[:, None] for x in ([r > SHORT for r in REACHES], [r < SHORT for r in REACHES]))
        self.tables = []
        for w in range(WALKS):
            hashes, at = self.walk(padded, head + shift, w, True)
            # a table counts if its samples lie inside the item
            fits = np.array([at[s[-1]] < end for s in self.samples[w]])
            used = np.where((fits & long).any(axis=0) & (counts[item] >= SHORT_ITEM), fits & long, fits & ((counts[item] < SHORTEST_ITEM) | ~few))
            self.tables.append([self._table(h[u], item[u], shift[u], COMMON) if u.any() else None for h, u in zip(hashes, used)])
        self.runs = {q: self._table(*found) for q, found in self._runs(padded, sizes, np.array(searched, np.int64), heads).items()}
        self.masks = [self._masks(item) for item in self.items]

    def _runs(self, padded: np.ndarray, sizes: np.ndarray, items: np.ndarray, heads: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length of the runs: (hash, item, shift) of the runs that have an entry, e + 1 for each item: the longest ones that few items share, else those that fewest share."""
        edits = (EDITS * sizes).astype(np.int64)
        lengths = range(int((sizes // (edits + 1)).max(initial=0)), 0, -1)
        cuts, kept, worst, total = {}, {}, {}, {}
        for q in lengths:
            shift, at, head = self._spread([np.arange(0, n - q + 1, q) for n in sizes], list(range(len(sizes))), heads)
            hashes = self.run(padded, head + shift, q)
            _, where, shared = np.unique(hashes, return_inverse=True, return_counts=True)
            shared = shared[where]
            order = np.lexsort((shift, shared, at))
            rank = ranges(sizes // q)
            chosen = order[rank <= edits[at[order]]]
            cuts[q], kept[q] = (hashes, at, shift), chosen
            fits = sizes // q > edits
            worst[q] = np.where(fits, self._most(shared[chosen], at[chosen], len(sizes)), np.iinfo(np.int64).max)
            total[q] = np.where(fits, np.bincount(at[chosen], shared[chosen], len(sizes)), np.inf)
        if not len(sizes):
            return {}
        by = list(lengths)
        few = np.array([worst[q] <= COMMON for q in by])
        best = np.where(few.any(axis=0), few.argmax(axis=0), np.array([total[q] for q in by]).argmin(axis=0))
        out = {}
        for i, q in enumerate(by):
            hashes, at, shift = cuts[q]
            mine = kept[q][best[at[kept[q]]] == i]
            if len(mine):
                out[q] = hashes[mine], items[at[mine]], shift[mine]
        return out

    @staticmethod
    def _most(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.maximum.at(out, of, values)
        return out

    @staticmethod
    def _spread(shifts: list[np.ndarray], items: list[int], heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shift, item, first word) of every entry."""
        n = np.array([len(x) for x in shifts], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *shifts]), np.repeat(np.array(items, np.int64), n), np.repeat(heads, n)

    @staticmethod
    def _table(hashes: np.ndarray, items: np.ndarray, shifts: np.ndarray, most: int | None = None):
        """Entries by hash; with `most`, without those of a hash that more entries have."""
        if most is not None:
            _, where, shared = np.unique(hashes, return_inverse=True, return_counts=True)
            hashes, items, shifts = (x[shared[where] <= most] for x in (hashes, items, shifts))
        by = np.argsort(hashes, kind="stable")
        last = np.uint32((1 << max(16, (8 * len(hashes)).bit_length())) - 1)
        filled = np.zeros(int(last) + 1, bool)
        filled[hashes & last] = True
        return filled, hashes[by], items[by], shifts[by]

    @staticmethod
    def run(text: np.ndarray, start: np.ndarray, q: int) -> np.ndarray:
        """The hash of the q words from each start."""
        out = np.zeros(len(start), np.uint32)
        for j in range(q):
            out *= np.uint32(0x85EBCA6B)
            out += text[start + j]
            out ^= out >> np.uint32(15)
        return out

    @staticmethod
    def _masks(item: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, t in enumerate(item.tolist()):
            out[t] = out.get(t, 0) | 1 << i
        return out

    def walk(self, text: np.ndarray, start: np.ndarray, w: int, stand: bool = False):
        """The tables' hashes of the walks from each start; with `stand`, where each walk stands at each step."""
        at, hashes, stands = start.copy(), [np.zeros(len(start), np.uint32) for _ in REACHES], []
        for j in range(self.steps):
            if stand:
                stands.append(at.copy())
            symbol = text[at]
            for t, s in enumerate(self.samples[w]):
                if j in s and (stand or self.tables[w][t] is not None):
                    hashes[t] *= np.uint32(0x85EBCA6B)
                    hashes[t] += symbol
            symbol *= self.odd[w, j]
            symbol >>= np.uint32(31)
            at += symbol
        return hashes, stands

    def candidates(self, symbol: np.ndarray, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct likely (start, item, text number) rows that meet in some table, MEETINGS at a time. The start of the item's first word follows from where they meet; it may lie before the text.

        symbol: the words' hashes; text: their numbers as in the items.
        """
        padded = np.concatenate([symbol, np.zeros(self.steps + 1, np.uint32)])
        found, met, n_met = [], [], 0

        def looked_at() -> None:
            nonlocal met, n_met
            if met:
                found.append(self.likely(text, np.unique(np.concatenate(met), axis=0)))
                met, n_met = [], 0

        def meet(start: np.ndarray, h: np.ndarray, table) -> None:
            nonlocal n_met
            filled, hashes, items, shifts = table
            near = np.flatnonzero(filled[h & np.uint32(len(filled) - 1)])
            if not len(near):
                return
            lo, hi = np.searchsorted(hashes, h[near], "left"), np.searchsorted(hashes, h[near], "right")
            part = np.cumsum(hi - lo) // MEETINGS
            for a, b in zip([0, *(np.flatnonzero(np.diff(part)) + 1)], [*(np.flatnonzero(np.diff(part)) + 1), len(near)]):
                n = hi[a:b] - lo[a:b]
                if n.any():
                    each = np.repeat(lo[a:b], n) + ranges(n)
                    at = np.repeat(start[near[a:b]], n)
                    met.append(np.column_stack([at - shifts[each], items[each], np.searchsorted(ends, at, "right")]))
                    n_met += len(each)
                    if n_met > MEETINGS:
                        looked_at()

        for a in range(0, len(symbol), CHUNK):
            start = np.arange(a, min(a + CHUNK, len(symbol)))
            for w in range(WALKS):
                for h, table in zip(self.walk(padded, start, w)[0], self.tables[w]):
                    if table is not None:
                        meet(start, h, table)
            for q, table in self.runs.items():
                meet(start, self.run(padded, start, q), table)
        looked_at()
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def likely(self, text: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The candidates whose window holds the words that a match needs: n - 2 e of its n words occur in the item.

        A match within e edits shares n - e words with the item. Where x of its edits move its start beside the window's,
        the window can miss x of them at its start and e - x at its end. Lossless.
        """
        found = found[np.argsort(found[:, 1], kind="stable")]
        cuts = [*np.flatnonzero(np.diff(found[:, 1], prepend=-1)), len(found)]
        kept = []
        for a, b in zip(cuts, cuts[1:]):
            item = self.items[found[a, 1]]
            n = len(item)
            words = np.unique(item)
            for c in range(a, b, 4096):
                part = found[c : min(b, c + 4096)]
                window = text[np.clip(part[:, :1] + np.arange(n), 0, len(text) - 1)]
                near = words[np.minimum(np.searchsorted(words, window), len(words) - 1)] == window
                kept.append(part[near.sum(axis=1) >= n - 2 * int(EDITS * n)])
        return np.concatenate(kept) if kept else found

    def distance(self, text: np.ndarray, item: int) -> int:
        """Least word edit distance between the item and any part of the text, bit-parallel over the item's words."""
        masks, n = self.masks[item], len(self.items[item])
        full, top = (1 << n) - 1, 1 << n - 1
        plus, minus, score, best = full, 0, n, n
        for t in text.tolist():
            eq = masks.get(t, 0)
            d0 = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(d0 | plus) & full, plus & d0
            score += bool(up & top) - bool(down & top)
            up, down = up << 1 & full, down << 1 & full  # a match may start anywhere
            plus, minus = (down | ~(d0 | up)) & full, up & d0
            best = min(best, score)
        return best

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, distance, words of the item, word at which the window starts), the best window of each text and item."""
        codes, words, counts = tokens(texts)
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # 0 is a word of no item: it matches nothing, and walks see something else in each
        numbers = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64) + 1
        shown = np.where(numbers > 0, self.seen[numbers], np.arange(1, len(words) + 1, dtype=np.uint32) * np.uint32(0x9E3779B1) & np.uint32(0xFFFFFFFE))
        text, symbol = (numbers[codes], shown[codes]) if len(codes) else (codes, np.zeros(0, np.uint32))
        for start, item, doc in self.candidates(symbol, text, ends).tolist():
            n = len(self.items[item])
            most = int(EDITS * n)
            if best.get((doc, item), (n,))[0] == 0:
                continue
            head = int(ends[doc] - counts[doc])
            lo, hi = max(start - most, head), min(start + n + most, int(ends[doc]))
            if hi - lo < n - most:
                continue
            got = (self.distance(text[lo:hi], item), max(start - head, 0))
            if got[0] <= most and got < best.get((doc, item), (n, 0)):
                best[doc, item] = got
        return [(doc, int(self.ids[i]), d, len(self.items[i]), at) for (doc, i), (d, at) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block: int, min_words: int) -> Iterator[Index]:
    """The items, a block of at most about `block` at a time in the driver."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
    n = -(-items.count() // block)
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64(F.lit(9), "item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows], min_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, min_words: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, item_words, similarity, first_word) of every document and item that occurs in it.

    An item occurs where a part of the document is at a word edit distance of at most EDITS of the item's words; all that occur are
    found, with their least distance. first_word is at most so many words beside the best part's first one.
    Work is local to a row; items are held block by block, and each block is one pass over the documents.

    * Null and empty texts contain nothing, and items without words occur nowhere. Items of under five words occur only unedited; a caller to whom
      they say little leaves them out by min_words. Items of null id are not searched.
    * Repeated documents are each reported; of repeated items with one id, each text that occurs is.
    * Other columns are ignored. An empty table on either side gives an empty result.
    """
    schema = "doc_id bigint, item_id bigint, distance int, item_words int, similarity double, first_word bigint"
    docs = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text"))

    def searched(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 2 << 20):
                got = index.search(plain_texts(batch.column(1)))
                if got:
                    doc, item, distance, words, at = map(np.array, zip(*got))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(words, pa.int32()), pa.array(1 - distance / words, pa.float64()), pa.array(at, pa.int64())],
                        ["doc_id", "item_id", "distance", "item_words", "similarity", "first_word"],
                    )

        return docs.mapInArrow(run, schema)

    out = None
    for index in _blocks(benchmark, block, min_words):
        out = searched(index) if out is None else out.union(searched(index))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK, min_words: int = 1) -> DataFrame:
    """The rows of docs in which no item occurs, with the columns they came with, whatever their names.

    Null and empty texts stay; null ids and repeated rows are judged like any other. Items as in find_leaks(). An empty table on either side changes nothing.
    """

    at = f"_c{docs.columns.index(text_col)}"

    def clean(frame: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at, 2 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[doc for doc, *_ in index.search(plain_texts(batch.column(batch.schema.get_field_index(at))))]] = False
                yield batch.filter(pa.array(keep))

        return frame.mapInArrow(run, frame.schema)

    out = renamed(docs)
    for index in _blocks(benchmark, block, min_words):
        out = clean(out, index)
    return out.toDF(*docs.columns)
