"""Near-duplicate detection by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banding, exact verification.

A document is the multiset of its five-word shingles. For each shingle there is one Poisson process
of points (time, weight level) over the weight axis, cut at 0, 1, 2, 4, 8, ...; a document sees
the points at or below its own count. Each point is dealt to one of the signature's places, whose
entry is the earliest time it sees: two documents agree in a place with a probability equal to their
weighted Jaccard similarity. The processes are cut off at a time by which all places are filled, so the
work is the number of shingles plus about m log m points, not their product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, column, partitions, written
from .components import components
from .words import MASK, bags, mixed, plain_texts, ranges, slices

#: A pair at exactly the similarity asked for meets in no band with at most this probability.
MISS = 4e-5
#: Places of a signature at most; bands and rows follow from the similarity. At 0.8: 26 bands of 5.
PLACES = 130
SIMILARITY = 0.8
#: Pairs of the second round must agree in their signatures, and in longer ones of SHARP places, at most so many standard deviations below the
#: similarity: the share of pairs at exactly the similarity that either drops is under 5e-5, and falls quickly above it.
DEVIATIONS, SHARP = 4.0, 1024
#: Rows of one bucket that one task compares. Buckets whose classes beside the largest have more rows than BLOCKS such blocks are searched by rare shingles.
BLOCK, BLOCKS = 1000, 8
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SCALE = np.float64(2.0**-53)


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * _SCALE


def layout(similarity: float) -> tuple[int, int]:
    """(bands, rows of a band): as many rows as PLACES allow at a probability of MISS."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows <= PLACES:
            return bands, rows
    raise ValueError(f"a similarity of {similarity} needs more than {PLACES} places")


def least_share(similarity: float, places: int) -> float:
    """The share of equal places that a pair at the similarity has but for a negligible probability."""
    return similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / places)


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """n x places earliest times; infinity where a document has no shingle. doc: sorted text number of each shingle."""
    out = np.full((n, places), np.inf)
    weight = np.bincount(doc, count, n) if len(doc) else np.zeros(n)
    # pieces (lo, hi] of the weight axis with lo < count: 0-1, 1-2, 2-4, 4-8, ...
    pieces = [(0, 1)]
    while pieces[-1][1] < (count.max() if len(count) else 0):
        pieces.append((pieces[-1][1], max(2, 2 * pieces[-1][1])))
    todo = np.flatnonzero(weight > 0)
    slack = 4.0
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = places / weight[todo] * (np.log(places) + slack)
        chosen = limit[doc] > 0
        for k, (lo, hi) in enumerate(pieces):
            use = np.flatnonzero(chosen & (count > lo))
            d, c, end = doc[use], count[use], limit[doc[use]]
            seed = mixed(shingle[use] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & MASK))
            time, r = np.zeros(len(use)), 0
            while len(d):
                r += 1
                step = mixed(seed + np.uint64(0xD1B54A32D192ED03 * r & MASK))
                time = time - np.log1p(-_uniform(step)) / (hi - lo)
                live = time <= end
                d, c, end, seed, time, step = d[live], c[live], end[live], seed[live], time[live], step[live]
                other = mixed(step ^ np.uint64(0xA0761D6478BD642F))
                place = (other % np.uint64(places)).astype(np.int64)
                if hi - lo > 1:  # the point's level within the piece, from its own bits
                    seen = lo + 1 + ((other >> np.uint64(20)) % np.uint64(hi - lo)).astype(np.int64) <= c
                    np.minimum.at(out, (d[seen], place[seen]), time[seen])
                else:
                    np.minimum.at(out, (d, place), time)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        slack *= 3  # the few documents with an unfilled place go further; the points before stay the same
    return out


def _signed(docs: DataFrame, bands: int, height: int) -> DataFrame:
    """(doc_id, bag, n_shingles, sig, bands): a digest of the multiset, one byte a place, one key a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            n = batch.num_rows
            doc, shingle, count = bags(plain_texts(batch.column(1)))
            times = signatures(doc, shingle, count, n, bands * height)
            bits = mixed(np.ascontiguousarray(times).view(np.uint64))
            keys = np.zeros((n, bands), np.uint64)
            for j in range(height):
                keys = mixed(keys + bits[:, j::height] * np.uint64(2 * j + 1))
            cut = np.searchsorted(doc, np.arange(n + 1))
            digest = [xxhash.xxh3_128_digest(shingle[a:b].tobytes() + count[a:b].astype(np.int32).tobytes()) for a, b in zip(cut, cut[1:])]
            sig = np.ascontiguousarray((bits & np.uint64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(digest, pa.binary()), pa.array(np.diff(cut), pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())),
            ], ["doc_id", "bag", "n_shingles", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, bag binary, n_shingles bigint, sig binary, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets reach the similarity, compared in full, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "text_a", 2 << 20):
                n = batch.num_rows
                da, sa, ca = bags(plain_texts(batch.column(2)))
                db, sb, cb = bags(plain_texts(batch.column(3)))
                # multiplicities of each (pair, shingle) on both sides
                d, s = np.concatenate([da, db]), np.concatenate([sa, sb])
                c, side = np.concatenate([ca, cb]), np.concatenate([np.zeros(len(da), bool), np.ones(len(db), bool)])
                order = np.lexsort((side, s, d))
                d, s, c = d[order], s[order], c[order]
                met = np.flatnonzero((d[1:] == d[:-1]) & (s[1:] == s[:-1])) if len(d) else np.zeros(0, np.int64)
                shared = np.bincount(d[met], np.minimum(c[met], c[met + 1]), n) if len(met) else np.zeros(n)
                union = np.maximum(np.bincount(d, c, n) - shared, 1) if len(d) else np.ones(n)
                similarity = shared / union
                got = np.flatnonzero(similarity >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got)), batch.column(1).take(pa.array(got)), pa.array(similarity[got])], ["a", "b", "similarity"])

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def _mixed(rooted: DataFrame) -> DataFrame:
    """(band, key, n, largest, others) of the buckets whose documents are of several classes: rows, the largest class, and the rows beside it."""
    parts = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("m"))
    buckets = parts.groupBy("band", "key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("_most")).filter("n > _most.m")
    return buckets.select("band", "key", "n", F.col("_most.root").alias("largest"), (F.col("n") - F.col("_most.m")).alias("others"))


def _by_rare_shingles(rooted: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(band, key, doc_id, root) with one bucket for each rare shingle: two documents that reach the similarity share one of their rarest ones. Exact.

    Of n shingles (copies counted apart) a document shares at least similarity x n with any other that reaches it, so that in one order of all shingles,
    here by their number of documents, one of its first n - similarity x n + 1 is among the other's first ones, too. What very many documents share,
    such as boilerplate, comes last in that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            doc, shingle, count = bags(plain_texts(batch.column(1)))
            copy = np.repeat(shingle, count) + np.uint64(0x9E3779B97F4A7C15) * ranges(count).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(doc, count))), pa.array(mixed(copy).view(np.int64))], ["doc_id", "key"])

    roots = rooted.select("doc_id", "root").distinct()
    rows = written(texts.select("doc_id", "text").join(roots.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, key bigint"))
    frequency = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc_id").orderBy("n", "key")
    whole = Window.partitionBy("doc_id")
    rows = rows.join(frequency, "key").withColumns({"at": F.row_number().over(order), "size": F.count(F.lit(1)).over(whole)})
    rare = rows.filter((F.col("n") > 1) & (F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1))
    return rare.join(roots, "doc_id").select(F.lit(0).alias("band"), "key", "doc_id", "root")


def _sharp(docs: DataFrame) -> DataFrame:
    """(doc_id, sharp): a longer signature for the few documents whose pairs are many, one byte a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                times = signatures(*bags(plain_texts(part.column(1))), part.num_rows, SHARP)
                sig = np.ascontiguousarray((mixed(times.view(np.uint64)) & np.uint64(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "sharp"])

    return docs.mapInArrow(run, "doc_id bigint, sharp binary")


def _across(rooted: DataFrame, mixed_buckets: DataFrame, signed: DataFrame, sharp: DataFrame, similarity: float, places: int) -> DataFrame:
    """Distinct pairs (a, b) of documents of one bucket, of different classes and with similar signatures.

    Rows of a bucket's largest class go to one block of it, the others to all blocks, so that rows of one class cost their number.
    A pair that meets in several bands comes from the first of them.
    """
    spark = rooted.sparkSession
    least, least_sharp = least_share(similarity, places), least_share(similarity, SHARP)
    rows = rooted.join(mixed_buckets.select("band", "key", "largest", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), ["band", "key"])
    rows = rows.join(signed.select("doc_id", "sig", "bands"), "doc_id").join(sharp, "doc_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "doc_id"), "blocks").cast("int"))
    to = F.when(F.col("root") == F.col("largest"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("band", "key", F.explode(to).alias("block"), "own", "doc_id", "root", "sig", "bands", "sharp", (F.col("root") != F.col("largest")).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, group = [], None

        def pairs() -> Iterator[pa.RecordBatch]:
            band, _, block = group
            own, ids, roots, other = (np.array([r[k] for r in left]) for k in (0, 1, 2, 6))
            sigs, sharps = (np.frombuffer(b"".join(r[k] for r in left), np.uint8).reshape(len(left), -1) for k in (3, 5))
            earlier = np.array([r[4][:band] for r in left], np.int64).reshape(len(left), band)
            inside = np.flatnonzero(own == block)
            for i in np.flatnonzero(other):
                # two rows of other classes meet in the blocks of both: one of them counts
                js = inside[(roots[inside] != roots[i]) & (~other[inside] | (ids[inside] > ids[i]))]
                js = js[(sigs[js] == sigs[i]).mean(axis=1) >= least] if len(js) else js
                js = js[~(earlier[js] == earlier[i]).any(axis=1)] if len(js) else js
                js = js[(sharps[js] == sharps[i]).mean(axis=1) >= least_sharp] if len(js) else js
                if len(js):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[js], ids[i])), pa.array(np.maximum(ids[js], ids[i]))], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if key != group:
                    if len(left) > 1:
                        yield from pairs()
                    left, group = [], key
                left.append(row)
        if len(left) > 1:
            yield from pairs()

    dealt = rows.repartition(partitions(spark), "band", "key", "block").sortWithinPartitions("band", "key", "block")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rep), (a, b, similarity)): the smallest document of equal multiset of each document, and verified links between such representatives.

    The links connect all that the similarity connects: of a bucket's documents, those that links have connected already are not compared again.
    Edge cases as in near_duplicates().
    """
    bands, height = layout(similarity)
    docs = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).filter("doc_id is not null")
    with Scope() as scope:
        signed = written(_signed(docs, bands, height))
        # equal multisets: one representative each, counted before the shuffle
        reps = signed.groupBy("bag").agg(F.min("doc_id").alias("rep"))
        members = scope.keep(signed.select("doc_id", "bag").join(reps, "bag").select("doc_id", "rep"))
        alone = signed.join(reps, (signed.bag == reps.bag) & (signed.doc_id == reps.rep), "left_semi").filter("n_shingles > 0")
        buckets = alone.select("doc_id", F.posexplode("bands").alias("band", "key"))
        met = buckets.groupBy("band", "key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).filter("center <> last").select("band", "key", "center")
        buckets = written(buckets.join(met, ["band", "key"]))

        # only the texts of documents that met another one are needed from here on
        involved = written(buckets.select("doc_id").distinct())
        texts = written(docs.join(F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved, "doc_id", "left_semi"))
        star = written(buckets.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct())
        links = written(_verified(star, texts, similarity))

        found = components(links)
        rooted = written(buckets.join(found, buckets.doc_id == found.id, "left").select("band", "key", "doc_id", F.coalesce("root", "doc_id").alias("root")))
        among = written(_mixed(rooted))
        if not among.isEmpty():
            large = among.filter(F.col("others") > BLOCK * BLOCKS)
            if not large.isEmpty():
                rare = written(_by_rare_shingles(rooted.join(large, ["band", "key"], "left_semi"), texts, similarity))
                rooted = rooted.join(large, ["band", "key"], "left_anti").unionByName(rare)
                among = written(among.filter(F.col("others") <= BLOCK * BLOCKS).unionByName(_mixed(rare)))
            sharp = written(_sharp(texts.join(rooted.join(among, ["band", "key"]).select("doc_id").distinct(), "doc_id", "left_semi")))
            more = _across(rooted, among, signed, sharp, similarity, bands * height).join(star, ["a", "b"], "left_anti")
            links = links.unionByName(_verified(written(more), texts, similarity))
        return members, scope.keep(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, n_links): class_id is the smallest id of the documents that links of at least `similarity` connect.

    Documents with equal multisets are one node from the start, so groups of copies of any size
    cost one row. In each band's bucket every document is compared with the bucket's smallest id; a second
    round compares the documents of a bucket that the first left in different classes, block by
    block, or where these are very many by the rare shingles that they share. Each candidate is verified on the whole texts.
    n_links is the number of verified links (near_links()) of the document's text with other texts.

    * Words are split at white space and lower-cased. A text of under five words is one shingle;
      null, empty and blank texts have none and are copies of each other.
    * A null id takes no part and is left out. Repeated ids with different texts are joined under
      that id: any of their links count. Other columns are ignored. An empty table gives an empty result.
    * Bands, rows and thresholds follow from `similarity`; below about 0.08 it raises ValueError.
    """
    members, links = near_links(docs, id_col, text_col, similarity)
    with Scope() as scope:
        found = components(links)
        ends = links.select(F.col("a").alias("rep")).unionAll(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        # a representative without links is its own class
        classes = members.join(found, members.rep == found.id, "left").join(ends, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        classes = scope.keep(classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links")))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return classes.join(sizes, "class_id").select("doc_id", "class_id", "class_size", "n_links")
