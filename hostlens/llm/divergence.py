"""Divergence of sources: how far each source's use of terms is from that of the other sources and of its whole language.

Two passes over the texts. The first counts in how many documents of its language each term occurs; terms of enough documents are kept.
The second finds the kept terms again with an Aho-Corasick automaton a language, whose patterns are the terms between two blanks, in
texts whose delimiters are blanks; matches may share a blank. Both passes sum up inside a task before anything is exchanged. What they
leave is sparse: a posting for each term that a source uses. Terms that a source doesn't use all have one share, so that pairs of sources
need only the postings: what two sources share term by term, the rest from sums of each source.

All numbers are integers: a share is 1 + floor(SCALE (count + SMOOTH) / (N + SMOOTH V)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, partitions, written
from .words import plain_texts, slices

MIN_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Kept terms that one automaton pass holds in each task: more are searched in further passes, each for its part of the terms.
BLOCK = 1_000_000
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: Postings that one task compares.
POSTINGS = 200_000

# Delimiters are all ASCII characters but letters; only A to Z are lower-cased.
_PLAIN = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [ord(_PLAIN[i]) for i in range(128)]


def plain(texts: pa.Array) -> pa.Array:
    """The texts with a blank for each delimiter and small ASCII letters. Bytes of other characters stay."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(n, pa.py_buffer((offsets - offsets[0]).astype(np.int32).tobytes()), pa.py_buffer(_BYTES[data].tobytes()))


def _columns(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    filled = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    return docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))


class _Held:
    """Counts of terms by key, handed on as Arrow batches once there are many of them."""

    def __init__(self, *names: str):
        self.names, self.counts, self.size = names, {}, 0

    def add(self, key: tuple[str, ...], found: Iterable | dict) -> None:
        """found: terms to count, or their counts."""
        mine = self.counts.setdefault(key, Counter())
        before = len(mine)
        mine.update(found)
        self.size += len(mine) - before

    def batches(self, least: int = 0, terms: dict[str, pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
        """terms: of each first key, the terms that its numbers stand for; else the terms themselves were counted."""
        if self.size > least:
            for key, found in self.counts.items():
                named = pa.array(found.keys(), pa.string()) if terms is None else terms[key[0]].take(pa.array(found.keys(), pa.int64()))
                same = [pa.array([k], pa.string()).take(pa.array(np.zeros(len(found), np.int64))) for k in key]
                yield pa.RecordBatch.from_arrays([*same, named, pa.array(found.values(), pa.int64())], [*self.names, "term", "n"])
            self.counts, self.size = {}, 0


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of the language each term occurs, exactly. docs: (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held("lang")
        for batch in slices(batches, "text", 4 << 20):
            words = pc.split_pattern(plain(plain_texts(batch.column(1))), " ")
            coded, ends = words.flatten().dictionary_encode(), np.asarray(words.offsets).astype(np.int64)
            codes, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
            doc = np.repeat(np.arange(len(words)), np.diff(ends))
            pairs = pd.unique(doc * n + codes)  # each term of a document once
            langs = plain_texts(batch.column(0)).dictionary_encode()
            of, names = np.asarray(langs.indices).astype(np.int64), langs.dictionary.to_pylist()
            which, seen = pd.factorize(of[pairs // max(n, 1)] * n + pairs % max(n, 1))
            counts, terms = np.bincount(which, minlength=len(seen)), coded.dictionary
            for i, name in enumerate(names):
                mine = np.flatnonzero(seen // max(n, 1) == i)
                found = dict(zip(terms.take(pa.array(seen[mine] - i * n)).to_pylist(), counts[mine].tolist()))
                found.pop("", None)
                held.add((name,), found)
            yield from held.batches(HELD)
        yield from held.batches()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _automata(terms: dict[str, list[str]]) -> dict[str, ahocorasick.Automaton]:
    """Of each language, the automaton that finds the numbers of its terms."""
    out = {}
    for lang, names in terms.items():
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, name in enumerate(names):
            found.add_word(f" {name} ", i)
        found.make_automaton()
        out[lang] = found
    return out


def occurrences(docs: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, term, n): how often each kept term of its language occurs in each source's documents. kept: (lang, term), each row once.

    The driver holds and sends at most about `block` terms at a time; each further block is one more pass.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-kept.count() // block))

    def searched(terms) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = terms.value  # a worker keeps it from task to task, and what is made of it
            if "automata" not in known:
                known["automata"], known["names"] = _automata(known["terms"]), {lang: pa.array(of, pa.string()) for lang, of in known["terms"].items()}
            automata, names, held = known["automata"], known["names"], _Held("lang", "source")
            for batch in slices(batches, "text"):
                texts = plain(plain_texts(batch.column(2)))
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts.to_pylist()):
                    if lang in automata:
                        held.add((lang, source), map(itemgetter(1), automata[lang].iter(f" {text} ")))
                        yield from held.batches(HELD, names)
            yield from held.batches(0, names)

        return docs.mapInArrow(run, "lang string, source string, term string, n bigint")

    out = None
    for b in range(blocks):
        mine: dict[str, list[str]] = {}
        for r in kept.filter(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)) == b).toLocalIterator():
            mine.setdefault(r.lang, []).append(r.term)
        found = searched(spark.sparkContext.broadcast({"terms": mine}))
        out = found if out is None else out.union(found)
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (n + SMOOTH v)), exactly: in decimals where 64 bits don't hold the product."""
    up, down = count + SMOOTH, n + v * SMOOTH
    wide = F.call_function("div", up.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), down.cast("decimal(20,0)"))
    return F.when(up < (1 << 63) // SCALE, F.call_function("div", up * SCALE, down)).otherwise(wide) + 1


def _common(postings: DataFrame, buckets: int) -> DataFrame:
    """(lang, a, b, value) for a < b: over the terms that both use, what |p - q| differs from the sum of what each source's own terms bring.

    Dealt by language and hash of the term: a task holds one bucket's postings, however many sources share a term, and sums up before it hands on.
    """

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        lang = rows["lang"].iloc[0]
        names, source = np.unique(rows["source"].to_numpy(dtype=object), return_inverse=True)
        term = pd.factorize(rows["term"])[0]
        order = np.lexsort((source, term))
        term, source = term[order], source[order].astype(np.int64)
        p, p0 = rows["p"].to_numpy()[order], rows["p0"].to_numpy()[order]
        sums: dict[int, int] = {}
        for step in range(1, len(term)):  # each posting with the one `step` places on, while any two belong to one term
            at = np.flatnonzero(term[step:] == term[:-step])
            if not len(at):
                break
            a, b = at, at + step
            part = np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p[b] - p0[a]) + np.abs(p0[a] - p0[b])
            code, where = np.unique(source[a] * len(names) + source[b], return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, where, part)
            for c, x in zip(code.tolist(), total.tolist()):
                sums[c] = sums.get(c, 0) + x
        codes = np.fromiter(sums, np.int64, len(sums))
        return pd.DataFrame({"lang": lang, "a": names[codes // len(names)], "b": names[codes % len(names)], "value": np.fromiter(sums.values(), np.int64, len(sums))})

    rows = postings.select("lang", F.pmod(F.xxhash64(F.lit(3), "term"), F.lit(buckets)).alias("_bucket"), "source", "term", "p", "p0")
    found = rows.groupBy("lang", "_bucket").applyInPandas(pairs, "lang string, a string, b string, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group that occurs.

    Part `pair`: item is each other source of the language, value the sum of |p - q| over all kept terms of the language. Part `term`: item is
    each kept term that the group uses more than its language does, value p - q, ranks to `top`. rank counts from 1 in each group and part: greater values first, then items by their bytes.

    * Null text, language and source are ''. Texts without terms count for their group all the same: it has pairs, with the share that a count of 0 gives.
    * A language without kept terms has pairs of value 0 and no terms; the only source of a language has no pairs. Equal values rank by item.
    * Repeated rows are documents of their own. Texts are read whole, however long. Other columns are ignored; an empty table gives an empty result.
    * The sources of a language are all paired in the result, as asked: the result has the square of their number.
    """
    rows = _columns(docs, text_col, lang_col, source_col)
    kept = written(document_counts(rows).filter(F.col("n") >= min_docs).select("lang", "term"))
    counts = written(occurrences(rows, kept, block))
    groups = rows.select("lang", "source").distinct()
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    used = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(used, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).otherwise(0).cast("bigint")))
    postings = written(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"))

    # pairs: V |a0 - b0|, changed by each source's own terms, and again where both use a term
    own = postings.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    own = own.join(other, "lang").groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("own"))
    own = written(own)
    both = _common(postings, max(partitions(docs.sparkSession), -(-counts.count() // POSTINGS)))
    pairs = groups.join(other, "lang").filter("source <> other").select("lang", "source", "other", (F.col("v") * F.abs(F.col("p0") - F.col("q0"))).alias("base"))
    pairs = pairs.join(own, ["lang", "source", "other"], "left").join(own.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("own").alias("back")), ["lang", "source", "other"], "left")
    least, most = F.least("source", "other"), F.greatest("source", "other")
    pairs = pairs.withColumns({"a": least, "b": most}).join(both, ["lang", "a", "b"], "left")
    value = F.col("base") + F.coalesce("own", F.lit(0)) + F.coalesce("back", F.lit(0)) + F.coalesce("value", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("_total"), F.max("v").alias("_v"))
    whole = whole.join(langs, "lang").select("lang", "term", share(F.col("_n"), F.col("_total"), F.col("_v")).alias("q"))
    terms = postings.join(whole, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # each part is ranked by itself: the limit on terms then works in each task before the exchange
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
