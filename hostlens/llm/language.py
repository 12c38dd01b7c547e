"""Language identification by compression.

Text is coded shortest by the dictionary of its own language. Each language gets a few zstandard raw-content dictionaries from
a bounded sample of labelled texts. A text is coded in blocks by one dictionary of each language; where the shortest
code leads by little, the further dictionaries are asked, too, and where they don't agree by more than a margin, the guess is marked as
rejected. Only letters count, and case doesn't: keys, numbers and markup say nothing about the language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column
from .words import plain_texts, slices

UNKNOWN = "und"
#: The sample: so many texts of each language, so many characters of each (fewer texts where there are many languages), and languages at most.
TEXTS, PIECE, ALL_TEXTS, MAX_LANGS = 400, 700, 100_000, 2_000
#: So many times the sample are drawn by hash, so that enough are there.
DRAWN = 4
#: Bytes of a dictionary, and of all dictionaries together; a language's dictionaries, the first of which codes every text.
DICTIONARY, ALL_BYTES, DICTIONARIES = 32 << 10, 64 << 20, 4
#: Bytes of a text that are coded at once: a dictionary helps near it. Levels of the first and of the further dictionaries.
BLOCK, LEVEL, FURTHER_LEVEL = 8 << 10, 6, 9
#: Leads, as a share of the shortest code, under which further dictionaries are asked, and under which a guess is rejected.
UNSURE, REJECT = 0.05, 0.01

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words, one blank between them."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass(frozen=True)
class Model:
    """langs in order; for each its dictionaries and the cost of naming it, in bytes: -log2(its share of the labelled texts) / 8."""

    langs: tuple[str, ...]
    dictionaries: tuple[tuple[bytes, ...], ...]
    cost: tuple[float, ...]


class Coder:
    """The compressors of a model; made in the task."""

    def __init__(self, model: Model):
        self.model = model
        levels = [LEVEL] + [FURTHER_LEVEL] * (DICTIONARIES - 1)
        self.first, *self.further = ([self._compressor(of[j], level) for of in model.dictionaries] for j, level in enumerate(levels))

    @staticmethod
    def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
        parameters = zstandard.ZstdCompressionParameters.from_level(level)
        known = zstandard.ZstdCompressionDict(data.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters)

    def sizes(self, data: bytes, compressors: list) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in compressors]

    def guess(self, text: str) -> tuple[str, float, float]:
        """(language, score, lead): the lead of the shortest code over the next one, as a share of it."""
        data = letters(text)
        if not any(map(str.isalpha, text)) or not self.model.langs:  # stops at the first letter; signs such as fractions are none
            return UNKNOWN, 0.0, 0.0
        total = [s + c for s, c in zip(self.sizes(data, self.first), self.model.cost)]
        if self._lead(total) < UNSURE:
            asked = [self.sizes(data, more) for more in self.further]
            total = [sum(s) / len(s) + c for *s, c in zip(*asked, self.model.cost)]
        best = min(range(len(total)), key=lambda i: (total[i], self.model.langs[i]))
        # a code's length is a probability: 2 to the power of minus its bits
        score = 1 / sum(2 ** max(-8 * (t - total[best]), -1000) for t in total)
        return self.model.langs[best], score, self._lead(total)

    @staticmethod
    def _lead(total: list[float]) -> float:
        low = sorted(total)
        return (low[1] - low[0]) / low[0] if len(low) > 1 else 1.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 11) -> Model:
    """Dictionaries from at most TEXTS texts of each language, PIECE characters of each, drawn by a hash of id and text.

    Rows of null text or language teach nothing; an empty language is a language. Repeated rows count as often as they are there. Without
    labelled rows the model knows no language. The sample has at most ALL_TEXTS pieces and there are at most MAX_LANGS languages (else an error).
    """
    rows = docs.select(column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"), F.xxhash64(F.lit(seed), column(id_col), F.length(column(text_col))).alias("draw"))
    rows = rows.filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model((), (), ())
    # what a hash leaves of each language is a few times the sample, however many texts there are; then a part of the text from anywhere in it
    texts = max(1, min(TEXTS, ALL_TEXTS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, DRAWN * texts / n))])
    rows = rows.filter(F.col("draw") / F.lit(2.0**64) + 0.5 <= F.element_at(share, F.col("lang")))
    at = F.lit(1) + F.pmod(F.col("draw"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1).cast("int")
    rows = rows.select("lang", "draw", F.substring("text", at, F.lit(PIECE)).alias("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "piece"))
    drawn = rows.withColumn("place", place).filter(F.col("place") <= texts).collect()
    pieces: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(drawn, key=lambda r: (r.lang, r.place)):
        pieces[r.lang].append(letters(r.piece))
    size = min(DICTIONARY, ALL_BYTES // (DICTIONARIES * len(counts)))
    dictionaries = tuple(tuple(b" ".join(of[j::DICTIONARIES])[:size] for j in range(DICTIONARIES)) for of in pieces.values())
    return Model(tuple(pieces), dictionaries, tuple(-math.log2(counts[lang] / sum(counts.values())) / 8 for lang in pieces))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every row; a shuffle-free pass over whole texts.

    score: the language's share of all languages' probabilities, 0 to 1. margin: the lead of its code, as a share. rejected: the margin is under REJECT.

    * Null texts, empty ones and those without a letter are `und`: score and margin 0, rejected. So is every text if the model knows no language.
    * Equal codes: the language that sorts first. Texts of any length are coded whole, block by block.
    * Repeated rows and null ids are judged like any other; other columns are ignored. An empty table gives an empty result.
    """
    schema = "_id bigint, lang_pred string, score double, margin double, rejected boolean"
    rows = docs.select(column(id_col).cast("bigint").alias("_id"), column(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for batch in slices(batches, "_text"):
            lang, score, margin = zip(*map(coder.guess, plain_texts(batch.column(1)).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m < REJECT for m in margin], pa.bool_())],
                ["_id", "lang_pred", "score", "margin", "rejected"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
