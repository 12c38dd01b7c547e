"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, renamed, written
from .words import plain_texts, slices, split_words

#: Rows that fit the model, expected: a hash of the id draws them from all labelled rows.
MAX_TRAIN = 60_000
FEATURES, GAMMA, RIDGE, SEED = 256, 0.02, 0.1, 11
#: Standardised statistics are cut at +-CLIP.
CLIP = 3
#: Partitions whose sums meet in the driver, FEATURES^2 numbers each.
SUMS = 12
SYMBOLS = ("!", "|", "$", "&", "%", "#", "*", "@", "=", "<", ">", "/", "\\", "_", "-", "+")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each whole text; an empty text has zeros."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]).astype(float)

    before = np.concatenate([[0], data[:-1]]) if len(data) else data
    two = before == 0xC3
    upper = (data >= 65) & (data <= 90) | two & (data >= 0x80) & (data <= 0x9E)
    lower = (data >= 97) & (data <= 122) | two & (data >= 0x9F) & (data <= 0xBF)
    digit, space, line = (data >= 48) & (data <= 57), (data == 32) | (data >= 9) & (data <= 13), data == 10
    mark = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    doubled = mark & (np.concatenate([data[1:], [0]]) == data) if len(data) else mark
    n_bytes, n_upper, n_lower, n_digit, n_space, n_line, n_mark, n_doubled = map(count, (np.ones(len(data), bool), upper, lower, digit, space, line, mark, doubled))
    n_stop = count((data == 46) | (data == 44) | (data == 63) | (data == 59))
    table = np.zeros(256, bool)
    table[[ord(c) for c in SYMBOLS]] = True
    n_symbol, n_pipe, n_high = count(table[data]), count(data == 124), count(data >= 128)

    codes, vocabulary, words = split_words(texts, lower=False)
    length = np.fromiter(map(len, vocabulary.to_pylist()), float, len(vocabulary))[codes] if len(codes) else np.zeros(0)
    ends = np.cumsum(words)
    starts = ends - words
    doc = np.repeat(np.arange(n), words)
    total = lambda x: np.bincount(doc, x, n) if len(doc) else np.zeros(n)
    same = np.zeros(len(codes))
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(words):
        _, c = np.unique(codes[starts[i] : ends[i]], return_counts=True)
        distinct[i], top[i] = len(c), c.max()
    w, b = np.maximum(words, 1), np.maximum(n_bytes, 1)
    mean = total(length) / w
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(words), mean, np.sqrt(np.maximum(total(length**2) / w - mean**2, 0)), n_upper / np.maximum(n_upper + n_lower, 1), (n_upper + n_lower) / b, n_digit / b, n_space / b, n_mark / w, n_doubled / w,
        n_symbol / w, n_pipe / w, n_stop / w, n_high / b, n_line / w, distinct / w, top / w, total(same) / w, total(length <= 3) / w, total(length >= 12) / w, np.log1p(words) * distinct / w,
    ])


N_STATISTICS = 21


@dataclass(frozen=True)
class Model:
    """All that scoring needs: a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        f = np.sqrt(2 / FEATURES) * np.cos(z @ self.waves + self.phases)
        return np.column_stack([f, np.ones(len(z))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        return np.clip(np.interp(raw, self.steps, self.values), 0, 1) if len(self.steps) else np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing fit (pool adjacent violators): the blocks' mean x and mean y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of x, sum of y
    for a, b in zip(x[order], y[order]):
        blocks.append([1.0, a, b])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            c = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], c)]
    got = np.array(blocks).reshape(-1, 3)
    return got[:, 1] / got[:, 0], got[:, 2] / got[:, 0]


def _statistics_frame(docs: DataFrame, keep: str, schema: str, text_col: str) -> DataFrame:
    names = keep.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            x = statistics(plain_texts(batch.column(batch.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(list(x), pa.list_(pa.float64()))], [*names, "x"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits P(quality = 1) on labelled rows outside the held-out fold (crc32(doc_id) mod 5 = 0).

    Folds 1 to 3 fit the ridge, fold 4 calibrates it. Only the text is seen. Of more than
    max_train labelled rows, a hash of the id draws about that many. Null labels are ignored,
    repeated ones averaged; labels have the columns doc_id and quality. Without usable labels every document scores 0.5.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("q"))
    known = known.filter(fold != 0)
    n = known.count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    known = known.groupBy("doc_id").agg(F.avg("q").alias("q"))
    # at most about max_train rows of 16 bytes: broadcast by that bound
    drawn = docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).join(F.broadcast(known), "doc_id").select(fold.cast("int").alias("fold"), "q", "text")
    sample = written(_statistics_frame(drawn, "fold q", "fold int, q double, x array<double>", "text"))

    fit = sample.filter("fold < 4")
    columns = [F.col("x")[i] for i in range(N_STATISTICS)]
    row = fit.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    rng = np.random.default_rng(SEED)
    waves = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATISTICS, FEATURES))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    none = np.zeros(0)
    if not row[0]:
        w = np.zeros(FEATURES + 1)
        w[-1] = 0.5
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), waves, phases, w, none, none)
    mean, scale = np.array(row[1 : 1 + N_STATISTICS], float), np.array(row[1 + N_STATISTICS :], float)
    draft = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, phases, none, none, none)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                f = draft.features(np.stack(batch.column(1).to_pylist()))
                a += f.T @ f
                b += f.T @ np.asarray(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    # the normal equations of SUMS partitions, half a megabyte each
    parts = fit.select("q", "x").coalesce(SUMS).mapInArrow(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(p.a).reshape(FEATURES + 1, -1) for p in parts)
    b = sum(np.frombuffer(p.b) for p in parts)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(a + penalty, b)

    # about a quarter of max_train rows come back for the calibration
    held = sample.filter("fold = 4").select("q", "x").collect()
    if not held:
        return Model(mean, draft.scale, waves, phases, weights, none, none)
    raw = draft.features(np.array([r.x for r in held])) @ weights
    steps, values = isotonic(raw, np.array([r.q for r in held]))
    return Model(mean, draft.scale, waves, phases, weights, steps, values)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row: work local to a row, whole texts.

    Null text is the empty text, which is scored like any other. Null ids and repeated rows are
    kept. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = model.score(statistics(plain_texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): trains on the labelled documents, scores all. Edge cases as in train() and score()."""
    out = score(docs, train(docs, labels, max_train, id_col, text_col), id_col, text_col, threshold)
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score", "predicted")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with the columns they came with, whatever their names. Local to a row: no join on ids.

    Null text is scored as the empty text. Null ids and repeated rows are judged like any other; equal texts are judged alike.
    Without usable labels all rows stay. An empty table gives an empty result.
    """
    model, rows, at = train(docs, labels, max_train, id_col, text_col), renamed(docs), f"_c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            s = model.score(statistics(plain_texts(batch.column(batch.schema.get_field_index(at)))))
            yield batch.filter(pa.array(s >= threshold))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
