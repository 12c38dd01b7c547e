"""Words and word shingles of many texts at once, as numpy arrays. Runs inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_texts(column) -> pa.Array:
    """One array of texts with 32-bit offsets, whatever Arrow type the session sends; null is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column if column.type == pa.string() else column.cast(pa.string()), "")


def at_white_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, words in each text).

    Each text gets a last word of its own, which is left out again: Arrow's split looks one byte past the end of a text that ends in white
    space, and so at whatever the next one begins with.
    """
    lists = pc.utf8_split_whitespace(pc.binary_join_element_wise(texts, "x", " "))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    ends = ends - ends[0]
    full = np.array(pc.not_equal(flat, ""))
    full[ends[1:] - 1] = False
    return flat.filter(pa.array(full)), np.diff(np.concatenate([[0], np.cumsum(full)])[ends])


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words at white space: (code of each word, the distinct words, words in each text)."""
    flat, counts = at_white_space(pc.utf8_lower(texts) if lower else texts)
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, counts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-case word, words in each text)."""
    codes, vocabulary, counts = split_words(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    return hashed[codes] if len(codes) else np.zeros(0, np.uint64), counts


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words, runs in each text); a shorter text with words is one run, one without has none."""
    words, n = word_hashes(texts)
    runs = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    ends = np.cumsum(n)
    at = np.repeat(ends - n, runs) + ranges(runs)
    end = np.repeat(ends, runs)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        out += np.where(at + j < end, mixed(padded[at + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & MASK)), np.uint64(0))
    return mixed(out), runs


def bags(texts: pa.Array, size: int = SHINGLE):
    """(text number, shingle, count) of the distinct shingles of each text, as three arrays sorted by text and shingle."""
    hashes, runs = shingle_hashes(texts, size)
    doc = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return doc[first], hashes[first], np.diff(np.append(first, len(doc)))


def slices(batches, column: str, max_bytes: int = 8 << 20):
    """Record batches of at most about max_bytes of `column` each; a row is never split."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
