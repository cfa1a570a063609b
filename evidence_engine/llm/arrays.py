"""Numpy over Arrow batches of texts: bytes end to end, words, their hashes and runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty, and where each starts and, last, ends."""
    texts = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about so many bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number mixed so that all its bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse, from the 0th on; kept from call to call."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            each = np.full(n, base)
            each[0] = 1
            _POWERS[k] = np.cumprod(each, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    power, inverse = powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTE[body] * power[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space) and the number of the text of each."""
    inside = ~_SPACE[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    stops[tails] = inside[tails]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def shingles(word_hashes: np.ndarray, of: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words and the number of the text of each. A shorter text has one run, all its words."""
    count = np.bincount(of, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])
    made = np.maximum(count - width + 1, 1)
    owner = np.repeat(np.arange(n_texts), made)
    begin = np.repeat(first[:-1], made) + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
    run = np.zeros(len(owner), np.uint64)
    padded = np.concatenate([word_hashes, np.zeros(width, np.uint64)])
    last = first[1:][owner]
    for k in range(width):
        here = begin + k
        run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(here < last, padded[np.minimum(here, len(padded) - 1)], np.uint64(0)) + np.uint64(k + 1)
    return mixed(run), owner
