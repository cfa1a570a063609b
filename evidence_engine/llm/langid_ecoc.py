"""Language identification by error-correcting output codes over binary n-gram classifiers.

Each language has a codeword. For each bit a binary classifier, whose features are the hashed byte trigrams of a text,
tells the languages with a 1 from those with a 0. Its weights are the log odds of a trigram in the two groups, taken
from counts over all training texts: tasks add up counts for their own rows, and tables of fixed size (languages x
2**HASH_BITS) are summed by Spark, so training reads every labelled row and needs no sample. Decoding sums, over the bits,
a logistic loss of the classifier's margin times the bit's weight (its reliability on the training counts) and takes
the codeword of least loss. The score is the share of that codeword in a softmax over the losses; a text is ambiguous when
the second best is nearly as close. The loss itself tells, whatever the number of languages is, how well the text fits any
of them: near 0 for a text of a learned language, near log 2 for letters that speak for no side of any bit. loss_limit()
is the loss up to which a text counts as of a learned language, taken from the labelled rows.

Nulls: a null text, an empty one or one without a letter gets UNKNOWN and score 0. Rows without language train nothing.
Without any training row all texts are UNKNOWN. Ties go to the language that comes first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import joined, parts
from evidence_engine.llm.columns import free_names, text_or_empty

UNKNOWN = "und"
HASH_BITS = 15
#: Margins are means over a text's trigrams times this, so that long texts do not saturate.
SHARPNESS = 12.0
#: A second codeword with at least this share of the best one's makes a text ambiguous.
AMBIGUOUS = 0.5
#: Share of the labelled rows within the limit of the loss, and a limit that no table goes below.
WITHIN, LEAST_LIMIT = 0.999, 0.2
_CHUNK = 1 << 18


def trigrams(body: np.ndarray) -> np.ndarray:
    """Hashes of the byte trigrams of body (uint8): A-Z lower-cased, digits and ASCII punctuation as blanks."""
    wide = _FOLD[body].astype(np.uint32)
    h = wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - HASH_BITS)


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    for c in range(128):
        if not chr(c).isalpha():
            fold[c] = 32
    return fold


_FOLD = _folding()


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n distinct codewords of 0 and 1, one in each row; no column is constant or repeats another or its complement.

    Up to six languages get the exhaustive code of 2**(n-1) - 1 bits; more get about 10 log2(n) columns, random but for
    these rules, of which the draw with the largest least distance is taken.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = np.arange(1, 2 ** (n - 1))
        return ((columns[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, width), dtype=np.int8)
        code = code[:, (code.sum(0) > 0) & (code.sum(0) < n)]
        apart = (code[:, None, :] != code[None]).sum(-1)
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = code, least
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # 2**HASH_BITS x bits: log odds
    reliability: np.ndarray  # of each bit


def _fit_counts(languages: list[str], counts: np.ndarray) -> Model:
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((2**HASH_BITS, 1), np.float32), np.ones(1))
    smooth = counts + 0.5
    share = smooth / smooth.sum(1, keepdims=True)  # each language counts alike, however many texts it has
    ones, zeros = code.T @ share, (1 - code).T @ share
    ones /= np.maximum(code.sum(0)[:, None], 1)
    zeros /= np.maximum((1 - code).sum(0)[:, None], 1)
    weights = np.log(np.maximum(ones, 1e-12)) - np.log(np.maximum(zeros, 1e-12)) if len(languages) > 1 else np.zeros_like(ones)
    # reliability: the mean margin of the training texts on the right side of the bit
    sides = np.where(code == 1, 1.0, -1.0)
    margin = (share @ weights.T) * sides
    reliability = np.clip(margin.mean(0), 0.05, None)
    return Model(languages, code, weights.T.astype(np.float32).copy(), reliability / reliability.sum())


def fit(labelled: DataFrame) -> Model:
    """labelled(text, lang) -> Model, from all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, totals = 2**HASH_BITS, {}
        for batch in (p for whole in batches for p in parts(whole, "text")):
            body, at = joined(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                for start in range(at[i], at[i + 1] - 2, _CHUNK):
                    part = trigrams(body[start : min(start + _CHUNK + 2, at[i + 1])])
                    if lang not in totals:
                        totals[lang] = np.zeros(size, np.int64)
                    totals[lang] += np.bincount(part, minlength=size)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(total[used])], ["lang", "h", "n"])

    rows = labelled.filter(F.col("lang").isNotNull()).select(text_or_empty(F.col("text")).alias("text"), "lang")
    counted = rows.mapInArrow(count, "lang string, h int, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    # at most languages x 2**HASH_BITS rows, whatever the input
    table = counted.toArrow()
    langs = np.asarray(table["lang"].to_pylist(), object)
    languages = sorted(set(langs.tolist()))
    counts = np.zeros((len(languages), 2**HASH_BITS))
    if languages:
        counts[np.searchsorted(languages, langs.astype(str)), table["h"].to_numpy()] = table["n"].to_numpy()
    return _fit_counts(languages, counts)


def _margins(model: Model, body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's trigrams for each bit, divided by their number."""
    n, bits = len(at) - 1, model.weights.shape[1]
    sums = np.zeros((n, bits))
    for first in range(at[0], at[-1], _CHUNK):
        last = min(first + _CHUNK, at[-1])
        part = body[first : min(last + 2, at[-1])]
        if len(part) < 3:
            continue
        h = trigrams(part)
        # the trigrams that run over the end of their text do not count
        lo, hi = np.searchsorted(at, first, side="right") - 1, np.searchsorted(at, first + len(h) - 1, side="right") - 1
        texts = np.arange(lo, hi + 1)
        starts = np.maximum(at[texts], first) - first
        stops = np.minimum(at[texts + 1] - 2, first + len(h)) - first
        run = np.zeros((len(h) + 1, bits), np.float64)
        np.cumsum(model.weights[h], axis=0, out=run[1:], dtype=np.float64)
        ok = stops > starts
        sums[texts[ok]] += run[stops[ok]] - run[starts[ok]]
    return sums / np.maximum(np.diff(at) - 2, 1)[:, None]


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score, whether the next is nearly as close, and its loss."""
    z = margins * SHARPNESS
    lost1, lost0 = np.logaddexp(0, -z), np.logaddexp(0, z)
    loss = (lost1 * model.reliability) @ model.code.T + (lost0 * model.reliability) @ (1 - model.code).T
    near = np.exp(-(loss - loss.min(1, keepdims=True)) * SHARPNESS / 2)
    near /= near.sum(1, keepdims=True)
    best = loss.argmin(1)
    score = near[np.arange(len(best)), best]
    near[np.arange(len(best)), best] = 0
    return best, score, near.max(1) >= AMBIGUOUS * score, loss.min(1)


_TOLD = ["lang_pred", "score", "ambiguous", "loss"]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all its columns, text among them, and lang_pred, score, ambiguous, loss (columns of these names are replaced)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts(whole, "text")):
            body, at = joined(batch.column("text"))
            known = batch.column(letter).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            if model.languages:
                best, score, ambiguous, loss = decode(model, _margins(model, body, at))
                langs = np.where(known, np.asarray(model.languages, object)[best], UNKNOWN)
                score, ambiguous = np.where(known, score, 0.0), np.where(known, ambiguous, False)
            else:
                langs, score, ambiguous, loss = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool), np.full(n, np.log(2))
            keep = [batch.column(c) for c in columns]
            told = [pa.array(langs.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous), pa.array(loss, pa.float64())]
            yield pa.RecordBatch.from_arrays([*keep, *told], [*columns, *_TOLD])

    docs = docs.drop(*_TOLD)
    columns = docs.columns
    (letter,) = free_names(columns, "letter")
    source = docs.withColumn(letter, text_or_empty(F.col("text")).rlike(r"\p{L}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean, loss double")


def loss_limit(labelled: DataFrame, model: Model) -> float:
    """The loss that WITHIN of the labelled texts with a letter do not exceed, or LEAST_LIMIT if that is more."""
    rows = labelled.filter(F.col("lang").isNotNull()).select("text")
    limit = predict(rows, model).filter(F.col("lang_pred") != UNKNOWN).agg(F.percentile_approx("loss", WITHIN, 100_000)).first()[0]
    return max(LEAST_LIMIT, limit or 0.0)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
