"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk estimator.

Features of a whole text are shares and means (characters, words, lines, repetition); a small network of one hidden layer
maps them to a margin. Its risk on trusted positives P and unlabelled texts U with class prior p is

    p E_P[loss(+)] + max(0, E_U[loss(-)] - p E_P[loss(-)])

where a step that makes the second part negative climbs back instead. The prior is estimated as the share of positives
among the labelled rows that training may see. The margin's offset is then set so that the share p of the unlabelled sample
scores over one half.

P and U are about SAMPLE rows each at most. Rows of equal features are counted, and each such group is in the sample as often
as its share says, its fraction rounded up or down by a hash of the features: so copies and empty texts weigh in the sample as
in the table, and its size differs from SAMPLE by chance alone. Everything else, features and scores, covers all rows. Without a positive all texts score the prior (one half if that is unknown too).

Nulls: a null text counts as empty, whose features are zeros. Ids may be null or repeated; of several labels of an id
the largest counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import joined, parts, span_hashes, words
from evidence_engine.llm.columns import text_or_empty
from evidence_engine.plans.materialize import materialize

SAMPLE = 20_000
HIDDEN = 24
FEATURES = (
    "log_bytes log_words word_length long_words short_words upper_letters title_words digits marks symbols bars exclaims blanks wide "
    "distinct_words top_word repeated_next distinct_lines lines_a_word stops symbol_ends"
).split()


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_KINDS = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _table("abcdefghijklmnopqrstuvwxyz"),
    "digits": _table("0123456789"),
    "marks": _table(".,;:?'\"()-"),
    "symbols": _table("#$%&*+/<=>@[\\]^_`{}~"),
    "bars": _table("|"),
    "exclaims": _table("!"),
    "blanks": _table(" \t\n\r\v\f"),
    "wide": (np.arange(256) >= 0x80).astype(float),
    "stops": _table(".?!"),
    "feeds": _table("\n"),
}


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)
    of_byte = np.repeat(np.arange(n), np.diff(at))
    share = {k: np.bincount(of_byte, weights=t[body], minlength=n) for k, t in _KINDS.items()}
    starts, ends, of = words(body, at)
    count = np.bincount(of, minlength=n)
    some = np.maximum(count, 1)
    length = ends - starts
    hashes = span_hashes(body, starts, ends)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=n) / some

    same = np.zeros(len(of))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(o), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[first], times)
    distinct = np.bincount(o[first], minlength=n)
    # lines: spans between line feeds, the borders of the texts being line feeds too
    line_ends = np.union1d(np.flatnonzero(body == 10), at[1:][np.diff(at) > 0] - 1).astype(np.int64)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1]).astype(np.int64)[: len(line_ends)]
    line_of = np.searchsorted(at, line_starts, side="right") - 1
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    line_hash = span_hashes(body, line_starts, np.maximum(line_ends, line_starts))
    pairs = np.unique(np.stack([line_of.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64) if len(line_of) else line_of
    letters = np.maximum(share["upper"] + share["lower"], 1)
    tail = body[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = body[starts] if len(starts) else tail
    columns = [
        np.log1p(np.diff(at)), np.log1p(count), mean(length) / 10, mean(length > 14), mean(length <= 3), share["upper"] / letters, mean(_KINDS["upper"][head]),
        share["digits"] / size, share["marks"] / size, share["symbols"] / size, share["bars"] / size, share["exclaims"] / size, share["blanks"] / size, share["wide"] / size,
        distinct / some, top / some, mean(same), np.bincount(pairs, minlength=n) / lines, lines / some, share["stops"] / some, mean(_KINDS["symbols"][tail] + _KINDS["bars"][tail]),
    ]
    out = np.stack(columns, axis=1).astype(np.float32)
    out[np.diff(at) == 0] = 0
    return out


def featured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, x (array<float>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                x = features(*joined(batch.column("text")))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "x"])

    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<float>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    scale: float


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.spread, -6, 6)
    return np.tanh(z @ model.w1 + model.b1) @ model.w2 + model.b2


def score(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * margins(model, x), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, seed: int = 3) -> Model:
    """Adam on the non-negative risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p_all, u_all = (np.clip((x - mean) / spread, -6, 6) for x in (positive, unlabelled))
    p = [rng.normal(0, 0.3, (p_all.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = ([np.zeros_like(a) for a in p] for _ in range(2))
    for t in range(1, steps + 1):
        xp, xu = p_all[rng.integers(0, len(p_all), batch)], u_all[rng.integers(0, len(u_all), batch)]
        hp, hu = np.tanh(xp @ p[0] + p[1]), np.tanh(xu @ p[0] + p[1])
        gp, gu = hp @ p[2] + p[3][0], hu @ p[2] + p[3][0]
        sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
        # sigmoid loss: 1 - s for a positive, s for a negative
        negative_part = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / batch, su * (1 - su) / batch
        if negative_part >= 0:
            gp_, gu_ = -2 * prior * dp, du
        else:  # climb back
            gp_, gu_ = prior * dp, -du
        grads = [np.zeros_like(a) for a in p]
        for x, h, g in ((xp, hp, gp_), (xu, hu, gu_)):
            back = g[:, None] * p[2] * (1 - h**2)
            grads[0] += x.T @ back
            grads[1] += back.sum(0)
            grads[2] += h.T @ g
            grads[3] += g.sum()
        for k in range(4):
            grads[k] += 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    raw = Model(mean, spread, p[0], p[1], p[2], float(p[3][0]), 1.0)
    g = margins(raw, unlabelled)
    cut = float(np.quantile(g, 1 - prior))
    return Model(mean, spread, p[0], p[1], p[2], float(p[3][0]) - cut, 4.0 / max(float(np.std(g)), 1e-3))


def _sampled(rows: DataFrame, sample: int) -> np.ndarray:
    """About sample rows at most, sorted; each distinct row comes to the driver once, with the times that it counts."""
    share = min(1.0, sample / max(1, rows.count()))
    even = F.shiftrightunsigned(F.xxhash64("x"), 11) * F.lit(2.0**-53)
    times = F.col("n") if share == 1 else F.floor(F.col("n") * F.lit(share) + even)
    taken = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("x", times.alias("times")).filter("times > 0")
    found = sorted((r["x"], r["times"]) for r in taken.collect())
    x = np.array([x for x, _ in found], np.float64).reshape(-1, len(FEATURES))
    return np.repeat(x, np.array([n for _, n in found], np.int64), axis=0)


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """rows(doc_id, x) are unlabelled texts; labels(doc_id, quality) of those that training may see. The model and the prior."""
    prior = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = 0.5 if prior is None else min(max(prior, 0.02), 0.98)
    good = rows.join(labels.filter(F.col("quality") == 1).select("doc_id").distinct(), "doc_id", "left_semi")
    p, u = (_sampled(side, sample) for side in (good, rows))
    return (train(p, u, prior) if len(p) and len(u) else None), prior


def scored(rows: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """rows(doc_id, x) -> doc_id, score."""
    if model is None:
        return rows.select("doc_id", F.lit(float(prior)).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(model, x))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, score. usable: a condition on doc_id for labels that may train."""
    rows = materialize(featured(docs))
    labels = labels.filter(usable & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model, prior = fit(rows, labels, sample)
    return scored(rows, model, prior)
