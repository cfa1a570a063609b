"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Candidates are all runs of at least MIN_CHARS characters of CANDIDATE, words of letters alone among them, but those that lie
within findings of the patterns. The network reads bytes by their classes: a convolution over the whole text, made once;
for each candidate the maxima of its filters over the candidate, over the CONTEXT bytes before it and over those after it, and
with the candidate's length and mix of characters a dense layer over these.

It is trained on all labelled findings: values that the patterns found are positive, those without a letter aside; other
candidates are negative. A quarter of the negatives' weight, as far as there are so many, is that of numbers (candidates with
digits and without a letter: card, telephone and order numbers, dates, amounts, addresses of machines), which are rare among all
candidates. So that the network learns more than the patterns know, each finding is shown as it stands and without the
surroundings that the patterns go by. The negatives that look most like secrets are left out of a step, for those may be secrets
that no pattern knows; numbers always stay.

A fit on START drawn findings of each side is where the training starts. In each of ROUNDS passes over the whole texts every task
then steps through all its findings from the network that the last pass left, and the networks of the tasks are averaged, by
their numbers of findings. The loss is a squared hinge: findings beyond the margin have no gradient, so most need a forward pass alone.

A quarter of the findings, by hash, is never trained on and calibrates, all of it. Margins are rounded to 1 / STEPS, and Spark
counts how often each margin occurs on each side. From these counts come a logistic scale and, as threshold, the largest margin
that still finds RECALL of the calibrating positives as they stand in the texts. If more than FALSE_SHARE of the calibrating negatives
would pass it, no threshold keeps both: then nothing is added, and the scan says so (network: "clash"). Candidates at or over the
threshold are added with kind "model".

Passes over the whole texts: one counts and draws, ROUNDS train, one judges, counts the calibrating margins
and writes the candidates that a threshold can reach. Those are all from a floor on that FLOOR of the drawn negatives pass; should the
threshold, from the counts of all, lie below it, another pass judges and writes from there. Work and memory grow in proportion to a text's length, whatever it holds.

Nulls: a null text counts as empty: no spans. Ids may be null or repeated. Without positives or negatives to learn
from nothing is added (network: "untrained"). An empty table gives an empty result. Very long texts and candidates are judged
whole, in blocks.
"""

from __future__ import annotations

import re
import threading
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import joined, mixed, parts
from evidence_engine.llm.columns import text_or_empty
from evidence_engine.plans.materialize import materialize

#: The patterns and the least length of what counts: of group 2, or of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What every match of ASSIGN begins with, as Arrow reads it.
_LEAD = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
KINDS = ("assign", "access", "hex")

CANDIDATE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=@-"
#: As long as the shortest value that the patterns take.
MIN_CHARS = 6
CONTEXT = 24
#: Findings of each side that the first fit, where the training starts, is made on.
START = 3000
#: Passes of training over all findings.
ROUNDS = 2
#: Learning rates of the first fit and of the passes, and the most bytes of texts that one step of a pass reads.
RATES, STEP = (0.01, 0.002), 1 << 16
#: Steps of a pass over a small table, which reads less at once.
PACE = 500
#: Bytes of texts that are judged together, few enough to stay in the processor's cache.
PART = 1 << 17
#: Least numbers of secrets and of numbers that a step of a pass sees, as far as there are so many.
LEAST = (64, 16)
#: Margins are whole multiples of 1 / STEPS, at most MOST of them on either side of 0.
STEPS, MOST = 1024, 1 << 16
RECALL = 0.98
#: Share of the calibrating negatives that may pass; some of them may be secrets that no pattern knows.
FALSE_SHARE = 0.005
#: Share of the drawn negatives at or over the least margin that is written: so many above FALSE_SHARE that a lower threshold would clash.
FLOOR = 0.02
#: Share of the negatives that are numbers, as far as there are so many.
NUMBERS = 0.25
#: Share of the negatives, those that look most like secrets, that the second fit and the steps of the passes leave out.
DOUBTFUL = 0.01

_WIDTH, _FILTERS = 5, 16
#: Bytes whose convolution is made at once: it and its maxima stay in a core's own cache.
_BLOCK = 1 << 13


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, value start, value end) of what the patterns find, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), 0, *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), 2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_RUN = _table(CANDIDATE)
_SHAPES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_.=@-"]
_KIND = sum(_table(chars).astype(np.int8) * (k + 1) for k, chars in enumerate(_SHAPES))


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: kinds of letters and digits, each usual sign by itself, the rest."""
    groups = ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\r", *"=:\"'._-/+,;|()[]{}<>@#$%&*!?"]
    out = np.full(256, len(groups), np.int64)
    for k, g in enumerate(groups):
        out[list(g.encode())] = k
    return out, len(groups) + 1


_CLASS, _CHANNELS = _classes()
_POOLED = 3 * _FILTERS + 2 + 2 * len(_SHAPES)
#: Values whose maxima are made from each place on; ranges up to _LONG are covered by some of these.
_WIDE, _LONG = 8, 64
#: Bits of a count, where the counts of a span's kinds and changes are one number; spans with as many bytes are counted by themselves.
_BITS = 12
_ONE_OF = np.where(_KIND > 0, np.uint64(1) << (np.maximum(_KIND, 1) - 1).astype(np.uint64) * np.uint64(_BITS), 0).astype(np.uint64)
_CHANGE = len(_SHAPES)


def candidates(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and text numbers of the candidates."""
    run = np.zeros(len(body) + 2, bool)
    _RUN.take(body, out=run[1:-1], mode="clip")
    edges = np.flatnonzero(run[1:] != run[:-1])
    starts, ends = edges[::2], edges[1::2]
    within = at[1:-1]
    within = np.unique(within[run[within] & run[within + 1]])
    if len(within):  # runs end with their text
        starts, ends = (np.sort(np.concatenate([x, within]), kind="stable") for x in (starts, ends))
    long = ends - starts >= MIN_CHARS
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


@dataclass
class Part:
    """What a part of a batch holds: findings of the patterns and candidates, in bytes of body and in code points of their texts."""

    body: np.ndarray
    at: np.ndarray
    base: np.ndarray  # rows of text number, start, stop, kind (code points), value start, value end (bytes)
    starts: np.ndarray  # candidates, in bytes
    ends: np.ndarray
    of: np.ndarray

    @cached_property
    def inner(self) -> np.ndarray:
        """The bytes that don't begin a code point."""
        return np.flatnonzero((self.body & 0xC0) == 0x80)

    def code_points(self, places: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of places in bytes, within the texts that they are of."""
        begins = self.at - np.searchsorted(self.inner, self.at)
        return places - np.searchsorted(self.inner, places) - begins[of]

    @cached_property
    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        return kind_totals(self.body)

    @cached_property
    def counts(self) -> np.ndarray:
        """What the candidates are made of."""
        return kind_counts(self.body, self.starts, self.ends, self.totals)

    @cached_property
    def numbers(self) -> np.ndarray:
        """Whether each candidate is a number: with digits, without a letter."""
        digits, lower, upper, *_ = self.counts
        return (lower + upper == 0) & (digits > 0)


def to_search(texts: pa.Array, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Numbers of the texts that the patterns may find something in: with a run as long as ACCESS and HEX want, or with what ASSIGN begins with."""
    may = pc.match_substring_regex(texts, _LEAD, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
    may[of[ends - starts >= 20]] = True
    return np.flatnonzero(may)


def found_in(batch: pa.RecordBatch) -> Part:
    texts = batch.column("text")
    body, at = joined(texts)
    starts, ends, of = candidates(body, at)
    some = to_search(texts, starts, ends, of)
    rows = [(i, *span) for i, text in zip(some.tolist(), texts.take(pa.array(some)).to_pylist(), strict=True) for span in base_spans(text)]
    base = np.array(rows, np.int64).reshape(-1, 6)
    if len(base):
        first = (body & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
        byte_of = np.append(np.flatnonzero(first), len(body))
        # code points of a text to bytes of the part
        bytes_at = {c: byte_of[base[:, c] + points[at[base[:, 0]]]] for c in (1, 2, 4, 5)}
        step = np.zeros(len(body) + 1, np.int64)
        np.add.at(step, bytes_at[1], 1)
        np.add.at(step, bytes_at[2], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
        free = covered[ends] - covered[starts] < ends - starts
        starts, ends, of = starts[free], ends[free], of[free]
        base[:, 4], base[:, 5] = bytes_at[4], bytes_at[5]
    return Part(body, at, base, starts, ends, of)


@dataclass(frozen=True)
class Network:
    """All weights in one vector, and mean and spread of the features, which only bring the shapes to one scale (0 and 1 for the filters)."""

    flat: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    floor: int = -MOST  # candidates of lower margins need not be written


@dataclass(frozen=True)
class Calibration:
    scale: float
    shift: float
    threshold: float  # in margins
    state: str  # "kept", or "clash": no threshold keeps recall and false share


_SIZES = (_WIDTH * _CHANNELS * _FILTERS, _FILTERS, _POOLED, 1)


def views(flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kernel (_WIDTH x _CHANNELS x _FILTERS), bias, dense layer and offset within a vector of weights."""
    kernel, bias, dense, offset = np.split(flat, np.cumsum(_SIZES)[:-1])
    return kernel.reshape(_WIDTH, _CHANNELS, _FILTERS), bias, dense, offset


OTHER, SECRET, NUMBER = range(3)


def kind_totals(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte its kind and whether it is of another than the byte before, as counts in one number; and their sums before each byte."""
    each, kind = _ONE_OF.take(body, mode="clip"), _KIND.take(body, mode="clip")
    each[1:] += (kind[1:] != kind[:-1]).astype(np.uint64) << np.uint64(_BITS * _CHANGE)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return each, total


def kind_counts(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, totals: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """How many bytes of each span are of each kind and, last, how often the kind changes within it: a row a count."""
    if not len(starts):
        return np.zeros((_CHANGE + 1, 0), np.int64)
    each, total = totals or kind_totals(body)
    sums = total[ends] - total[starts] - (each[starts] >> np.uint64(_BITS * _CHANGE) << np.uint64(_BITS * _CHANGE))
    fields = [sums >> np.uint64(_BITS * k) & np.uint64((1 << _BITS) - 1) for k in range(_CHANGE + 1)]
    out = np.stack(fields).view(np.int64)
    for i in np.flatnonzero(ends - starts >= 1 << _BITS).tolist():
        kind = _KIND[body[starts[i] : ends[i]]]
        out[:, i] = *np.bincount(kind, minlength=_CHANGE + 1)[1:], np.count_nonzero(kind[1:] != kind[:-1])
    return out


def sides(part: Part) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends (bytes) and text numbers of the labelled findings of each side."""
    out = {}
    _, lower, upper, *_ = kind_counts(part.body, part.base[:, 4], part.base[:, 5], part.totals)
    out[SECRET] = tuple(part.base[lower + upper > 0, c] for c in (4, 5, 0))
    number = part.numbers
    for side, of in ((OTHER, ~number), (NUMBER, number)):
        out[side] = (part.starts[of], part.ends[of], part.of[of])
    return out


def tables(kernel: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
    """The kernel as sums for pairs of neighbouring classes, and for the last class with the bias; class _CHANNELS adds nothing."""
    padded = np.concatenate([kernel, np.zeros((_WIDTH, 1, _FILTERS), np.float32)], axis=1)
    pairs = [(padded[k][:, None, :] + padded[k + 1][None, :, :]).reshape(-1, _FILTERS) for k in range(0, _WIDTH - 1, 2)]
    return (*pairs, padded[-1] + bias)


_ROOMS = threading.local()


def _room(name: str, n: int) -> np.ndarray:
    """n rows of filters to write to, kept from call to call of a thread; large ones are new ones."""
    if n > 4 * _BLOCK:
        return np.empty((n, _FILTERS), np.float32)
    rooms = vars(_ROOMS)
    if len(rooms.get(name, ())) < n:
        rooms[name] = np.empty((4 * _BLOCK, _FILTERS), np.float32)
    return rooms[name][:n]


def convolved(made: tuple[np.ndarray, ...], classes: np.ndarray) -> np.ndarray:
    """The filters at each place, the kernel centred on it; beyond the ends nothing. The next call may write over it."""
    half, n = _WIDTH // 2, len(classes)
    wide = np.full(n + 2 * half, _CHANNELS)
    wide[half : half + n] = classes
    two = wide[:-1] * (_CHANNELS + 1) + wide[1:]
    out, more = _room("convolved", n), _room("more", n)
    made[-1].take(wide[_WIDTH - 1 :], axis=0, mode="clip", out=out)
    for k, pair in enumerate(made[:-1]):
        out += pair.take(two[2 * k : 2 * k + n], axis=0, mode="clip", out=more)
    return out


def _ranges_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The maxima over [low, high) of each, not below 0; 0 where that is empty.

    A range shorter than _WIDE gets its maximum from two of a power of two values, others from as many of _WIDE values as cover it.
    """
    size = high - low
    most = int(size.max(initial=0))
    level, width, short = values, 1, []
    while width < _WIDE and width <= most:  # level: the maxima of the width values from each place on
        some = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(some):
            short.append((some, np.maximum(level.take(low[some], axis=0, mode="clip"), level.take(high[some] - width, axis=0, mode="clip"))))
        width *= 2
        if width <= most:
            level = np.maximum(level[: -(width // 2)], level[width // 2 :], out=_room(f"level {width}", len(level) - width // 2))
    if most < _WIDE:
        out = np.zeros((len(low), values.shape[1]), np.float32)
    else:
        end = high - _WIDE
        out, more = level.take(low, axis=0, mode="clip"), _room("more", len(low))
        for place in (np.minimum(low + _WIDE, end), end):
            np.maximum(out, level.take(place, axis=0, mode="clip", out=more), out=out)
        for covered in range(2 * _WIDE, min(_LONG, most) - _WIDE, _WIDE):
            some = np.flatnonzero((size > covered + _WIDE) & (size <= _LONG))
            out[some] = np.maximum(out[some], level.take(low[some] + covered, axis=0, mode="clip"))
        some = np.flatnonzero(size > _LONG)
        if len(some):
            out[some] = np.maximum(out[some], np.maximum.reduceat(level, np.stack([low[some], end[some]], axis=1).ravel(), axis=0)[::2])
        out[size < 1] = 0
    for some, best in short:
        out[some] = best
    return np.maximum(out, 0, out=out)


def shapes(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each candidate: logarithm of its length, share and presence of each kind, and number of changes between kinds of characters."""
    out = np.empty((len(size), _POOLED - 3 * _FILTERS), np.float32)
    out[:, 0] = np.log(size)
    for k in range(_CHANGE):
        out[:, 1 + 2 * k] = counts[k] / size
        out[:, 2 + 2 * k] = counts[k] > 0
    out[:, -1] = counts[-1] / size
    return out


def pooled(kernel: np.ndarray, bias: np.ndarray, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, counts: np.ndarray | None = None, made: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """The features of candidates sorted by start: filters over each, over what is before it (from lows) and after it (to highs), shapes.

    Runs of candidates whose bytes fit into a block share one convolution; a longer candidate is read block by block.
    counts, made: kind_counts of the candidates and tables of the kernel, where they are known.
    """
    out = np.zeros((len(starts), _POOLED), np.float32)
    made, edge, i = made or tables(kernel, bias), _WIDTH // 2, 0
    while i < len(starts):
        first = int(max(0, lows[i] - edge))
        j = max(i + 1, int(np.searchsorted(ends, first + _BLOCK)))
        last = int(min(len(body), highs[i:j].max() + edge))
        s, e, low, high = (x[i:j] for x in (starts, ends, lows, highs))
        views_of = [(s, e), (low, s), (e, high)] if (low < s).any() or (e < high).any() else [(s, e)]
        if last - first <= 2 * _BLOCK:
            conv = convolved(made, _CLASS.take(body[first:last], mode="clip"))
            best = _ranges_max(conv, np.concatenate([a for a, _ in views_of]) - first, np.concatenate([b for _, b in views_of]) - first)
            for view in range(len(views_of)):
                out[i:j, view * _FILTERS : (view + 1) * _FILTERS] = best[view * (j - i) : (view + 1) * (j - i)]
        else:
            for view, (a, b) in enumerate((int(a[0]), int(b[0])) for a, b in views_of):
                best = out[i, view * _FILTERS : (view + 1) * _FILTERS]
                for k in range(a, b, _BLOCK):
                    stop = min(b, k + _BLOCK)
                    left = max(0, k - edge)
                    conv = convolved(made, _CLASS[body[left : min(len(body), stop + edge)]])
                    np.maximum(best, conv[k - left : stop - left].max(0), out=best)
        i = j
    if len(starts):
        out[:, 3 * _FILTERS :] = shapes(ends - starts, kind_counts(body, starts, ends) if counts is None else counts)
    return out


def surroundings(part: Part) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate where the bytes before it begin and those after it end, within its text."""
    return np.maximum(part.starts - CONTEXT, part.at[part.of]), np.minimum(part.ends + CONTEXT, part.at[part.of + 1])


def scaled(net: Network, features: np.ndarray) -> np.ndarray:
    """The features with their shapes brought to one scale, in place."""
    form = features[:, 3 * _FILTERS :]
    form -= net.mean[3 * _FILTERS :]
    form /= net.spread[3 * _FILTERS :]
    return features


def margins(net: Network, features: np.ndarray) -> np.ndarray:
    """Of each the margin, over 0 for what looks like a secret, in steps of 1 / STEPS. The features are scaled in place."""
    _, _, dense, offset = views(net.flat)
    return np.clip(np.floor((scaled(net, features) @ dense + offset[0]) * STEPS), -MOST, MOST).astype(np.int32)


Window = tuple[int, int, bytes]


def _laid(windows: list[Window]) -> tuple[np.ndarray, ...]:
    """Windows (bytes before the value, its size, bytes) end to end with gaps, and starts, ends, lows, highs of their values."""
    gap = b"\0" * _WIDTH
    sizes = np.array([len(w) + len(gap) for _, _, w in windows])
    lows = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = lows + np.array([b for b, _, _ in windows])
    ends = starts + np.array([n for _, n, _ in windows])
    return np.frombuffer(gap.join([w for _, _, w in windows]) + gap, np.uint8), starts, ends, lows, lows + sizes - len(gap)


@dataclass
class Shown:
    """Values that a step is shown: where they lie in body, their label (1 or -1), and the weight of all."""

    body: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    label: int
    weight: float
    doubt: bool = False  # leave out those that look most like secrets
    counts: np.ndarray | None = None  # kind_counts, where they are known


def _both(windows: list[Window], label: int, weight: float) -> list[Shown]:
    """Windows as they stand and without surroundings, half the weight each."""
    return [Shown(*_laid(shown), label, weight / 2) for shown in (windows, [_bare(w) for w in windows])] if windows else []


def _first_places(made: tuple[np.ndarray, ...], classes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Range, filter and first place of each maximum over 0 of the ranges [low, high)."""
    if len(classes) > 2 * _BLOCK:  # few ranges, read block by block
        best, place, edge = np.zeros((len(low), _FILTERS), np.float32), np.full((len(low), _FILTERS), -1), _WIDTH // 2
        for i in range(len(low)):
            for k in range(int(low[i]), int(high[i]), _BLOCK):
                stop, left = min(int(high[i]), k + _BLOCK), max(0, k - edge)
                conv = convolved(made, classes[left : stop + edge])[k - left : stop - left]
                here, top = conv.argmax(0), conv.max(0)
                place[i] = np.where(top > best[i], here + k, place[i])
                best[i] = np.maximum(best[i], top)
        row, f = np.nonzero(place >= 0)
        return row, f, place[row, f]
    conv = convolved(made, classes)
    best, size = _ranges_max(conv, low, high), high - low
    owner = np.repeat(np.arange(len(low)), size)
    at = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)
    peak = best[owner]
    hit, f = np.nonzero((conv[at] == peak) & (peak > 0))
    _, first = np.unique(owner[hit] * _FILTERS + f, return_index=True)
    return owner[hit[first]], f[first], at[hit[first]]


class Learner:
    """Adam on the squared hinge loss."""

    def __init__(self, net: Network, rate: float):
        self.net = Network(net.flat.copy(), net.mean, net.spread)
        self.rate, self.t = rate, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)

    def step(self, groups: list[Shown]) -> None:
        flat, grad = self.net.flat, np.zeros_like(self.net.flat)
        kernel, bias, dense, offset = views(flat)
        _, _, of_dense, of_offset = views(grad)
        of_dense += 1e-4 * dense
        made = tables(kernel, bias)
        for s in groups:
            x = scaled(self.net, pooled(kernel, bias, s.body, s.starts, s.ends, s.lows, s.highs, s.counts, made))
            z = x @ dense + offset[0]
            d = (-2 * s.label * s.weight / len(z) * np.maximum(0, 1 - s.label * z)).astype(np.float32)
            if s.doubt:
                d[np.argsort(-z, kind="stable")[: int(DOUBTFUL * len(z))]] = 0
            on = np.flatnonzero(d)
            of_dense += x[on].T @ d[on]
            of_offset += d[on].sum()
            # windows of about a block together; a longer one by itself
            sizes, i = np.cumsum(s.highs[on] - s.lows[on] + 2 * (_WIDTH // 2)), 0
            while i < len(on):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + 2 * _BLOCK, side="right")))
                self._back(s, on[i:j], d[on[i:j]], made, grad)
                i = j
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        self.net.flat[:] = flat - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)

    def _back(self, s: Shown, some: np.ndarray, d: np.ndarray, made: tuple[np.ndarray, ...], grad: np.ndarray) -> None:
        """Each maximum passes its gradient to the first place that reached it."""
        edge, dense = _WIDTH // 2, views(self.net.flat)[2]
        of_kernel, of_bias, _, _ = views(grad)
        low, high = s.lows[some] - edge, s.highs[some] + edge
        at = np.concatenate([[0], np.cumsum(high - low)])
        place = np.arange(at[-1]) + np.repeat(low - at[:-1], high - low)
        classes = np.where((place >= 0) & (place < len(s.body)), _CLASS[s.body.take(place, mode="clip")], _CHANNELS)
        move = at[:-1] - low
        starts, ends, lows, highs = (x[some] + move for x in (s.starts, s.ends, s.lows, s.highs))
        for view, (a, b) in enumerate(((starts, ends), (lows, starts), (ends, highs))):
            row, f, where = _first_places(made, classes, a, b)
            back = d[row] * dense[view * _FILTERS + f]
            of_bias += np.bincount(f, back, _FILTERS).astype(np.float32)
            for k in range(_WIDTH):
                near = where + k - edge
                ok = (near >= 0) & (near < len(classes))
                sums = np.bincount(classes[near[ok]] * _FILTERS + f[ok], back[ok], (_CHANNELS + 1) * _FILTERS)
                of_kernel[k] += sums.reshape(-1, _FILTERS)[:_CHANNELS].astype(np.float32)


def _bare(window: Window) -> Window:
    """The value without its surroundings."""
    before, size, data = window
    return 0, size, data[before : before + size]


def _fitted(windows: list[Window], labels: np.ndarray, used: np.ndarray, epochs: int, batch: int, rng: np.random.Generator) -> Network:
    """A network from drawn windows, both sides weighted alike."""
    kernel, dense = rng.normal(0, 0.1, _SIZES[0]), rng.normal(0, 0.1, _POOLED)
    flat = np.concatenate([kernel, np.zeros(_FILTERS), dense, np.zeros(1)]).astype(np.float32)
    body, starts, ends, _, _ = _laid([windows[k] for k in used])
    form = shapes(ends - starts, kind_counts(body, starts, ends))
    mean, spread = np.zeros(_POOLED, np.float32), np.ones(_POOLED, np.float32)
    mean[3 * _FILTERS :], spread[3 * _FILTERS :] = form.mean(0), form.std(0) + 1e-2
    learner, share = Learner(Network(flat, mean, spread), RATES[0]), labels[used].mean()
    for _ in range(epochs):
        turn = rng.permutation(used)
        for i in range(0, len(turn), batch):
            groups = []
            for y, part in ((1, share), (0, 1 - share)):
                pick = [windows[k] for k in turn[i : i + batch] if labels[k] == y]
                if pick:
                    groups.append(Shown(*_laid(pick), 2 * y - 1, 0.5 / part * len(pick) / batch))
            learner.step(groups)
    return learner.net


def judged(net: Network, windows: list[Window]) -> np.ndarray:
    """The margins of windows."""
    if not windows:
        return np.zeros(0, np.int32)
    body, starts, ends, lows, highs = _laid(windows)
    kernel, bias, _, _ = views(net.flat)
    return margins(net, pooled(kernel, bias, body, starts, ends, lows, highs))


def begun(windows: list[Window], labels: np.ndarray, numbers: np.ndarray, epochs: int = 5, batch: int = 64, seed: int = 5) -> Network:
    """Two fits over drawn findings, the second without doubtful negatives (numbers are none)."""
    rng = np.random.default_rng(seed)
    used = np.arange(len(labels))
    # every second window is shown as it stands, the others without surroundings
    shown = [_bare(w) if rng.random() < 0.5 else w for w in windows]
    first = _fitted(shown, labels, used, max(1, epochs // 2), batch, rng)
    negative = np.flatnonzero((labels == 0) & ~numbers)
    z = judged(first, [shown[k] for k in negative])
    doubtful = negative[np.argsort(-z, kind="stable")[: int(DOUBTFUL * len(negative))]]
    return _fitted(shown, labels, np.delete(used, doubtful), epochs, batch, rng)


def parts_of(counts: dict[int, int]) -> dict[int, float]:
    """Weight of each side, 1 in all: half for the secrets; numbers have NUMBERS of the other half, fewer if there are few."""
    most = {NUMBER: START * NUMBERS, OTHER: START * (1 - NUMBERS)}
    n = {side: min(counts.get(side, 0), x) for side, x in most.items()}
    return {SECRET: 0.5, **{side: 0.5 * n[side] / max(1, sum(n.values())) for side in n}}


def calibrated(side: np.ndarray, z: np.ndarray, n: np.ndarray) -> Calibration:
    """Scale, shift and threshold from how often (n) each margin z occurs among the calibrating findings of each side."""
    each = {k: int(n[side == k].sum()) for k in range(3)}
    weight = n * np.array([x / max(1, each[k]) for k, x in sorted(parts_of(each).items())])[side]
    x, y, share = z / STEPS, side == SECRET, weight / max(weight.sum(), 1e-9)
    scale, shift = 1.0, 0.0
    for _ in range(200):  # logistic regression on one number, held near the identity
        e = (1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30))) - y) * share
        scale, shift = max(scale - 0.02 * ((e * x).sum() + 0.01 * (scale - 1)), 0.05), shift - 0.1 * (e.sum() + 0.01 * shift)
    return Calibration(float(scale), float(shift), *recall_threshold(z[y], z[~y], n[y], weight[~y]))


def recall_threshold(positive: np.ndarray, negative: np.ndarray, of_positive: np.ndarray | None = None, of_negative: np.ndarray | None = None) -> tuple[float, str]:
    """The largest threshold that finds RECALL of the positives, and "kept"; one that nothing reaches, and "clash", if too many negatives pass it.

    of_positive: how often each positive counts; of_negative: how much each negative weighs; 1 if not given.
    """
    of_positive = np.ones(len(positive), np.int64) if of_positive is None else of_positive
    of_negative = np.ones(len(negative)) if of_negative is None else of_negative
    if not len(positive):
        return 1.1, "clash"
    order = np.argsort(positive, kind="stable")
    upto = np.cumsum(of_positive[order])
    threshold = float(positive[order[np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right")]])
    return (threshold, "kept") if of_negative[negative >= threshold].sum() <= FALSE_SHARE * of_negative.sum() else (1.1, "clash")


def drawn(part: Part, ids: np.ndarray, row: int, of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each finding a number in [0, 1) and whether it calibrates, by a hash of the text's id, the place and the row's number in its task.

    So copies of a text are drawn one by one.
    """
    salt = mixed(ids[of] + (row + of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = mixed(salt + (starts - part.at[of]).astype(np.uint64))
    return (h >> np.uint64(11)).astype(float) * 2.0**-53, (h & np.uint64(3)) == 0


def window(part: Part, start: int, end: int, of: int) -> Window:
    """The value with its surroundings."""
    a, b = max(int(part.at[of]), int(start) - CONTEXT), min(int(part.at[of + 1]), int(end) + CONTEXT)
    return int(start) - a, int(end - start), part.body[a:b].tobytes()


_FOUND = [("side", pa.int32()), ("h", pa.float64()), ("n", pa.int64()), ("before", pa.int32()), ("size", pa.int32()), ("window", pa.binary())]


def findings(docs: DataFrame, start: int = START) -> DataFrame:
    """docs(id, text) -> side, h, n, before, size, window: of each task the findings of least h in [0, 1) that do not calibrate, start of each
    side at most, and, with h null, how many (n) of that side do not calibrate. Sides: OTHER, SECRET, NUMBER.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kept, bound, row = {k: 0 for k in range(3)}, {k: [] for k in range(3)}, {k: 1.0 for k in range(3)}, 0
        for batch in (p for whole in batches for p in parts(whole, "text", PART)):
            part = found_in(batch)
            ids = batch.column("id").to_numpy().view(np.uint64)
            for side, (starts, ends, of) in sides(part).items():
                h, held = drawn(part, ids, row, of, starts)
                counts[side] += int((~held).sum())
                near = np.flatnonzero(~held & (h < bound[side]))
                for k in near[np.argsort(h[near], kind="stable")[:start]].tolist():
                    kept[side].append((float(h[k]), *window(part, starts[k], ends[k], of[k])))
                if len(kept[side]) > 2 * start:
                    kept[side] = sorted(kept[side])[:start]
                    bound[side] = kept[side][-1][0]
            row += batch.num_rows
        out = [(side, None, counts[side], None, None, None) for side in counts]
        out += [(side, h, 1, *rest) for side in kept for h, *rest in sorted(kept[side])[:start]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_FOUND)], [n for n, _ in _FOUND])

    return docs.select("id", "text").mapInArrow(run, "side int, h double, n long, before int, size int, window binary")


def _shown(part: Part, chosen: tuple[np.ndarray, ...], counts: np.ndarray, bare: np.ndarray, weight: float) -> list[Shown]:
    """The other candidates of a part: some without surroundings, end to end with gaps, the others as they stand in it."""
    out = []
    starts, ends, of = (x[~bare] for x in chosen)
    if len(starts):
        lows, highs = np.maximum(starts - CONTEXT, part.at[of]), np.minimum(ends + CONTEXT, part.at[of + 1])
        out.append(Shown(part.body, starts, ends, lows, highs, -1, weight * len(starts) / len(bare), True, counts[:, ~bare]))
    starts, ends, _ = (x[bare] for x in chosen)
    if len(starts):
        size = ends - starts
        at = np.cumsum(size + _WIDTH) - size - _WIDTH
        body = np.zeros(int(at[-1] + size[-1]) + _WIDTH, np.uint8)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        body[np.repeat(at, size) + within] = part.body[np.repeat(starts, size) + within]
        out.append(Shown(body, at, at + size, at, at + size, -1, weight * len(starts) / len(bare), True, counts[:, bare]))
    return out


def trained(docs: DataFrame, net: Network, weights: dict[int, float], known: dict[int, list[Window]], turn: int = 0, step: int = STEP) -> Network:
    """One pass: every task steps from net through all its findings that do not calibrate; the mean of the tasks' networks.

    known: drawn secrets and numbers, which fill up the steps whose own are few. Of the other candidates each half is shown
    without surroundings in every second turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, n, row = Learner(net, RATES[1]), 0, 0
        queues = {side: deque(known[side], maxlen=START) for side in (SECRET, NUMBER)}
        for batch in (p for whole in batches for p in parts(whole, "text", step)):
            part = found_in(batch)
            ids = batch.column("id").to_numpy().view(np.uint64)
            groups: list[Shown] = []
            for side, (starts, ends, of) in sides(part).items():
                h, held = drawn(part, ids, row, of, starts)
                starts, ends, of, h = (x[~held] for x in (starts, ends, of, h))
                n += len(starts)
                if side == OTHER:
                    counts = part.counts[:, ~part.numbers][:, ~held]
                    groups += _shown(part, (starts, ends, of), counts, (h * START % 1 < 0.5) == turn % 2, weights[side])
                    continue
                queue = queues[side]
                own = [window(part, *x) for x in zip(starts, ends, of, strict=True)]
                more = min(LEAST[side - 1] - len(own), len(queue))
                groups += _both(own + [queue[k] for k in range(more)], 2 * (side == SECRET) - 1, weights[side])
                queue.rotate(-max(0, more))
                queue.extend(own)
            row += batch.num_rows
            if groups:
                learner.step(groups)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([learner.net.flat.astype(float)], pa.list_(pa.float64()))], ["n", "flat"])

    tasks = docs.select("id", "text").mapInArrow(run, "n long, flat array<double>").select("n", F.posexplode("flat").alias("at", "x"))
    mean = tasks.groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).orderBy("at").collect()  # one row a weight
    return Network(np.array([r.x for r in mean], np.float32), net.mean, net.spread) if mean else net


def fit(docs: DataFrame, start: int = START, rounds: int = ROUNDS) -> Network | None:
    """A network from all findings of docs(id, text) that do not calibrate."""
    found = materialize(findings(docs, start))
    counts = {r.side: r["n"] for r in found.filter("h IS NULL").groupBy("side").agg(F.sum("n").alias("n")).collect()}
    wanted = {SECRET: start, NUMBER: start * NUMBERS, OTHER: start * (1 - NUMBERS)}
    share = F.create_map(*[F.lit(x) for k, n in wanted.items() for x in (k, n / max(1, counts.get(k) or 0))])
    rows = found.filter(F.col("h") < share[F.col("side")]).orderBy("h", "window").collect()
    side = np.array([r.side for r in rows], np.int64)
    labels = (side == SECRET).astype(float)
    if len(rows) < 8 or labels.min() == labels.max():
        return None
    windows = [(r["before"], r["size"], bytes(r["window"])) for r in rows]
    known = {k: [w for w, of in zip(windows, side, strict=True) if of == k] for k in (SECRET, NUMBER)}
    net, weights = begun(windows, labels, side == NUMBER), parts_of(counts)
    step = min(STEP, max(STEP // 16, 16 * sum(counts.values()) // PACE))  # there is a finding in about 16 bytes
    for turn in range(rounds):
        net = trained(docs, net, weights, known, turn, step)
    z = judged(net, [w for w, of in zip(windows, side, strict=True) if of != SECRET])
    return replace(net, floor=int(np.sort(z)[-1 - int(FLOOR * len(z))]))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("z", pa.int32())])
_HELD = pa.struct([("side", pa.int32()), ("z", pa.int32()), ("n", pa.int64())])


def judgements(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(doc_id, id, text) -> doc_id, spans, held. Spans, by start, then kind: the findings of the patterns (z null) and, with a network,
    all other candidates from the network's floor on with their margins z. held, in some rows: how many calibrating findings of a side have a margin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in (p for whole in batches for p in parts(whole, "text", PART)):
            part = found_in(batch)
            rows, z, held = part.base[:, :4], np.zeros(len(part.base), np.int32), []
            if net is not None:
                kernel, bias, _, _ = views(net.flat)
                of_candidates = margins(net, pooled(kernel, bias, part.body, part.starts, part.ends, *surroundings(part), part.counts))
                near = np.flatnonzero(of_candidates >= net.floor)
                of = part.of[near]
                here = np.stack([of, part.code_points(part.starts[near], of), part.code_points(part.ends[near], of), np.full(len(of), len(KINDS))], axis=1)
                rows, z = np.concatenate([rows, here]), np.concatenate([z, of_candidates[near]])
                ids = batch.column("id").to_numpy().view(np.uint64)
                for side, (starts, ends, of) in sides(part).items():
                    use = np.flatnonzero(drawn(part, ids, row, of, starts)[1])
                    if side == SECRET:
                        of_side = judged(net, [window(part, starts[k], ends[k], of[k]) for k in use])
                    else:
                        of_side = of_candidates[np.searchsorted(part.starts, starts[use])]
                    at, times = np.unique(of_side, return_counts=True)
                    held.append(np.stack([np.full(len(at), side), at, times]))
            row += batch.num_rows
            if len(part.base):  # candidates alone are in order
                order = np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))
                rows, z = rows[order], z[order]
            columns = [pa.array(rows[:, c].astype(np.int32)) for c in (3, 1, 2)] + [pa.array(z, mask=rows[:, 3] < len(KINDS))]
            ends = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))
            side, at, times = np.concatenate(held or [np.zeros((3, 0), np.int64)], axis=1)
            columns = [pa.array(side.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(times)]
            first = np.full(batch.num_rows + 1, len(side), np.int32)
            first[0] = 0  # all in the part's first row
            counted = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(columns, fields=list(_HELD)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans, counted], ["doc_id", "spans", "held"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:int,start:int,stop:int,z:int>>, held array<struct<side:int,z:int,n:long>>")


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: array<struct<kind, start, stop, score>> in code points, stop exclusive, and network.

    By start, then kind (assign, access, hex, model). Spans of the patterns have score 1. network tells whether the network
    kept its recall ("kept"), or adds nothing because it could not ("clash") or had nothing to learn from ("untrained").
    """
    source = docs.select("doc_id", F.xxhash64("doc_id").alias("id"), text_or_empty(F.col("text")).alias("text"))
    net = fit(source)
    rows, state, found = judgements(source, net), "untrained", Calibration(1.0, 0.0, 0.0, "untrained")
    if net is not None:
        rows = materialize(rows)
        counts = rows.select(F.inline("held")).groupBy("side", "z").agg(F.sum("n").alias("n")).collect()  # a row a side and margin
        found = calibrated(*(np.array([r[k] for r in counts], np.int64) for k in ("side", "z", "n")))
        if found.state == "kept" and found.threshold < net.floor:  # the drawn negatives misled
            rows = materialize(judgements(source, replace(net, floor=int(found.threshold))))
        state = found.state

    def passes(span):
        return span["z"].isNull() | (F.lit(state == "kept") & (span["z"] >= found.threshold))

    def written(span):
        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), span["z"] / STEPS * found.scale + found.shift))
        return F.struct(
            F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "model")]), span["kind"] + 1).alias("kind"),
            span["start"].cast("long").alias("start"),
            span["stop"].cast("long").alias("stop"),
            F.when(span["z"].isNull(), 1.0).otherwise(1 / (1 + F.exp(-logit))).alias("score"),
        )

    return rows.select("doc_id", F.transform(F.filter("spans", passes), written).alias("spans"), F.lit(state).alias("network"))
