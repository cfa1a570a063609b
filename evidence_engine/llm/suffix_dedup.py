"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes when a string of LENGTH bytes that covers it also starts in a document with a smaller id. Such strings are
found by sorting suffixes, with two savings that lose nothing:

* Suffixes are sorted at anchors only. Each window of LENGTH bytes has one anchor, the place in it where the hash of
  GRAM bytes is least (the leftmost such place), which depends on the window's bytes alone; equal windows have equal
  anchors. An anchor serves the run of windows that chose it and stands for the LENGTH bytes from it and, reversed, the up
  to LENGTH - GRAM bytes before it.
* Duplicate detection by fingerprints first: an anchor whose GRAM bytes occur nowhere else has no equal windows. Chunks
  of documents send the sorted hashes of their anchors, packed, to hash ranges, which answer with one bit for each.

What remains is sorted in each chunk. Of equal entries there, the one of the least document goes on and the others'
windows are settled at once, so copies are combined before they move. The sorted runs go, front-coded (the length of the
prefix shared with the entry before, and the rest), to ranges of the alphabet, cut by GRAM bytes at quantiles of a
sample. Each range merges its runs by a loser tree whose nodes know the prefix they share with the last winner: the
longer shared prefix wins without a look at the bytes, and equal ones are compared from there on. The merged order
with its shared prefixes tells, for each offset of a window from its anchor, which entries hold the same
window, hence its least document. The spans return to the chunks of their documents.

A gram so frequent that it would fill a range alone is in no range: entries that differ after it can still share windows
that lie mostly before it. Its entries send each of their windows instead, as a 64-bit hash of the window's bytes, to hash
ranges; of a chunk's equal windows only those of its least document go on, so a frequent window costs a record a chunk.

A chunk is a function of the document's id and text, so texts move once and rows of equal or null ids are spread. The number of chunks and ranges grows with the input; a
chunk is CHUNK bytes, or one document if that is longer.

Nulls: a null text counts as empty; a null id ranks below all others. Rows of equal id do not remove each other's
bytes. An empty table gives an empty result. Ids are read as long integers: ids that are no integers are an error. A very long
text is a chunk of its own, held whole in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.arrays import _BYTE, joined, mixed, parts, powers
from evidence_engine.llm.columns import text_or_empty

LENGTH, GRAM = 50, 20
CHUNK = 8 << 20
#: Documents, about, whose anchors give the cuts of the ranges; of larger tables a thousandth.
SAMPLE, SHARE = 2000, 1000
#: Most ranges of the alphabet, which bounds the cuts that each task gets (20 bytes each) and the sample that gives them.
RANGES = 1 << 16
#: Places within a text; 31 bits, for no text is longer.
_PLACE = np.uint64((1 << 31) - 1)
_HASH_BITS, _LOW_BITS = 48, 32
_LOWEST = -(2**63)
#: Entries whose windows are hashed at once.
_SLICE = 1 << 15


class Shape:
    """The lengths that follow from LENGTH and GRAM."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.before = length - gram  # bytes before an anchor that a window can hold
        self.row = length + self.before + 2  # and the least and the largest offset served


def anchors(body: np.ndarray, at: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts laid end to end: place, first and last window start that it serves, hash of its gram."""
    n, none = len(body), np.zeros(0, np.int64)
    if n < shape.length:
        return none, none, none, np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * power[:-1], out=sums[1:])
    h = mixed((sums[shape.gram :] - sums[: -shape.gram]) * inverse[: n - shape.gram + 1])
    least, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    span = shape.before + 1
    while width < span:
        step = min(width, span - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    room = np.repeat(at[1:], np.diff(at))[: len(least)] - np.arange(len(least))
    starts = np.flatnonzero(room >= shape.length)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    p = place[head]
    return p, starts[head], starts[np.append(head[1:], len(starts)) - 1], h[p] >> np.uint64(64 - _HASH_BITS)


def rows_of(body: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, shape: Shape) -> np.ndarray:
    """The entries: bytes from the anchor as far as its windows reach, then those before it, reversed; rest 0; the offsets."""
    out = np.zeros((len(p), shape.row), np.uint8)
    right, left = np.arange(shape.length), np.arange(shape.before)
    padded = np.concatenate([body, np.zeros(shape.length, np.uint8)])
    out[:, : shape.length] = np.where(p[:, None] + right < (high + shape.length)[:, None], padded[p[:, None] + right], 0)
    out[:, shape.length : -2] = np.where(p[:, None] - 1 - left >= low[:, None], padded[p[:, None] - 1 - left], 0)
    out[:, -2], out[:, -1] = p - high, p - low
    return out


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """For each row the length of the prefix it shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    lcp = shared_prefix(rows)
    return lcp.astype(np.uint8).tobytes(), rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes()


def from_front_coded(lcp: bytes, tails: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    shared = np.frombuffer(lcp, np.uint8).astype(np.int64)
    own = np.arange(width) >= shared[:, None]
    source = np.where(own, np.arange(len(shared), dtype=np.int32)[:, None], np.int32(0))
    np.maximum.accumulate(source, axis=0, out=source)
    filled = np.zeros((len(shared), width), np.uint8)
    filled[own] = np.frombuffer(tails, np.uint8)
    return filled[source, np.arange(width)], shared


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs (rows, shared prefixes): the order, as places in the runs laid end to end, and its shared prefixes."""
    width = runs[0][0].shape[1]
    first = np.concatenate([[0], np.cumsum([len(r) for r, _ in runs])]).tolist()
    data = np.concatenate([r for r, _ in runs]).tobytes()
    known = np.concatenate([s for _, s in runs]).tolist()
    ends = first[1:]
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    at = first[:-1] + [0] * (leaves - len(runs))
    lcp = [0] * len(runs) + [-1] * (leaves - len(runs))  # with the last winner; -1: the run is at its end
    for k in range(len(runs)):
        if at[k] == ends[k]:
            lcp[k] = -1
    read = int.from_bytes

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser. The loser keeps the prefix it shares with the winner."""
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if la < lb:
            return b, a
        if la < 0:
            return a, b
        x = data[at[a] * width + la : (at[a] + 1) * width]
        y = data[at[b] * width + la : (at[b] + 1) * width]
        if x == y:
            lcp[b] = width
            return a, b
        same = width - (((read(x, "big") ^ read(y, "big")).bit_length() + 7) >> 3)
        if x < y:
            lcp[b] = same
            return a, b
        lcp[a] = same
        return b, a

    losers = [0] * leaves
    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    order, shared = [], []
    while lcp[top] >= 0:
        here = at[top]
        order.append(here)
        shared.append(lcp[top])
        here += 1
        at[top] = here
        lcp[top] = known[here] if here < ends[top] else -1
        node = (leaves + top) >> 1
        while node:
            top, losers[node] = match(top, losers[node])
            node >>= 1
    return np.asarray(order, np.int64), np.asarray(shared, np.int64)


def repeated(rows: np.ndarray, lcp: np.ndarray, doc: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the merged order the least and largest offset of a window that a smaller document has; -1: none."""
    n = len(rows)
    least, most = np.full(n, -1), np.full(n, -1)
    # entries alone with their gram have no equal windows
    group = np.cumsum(lcp < shape.gram) - 1
    many = np.bincount(group)[group] > 1
    pick = np.flatnonzero(many)
    if not len(pick):
        return least, most
    low, high, who = rows[pick, -2].astype(int), rows[pick, -1].astype(int), doc[pick]
    left = np.zeros(len(pick), np.uint64)
    for offset in range(shape.before + 1):
        if offset:
            left = left * np.uint64(0x9E3779B97F4A7C15) + _BYTE[rows[pick, shape.length + offset - 1]]
        on = np.flatnonzero((low <= offset) & (offset <= high))
        if len(on) < 2:
            continue
        block = np.cumsum(lcp < shape.length - offset)[pick[on]].astype(np.uint64)
        key = mixed(mixed(block) + left[on])
        order, head = grouped(key, block, rows[pick[on], shape.length : shape.length + offset])
        smallest = np.minimum.reduceat(who[on][order], head)
        smaller = np.repeat(smallest, np.diff(np.append(head, len(order)))) < who[on][order]
        hit = pick[on[order[smaller]]]
        most[hit] = offset
        least[hit] = np.where(least[hit] < 0, offset, least[hit])
    return least, most


def grouped(key: np.ndarray, block: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (block, left) together, and where each group begins. key: their hash, which saves the comparison of most bytes."""
    order = np.argsort(key, kind="stable")
    for exact in (False, True):
        if exact:  # different bytes have one hash: sort by the bytes themselves
            order = np.lexsort((*left.T[::-1], block))
        k, b, x = key[order], block[order], left[order]
        other = (b[1:] != b[:-1]) | (x[1:] != x[:-1]).any(1)
        if exact or not (other & (k[1:] == k[:-1])).any():
            break
    return order, np.flatnonzero(np.concatenate([[True], other]))


def windows_of(rows: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the entries: the entry, the offset of the window's start before the anchor, the hash of its bytes."""
    wide = shape.before + shape.length
    power, inverse = powers(wide + 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for first in range(0, len(rows), _SLICE):
        some = rows[first : first + _SLICE]
        line = np.concatenate([some[:, shape.length : -2][:, ::-1], some[:, : shape.length]], axis=1)
        sums = np.zeros((len(some), wide + 1), np.uint64)
        np.cumsum(_BYTE[line] * power[:wide], axis=1, out=sums[:, 1:])
        for offset in range(shape.before + 1):
            on = np.flatnonzero((some[:, -2] <= offset) & (offset <= some[:, -1]))
            h = mixed((sums[on, wide - offset] - sums[on, shape.before - offset]) * inverse[shape.before - offset])
            found.append((on + first, np.full(len(on), offset), h))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def union(start: np.ndarray, stop: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of the same owner as one, sorted."""
    if not len(start):
        return start, stop, of
    order = np.lexsort((start, of))
    start, stop, of = start[order], stop[order], of[order]
    wide = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + of * wide) - of * wide
    new = np.ones(len(start), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return start[head], reach[np.append(head[1:], len(start)) - 1], of[head]


class _Chunk:
    """The documents of a chunk in an order that does not depend on how they came: by id, then text."""

    def __init__(self, table: pa.Table, shape: Shape):
        rows = table.select(["id", "body"]).sort_by([("id", "ascending"), ("body", "ascending")]).combine_chunks()
        self.batches = [p for b in rows.to_batches(max_chunksize=max(1, rows.num_rows)) for p in parts(b, "body")]
        self.shape = shape

    def each(self):
        """(number of the first document, ids, bytes, borders) of each part."""
        first = 0
        for b in self.batches:
            body, at = joined(b.column("body"))
            yield first, b.column("id").to_numpy(), body, at
            first += b.num_rows

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct hashes of the anchors, and which of them more than one document of the chunk has."""
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, ids, body, at in self.each():
            p, _, _, h = anchors(body, at, self.shape)
            found.append(h)
            owner.append(ids[np.searchsorted(at, p, side="right") - 1])
        h, o = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(head):
            return h, np.zeros(0, bool)
        return h[head], np.minimum.reduceat(o, head) != np.maximum.reduceat(o, head)


def _bucket_bits(chunks: int) -> int:
    """Hash ranges are powers of two, about as many as chunks."""
    return min(_HASH_BITS - _LOW_BITS, max(2, (max(1, chunks) - 1).bit_length()))


def _bounds(h: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(h, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(_HASH_BITS - bits))


def fingerprints_sent(table: pa.Table, bits: int, shape: Shape) -> pa.Table:
    """A chunk's hashes, one row for each hash range: the low 32 bits of each, and how many share each value of the bits above."""
    h, _ = _Chunk(table, shape).hashes()
    at, fine = _bounds(h, bits), 1 << (_HASH_BITS - _LOW_BITS - bits)
    chunk = table.column("chunk")[0].as_py()
    rows = []
    for k in np.flatnonzero(np.diff(at)):
        part = h[at[k] : at[k + 1]]
        counts = np.bincount((part >> np.uint64(_LOW_BITS)).astype(np.int64) - k * fine, minlength=fine)
        rows.append((int(k), chunk, part.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes()))
    return _table(rows, [("bucket", pa.int32()), ("chunk", pa.int32()), ("low", pa.binary()), ("counts", pa.binary())])


def fingerprints_met(table: pa.Table) -> pa.Table:
    """For each chunk's hashes of a hash range one bit: whether another chunk has it."""
    lows, counts = table.column("low").to_pylist(), table.column("counts").to_pylist()
    hashes = []
    for low, count in zip(lows, counts, strict=True):
        count = np.frombuffer(count, np.uint32)
        hashes.append(np.frombuffer(low, np.uint32) | np.repeat(np.arange(len(count), dtype=np.uint64), count) << np.uint64(_LOW_BITS))
    every = np.sort(np.concatenate(hashes))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    bits = [np.packbits(np.isin(h, twice, assume_unique=True)).tobytes() for h in hashes]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


_RUN = [("part", pa.int32()), ("chunk", pa.int32()), ("lcp", pa.binary()), ("tails", pa.binary()), ("ids", pa.binary()), ("nth", pa.binary()), ("place", pa.binary()), ("done", pa.binary())]


def runs_sent(texts: pa.Table, answers: pa.Table, bits: int, cuts: np.ndarray, hot: np.ndarray, shape: Shape) -> pa.Table:
    """The sorted, front-coded runs of a chunk, one row for each range, with what is settled within the chunk.

    The windows of hot grams go to as many hash ranges, numbered after the others: hashes as tails, window starts as places.
    """
    if not texts.num_rows:
        return _table([], _RUN)
    chunk = _Chunk(texts, shape)
    h, several = chunk.hashes()
    at, wanted = _bounds(h, bits), several.copy()
    for bucket, packed in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        n = at[bucket + 1] - at[bucket]
        wanted[at[bucket] : at[bucket + 1]] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    rows, ids, nth, place = [], [], [], []
    for first, doc_ids, body, borders in chunk.each():
        p, low, high, hashes = anchors(body, borders, shape)
        on = wanted[np.searchsorted(h, hashes)]
        p, low, high = p[on], low[on], high[on]
        doc = np.searchsorted(borders, p, side="right") - 1
        rows.append(rows_of(body, p, low, high, shape))
        ids.append(doc_ids[doc])
        nth.append(doc + first)
        place.append(p - borders[doc])
    rows, ids, nth, place = np.concatenate(rows), np.concatenate(ids), np.concatenate(nth), np.concatenate(place)
    order = np.argsort(rows.view(f"S{shape.row}").ravel(), kind="stable")
    rows, ids, nth, place = rows[order], ids[order], nth[order], place[order]
    # of equal entries the least document goes on; the windows of larger ones are settled
    head = np.flatnonzero(shared_prefix(rows) < shape.row)
    if not len(head):
        return _table([], _RUN)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(rows))))
    smallest = np.minimum.reduceat(ids, head)
    settled = ids > smallest[group]
    start = place[settled] - rows[settled, -1]
    stop = place[settled] - rows[settled, -2] + shape.length
    owner = nth[settled]
    # nothing ranks below the lowest id, so one of its equal entries is enough
    again = ids == _LOWEST
    again[head] = False
    go_on = ~settled & ~again
    rows, ids, nth, place = rows[go_on], ids[go_on], nth[go_on], place[go_on]
    grams = np.ascontiguousarray(rows[:, : shape.gram]).view(f"S{shape.gram}").ravel()
    frequent = np.isin(grams, hot)
    of, offset, window = windows_of(rows[frequent], shape)
    w_ids, w_nth, w_place = ids[frequent][of], nth[frequent][of], place[frequent][of] - offset
    ranges = len(cuts) + 1
    target = (window % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((w_ids, window, target))
    target, window, w_ids, w_nth, w_place = target[order], window[order], w_ids[order], w_nth[order], w_place[order]
    new = np.ones(len(window), bool)
    new[1:] = window[1:] != window[:-1]
    larger = w_ids > w_ids[np.maximum.accumulate(np.where(new, np.arange(len(window)), 0))]
    start, stop, owner = np.concatenate([start, w_place[larger]]), np.concatenate([stop, w_place[larger] + shape.length]), np.concatenate([owner, w_nth[larger]])
    done = np.stack(union(start, stop, owner)).astype(np.int64)
    go_on = ~larger & (new | (w_ids != _LOWEST))
    target, window, w_ids, w_nth, w_place = target[go_on], window[go_on], w_ids[go_on], w_nth[go_on], w_place[go_on]
    rows, ids, nth, place, grams = rows[~frequent], ids[~frequent], nth[~frequent], place[~frequent], grams[~frequent]
    which = np.searchsorted(cuts, grams, side="right")
    number = texts.column("chunk")[0].as_py()
    bounds = np.searchsorted(which, np.arange(len(cuts) + 2))
    out = []
    for k in np.flatnonzero(np.diff(bounds)):
        s = slice(bounds[k], bounds[k + 1])
        out.append((int(k), number, *front_coded(rows[s]), ids[s].astype(np.int64).tobytes(), nth[s].astype(np.int32).tobytes(), place[s].astype(np.int32).tobytes(), b""))
    bounds = np.searchsorted(target, np.arange(ranges + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        s = slice(bounds[k], bounds[k + 1])
        out.append((int(k) + ranges, number, b"", window[s].tobytes(), w_ids[s].astype(np.int64).tobytes(), w_nth[s].astype(np.int32).tobytes(), w_place[s].astype(np.int32).tobytes(), b""))
    out[0] = (*out[0][:-1], done.tobytes())
    return _table(out, _RUN)


_SPANS = [("chunk", pa.int32()), ("nth", pa.binary()), ("start", pa.binary()), ("stop", pa.binary())]


def range_merged(table: pa.Table, ranges: int, shape: Shape) -> pa.Table:
    """The spans that a range finds repeated, one row for each chunk. Ranges from number ranges on hold windows."""
    hashed = table.column("part")[0].as_py() >= ranges
    runs = [] if hashed else [from_front_coded(a, b, shape.row) for a, b in zip(table.column("lcp").to_pylist(), table.column("tails").to_pylist(), strict=True)]
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    nth, place = (np.concatenate([np.frombuffer(x, np.int32) for x in table.column(c).to_pylist()]) for c in ("nth", "place"))
    chunks = table.column("chunk").to_numpy()
    chunk = np.repeat(chunks, [len(x) // 8 for x in table.column("ids").to_pylist()])
    if hashed:
        window = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tails").to_pylist()])
        order = np.argsort(window, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], window[order[1:]] != window[order[:-1]]]))
        smallest = np.repeat(np.minimum.reduceat(ids[order], head), np.diff(np.append(head, len(order))))
        of = order[ids[order] > smallest]
        found = [(chunk[of], nth[of], place[of], place[of] + shape.length)]
    else:
        order, lcp = merge(runs)
        rows = np.concatenate([r for r, _ in runs])[order]
        least, most = repeated(rows, lcp, ids[order], shape)
        hit = most >= 0
        of = order[hit]
        found = [(chunk[of], nth[of], place[of] - most[hit], place[of] - least[hit] + shape.length)]
    for number, done in zip(chunks, table.column("done").to_pylist(), strict=True):
        if done:
            start, stop, owner = np.frombuffer(done, np.int64).reshape(3, -1)
            found.append((np.full(len(start), number), owner, start, stop))
    chunk, nth, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(chunk, kind="stable")
    chunk, nth, start, stop = chunk[by], nth[by], start[by], stop[by]
    head = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
    out = [(int(chunk[a]), *(x[a:b].astype(np.int32).tobytes() for x in (nth, start, stop))) for a, b in zip(head, np.append(head[1:], len(chunk)), strict=True)]
    return _table(out, _SPANS)


_KEPT = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())]


def chunk_cut(texts: pa.Table, spans: pa.Table, shape: Shape) -> pa.Table:
    """The documents of a chunk without the spans found."""
    if not texts.num_rows:
        return _table([], _KEPT)
    nth, start, stop = (np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in spans.column(c).to_pylist())]).astype(np.int64) for c in ("nth", "start", "stop"))
    start, stop, nth = union(start, stop, nth)
    out = []
    for first, ids, body, at in _Chunk(texts, shape).each():
        bounds = np.searchsorted(nth, first + np.arange(len(ids) + 1))
        data = body.tobytes()
        for i, doc_id in enumerate(ids.tolist()):
            text = data[at[i] : at[i + 1]]
            own = list(zip(start[bounds[i] : bounds[i + 1]].tolist(), stop[bounds[i] : bounds[i + 1]].tolist(), strict=True))
            kept, last = [], 0
            for a, b in own:
                kept.append(text[last:a])
                last = b
            kept.append(text[last:])
            out.append((doc_id, len(text), sum(b - a for a, b in own), [{"start": a, "stop": b} for a, b in own], b"".join(kept)))
    return _table(out, _KEPT)


def ranges_of(grams: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the alphabet at quantiles of the sorted sample, and the grams that are several quantiles: too frequent for a range."""
    if not len(grams):
        return grams, grams
    cuts, times = np.unique(grams[np.linspace(0, len(grams), chunks, endpoint=False).astype(int)[1:]], return_counts=True)
    return cuts, cuts[times > 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, spans (array<struct<start, stop>>, bytes), kept (binary).

    The ids of chunks and ranges depend on the size of the input alone; the result does not depend on them.
    """
    shape, lowest = Shape(length, gram), _LOWEST
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), text_or_empty(F.col("text")).alias("body"))
    n, total = source.agg(F.count(F.lit(1)), F.sum(F.octet_length("body"))).first()
    chunks = max(1, -(-(total or 0) // chunk_bytes))
    bits = _bucket_bits(chunks)

    def sampled(batches):
        for whole in batches:
            for b in parts(whole, "body"):
                body, at = joined(b.column("body"))
                p = anchors(body, at, shape)[0][::16]
                yield pa.RecordBatch.from_arrays([pa.array([body[x : x + gram].tobytes() for x in p], pa.binary())], ["gram"])

    # about sample documents, chosen by a hash of their id, cut the alphabet into as many ranges as there are chunks
    few = source.filter(F.pmod(F.xxhash64("id", "body"), F.lit(max(1, min(SHARE, n // sample)))) == 0)
    sample_rows = few.mapInArrow(sampled, "gram binary")
    ranges = min(chunks, RANGES)
    if chunks > RANGES:  # the sample of a very large table is thinned to what its cuts need
        sample_rows = sample_rows.filter(F.pmod(F.xxhash64("gram"), F.lit(chunks // RANGES)) == 0)
    grams = np.sort(np.array(sample_rows.toArrow()["gram"].to_pylist(), f"S{gram}"))
    cuts, hot = ranges_of(grams, ranges)

    texts = source.select(F.pmod(F.xxhash64("id", "body"), F.lit(chunks)).cast("int").alias("chunk"), "id", "body")
    sent = texts.groupBy("chunk").applyInArrow(lambda t: fingerprints_sent(t, bits, shape), "bucket int, chunk int, low binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(fingerprints_met, "chunk int, bucket int, bits binary")
    runs = (
        texts.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(lambda a, b: runs_sent(a, b, bits, cuts, hot, shape), "part int, chunk int, lcp binary, tails binary, ids binary, nth binary, place binary, done binary")
    )
    spans = runs.groupBy("part").applyInArrow(lambda t: range_merged(t, len(cuts) + 1, shape), "chunk int, nth binary, start binary, stop binary")
    cut = texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(lambda a, b: chunk_cut(a, b, shape), "id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return cut.select(F.when(F.col("id") != lowest, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")
