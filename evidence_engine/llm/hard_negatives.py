"""Hard-negative mining by exact inner products in integers, behind a filter of segment summaries.

A vector is cut into segments; each has its mean and its deviation (the length of what is left without the mean). The
inner product of two segments is n * mean * mean, plus or minus at most deviation * deviation. Summed over the segments
this bounds a score; finer segments bound it closer. Pairs are judged by 1, 4 and 16 segments in turn, and only those
whose bounds reach what an anchor still looks for are scored exactly.

Anchors are a stated query set. They are taken in blocks of bounded size, one after another; a block goes to all tasks and
each task reads its own part of the rows against it, so the rows are never dealt out or repeated. Before that, a hash share
of the rows gives each list a score that its last place has at least; with it a task sends on only what may still stand in
a list, whatever the number of tasks. The lists themselves always come from all rows.

Rows with a null label, a null vector, or a component that is null or not finite take no part. A vector that is shorter
than the longest counts as filled up with zeros. A null id comes last among equal scores and is never an anchor (ids are
integers). Other rows than the anchor's are those of another id; rows that repeat an id each count; an anchor that is
repeated as a whole counts once. Components of any finite size are exact; a score beyond the range of long counts as its
nearest end. An empty table, or one without anchors, gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.vectors import LONG, finite, integers, matrix, with_integers
from evidence_engine.plans.materialize import materialize, shared_dir

#: Anchors of a block: what the driver and each task hold of them, some 500 bytes each and five lists of ten.
ANCHORS = 8192

#: One of so many rows, by hash, gives the lists their first thresholds.
SHARE = 8

#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)

#: Rows and anchors that meet at a time.
ROWS, MEET = 2048, 1024

#: Above this share of pairs left, a level judges the whole block at once, below it pair by pair. The outcome is the same.
DENSE = 0.2

#: By how much bounds give way, relative to the lengths of both vectors: far above the rounding of 32-bit summaries.
SLACK = 1e-5

#: Finds that a task holds before it keeps the best of each list.
BUFFER = 1 << 20

_ROW = "id long, label {}, ints binary, wide string, summary binary"


def summaries(rows: np.ndarray) -> np.ndarray:
    """Of each row and level: the means times the root of the segment's size, then the deviations."""
    out = []
    for n in LEVELS:
        parts = rows.reshape(len(rows), n, rows.shape[1] // n)
        mean = parts.mean(axis=2)
        out += [mean * math.sqrt(parts.shape[2]), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))]
    return np.concatenate(out, axis=1)


@dataclass
class Block:
    """Rows as numpy: id, code of the label (-1: none of the anchors'), integers of the narrow rows, Python integers of the wide."""

    ids: np.ndarray
    labels: np.ndarray
    narrow: np.ndarray  #: indices of narrow rows
    ints: np.ndarray
    summary: np.ndarray
    wide: dict[int, list[int]]

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table, labels: pa.Array, width: int) -> Block:
        column = {c: (x.combine_chunks() if isinstance(x := batch.column(c), pa.ChunkedArray) else x) for c in ("id", "label", "ints", "wide", "summary")}
        valid = column["ints"].is_valid()
        narrow = np.flatnonzero(valid.to_numpy(zero_copy_only=False))
        code = pc.fill_null(pc.index_in(column["label"], value_set=labels), -1).to_numpy(zero_copy_only=False)
        ints = matrix(column["ints"].filter(valid), "<i4", width).astype(float)
        summary = matrix(column["summary"].filter(valid), "<f4", 2 * sum(LEVELS)).astype(float)
        wide = {i: integers(None, text) for i, text in enumerate(column["wide"].to_pylist()) if text is not None}
        return Block(column["id"].to_numpy(zero_copy_only=False), code, narrow, ints, summary, wide)

    def level(self, n: int, of: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations of some narrow rows (by their place among those) at a level."""
        at = 2 * sum(LEVELS[:n])
        return self.summary[of, at : at + LEVELS[n]], self.summary[of, at + LEVELS[n] : at + 2 * LEVELS[n]]

    def whole(self, i: int) -> list[int]:
        return self.wide[i] if i in self.wide else self.ints[np.searchsorted(self.narrow, i)].astype(np.int64).tolist()


@dataclass
class Lists:
    """What is looked for: for each list its anchor (ascending), the range of scores, and a place that the last entry has at least."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray
    id: np.ndarray
    size: int
    same: bool  #: rows of the anchor's label, or of other labels

    @staticmethod
    def of(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, same: bool) -> Lists:
        return Lists(anchor, low, high, np.full(len(anchor), -LONG - 1), np.full(len(anchor), LONG), size, same)

    def ranges(self, anchors: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor, the least and greatest score that any of its lists can still take."""
        low, high = np.full(anchors, LONG), np.full(anchors, -LONG - 1)
        np.minimum.at(low, self.anchor, np.maximum(self.low, self.score))
        np.maximum.at(high, self.anchor, self.high)
        return low.astype(float), high.astype(float)


class Finds:
    """The best of each list among the rows that a task has read."""

    def __init__(self, lists: Lists, anchors: int):
        self.lists, self.anchors = lists, anchors
        self.score, self.id = lists.score.copy(), lists.id.copy()
        self.first = np.searchsorted(lists.anchor, np.arange(anchors + 1))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0
        self.low, self.high = lists.ranges(anchors)

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        many = self.first[anchor + 1] - self.first[anchor]
        of = np.repeat(np.arange(len(anchor)), many)
        each = self.first[anchor][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        s, k = score[of], ids[of]
        ok = (s >= self.lists.low[each]) & (s <= self.lists.high[each]) & ((s > self.score[each]) | ((s == self.score[each]) & (k <= self.id[each])))
        self.held.append((each[ok], s[ok], k[ok]))
        self.count += int(ok.sum())
        if self.count > BUFFER:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the best of each list, and raise the thresholds to the last of full ones."""
        each, s, k = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((k, ~s, each))  # ~s: descending, without overflow
        each, s, k = each[order], s[order], k[order]
        place = np.arange(len(each)) - np.searchsorted(each, each)
        keep = place < self.lists.size
        last = np.flatnonzero(place == self.lists.size - 1)
        self.score[each[last]], self.id[each[last]] = s[last], k[last]
        low = np.full(self.anchors, LONG)
        np.minimum.at(low, self.lists.anchor, np.maximum(self.lists.low, self.score))
        self.low = low.astype(float)
        self.held, self.count = [(each[keep], s[keep], k[keep])], int(keep.sum())
        return self.held[0]


def left_over(rows: Block, some: np.ndarray, anchors: Block, to: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places among some and to, and exact scores, of the pairs of narrow rows that the bounds leave in."""
    length = [np.sqrt((x.summary[of, :2] ** 2).sum(axis=1)) for x, of in ((rows, some), (anchors, to))]
    mask = np.ones((len(some), len(to)), bool) if allowed is None else allowed
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(len(LEVELS)):
        (a, d), (b, e) = rows.level(n, some), anchors.level(n, to)
        if pairs is None and mask.mean() > DENSE:
            inner, spread = a @ b.T, d @ e.T + SLACK * np.outer(*length) + 0.5
            mask = mask & (inner + spread >= low) & (inner - spread <= high)
        else:
            i, j = pairs or np.nonzero(mask)
            inner = np.einsum("ij,ij->i", a[i], b[j])
            spread = np.einsum("ij,ij->i", d[i], e[j]) + SLACK * length[0][i] * length[1][j] + 0.5
            ok = (inner + spread >= low[j]) & (inner - spread <= high[j])
            pairs = i[ok], j[ok]
    if pairs is None and mask.mean() > DENSE:
        exact = rows.ints[some] @ anchors.ints[to].T
        i, j = np.nonzero(mask & (exact >= low) & (exact <= high))
        return i, j, exact[i, j].astype(np.int64)
    i, j = pairs or np.nonzero(mask)
    cuts = range(0, max(len(i), 1), 1 << 17)
    exact = np.concatenate([np.einsum("ij,ij->i", rows.ints[some[i[c : c + (1 << 17)]]], anchors.ints[to[j[c : c + (1 << 17)]]]) for c in cuts])
    return i, j, exact.astype(np.int64)


def meet(rows: Block, anchors: Block, finds: Finds) -> None:
    """Score a block of rows against all anchors."""
    same = finds.lists.same
    labels = rows.labels[rows.narrow]
    anchor_labels = anchors.labels[anchors.narrow]
    groups = [(np.flatnonzero(labels == x), np.flatnonzero(anchor_labels == x)) for x in np.intersect1d(labels, anchor_labels)] if same else [(np.arange(len(labels)), np.arange(len(anchor_labels)))]
    for some, to in groups:
        for at in range(0, len(some), ROWS):
            for by in range(0, len(to), MEET):
                r, a = some[at : at + ROWS], to[by : by + MEET]
                of, own = anchors.narrow[a], rows.narrow[r]
                allowed = rows.ids[own][:, None] != anchors.ids[of] if same else labels[r][:, None] != anchor_labels[a]
                i, j, score = left_over(rows, r, anchors, a, finds.low[of], finds.high[of], allowed)
                finds.add(of[j], score, rows.ids[own[i]])
    # wide rows or anchors: one by one, in Python's integers
    pairs = [(i, j) for i in rows.wide for j in range(len(anchors.ids))] + [(i, j) for j in anchors.wide for i in rows.narrow.tolist()]
    for i, j in pairs:
        if (rows.labels[i] == anchors.labels[j]) == same and not (same and rows.ids[i] == anchors.ids[j]):
            score = sum(x * y for x, y in zip(rows.whole(i), anchors.whole(j), strict=True))
            finds.add(np.array([j]), np.array([max(-LONG - 1, min(LONG, score))]), rows.ids[[i]])


def best_of(rows: DataFrame, anchors: Block, labels: pa.Array, lists: Lists, width: int) -> DataFrame:
    """list, place (from 1), score, id: the best entries of each list among the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = Finds(lists, len(anchors.ids))
        for batch in batches:
            meet(Block.of(batch, labels, width), anchors, finds)
        each, score, ids = finds.best()
        yield pa.RecordBatch.from_arrays([pa.array(each.astype(np.int32)), pa.array(score), pa.array(ids)], ["list", "score", "id"])

    found = rows.mapInArrow(run, "list int, score long, id long")
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= lists.size)


def with_thresholds(rows: DataFrame, anchors: Block, labels: pa.Array, lists: Lists, width: int) -> Lists:
    """The lists, where a share of the rows fills one, with its last entry there as a place that the true last one has at least."""
    part = rows.filter(F.pmod(F.xxhash64("id", "ints"), F.lit(SHARE)) == 0)
    last = best_of(part, anchors, labels, lists, width).filter(F.col("place") == lists.size).toArrow()
    of = last["list"].to_numpy()
    lists.score[of], lists.id[of] = last["score"].to_numpy(), last["id"].to_numpy()
    return lists


def prepared(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """id, label, ints, wide, summary of the rows, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column("ints").is_valid()
            body = summaries(matrix(batch.column("ints").filter(valid), "<i4", width).astype(float)).astype("<f4").tobytes()
            step = 8 * sum(LEVELS)
            made = iter(range(0, len(body), step))
            told = [body[(at := next(made)) : at + step] if ok else None for ok in valid.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.binary())], [*batch.schema.names, "summary"])

    most = math.isqrt(2**52 // width)  # inner products stay exact as doubles
    rows = with_integers(vectors, "vector", width, scale, min(most, 2**31 - 1))
    return materialize(rows.mapInArrow(run, _ROW.format(vectors.schema["label"].dataType.simpleString())))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor row and each of its first positives (other rows of its label, best score first, ties by the smaller id):
    the first negatives (rows of other labels, in the same order) whose score lies between low and high per cent of the
    positive's. A score is the inner product of floor(scale * component).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(LONG)).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & finite(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(LEVELS[-1], -(-longest // LEVELS[-1]) * LEVELS[-1])
    whole = prepared(rows.drop("anchor"), width, scale)
    queries = materialize(prepared_anchors(rows, width, scale))
    blocks = -(-queries.count() * 9 // (ANCHORS * 8))  # by hash: some hold more than the mean, none much more
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for n in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("id", "label", "ints", "wide"), F.lit(blocks)) == n).toArrow()
        labels = pc.unique(table["label"])
        labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
        mined(whole, Block.of(table, labels, width), labels, width, positives, negatives, low, high).write.mode("append").parquet(out)
    found = spark.read.schema(schema).parquet(out) if blocks else spark.createDataFrame([], schema)
    return found.withColumns({c: F.nullif(c, F.lit(LONG)) for c in ("positive_id", "negative_id")})


def prepared_anchors(rows: DataFrame, width: int, scale: int) -> DataFrame:
    return prepared(rows.filter("anchor").drop("anchor"), width, scale).distinct()


def mined(rows: DataFrame, anchors: Block, labels: pa.Array, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one block of anchors."""
    n = len(anchors.ids)
    anywhere = np.full(n, -LONG - 1), np.full(n, LONG)
    lists = with_thresholds(rows, anchors, labels, Lists.of(np.arange(n), *anywhere, positives, True), width)
    table = best_of(rows, anchors, labels, lists, width).toArrow()  # at most positives x ANCHORS rows
    order = np.lexsort((table["place"].to_numpy(), table["list"].to_numpy()))
    anchor, score, ids = (table[c].to_numpy()[order] for c in ("list", "score", "id"))
    least = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)
    most = np.array([high * s // 100 for s in score.tolist()], np.int64)
    ok = least <= most
    lists = Lists.of(anchor[ok].astype(np.int64), least[ok], most[ok], negatives, False)
    told = pa.table({"list": pa.array(np.arange(int(ok.sum()), dtype=np.int32)), "anchor_id": anchors.ids[anchor[ok]], "positive_id": ids[ok], "positive_score": score[ok]})
    known = rows.sparkSession.createDataFrame(told) if len(told) else rows.sparkSession.createDataFrame([], "list int, anchor_id long, positive_id long, positive_score long")
    found = best_of(rows, anchors, labels, with_thresholds(rows, anchors, labels, lists, width), width)
    return found.join(F.broadcast(known), "list").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
