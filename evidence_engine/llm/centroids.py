"""Centroid clustering in exact integers, filtered by n-simplex projection.

A few pivots among the vectors span a simplex. A vector's distances to the pivots, taken once and cached, are the edges to
an apex over that simplex: its coordinates in the span and its height over it. For two apexes the distance of their
coordinates is a lower bound of the true distance where both heights point to one side, and an upper bound where they
point to opposite sides. In each round a centroid whose lower bound exceeds the least upper bound of a vector cannot be
its nearest; the others are compared exactly, in integers.

Each round is one job: tasks assign their rows and add up vectors for each centroid; Spark adds the partial sums, and the
driver sees one sum for each centroid and component. A lost executor costs its tasks.

Nulls and others: rows whose vector is null, has another number of components, or a component that is null or not finite,
are left out. A null id stays and seeds only where too few other rows do. Rows that repeat an id, or a vector, each count.
Equal hashes are ordered by the vectors. Fewer rows than centroids give fewer centroids; an empty table gives no rows.
Components of any finite size are exact; a distance or sum beyond the range of long counts as the greatest long. Other
columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.vectors import LONG, finite, integers, limit_of, matrix, to_float, with_integers
from evidence_engine.plans.materialize import materialize

#: Pivots of the projection at most; fewer where the vectors span fewer dimensions.
PIVOTS = 12

#: Vectors, in the order of their hashes, among which the pivots are chosen. They only steer the filter, not the result.
SAMPLE = 512

#: A pivot's squared height over the others, relative to the greatest squared distance, at least.
LEAST_HEIGHT = 1e-3

#: By how much bounds give way, relative to the squared distances to the first pivot: far above what rounding can do.
SLACK = 1e-5

#: Bits of a limb of the sums, so that limbs of many tasks add up within a long.
_LIMB = 32


@dataclass
class Simplex:
    """The pivots, and what turns distances to them into the coordinates of an apex."""

    pivots: np.ndarray
    edges: np.ndarray  #: row j: coordinates of pivot j + 1; its last is its height over the pivots before it

    def apex(self, squared: np.ndarray) -> np.ndarray:
        """Rows of squared distances to the pivots -> squared distance to the first, coordinates, height."""
        n, m = len(squared), len(self.pivots)
        out = np.zeros((n, m + 1))
        if not m:
            out[:] = np.nan
            return out
        rest = squared[:, 0].astype(float)
        out[:, 0] = rest
        for j in range(1, m):
            own = self.edges[j - 1]
            half = (out[:, 0] + (own[:j] ** 2).sum() - squared[:, j]) / 2
            out[:, j] = (half - out[:, 1:j] @ own[: j - 1]) / own[j - 1]
            rest = rest - out[:, j] ** 2
        out[:, m] = np.sqrt(np.maximum(rest, 0))
        return out

    def project(self, rows: np.ndarray) -> np.ndarray:
        """The apexes of narrow rows, from exact distances."""
        return self.apex(np.stack([squares(rows, p) for p in self.pivots], axis=1) if len(self.pivots) else np.zeros((len(rows), 0)))

    def project_wide(self, row: list[int]) -> np.ndarray:
        return self.apex(np.array([[to_float(distance(row, p.tolist())) for p in self.pivots]]))


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of narrow rows to a narrow point."""
    apart = rows.astype(np.int64) - point
    return np.einsum("ij,ij->i", apart, apart)


def distance(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def simplex(sample: np.ndarray, most: int = PIVOTS) -> Simplex:
    """Pivots out of narrow rows: the first row, then always the row that stands highest over the pivots so far."""
    if not len(sample):
        return Simplex(sample, np.zeros((0, 0)))
    chosen = [0]
    edges = np.zeros((most, most))
    first = squares(sample, sample[0]).astype(float)
    height, at = first.copy(), np.zeros((len(sample), most))
    while len(chosen) < most:
        j, i = len(chosen), int(height.argmax())
        if height[i] <= LEAST_HEIGHT * first.max():
            break
        own = at[i, :j].copy()
        own[j - 1] = np.sqrt(height[i])
        half = (first + first[i] - squares(sample, sample[i])) / 2
        at[:, j - 1] = (half - at[:, : j - 1] @ own[: j - 1]) / own[j - 1]
        height -= at[:, j - 1] ** 2
        edges[j - 1, :j] = own
        chosen.append(i)
    m = len(chosen)
    return Simplex(sample[chosen].astype(np.int64), edges[: m - 1, : m - 1])


@dataclass
class Centroids:
    """Centroids as exact integers, with their apexes."""

    values: list[list[int]]
    apexes: np.ndarray
    narrow: np.ndarray  #: which of them are narrow
    ints: np.ndarray  #: the narrow ones; zeros for the others

    @staticmethod
    def of(values: list[list[int]], base: Simplex, limit: int) -> Centroids:
        narrow = np.array([all(abs(x) < limit for x in v) for v in values], bool)
        ints = np.array([v if ok else [0] * len(v) for v, ok in zip(values, narrow, strict=True)], np.int64)
        apexes = base.project(ints)
        for j in np.flatnonzero(~narrow):
            apexes[j] = base.project_wide(values[j])[0]
        return Centroids(values, apexes, narrow, ints)


def candidates(apexes: np.ndarray, centroids: Centroids) -> np.ndarray:
    """rows x centroids: whether the bounds leave the centroid in. Where a bound is no number, they do."""
    other = centroids.apexes
    size = apexes[:, :1] + other[:, 0]
    inner = apexes[:, 1:-1] @ other[:, 1:-1].T
    heights = np.outer(apexes[:, -1], other[:, -1])
    low, high = size - 2 * (inner + heights), size - 2 * (inner - heights)
    least = np.fmin.reduce(high + SLACK * size, axis=1)
    return ~(low - SLACK * size > least[:, None])


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: Centroids, distances: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The nearest centroid of each narrow row (ties: the smaller number) and, if asked, its squared distance as Python or numpy integers."""
    left = candidates(apexes, centroids)
    label = left.argmax(axis=1)
    if not centroids.narrow.all() and left[:, ~centroids.narrow].any():
        found = [min((distance(row, centroids.values[j]), int(j)) for j in np.flatnonzero(ok)) for row, ok in zip(rows.tolist(), left, strict=True)]
        return np.array([j for _, j in found], np.int64), np.array([d for d, _ in found], object)
    open_rows = np.flatnonzero(left.sum(axis=1) > 1) if not distances else np.arange(len(rows))
    best = np.full(len(rows), LONG, np.int64)
    for j in range(left.shape[1]):
        some = open_rows[left[open_rows, j]]
        if len(some):
            exact = squares(rows[some], centroids.ints[j])
            closer = exact < best[some]
            best[some[closer]] = exact[closer]
            label[some[closer]] = j
    return label, best if distances else None


def nearest_wide(row: list[int], centroids: Centroids) -> tuple[int, int]:
    d, j = min((distance(row, v), j) for j, v in enumerate(centroids.values))
    return j, d


def limbs(sums: list[int]) -> list[list[int]]:
    """Numbers of any size as parts of 32 bits, lowest first; only the last part is signed."""
    out = []
    while True:
        if all(-(2**31) <= x < 2**31 for x in sums):
            return [*out, sums]
        out.append([x & (2**_LIMB - 1) for x in sums])
        sums = [x >> _LIMB for x in sums]


def _split(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, pa.RecordBatch, pa.RecordBatch]:
    """Which rows are narrow; the narrow and the wide ones."""
    narrow = batch.column("ints").is_valid()
    return narrow.to_numpy(zero_copy_only=False), batch.filter(narrow), batch.filter(batch.column("ints").is_null())


def partial_sums(cached: DataFrame, centroids: Centroids, width: int) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has rows: their number and the exact sum of their components."""
    m = centroids.apexes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.values)
        count, total = [0] * k, [[0] * width for _ in range(k)]
        for batch in batches:
            _, narrow, wide = _split(batch, width)
            rows = matrix(narrow.column("ints"), "<i4", width)
            label, _ = nearest(rows, matrix(narrow.column("apex"), "<f8", m), centroids, False)
            for j in np.flatnonzero(np.bincount(label, minlength=k)).tolist():
                own = label == j
                count[j] += int(own.sum())
                total[j] = [a + b for a, b in zip(total[j], rows[own].sum(axis=0, dtype=np.int64).tolist(), strict=True)]
            for text in wide.column("wide").to_pylist():
                row = integers(None, text)
                j, _ = nearest_wide(row, centroids)
                count[j] += 1
                total[j] = [a + b for a, b in zip(total[j], row, strict=True)]
        out = [(j, i, count[j] if i == 0 else 0, part) for j in range(k) if count[j] for i, part in enumerate(limbs(total[j]))]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.int64()))], ["cluster", "limb", "n", "sums"])

    told = cached.select("ints", "wide", "apex").mapInArrow(run, "cluster int, limb int, n long, sums array<long>")
    added = told.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # centroids x limbs rows
        n, sums = out.get(r.cluster, (0, [0] * width))
        out[r.cluster] = n + r.n, [a + (b << _LIMB * r.limb) for a, b in zip(sums, r.sums, strict=True)]
    return out


def assigned(cached: DataFrame, centroids: Centroids, width: int, key: str) -> DataFrame:
    """key, cluster, distance of every row."""
    m = centroids.apexes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_narrow, narrow, wide = _split(batch, width)
            label, far = np.zeros(len(is_narrow), np.int32), np.zeros(len(is_narrow), np.int64)
            own, exact = nearest(matrix(narrow.column("ints"), "<i4", width), matrix(narrow.column("apex"), "<f8", m), centroids, True)
            label[is_narrow], far[is_narrow] = own, np.minimum(exact, LONG).astype(np.int64)
            found = [nearest_wide(integers(None, text), centroids) for text in wide.column("wide").to_pylist()]
            label[~is_narrow] = [j for j, _ in found]
            far[~is_narrow] = [min(d, LONG) for _, d in found]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(label), pa.array(far)], [key, "cluster", "distance"])

    return cached.mapInArrow(run, f"`{key}` {cached.schema[key].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector that counts: key, cluster, distance, cluster_inertia, inertia, centroid (text: its integers joined by commas).

    Centroids start as the k vectors with the smallest sha256 of salt and key. Each round assigns all vectors to the nearest
    centroid by squared distance (ties: the smaller number) and puts each centroid that has vectors to the floor of their mean.
    """
    spark, limit = vectors.sparkSession, limit_of(width)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(finite(F.col("vector")) & (F.size("vector") == width))
    order = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    first = rows.withColumn("mark", order).orderBy(F.asc_nulls_last("mark"), "vector").limit(max(k, SAMPLE))
    sample = with_integers(first.select("mark", "vector"), "vector", width, scale, limit).collect()  # SAMPLE rows
    sample = sorted(((r.mark is None, r.mark or "", integers(r.ints, r.wide)) for r in sample), key=lambda r: r[:3])
    points = [r[2] for r in sample]
    base = simplex(np.array([p for p in points if max(map(abs, p), default=0) < limit], np.int64).reshape(-1, width))
    m = len(base.pivots) + 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, narrow, _ = _split(batch, width)
            body = base.project(matrix(narrow.column("ints"), "<i4", width)).astype("<f8").tobytes()
            made = iter(range(0, len(body), 8 * m))
            apex = [body[(at := next(made)) : at + 8 * m] if ok else None for ok in batch.column("ints").is_valid().to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apex, pa.binary())], [*batch.schema.names, "apex"])

    whole = with_integers(rows, "vector", width, scale, limit)
    cached = materialize(whole.mapInArrow(project, f"key {rows.schema['key'].dataType.simpleString()}, ints binary, wide string, apex binary"))
    values = points[:k]
    for _ in range(rounds if values else 0):
        sums = partial_sums(cached, Centroids.of(values, base, limit), width)
        values = [[s // sums[j][0] for s in sums[j][1]] if j in sums else v for j, v in enumerate(values)]
    final = materialize(assigned(cached, Centroids.of(values, base, limit), width, "key")) if values else cached.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    of = {r.cluster: int(r.total) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}  # one row for each centroid
    everything = min(sum(of.values()), LONG)
    known = spark.createDataFrame([(j, min(of.get(j, 0), LONG), ",".join(map(str, v))) for j, v in enumerate(values)], "cluster int, cluster_inertia long, centroid string")
    return final.join(F.broadcast(known), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", F.lit(everything).cast("long").alias("inertia"), "centroid")


