"""Centroid clustering in whole numbers, with partial-distance search.

A vector of 64 finite components is rounded down to whole numbers, floor(256 x), so that every sum, mean and distance is exact
and no result depends on the order of rows. The nearest centroid is sought by partial distances: squared differences are summed
over blocks of dimensions, those of the highest variance over all vectors first, and a centroid is abandoned once its partial
sum is strictly above the best distance so far, a bound that falls with each centroid that survives all 64 dimensions. Equal
distances survive to the end, where the smaller number wins.

Each round is one pass over the table. Tasks add vectors up by centroid before anything is shuffled, so a pass shuffles at most
as many rows as tasks times centroids, and the driver sees one row for each centroid, however many vectors there are and
however many of them one centroid has. Centroids (40 of 64 numbers) travel with the tasks. A lost task is done again from the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 64
SCALE = 256
BLOCK = 8
#: Components beyond this could make distances whose sum over 1,024 vectors 64 bits can't hold.
LARGEST = 1 << 22


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and x (whole components) of the vectors with exactly 64 components, none null or not finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # NaN is above infinity
    whole = F.transform(e, lambda v: F.floor(v.cast("double") * SCALE))
    small = F.forall(whole, lambda v: v.between(-LARGEST, LARGEST))
    checked = F.when(small, whole).otherwise(F.raise_error(F.concat(F.lit("a component is too large for distances of 64 bits: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return vectors.where((F.size(e) == DIMENSIONS) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), checked.cast("array<int>").alias("x"))


def first_centroids(own: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k kept vectors of smallest sha256 of `seed:vec_id`, in that order; of rows with one vec_id, by components. A null id is an empty one."""
    key = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), "UTF-8"), 256)
    rows = own.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()  # k rows
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def _sums(own: DataFrame, table: Callable[[Iterator[np.ndarray]], np.ndarray], kind: str) -> np.ndarray:
    """The element-wise sum of what table makes of each task's vectors: a matrix of bounded size, of which the driver sees the sum."""
    schema = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("value", pa.int64() if kind == "bigint" else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = table(_matrix(part.column(0)) for part in common.parts(batches))
        row, col = np.nonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(made[row, col])], schema=schema)

    parts = own.select("x").mapInArrow(common.tidy(run), f"row int, col int, value {kind}")
    cells = parts.groupBy("row", "col").agg(F.sum("value").alias("value")).collect()
    made = np.zeros_like(table(iter(())))
    for cell in cells:
        made[cell.row, cell.col] = cell.value
    return made


def by_variance(own: DataFrame) -> np.ndarray:
    """The dimensions, those of the highest variance over all vectors first; ties by number."""

    def table(parts: Iterator[np.ndarray]) -> np.ndarray:
        made = np.zeros((3, DIMENSIONS))  # numbers of vectors, sums, sums of squares
        for x in parts:
            made += [np.full(DIMENSIONS, len(x)), x.sum(0), np.square(x.astype(np.float64)).sum(0)]
        return made

    n, sums, squares = _sums(own, table, "double")
    n = np.maximum(n, 1)
    return np.argsort(-(squares / n - np.square(sums / n)), kind="stable")


@dataclass(frozen=True)
class Search:
    """Nearest centroids. order: the dimensions in the order in which differences are summed."""

    centroids: np.ndarray
    order: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row of x; of the smallest number among the nearest."""
        x, c = x[:, self.order], self.centroids[:, self.order]
        head = np.stack([np.square(x[:, :BLOCK] - own[:BLOCK]).sum(1) for own in c], 1)  # partial sums of the first block
        # The centroid that is nearest so far is finished first, as its distance is a good bound for the others.
        best = head.argmin(1)
        bound = np.square(x - c[best]).sum(1)
        for j in range(len(c)):
            rows = np.flatnonzero((head[:, j] <= bound) & (best != j))
            part = head[rows, j]
            for at in range(BLOCK, DIMENSIONS, BLOCK):
                if not len(rows):
                    break
                part = part + np.square(x[rows, at : at + BLOCK] - c[j, at : at + BLOCK]).sum(1)
                going = part <= bound[rows]
                rows, part = rows[going], part[going]
            wins = (part < bound[rows]) | (j < best[rows])
            rows, part = rows[wins], part[wins]
            best[rows], bound[rows] = j, part
        return best, bound


def _totals(own: DataFrame, search: Search) -> np.ndarray:
    """A row for each centroid: the sums of its vectors' components, how many these are, the sum of their distances."""

    def table(parts: Iterator[np.ndarray]) -> np.ndarray:
        made = np.zeros((len(search.centroids), DIMENSIONS + 2), np.int64)
        for x in parts:
            best, distance = search.nearest(x)
            np.add.at(made, best, np.column_stack((x, np.ones(len(x), np.int64), distance)))
            if made[:, -1].max() > 1 << 62:
                raise OverflowError("the sum of distances is too large for 64 bits")
        return made

    return _sums(own, table, "bigint")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    vectors: vec_id, embedding (array of numbers). A vector that is null, of another length, or with a null, infinite or NaN component
    isn't kept. With fewer than k vectors there are as many centroids. Repeated rows count as often as they occur and get a row each;
    a null vec_id stays null; an empty table gives none; other columns are ignored. A component beyond 2 ** 22 in whole
    numbers is an error that names the vector, and so is a sum of distances beyond 2 ** 62: never a wrong number.
    """
    own = common.small_batches(kept(vectors))
    columns = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = first_centroids(own, k, seed)
    if not len(centroids):
        return own.sparkSession.createDataFrame([], columns)
    order = by_variance(own)
    for _ in range(rounds):
        totals = _totals(own, Search(centroids, order))
        sums, n = totals[:, :DIMENSIONS], totals[:, DIMENSIONS, None]
        centroids = np.where(n > 0, sums // np.maximum(n, 1), centroids)
    search = Search(centroids, order)
    inertias = _totals(own, search)[:, -1].tolist()
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.parts(batches):
            best, distance = search.nearest(_matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(distance)], schema=schema)

    assigned = own.mapInArrow(common.tidy(run), "vec_id bigint, cluster int, distance bigint")

    def told(values: list, kind: str) -> Column:  # one value for each centroid
        return F.array(*map(F.lit, values))[F.col("cluster")].cast(kind)

    return assigned.select("vec_id", "cluster", "distance", told(inertias, "bigint").alias("cluster_inertia"), F.lit(sum(inertias)).cast("bigint").alias("inertia"), told([digest(c) for c in centroids], "string").alias("centroid_sha256"))
