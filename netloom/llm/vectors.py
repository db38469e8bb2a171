"""What the vector operators share: matrices from Arrow, k-means on a bounded sample, the best of groups, groups of queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, root

#: Components in the sample that codebooks are fitted on (rows times width), and rows of it at most.
SAMPLE_COMPONENTS, SAMPLE_ROWS = 1 << 21, 16_384


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles, shorter ones with zeros at the end, and which of them are there whole and finite."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    out = np.zeros((len(column), width))
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    good = column.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(out).all(axis=1)
    return out, good


def width_of(rows: DataFrame, vec_col: str) -> int:
    """The longest vector's length."""
    return rows.agg(F.max(F.size(F.col(f"`{vec_col}`"))).alias("n")).first().n or 0


def sample(rows: DataFrame, id_col: str, vec_col: str, width: int) -> np.ndarray:
    """The vectors of the rows whose ids have the smallest hashes: a bounded sample, the same in each run."""
    n = min(SAMPLE_ROWS, max(1, SAMPLE_COMPONENTS // max(1, width)))
    taken = rows.orderBy(F.xxhash64(id_col), id_col).limit(n).select(vec_col).toArrow().column(0).combine_chunks()
    found, good = matrix(taken, width)
    return found[good]


def centroids(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids by Lloyd's rounds, from distinct points in their order; copies don't take each other's place."""
    if not points.size:
        return np.zeros((min(1, len(points)), points.shape[1]))
    _, first = np.unique(points, axis=0, return_index=True)
    c = points[np.sort(first)[:k]].copy()
    for _ in range(rounds if len(c) else 0):
        near = nearest(points, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, points[:, d], len(c)) for d in range(points.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of each point's nearest centroid."""
    return ((c * c).sum(axis=1) - 2 * (points @ c.T)).argmin(axis=1)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """The places of each group's first k, by score descending, then identifier."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


class Best:
    """The first k of each of n groups among what was added so far; floor: the score of a group's k-th, below which none counts."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.n = k, n
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.group, self.score, self.ident = np.zeros(0, np.int64), np.zeros(0, self.floor.dtype), np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        joined = [np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.ident, ident))]
        at = best(*joined, self.k)
        self.group, self.score, self.ident = (x[at] for x in joined)
        full = np.flatnonzero(np.bincount(self.group, minlength=self.n) == self.k)
        last = np.searchsorted(self.group, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


def blocks(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows."""
    return gathered((b for b in it if b.num_rows), rows)


def dealt_in_groups(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """rows with a column grp, so that the groups are about even and have most rows or not many more; the number of groups.

    rows should be stored, as the numbers depend on its partitions.
    """
    n = -(-rows.count() // most)
    return rows.withColumn("grp", F.monotonically_increasing_id() % max(1, n)), n


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: T.StructType, name: str) -> DataFrame:
    """The rows of parts, each written when it comes, as one table in the shared folder."""
    path, n = f"{root(spark)}/{uuid.uuid4().hex}/{name}", 0
    for n, part in enumerate(parts, 1):
        part.write.option("compression", "zstd").parquet(f"{path}/part={n}")
    if not n:
        return spark.createDataFrame([], schema)
    back = spark.read.schema(T.StructType([*schema, T.StructField("part", T.IntegerType())])).parquet(path).drop("part")
    back._netloom_path = path
    return back
