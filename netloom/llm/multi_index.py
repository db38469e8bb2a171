"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a row's list is named by its pair of centroids. Centroids are
fitted on a bounded sample, every row is indexed. The distance of a half from a query is minus the inner product with the
half's centroid, less SPREAD times what a residual of the centroid's rows adds to it by the standard deviation; a pair's distance is
the sum of both. A query traverses the pairs by ascending distance with a heap. It first takes lists until they hold FIRST
rows; the exact score of the k-th of these is a bound, and the second traversal takes all lists whose distance still
reaches it. So how far a query goes follows from its scores, and no list or query has a cap. Rows of the lists are
reranked by exact inner products.

Rows are range-partitioned by (pair, hash of the row's id) and sorted, so that a list's rows are neighbours and a list with many
rows spreads over partitions. Queries go to all tasks in groups, as bitmaps of the lists they take and vectors; a task multiplies each list
with the queries that take it and returns the first k of each query among its rows.

Nearness is the inner product in double precision, summed in the components' order. Edge cases: rows with a null id, a null or
zero vector, or a null or non-finite component take no part; a shorter vector has zeros at the end; rows with the query's own
id are no candidates of it; other repeated rows count each, and a query that is there twice has its result twice. Ties go by smaller id.
With fewer candidates than k, all of them are returned. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, columns, discard, partitions, stored, tuned
from .vectors import Best, blocks, centroids, dealt_in_groups, matrix, nearest, sample, stored_parts, width_of

#: Standard deviations of a residual that a list may lie beyond a query's bound; rows that the first traversal takes.
SPREAD, FIRST = 2.2, 400
#: Centroids of a half at most; queries of a group; bits of a group's bitmaps; rows of a block; queries multiplied at once.
MOST_CENTROIDS, GROUP, BITS, BLOCK, CHUNK = 256, 8192, 1 << 26, 8192, 1024
SCHEMA = columns("query_id long, rank int, vec_id long, score double")
FOUND = columns("query long, ident long, score double")


def centroids_for(rows: int) -> int:
    """Centroids of a half: a power of two, with about 12 rows for each pair."""
    return min(MOST_CENTROIDS, 1 << max(0, round(np.log2(max(1.0, rows / 12)) / 2)))


class Books:
    """The centroids of both halves, and the rows and the spread of the pairs' lists."""

    def __init__(self, points: np.ndarray, width: int, k: int):
        self.half = (width + 1) // 2
        self.parts = [centroids(p, k) for p in self.halves(points)]
        self.parts = [c if len(c) else np.zeros((1, w)) for c, w in zip(self.parts, (self.half, width - self.half), strict=True)]
        self.n = [len(c) for c in self.parts]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's list and the squared residuals of its halves."""
        codes, rest = [], []
        for part, c in zip(self.halves(vectors), self.parts, strict=True):
            code = nearest(part, c)
            codes.append(code)
            rest.append(((part - c[code]) ** 2).sum(axis=1))
        return codes[0] * self.n[1] + codes[1], rest

    def measured(self, lists: pa.Table) -> None:
        """lists: (list, n, rest_0, rest_1), sums over all rows."""
        at, n = lists.column("list").to_numpy(), lists.column("n").to_numpy()
        self.sizes = np.bincount(at, n, self.n[0] * self.n[1]).astype(np.int64)
        self.deviation = []
        for h, (place, c) in enumerate(zip((at // self.n[1], at % self.n[1]), self.parts, strict=True)):
            rows, rest = np.bincount(place, n, len(c)), np.bincount(place, lists.column(f"rest_{h}").to_numpy(), len(c))
            self.deviation.append(np.sqrt(rest / np.maximum(rows, 1) / max(1, c.shape[1])))

    def distances(self, vector: np.ndarray, spread: float) -> list[np.ndarray]:
        return [-(c @ q) - spread * np.sqrt((q * q).sum()) * d for q, c, d in zip((vector[: self.half], vector[self.half :]), self.parts, self.deviation, strict=True)]


def traversed(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, rows: float, until: float) -> list[int]:
    """The lists (places in sizes) by ascending sum of both halves' distances: until they hold so many rows, and on while
    the sum is not over `until`. A row of the table of sums enters the heap when the row before it does its first."""
    order, other = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[order].tolist(), second[other].tolist()
    heap, out, held, n = [(a[0] + b[0], 0, 0)], [], 0, len(b)
    while heap:
        d, i, j = heappop(heap)
        if held >= rows and d > until:
            break
        place = order[i] * n + other[j]
        if size := sizes[place]:
            out.append(place)
            held += size
        if j + 1 < n:
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if not j and i + 1 < len(a):
            heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products pair by pair, summed in the components' order, so that equal vectors have equal scores."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def chosen_lists(queries: DataFrame, books: Books, width: int, spread: float, rows: float, bounded: bool) -> DataFrame:
    """queries (id, vec, bound) with a bitmap of the lists that each takes; without a bound those of the first rows or, if
    bounded, all, as so few rows were found."""

    def run(it):
        sizes = books.sizes.tolist()
        for b in it:
            vectors, _ = matrix(b.column("vec"), width)
            maps = []
            for v, t in zip(vectors, b.column("bound").to_pylist(), strict=True):
                bits = np.zeros(len(sizes), bool)
                bits[traversed(*books.distances(v, spread), sizes, rows, (np.inf if bounded else -np.inf) if t is None else -t)] = True
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maps, pa.binary())], names=[*b.schema.names, "lists"])

    return queries.mapInArrow(run, T.StructType([*queries.schema, *columns("lists binary")]))


def scan(index: DataFrame, group: pa.Table, width: int, k: int) -> DataFrame:
    """(query, ident, score): the first k of each query of the group, by place, in each task's rows of its lists."""
    vectors, _ = matrix(group.column("vec").combine_chunks(), width)
    own, maps = group.column("id").to_numpy(), np.frombuffer(b"".join(group.column("lists").to_pylist()), np.uint8).reshape(len(vectors), -1)
    norms = np.sqrt((vectors**2).sum(axis=1))
    bounds = group.column("bound").fill_null(-np.inf).to_numpy()

    def run(it):
        top = Best(len(vectors), k, bounds)
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in blocks(it, BLOCK):
            lists, ids = b.column("list").to_numpy(), b.column("id").to_numpy()
            rows, _ = matrix(b.column("vec"), width)
            margin = 1e-12 * np.sqrt((rows**2).sum(axis=1))
            starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(lists)], strict=True):
                place = int(lists[start])
                takers = np.flatnonzero(maps[:, place >> 3] & (128 >> (place & 7)))
                for p in range(0, len(takers), CHUNK):
                    q = takers[p : p + CHUNK]
                    near = rows[start:end] @ vectors[q].T + margin[start:end, None] * norms[None, q] >= top.floor[None, q]
                    r, at = np.nonzero(near & (ids[start:end, None] != own[None, q]))
                    if len(r):
                        r += start
                        score = inner(rows[r], vectors[q[at]])
                        keep = score >= top.floor[q[at]]
                        pending.append((q[at[keep]], score[keep], ids[r[keep]]))
                        if sum(len(x[0]) for x in pending) > BLOCK * k:
                            top.add(*map(np.concatenate, zip(*pending, strict=True)))
                            pending.clear()
            if pending:
                top.add(*map(np.concatenate, zip(*pending, strict=True)))
                pending.clear()
        if len(top.group):
            yield batches(FOUND, [x.tolist() for x in (top.group, top.ident, top.score)])

    first = Window.partitionBy("query").orderBy(F.desc("score"), "ident")
    return index.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, is_query: Column, k: int = 20, spread: float = SPREAD, first: int = FIRST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """SCHEMA: the k nearest rows found of each query (is_query over rows' columns), nearest first."""
    spark = rows.sparkSession
    tuned(spark)
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull())
    plain = kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    width = width_of(plain, "vec")
    books = Books(sample(plain, "id", "vec", width), width, centroids_for(plain.count()))

    def encode(it):
        for b in blocks(it, BLOCK):
            vectors, good = matrix(b.column("vec"), width)
            good &= (vectors != 0).any(axis=1)
            place, rest = books.coded(vectors[good])
            yield pa.RecordBatch.from_arrays([*b.filter(pa.array(good)).columns, pa.array(place), *map(pa.array, rest)], names=[*b.schema.names, "list", "rest_0", "rest_1"])

    coded = stored(plain.mapInArrow(encode, T.StructType([*plain.schema, *columns("list long, rest_0 double, rest_1 double")])), "coded")
    books.measured(coded.groupBy("list").agg(F.count("*").alias("n"), F.sum("rest_0").alias("rest_0"), F.sum("rest_1").alias("rest_1")).toArrow())  # a row for each pair of centroids
    dealt = coded.select("id", "vec", "list").repartitionByRange(partitions(coded), F.col("list"), F.xxhash64("id")).sortWithinPartitions("list", "id")
    index = stored(dealt, "multi-index")
    most = min(GROUP, max(1, BITS // len(books.sizes)))
    queries, n = dealt_in_groups(coded.where("query").select("id", "vec"), most)
    queries = stored(queries, "queries")

    def parts():
        for g in range(n):
            chosen = queries.where(F.col("grp") == g).withColumn("bound", F.lit(None).cast("double")).drop("grp").toArrow()  # `most` rows
            group = _listed(spark, chosen, books, width, spread, first, False)
            found = scan(index, group, width, k).where(F.col("rank") == k).select("query", "score").toArrow()
            bounds: list[float | None] = [None] * len(group)
            for q, score in zip(*(c.to_pylist() for c in found.columns), strict=True):
                bounds[q] = score
            bounded = group.drop_columns(["lists", "bound"]).append_column("bound", pa.array(bounds, pa.float64()))
            group = _listed(spark, bounded, books, width, spread, first, True)
            names = spark.createDataFrame(pa.table([pa.array(range(len(group)), pa.int64()), group.column("id")], names=["query", "query_id"]))
            result = scan(index, group, width, k).join(names, "query")
            yield result.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("ident").alias("vec_id"), "score")

    out = stored_parts(spark, parts(), SCHEMA, "neighbours")
    discard(coded, index, queries)
    return out


def _listed(spark, group: pa.Table, books: Books, width: int, spread: float, rows: float, bounded: bool) -> pa.Table:
    """A group's queries with their lists, in one order; the tasks traverse."""
    df = spark.createDataFrame(group).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return chosen_lists(df, books, width, spread, rows, bounded).toArrow()
