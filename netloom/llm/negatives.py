"""Hard-negative mining by product quantisation with stored residual norms.

Components become whole numbers, floor(scale * x). Pairs of neighbouring components share a codebook of at most CODES whole
centroids, fitted on a bounded sample; each row is stored with its codes and the norm r of what the codes leave over. For
an anchor a a table of inner products with all centroids gives each row's looked-up score L, a whole number, and its
score is within L plus or minus |a| r. That interval, rounded outwards, filters candidates without losing one: first those that may
be among an anchor's positives, then those that may be in the window of a positive and among its first. Their scores
are then computed exactly from the whole numbers, and a running k-th best raises the filter's floor.

Anchors are taken in groups of about GROUP, which go to all tasks; a group reads the stored rows twice. A task holds
BLOCK rows and its best so far; what it returns is bounded by the group's windows, and the first of all tasks are the result. So
the work is anchors times rows, as the exact result needs, but no pair is shuffled and no group of rows is put together.

Edge cases: rows with a null id or label, a null vector, or a null or non-finite component take no part. A shorter vector has
zeros at the end. Rows with an anchor's own id are neither its positives nor its negatives; other repeated rows count
each, and an anchor that is there twice has its result twice. Ties go by smaller id. Whole numbers too large for exact
doubles are multiplied as Python's; a score beyond a long is an error. Vectors of any length are cut into pairs. Other columns are
not read. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, columns, discard, stored, tuned
from .vectors import Best, blocks, centroids, dealt_in_groups, matrix, nearest, sample, stored_parts, width_of

#: Components that share a code, codes of a codebook, anchors of a group, anchors scored at once, rows of a block.
PIECE, CODES, GROUP, CHUNK, BLOCK = 2, 256, 16_384, 256, 4096
#: Pairs whose exact scores are computed at once.
PAIRS = 1 << 16
SCHEMA = columns("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
FOUND = columns("anchor long, slot int, ident long, score long")


def whole(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    found, good = matrix(column, width)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(scale * found), good


def codebooks(points: np.ndarray) -> list[np.ndarray]:
    """Whole centroids of each piece of the sample's vectors."""
    return [np.rint(centroids(points[:, s : s + PIECE], CODES)) for s in range(0, points.shape[1], PIECE)]


def coded(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codes and the norm of what they leave over."""
    codes, rest = np.zeros((len(vectors), len(books)), np.uint8), np.zeros(len(vectors))
    for s, book in enumerate(books):
        part = vectors[:, s * PIECE : s * PIECE + book.shape[1]]
        codes[:, s] = nearest(part, book)
        rest += ((part - book[codes[:, s]]) ** 2).sum(axis=1)
    return codes, np.sqrt(rest)


def looked_up(codes: np.ndarray, anchors: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """(rows, anchors): sums of the tables' entries for the rows' codes."""
    out = np.zeros((len(codes), len(anchors)))
    for s, book in enumerate(books):
        table = book @ anchors[:, s * PIECE : s * PIECE + book.shape[1]].T
        out += table[codes[:, s]]
    return out


def exact(rows: np.ndarray, anchors: np.ndarray, small: bool) -> np.ndarray:
    """The inner products of rows with anchors, pair by pair, as longs."""
    if small:
        return np.einsum("ij,ij->i", rows, anchors).astype(np.int64)
    products = [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(rows, anchors, strict=True)]
    return np.array(products, np.int64)  # an OverflowError if one doesn't fit


class Anchors:
    """A group's anchors, and the windows of each: which rows of another (or the same) label may count, and their scores' limits."""

    def __init__(self, table: pa.Table, width: int, scale: int):
        self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        self.vectors, _ = whole(table.column("vec").combine_chunks(), width, scale)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))

    def limits(self, low: np.ndarray, high: np.ndarray, same: bool) -> Anchors:
        """These anchors with windows. low, high: (anchors, slots), both inclusive."""
        out = copy(self)
        out.low, out.high, out.same = low, high, same
        return out


def scan(rows: DataFrame, anchors: Anchors, books: list[np.ndarray], width: int, scale: int, k: int) -> DataFrame:
    """(anchor, slot, ident, score): of each task's rows the first k of each of the anchors' windows."""

    def run(it):
        n, slots = anchors.low.shape
        chunks = [slice(a, a + CHUNK) for a in range(0, n, CHUNK)]
        top = [Best(len(anchors.ids[c]) * slots, k, anchors.low[c].ravel()) for c in chunks]
        most = np.abs(anchors.vectors).max(initial=0)
        for b in blocks(it, BLOCK):
            ids, labels = b.column("id").to_numpy(), b.column("label").to_numpy()
            vectors, _ = whole(b.column("vec"), width, scale)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, len(books))
            rest = b.column("rest").to_numpy()
            largest = max(most, np.abs(vectors).max(initial=0), max((np.abs(x).max(initial=0) for x in books), default=0))
            small = 8 * width * largest * largest < 2**53
            for c, t in zip(chunks, top, strict=True):
                own = (labels[:, None] == anchors.labels[None, c]) == anchors.same
                may = own & (ids[:, None] != anchors.ids[None, c])
                if small:
                    score = looked_up(codes, anchors.vectors[c], books)
                    slack = rest[:, None] * anchors.norms[None, c] * (1 + 1e-9) + 1e-3
                    may &= score + slack >= t.floor.reshape(-1, slots).min(axis=1)
                    may &= score - slack <= anchors.high[c].max(axis=1)
                r, a = np.nonzero(may)
                for p in range(0, len(r), PAIRS):
                    rr, aa = r[p : p + PAIRS], a[p : p + PAIRS]
                    got = exact(vectors[rr], anchors.vectors[c][aa], small)
                    for s in range(slots):
                        inside = (got >= t.floor.reshape(-1, slots)[aa, s]) & (got <= anchors.high[c][aa, s])
                        t.add(aa[inside] * slots + s, got[inside], ids[rr[inside]])
        for c, t in zip(chunks, top, strict=True):
            if len(t.group):
                yield batches(FOUND, [x.tolist() for x in (c.start + t.group // slots, t.group % slots, t.ident, t.score)])

    found = rows.mapInArrow(run, FOUND)
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "ident")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """SCHEMA: for each anchor (is_anchor over rows' columns) and each of its first positives the first negatives whose score is
    between low_percent and high_percent of the positive's."""
    spark = rows.sparkSession
    tuned(spark)
    kept = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull())
    plain = kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    width = width_of(plain, "vec")
    with np.errstate(over="ignore", invalid="ignore"):
        books = codebooks(np.floor(scale * sample(plain, "id", "vec", width)))
    books = [x if len(x) else np.zeros((1, min(PIECE, width - s * PIECE))) for s, x in enumerate(books)]

    def encode(it):
        for b in blocks(it, BLOCK):
            vectors, good = whole(b.column("vec"), width, scale)
            codes, rest = coded(vectors[good], books)
            of = b.filter(pa.array(good))
            more = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(of.columns + more, names=[*b.schema.names, "codes", "rest"])

    index = stored(plain.mapInArrow(encode, T.StructType([*plain.schema, *columns("codes binary, rest double")])), "pq-index")
    anchors, n = dealt_in_groups(index.where("anchor").select("id", "label", "vec"), GROUP)
    parts = (_group(spark, index, anchors.where(F.col("grp") == g), books, width, scale, positives, negatives, low_percent, high_percent) for g in range(n))
    out = stored_parts(spark, parts, SCHEMA, "negatives")
    discard(index)
    return out


def _group(spark, index: DataFrame, chosen: DataFrame, books, width: int, scale: int, positives: int, negatives: int, low_percent: int, high_percent: int) -> DataFrame:
    """The result of a group of anchors."""
    group = Anchors(chosen.drop("grp").toArrow(), width, scale)  # GROUP rows
    n = len(group.ids)
    whole_line = np.full((n, 1), -(2**63)), np.full((n, 1), 2**63 - 1)
    found = scan(index, group.limits(*whole_line, same=True), books, width, scale, positives).toArrow()  # positives for each anchor
    anchor, slot, score, ident = (found.column(c).to_numpy() for c in ("anchor", "rank", "score", "ident"))
    low, high, positive = np.full((n, positives), 1, np.int64), np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)  # no score is in an empty window
    at = anchor, slot - 1
    low[at] = [-(-low_percent * int(s) // 100) for s in score]
    high[at] = [high_percent * int(s) // 100 for s in score]
    positive[at] = ident
    windows = [(int(a), int(s) - 1, int(group.ids[a]), int(positive[a, s - 1]), int(p)) for a, s, p in zip(anchor, slot, score, strict=True)]
    named = spark.createDataFrame(pa.table(list(map(pa.array, zip(*windows, strict=True))) or [pa.array([], pa.int64())] * 5, names=["anchor", "slot", "anchor_id", "positive_id", "positive_score"]))
    pairs = scan(index, group.limits(low, high, same=False), books, width, scale, negatives)
    joined = pairs.join(named.withColumn("slot", F.col("slot").cast("int")), ["anchor", "slot"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
