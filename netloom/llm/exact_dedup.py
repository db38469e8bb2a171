"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over (first bytes of the normalised text, its SHA-256, the row's id),
sorted within partitions, and neighbours whose keys agree are compared in full. The splitters stay small because of
the bounded first bytes, and a large group of copies spreads over partitions because the id is part of the splitters.
A run of equal texts that touches the edge of its partition may go on in the next, and a run of more than PIECE rows is
cut into pieces; such runs, at most two for a partition and one for PIECE rows, are put together in a table of a row for
each text that is broadcast.

Of equal texts the row with the most code points stays, of those the one with the smallest id (null ids last), of
those any one. Texts are equal when the same after deleting every [\\x20\\x09-\\x0D]; null counts as empty, so null,
empty and blank texts are equal. Other columns pass through with their values, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, as_bytes, batches, columns, partitions, stored, tuned, unused, with_new

#: Bytes of the normalised text that the splitters see before its hash; rows of a run that a task holds.
FIRST, PIECE = 32, 65_536


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def content_sorted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str, str]:
    """docs with first bytes, hash and code points of each text, so that equal texts are neighbours and the one to keep comes
    first in its partition; and the names of these columns."""
    first, sha, points = unused(docs, "first", "sha", "points")

    def make():
        def of(batch):
            raw = as_bytes(batch, text_col)
            norm = [normalised(t) for t in raw]
            return [[n[:FIRST] for n in norm], [sha256(n).digest() for n in norm], [len(t.decode()) for t in raw]]

        return of

    keyed = with_new(docs, make, columns(f"{first} binary, {sha} binary, {points} long"))
    by_id = F.col(f"`{id_col}`").asc_nulls_last()
    dealt = keyed.repartitionByRange(partitions(docs), F.col(first), F.col(sha), by_id)
    return dealt.sortWithinPartitions(first, sha, F.col(points).desc(), by_id), first, sha, points


class Runs:
    """Tells for each row of a sorted partition whether a new run of equal texts starts there."""

    def __init__(self):
        self.key, self.norm = None, None

    def starts(self, batch: pa.RecordBatch, sha_col: str, text_col: str) -> list[bool]:
        out = []
        for sha, text in zip(batch.column(sha_col).to_pylist(), as_bytes(batch, text_col), strict=True):
            if sha == self.key:
                if self.norm is None:
                    self.norm = normalised(self.text)
                new = normalised(text) != self.norm
            else:
                new = True
            if new:
                self.key, self.text, self.norm = sha, text, None
            out.append(new)
        return out


def better(points: Column, row_id: Column, part: Column) -> Column:
    """The least of these structs belongs to the row that stays."""
    return F.struct((-points).alias("less"), row_id.isNull().alias("no_id"), row_id.alias("keep_id"), part.alias("part"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too."""
    tuned(docs.sparkSession)
    schema = columns("doc_id long, sha binary, keep_id long, points long, size long, first boolean, edge boolean, part long")
    sorted_docs, _, sha_col, points_col = content_sorted(docs.select(id_col, text_col), id_col, text_col)

    def run(it):
        part, runs = TaskContext.get().partitionId() << 32, Runs()  # a piece's number is unique
        sha, points, ids, keep, edge = None, None, [], None, True
        out: list[list] = [[] for _ in schema]

        def close(edge):
            n = len(ids)
            for c, v in zip(out, (ids, [sha] * n, [keep] * n, [points] * n, [n] * n, [True] + [False] * (n - 1), [edge] * n, [part] * n), strict=True):
                c.extend(v)

        for b in it:
            for new, i, s, p in zip(runs.starts(b, sha_col, text_col), b.column(id_col).to_pylist(), b.column(sha_col).to_pylist(), b.column(points_col).to_pylist(), strict=True):
                if new or len(ids) == PIECE:
                    if ids:
                        close(edge or not new)
                        part += 1
                        edge = not new  # the rest of a long run goes with its other pieces
                    sha, points, keep, ids = s, p, i, []
                ids.append(i)
                if len(out[0]) >= 4096:
                    yield batches(schema, out)
                    out[:] = [[] for _ in schema]
        if ids:
            close(True)
        if out[0]:
            yield batches(schema, out)

    rows = stored(sorted_docs.mapInArrow(run, schema), "runs")
    edges = rows.where("edge and first").groupBy("sha").agg(F.sum("size").alias("all"), F.min(better(F.col("points"), F.col("keep_id"), F.col("part"))).alias("best"))
    r, e = rows.alias("r"), F.broadcast(edges).alias("e")  # two rows for each partition and one for PIECE rows at most
    joined = r.join(e, F.expr("r.edge and r.sha = e.sha"), "left")
    return joined.select(
        F.col("r.doc_id").alias("doc_id"),
        F.expr("case when e.sha is null then r.keep_id else e.best.keep_id end").alias("keep_id"),
        F.coalesce("e.all", "r.size").alias("group_size"),
        F.expr("r.first and (e.sha is null or r.part = e.best.part)").alias("kept"),
        F.lower(F.hex("r.sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    tuned(docs.sparkSession)
    sorted_docs, first_col, sha_col, points_col = content_sorted(docs, id_col, text_col)
    edge_col, part_col, best_sha, best_part = unused(sorted_docs, "edge", "part", "best_sha", "best_part")
    schema = T.StructType([f for f in sorted_docs.schema if f.name != first_col] + list(columns(f"{edge_col} boolean, {part_col} int")))
    places = [i for i, f in enumerate(sorted_docs.schema) if f.name != first_col]

    def run(it):
        part, runs, held, first_run = TaskContext.get().partitionId(), Runs(), None, True

        def made(rows: pa.RecordBatch, edges: list[bool]):
            more = [pa.array(edges, pa.bool_()), pa.array([part] * len(edges), pa.int32())]
            return pa.RecordBatch.from_arrays(rows.columns + more, names=[f.name for f in schema])

        for b in it:
            at = [k for k, new in enumerate(runs.starts(b, sha_col, text_col)) if new]
            rows = b.select(places)
            if not at:
                continue
            if held is not None:
                yield made(held, [first_run])
                first_run = False
            if len(at) > 1:
                yield made(rows.take(pa.array(at[:-1])), [first_run] + [False] * (len(at) - 2))
                first_run = False
            held = rows.take(pa.array(at[-1:]))
        if held is not None:
            yield made(held, [True])

    rows = stored(sorted_docs.mapInArrow(run, schema), "kept")
    best = rows.where(F.col(edge_col)).groupBy(F.col(sha_col).alias(best_sha)).agg(F.min(better(F.col(points_col), F.col(f"`{id_col}`"), F.col(part_col))).alias(best_part))
    best = best.select(best_sha, F.col(best_part).getField("part").alias(best_part))
    joined = rows.join(F.broadcast(best), F.col(edge_col) & (F.col(sha_col) == F.col(best_sha)), "left")  # two rows for each partition at most
    return joined.where(F.col(best_part).isNull() | (F.col(part_col) == F.col(best_part))).select(*[f"`{c}`" for c in docs.columns])
