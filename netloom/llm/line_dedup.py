"""Line dedup: explode normalised lines, hash, count documents per hash, drop lines over the threshold, reassemble.

A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. A document sends each of its distinct
long keys once, as a 128-bit hash, so that counting shuffles no text. Keys in enough documents lose their lines except
in the document of the largest id; texts meet the hashes of their own dropped lines and are put together again in order.
Keys that many documents share are broadcast, less than HOT of them, so that no common line is one task's key.

Edge cases: a null or empty text is one empty line; rows that share an id count as one document and lose the same
lines; a row without id counts for no key and loses no line; columns named like a result are replaced, all others pass
through with their values, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, batches, columns, keys_of, stored, tuned, unused, with_new

#: Code points that a key needs, and documents that it has to be in.
LEAST_POINTS, LEAST_DOCS = 20, 3


def key_of(line: bytes, least: int) -> bytes | None:
    """The hash of the line's key, None if the key is too short. bytes.lower() changes A-Z alone."""
    key = line.strip(SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_dedup(
    docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with n_lines, n_dropped, kept_sha256 and, if asked, kept_text."""
    tuned(docs.sparkSession)
    schema = columns("key binary, doc long")

    def explode(it):
        for b in it:
            keys, ids = [], []
            for i, text in zip(b.column(id_col).to_pylist(), as_bytes(b, text_col), strict=True):
                if i is not None:
                    own = {key_of(line, least_points) for line in text.split(b"\n")} - {None}
                    keys += own
                    ids += [i] * len(own)
            yield batches(schema, [keys, ids])

    lines = stored(docs.select(id_col, text_col).mapInArrow(explode, schema), "lines")
    common = lines.groupBy("key").agg(F.countDistinct("doc").alias("n"), F.count("*").alias("size"), F.max("doc").alias("last")).where(F.col("n") >= least_docs)
    common = stored(common.select("key", "size", "last"), "common")
    doc_col, drops_col = unused(docs, "doc", "drops")
    drops = keys_of(lines, common, "key", "size").where("doc <> last").groupBy(F.col("doc").alias(doc_col)).agg(F.collect_set("key").alias(drops_col))
    fields = columns("n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)

    def make():
        def of(batch):
            out: list[list] = [[] for _ in fields]
            for text, drop in zip(as_bytes(batch, text_col), batch.column(drops_col).to_pylist(), strict=True):
                all_lines = text.split(b"\n")
                drop = set(drop or ())
                kept = [x for x in all_lines if key_of(x, least_points) not in drop] if drop else all_lines
                left = b"\n".join(kept)
                for c, v in zip(out, (len(all_lines), len(all_lines) - len(kept), sha256(left).hexdigest(), left.decode()), strict=False):
                    c.append(v)
            return out

        return of

    joined = docs.join(drops, F.col(f"`{id_col}`") == F.col(doc_col), "left").drop(doc_col)
    return with_new(joined, make, fields).drop(drops_col)
