"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose token positions and ignore those between them; the hashes of the chosen tokens of every place in a
text are joined with those of the benchmark. Around each hit the two token sequences are laid side by side and verified:
windows of WINDOW tokens, or the whole item if it is shorter, with at least SHARE of their tokens equal are an overlap;
windows that run into each other are one. The rule is the same for items of any length, from one word on, and so is what
the masks find: the two of MASKS every window of 13 tokens with at most two substitutions, and for a shorter item, of
which k tokens may differ, k + 1 masks that share no position, one of which no k substitutions can touch.

A benchmark of at most BROADCAST words is broadcast as an index and texts are not shuffled. A larger one is joined in one
pass over the texts: a Bloom filter of fixed size keeps the seeds that may be in the benchmark, these are joined with its
seeds, and only texts with a hit are shuffled to be verified. Both ways give the same rows.

Edge cases: a null or empty text or item overlaps nothing; repeated rows are judged each; items with equal text are all
reported; other columns pass through decontaminate() with their values, whatever their names; an empty benchmark or table
gives no overlap.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import as_bytes, batches, columns, once, stored, tuned, unused, with_new

WINDOW, SHARE = 13, 0.8
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
#: Words of a benchmark that is broadcast, about; bits of the Bloom filter and of the map of texts with a hit (powers of two).
BROADCAST, BLOOM_BITS, TEXT_BITS = 400_000, 1 << 27, 1 << 24
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"place", seed=k) | 1 for k in range(WINDOW)], np.uint64)


def least_equal(width: int) -> int:
    return math.ceil(SHARE * width)


def masks_for(width: int) -> tuple[tuple[int, ...], ...]:
    """The masks that find every window of the width (a whole item's, if it is below WINDOW) with enough equal tokens."""
    if width >= WINDOW:
        return MASKS
    step = width - least_equal(width) + 1
    return tuple(tuple(range(r, width, step)) for r in range(step))


def tokens(text: bytes, of) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))


def seeds(h: np.ndarray, mask: tuple[int, ...], width: int) -> np.ndarray:
    """The hash of the masked tokens at every place where the mask fits; masks of different widths differ."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (min(width, WINDOW) * WINDOW + mask[0]) * 1_000_003 + mask[-1], np.uint64)
    for k, o in enumerate(mask):
        out += h[o : o + n] * _MULTIPLIERS[k]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def item_seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An item's seeds and their places; those of a short item stand at its beginning."""
    found = [seeds(h, m, len(h))[: None if len(h) >= WINDOW else 1] for m in masks_for(len(h))] if len(h) else []
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *map(np.arange, map(len, found))])


def text_seeds(h: np.ndarray, widths: list[int]):
    """The seeds of a text at every place, for items of the widths (up to WINDOW)."""
    for width in widths:
        for m in masks_for(width):
            yield seeds(h, m, width)


def verified(h: np.ndarray, item: np.ndarray, starts) -> list[tuple[int, int, int]]:
    """(start in the text in words, words, equal words) of the overlaps with an item that is laid at the starts; they share
    no word, and where two would, the one with more equal words stays."""
    found, width = [], min(WINDOW, len(item))
    for start in starts:
        a, b = max(0, start), min(len(h), start + len(item))
        if b - a < width:
            continue
        same = np.cumsum(np.concatenate([[0], h[a:b] == item[a - start : b - start]]))
        good = np.flatnonzero(same[width:] - same[:-width] >= least_equal(width))
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
            p, q = int(run[0]), int(run[-1]) + width
            found.append((a + p, q - p, int(same[q] - same[p])))
    out: list[tuple[int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (-x[2], x)):
        if all(x[0] + x[1] <= y[0] or y[0] + y[1] <= x[0] for y in out):
            out.append(x)
    return sorted(out)


class Benchmark:
    """The seeds of some items, for look-up. Items with equal words are one."""

    def __init__(self, items: list[tuple[int, bytes]]):
        of = Remembered(xxhash.xxh3_64_intdigest)
        ids: dict[bytes, list[int]] = {}
        for i, t in items:
            if len(h := tokens(t or b"", of)):
                ids.setdefault(h.tobytes(), []).append(i)
        self.ids, self.items = list(ids.values()), [np.frombuffer(h, np.uint64) for h in ids]
        self.widths = sorted({min(len(h), WINDOW) for h in self.items})
        made = [item_seeds(h) for h in self.items]
        self.keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in made]])
        self.item = np.repeat(np.arange(len(made)), [len(k) for k, _ in made])
        self.place = np.concatenate([np.zeros(0, np.int64), *[p for _, p in made]])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.item, self.place = self.keys[order], self.item[order], self.place[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start in the text in words, words, equal words) of every overlap."""
        lines: dict[int, set[int]] = {}
        for s in text_seeds(h, self.widths):
            at = np.flatnonzero(self.filter[(s >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.keys, s[at], "left"), np.searchsorted(self.keys, s[at], "right")
            n = hi - lo
            if not n.any():
                continue
            k = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            for item, start in zip(self.item[k].tolist(), (np.repeat(at, n) - self.place[k]).tolist(), strict=True):
                lines.setdefault(item, set()).add(start)
        out = [(i, *x) for k in lines for x in verified(h, self.items[k], sorted(lines[k])) for i in self.ids[k]]
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))


def small(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's items as a broadcast, None if it has more than about BROADCAST words."""
    b = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    if b.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n > 6 * BROADCAST:
        return None
    items = sorted(((r.item_id, (r.text or "").encode()) for r in b.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # about BROADCAST words
    return b.sparkSession.sparkContext.broadcast(items)


def bitmap(df: DataFrame, hashed: str, bits: int) -> np.ndarray:
    """Which of `bits` places the hashes fall on, as packed bits of fixed size."""
    place = F.pmod(hashed, F.lit(bits))
    rows = df.select(F.bitmap_bucket_number(place + 1).alias("k"), F.bitmap_bit_position(place + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)  # bits / 32768 rows of 4 kB at most
    for r in rows:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def on_map(held: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    place = hashed & (8 * len(held) - 1)
    return (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def within(df: DataFrame, key: str, shared, wanted: bool = True) -> DataFrame:
    """The rows whose hash may be on the broadcast map, or those whose hash isn't."""

    def run(it):
        held = shared.value
        for b in it:
            yield b.filter(pa.array(on_map(held, b.column(key).to_numpy(zero_copy_only=False)) == wanted))

    return df.mapInArrow(run, df.schema)


def joined_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(doc_id, text_key, item_id, start_word, n_words, n_equal) by a join of seeds, for a benchmark of any size.

    text_key: a 64-bit hash of the document's text. Texts and items are verified as they are, so its collisions do no harm.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("item_text"))
    items = stored(items.withColumn("item_key", F.xxhash64("item_text")), "items")
    seed_schema = columns("seed long, width int, item_key long, item_place long")

    def make_seeds(it):
        of = Remembered(xxhash.xxh3_64_intdigest)
        for b in it:
            out: list[list] = [[], [], [], []]
            for key, text in zip(b.column("item_key").to_pylist(), as_bytes(b, "item_text"), strict=True):
                h = tokens(text, of)
                s, p = item_seeds(h)
                for c, v in zip(out, (s.view(np.int64).tolist(), [min(len(h), WINDOW)] * len(s), [key] * len(s), p.tolist()), strict=True):
                    c.extend(v)
            yield batches(seed_schema, out)

    bench = stored(items.select("item_key", "item_text").distinct().mapInArrow(make_seeds, seed_schema), "seeds")
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # WINDOW rows at most
    bloom = spark.sparkContext.broadcast(bitmap(bench, "seed", BLOOM_BITS))
    hit_schema = columns("seed long, text_key long, text_place long")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))

    def all_seeds(it):
        of, held = Remembered(xxhash.xxh3_64_intdigest), bloom.value
        for b in it:
            for key, text in zip(b.column("text_key").to_pylist(), as_bytes(b, "text"), strict=True):
                h = tokens(text, of)
                for s in text_seeds(h, widths):
                    at = np.flatnonzero(on_map(held, s.view(np.int64)))
                    if len(at):
                        yield batches(hit_schema, [s.view(np.int64)[at], np.full(len(at), key), at])

    hits = texts.select("text_key", "text").mapInArrow(all_seeds, hit_schema)
    lines = hits.join(bench, "seed").select("text_key", "item_key", (F.col("text_place") - F.col("item_place")).alias("start")).distinct()
    lines = stored(lines.groupBy("text_key", "item_key").agg(F.collect_list("start").alias("starts")), "lines")  # less than a text and an item have places
    found = spark.sparkContext.broadcast(bitmap(lines, "text_key", TEXT_BITS))
    pairs = within(texts, "text_key", found).join(lines, "text_key").join(items, "item_key")
    schema = columns("doc_id long, text_key long, item_id long, start_word long, n_words long, n_equal long")

    def verify(it):
        of = Remembered(xxhash.xxh3_64_intdigest)
        for b in it:
            out: list[list] = [[] for _ in schema]
            names = [b.column(c).to_pylist() for c in ("doc_id", "text_key", "item_id", "starts")]
            for i, key, item, starts, text, own in zip(*names, as_bytes(b, "text"), as_bytes(b, "item_text"), strict=True):
                for x in verified(tokens(text, of), tokens(own, of), sorted(starts)):
                    for c, v in zip(out, (i, key, item, *x), strict=True):
                        c.append(v)
            yield batches(schema, out)

    return pairs.select("doc_id", "text_key", "item_id", "starts", "text", "item_text").mapInArrow(verify, schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal): every overlap of a document and an item; those of a pair share no word."""
    tuned(docs.sparkSession)
    items = small(benchmark, item_col, item_text)
    if items is None:
        return joined_overlaps(docs, benchmark, id_col, text_col, item_col, item_text).drop("text_key")
    schema, name = columns("doc_id long, item_id long, start_word long, n_words long, n_equal long"), uuid.uuid4().hex

    def run(it):
        bench, of = once(name, lambda: Benchmark(items.value)), Remembered(xxhash.xxh3_64_intdigest)
        for b in it:
            out: list[list] = [[] for _ in schema]
            for i, text in zip(b.column(id_col).to_pylist(), as_bytes(b, text_col), strict=True):
                for o in bench.overlaps(tokens(text, of)):
                    for c, v in zip(out, (i, *o), strict=True):
                        c.append(v)
            yield batches(schema, out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns."""
    spark = docs.sparkSession
    tuned(spark)
    items = small(benchmark, item_col, item_text)
    if items is None:
        [key] = unused(docs, "text_key")
        keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
        # A second hash tells texts of equal key apart.
        numbered = docs.select(F.xxhash64(F.lit(1), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        leaks = stored(joined_overlaps(numbered, benchmark, "doc_id", "text", item_col, item_text).select(F.col("text_key").alias("leak_key"), F.col("doc_id").alias("leak_check")).distinct(), "leaks")
        found = spark.sparkContext.broadcast(bitmap(leaks, "leak_key", TEXT_BITS))
        maybe = within(keyed, key, found)
        second = F.xxhash64(F.lit(1), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        clean = maybe.join(leaks, (F.col(key) == leaks["leak_key"]) & (second == leaks["leak_check"]), "left_anti")
        return within(keyed, key, found, wanted=False).union(clean).drop(key)
    [leak], name = unused(docs, "leak"), uuid.uuid4().hex

    def make():
        bench, of = once(name, lambda: Benchmark(items.value)), Remembered(xxhash.xxh3_64_intdigest)
        return lambda b: [[bool(bench.overlaps(tokens(t, of))) for t in as_bytes(b, text_col)]]

    return with_new(docs, make, columns(f"{leak} boolean")).where(f"not {leak}").select(*[f"`{c}`" for c in docs.columns])
