"""MinHash near-dedup by an inverted join over signature coordinates.

1. Each document's set of word shingles gives a signature of COORDINATES minima. Documents of equal sets are one from
   here on (the one of the smallest id speaks for them).
2. Two sets of the wanted similarity agree in at least `needed` coordinates (but for a chance of about 3e-6 at the very
   threshold), so of any order of the coordinate-value pairs they share one of each one's first COORDINATES - needed + 1.
   The order is by frequency, from a sketch of fixed size: common values are skipped, and lists stay short.
3. Documents are posted under these prefix pairs. In each list the document with the most common values is the hub: all
   others are candidates with it only, and each keeps the hub that it collides with most often.
4. Candidates whose whole signatures agree in enough coordinates are confirmed on the full sets; the links' components
   label the documents.
5. What the hubs leave open is settled exactly: lists that still hold several labels compare documents of different
   labels, short lists pair by pair where enough coordinates agree, long ones in blocks of full sets. Pairs within a
   label are never made. A family of n documents that stay apart costs n² / BLOCK² comparisons of blocks, dealt over all tasks.

Edge cases: without words or text (or id) a document's set is empty and it links with nothing; fewer words than a
shingle are one shingle; rows that share an id are taken as one document with the links of each; ties do not matter, as
a component is named by its smallest id; other columns take no part, and drop_near gives them back with their values,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import as_bytes, batches, columns, discard, keys_of, once, stored, tuned, unused
from .components import components

COORDINATES, WORDS, SKETCH_BITS, SHORT = 128, 5, 17, 24
#: Documents and shingles in a block of a long list, about.
BLOCK, BLOCK_SHINGLES = 64, 131_072
_R = np.random.default_rng(20_240_607)
_XOR = _R.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MUL = _R.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_PLACE = _R.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_PHI = np.uint64(0x9E3779B97F4A7C15)


def needed(similarity: float) -> int:
    """Coordinates in which sets of this similarity agree but for 4.5 standard deviations."""
    return max(1, math.floor(COORDINATES * similarity - 4.5 * math.sqrt(COORDINATES * similarity * (1 - similarity))))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PHI
    return h ^ (h >> np.uint64(29))


def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest, 500_000)


def shingles(text: bytes, of, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(of.__getitem__, ws), np.uint64, len(ws))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for o in range(k):
        out += h[o : o + n] * _PLACE[o]
    return np.unique(mixed(out))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(s), 512):
        np.minimum(out, (((s[a : a + 512, None] ^ _XOR) * _MUL) >> np.uint64(32)).min(0), out=out)
    return out.astype("<u4")


def pair_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each (coordinate, value) of an array of signatures."""
    return mixed((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sigs.astype(np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, set, sig) for every row; set is a 128-bit hash of the whole set, null if empty."""
    schema = columns("doc_id long, n_shingles long, set binary, sig binary")

    def run(it):
        of = once("word hashes", word_hashes)
        for b in it:
            out: list[list] = [[], [], []]
            for text in as_bytes(b, text_col):
                s = shingles(text, of, words)
                out[0].append(len(s))
                out[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out[2].append(signature(s).tobytes() if len(s) else None)
            yield batches(schema, [b.column(id_col).to_pylist(), *out])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def frequency_sketch(reps: DataFrame) -> np.ndarray:
    """How many signatures hold a pair whose key falls into each of 2^SKETCH_BITS buckets."""
    schema = columns("bucket int, n long")

    def run(it):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in it:
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
            total += np.bincount((pair_keys(sigs) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64).ravel(), minlength=len(total))
        used = np.flatnonzero(total)
        yield batches(schema, [used, total[used]])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in reps.select("sig").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def postings(reps: DataFrame, sketch: np.ndarray, prefix: int) -> DataFrame:
    """(key, rep, common): each document under the rarest `prefix` pairs of its signature; common: how frequent its pairs are."""
    shared = reps.sparkSession.sparkContext.broadcast(sketch)
    schema = columns("key long, rep long, common long")

    def run(it):
        counts = shared.value
        for b in it:
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
            keys = pair_keys(sigs)
            n = counts[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            common = (np.log2(n + 1) * 64).sum(1).astype(np.int64)
            order = np.lexsort((keys, n))[:, :prefix]
            top = np.take_along_axis(keys, order, 1).view(np.int64)
            yield batches(schema, [top.ravel(), np.repeat(np.array(b.column("rep").to_pylist(), np.int64), top.shape[1]), np.repeat(common, top.shape[1])])

    return reps.select("rep", "sig").mapInArrow(run, schema)


def agreeing(pairs: DataFrame, reps: DataFrame, least: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose set sizes allow the similarity and whose signatures agree in at least `least` coordinates."""
    one = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    two = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9))
    schema = columns("a long, b long")

    def run(it):
        for x in it:
            sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u4").reshape(-1, COORDINATES) for c in ("sa", "sb"))
            on = (sa == sb).sum(1) >= least
            yield batches(schema, [np.array(x.column(c).to_pylist(), np.int64)[on] for c in ("a", "b")])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, schema)


def texts_of(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of rows that may be in the pairs: a bitmap of fixed size (2 MB) over hashed ids tells most others apart."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 24))
    maps = ids.select(F.bitmap_bucket_number(place + 1).alias("k"), F.bitmap_bit_position(place + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()  # 512 rows at most
    bits = np.zeros(1 << 24, bool)
    for r in maps:
        bits[(r.k - 1) * 32_768 : r.k * 32_768] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    schema = columns("id long, text string, place long")

    def run(it):
        bits = shared.value
        for b in it:
            p = b.column("place").to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bits[p >> 3] >> (p & 7) & 1).astype(bool)))

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.withColumn("place", place).mapInArrow(run, schema).select("id", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets are at least as similar as asked, as a stored table (a, b)."""
    pairs = stored(pairs, "pairs")
    texts = stored(texts_of(docs, pairs, id_col, text_col), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    schema = columns("a long, b long")
    percent = round(similarity * 100)

    def run(it):
        of, last = once("word hashes", word_hashes), (None, None, None)
        for x in it:
            out: list[list] = [[], []]
            for a, b, ta, tb in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), as_bytes(x, "ta"), as_bytes(x, "tb"), strict=True):
                if (b, tb) != last[:2]:
                    last = (b, tb, shingles(tb, of, words))
                s = shingles(ta, of, words)
                inter = len(np.intersect1d(s, last[2], assume_unique=True))
                if 100 * inter >= percent * (len(s) + len(last[2]) - inter):
                    out[0].append(a)
                    out[1].append(b)
            yield batches(schema, out)

    links = stored(both.select("a", "b", "ta", "tb").mapInArrow(run, schema).distinct(), "confirmed")
    discard(pairs, texts)
    return links


def opened(lists: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, labels and full sets of the k-th block."""
    rows = lists.values.slice(lists.offsets[k].as_py(), lists.value_lengths()[k].as_py())
    sets = [np.frombuffer(f, np.uint64) for f in rows.field("full").to_pylist()]
    return rows.field("rep").to_numpy(zero_copy_only=False), rows.field("label").to_numpy(zero_copy_only=False), sets


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """For each set of one and each of two, how many elements both have."""
    flat = [np.concatenate(x) for x in (one, two)]
    common = np.intersect1d(*flat)
    if not len(common):
        return np.zeros((len(one), len(two)), np.int64)
    tables = []
    for sets, values in zip((one, two), flat, strict=True):
        place = np.searchsorted(common, values)
        place[place == len(common)] = 0
        on = common[place] == values
        table = np.zeros((len(sets), len(common)), np.float32)
        table[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[on], place[on]] = 1
        tables.append(table)
    return np.rint(tables[0] @ tables[1].T).astype(np.int64)  # whole numbers below 2^24 are exact


def open_links(
    lists: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, least: int, similarity: float, words: int, id_col: str, text_col: str
) -> DataFrame:
    """Links (a, b) between different labels, enough to join all labels that have one: of documents that share a list,
    and are confirmed on the full sets; those of short lists agree in at least `least` coordinates first."""
    marked = lists.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_keys = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    marked = stored(marked.join(open_keys, "key"), "open")

    pair = columns("a long, b long")

    def cross(it):
        for x in it:
            out: list[list] = [[], []]
            for members in x.column("members").to_pylist():
                members.sort(key=lambda m: m["rep"])
                for i, m in enumerate(members):
                    for o in members[i + 1 :]:
                        if m["label"] != o["label"]:
                            out[0].append(m["rep"])
                            out[1].append(o["rep"])
            yield batches(pair, out)

    short = marked.where(F.col("n") <= SHORT).groupBy("key").agg(F.collect_list(F.struct("rep", "label")).alias("members"))  # SHORT rows at most
    short = agreeing(short.select("members").mapInArrow(cross, pair).distinct(), reps, least, similarity)

    short = confirmed(short, docs, similarity, words, id_col, text_col)

    # Long lists: by hub; those outside the hub's most frequent label against all of the hub's lists, block by block.
    # Blocks hold the full sets, so that only confirmed links leave them, one for a document and label at most.
    members = marked.where(F.col("n") > SHORT).select("hub", "rep", "label").distinct()
    members = stored(members.join(reps.select("rep", "set", "n_shingles"), "rep"), "members")
    sizes = members.groupBy("hub", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    sizes = sizes.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label")).getField("label").alias("main"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES))
    sizes = stored(sizes.select("hub", "main", "n", parts.alias("parts")), "sizes")
    texts = texts_of(docs, members.select(F.col("rep").alias("a"), F.col("rep").alias("b")), id_col, text_col)
    id_set = columns("id long, set binary, full binary")

    def full_sets(it):
        of = once("word hashes", word_hashes)
        for x in it:
            sets = [shingles(t, of, words).tobytes() for t in as_bytes(x, "text")]
            yield batches(id_set, [x.column("id").to_pylist(), [xxhash.xxh3_128_digest(f) for f in sets], sets])

    full = members.select(F.col("rep").alias("id")).distinct().join(texts, "id").mapInArrow(full_sets, id_set)
    full = full.groupBy("id", "set").agg(F.any_value("full").alias("full")).withColumnRenamed("id", "rep")  # equal rows are one
    placed = keys_of(members, sizes, "hub", "n").join(full, ["rep", "set"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    rows = F.collect_list(F.struct("rep", "label", "full")).alias("rows")  # about BLOCK rows
    blocks = stored(placed.groupBy("hub", "part").agg(F.any_value("parts").alias("parts"), F.any_value("main").alias("main"), rows), "blocks")
    outside = blocks.select("hub", "part", "parts", F.expr("filter(rows, r -> r.label <> main)").alias("others")).where("size(others) > 0")
    inside = blocks.select("hub", F.col("part").alias("to"), F.expr("filter(rows, r -> r.label = main)").alias("rows")).where("size(rows) > 0")
    sent = outside.select("hub", "part", "others", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
    later = sent.where("to >= part").join(outside.select("hub", F.col("part").alias("to"), F.col("others").alias("rows")), ["hub", "to"])
    both = later.select("others", "rows").union(sent.join(inside, ["hub", "to"]).select("others", "rows"))
    percent = round(similarity * 100)

    def compare(it):
        for x in it:
            found: list[list] = [[], []]
            for k in range(x.num_rows):
                (ids, labels, sets), (rows, row_labels, row_sets) = opened(x.column("others"), k), opened(x.column("rows"), k)
                inter = shared_counts(sets, row_sets)
                total = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in row_sets])
                linked = (100 * inter >= percent * (total - inter)) & (labels[:, None] != row_labels)
                for i in np.flatnonzero(linked.any(1)):
                    at = np.flatnonzero(linked[i])
                    for j in at[np.unique(row_labels[at], return_index=True)[1]]:
                        found[0].append(int(ids[i]))
                        found[1].append(int(rows[j]))
            yield batches(pair, found)

    links = stored(short.union(both.mapInArrow(compare, pair)).distinct(), "more")
    discard(marked, members, sizes, blocks, short)
    return links


def near_dedup(docs: DataFrame, similarity: float = 0.8, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; kept: the document names its component."""
    spark = docs.sparkSession
    tuned(spark, 64)
    least = needed(similarity)
    rows = stored(signatures(docs, id_col, text_col, words), "signatures")
    linked = rows.where("set is not null and doc_id is not null")
    reps = stored(
        linked.groupBy("set").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig")), "sets"
    )
    posted = postings(reps, frequency_sketch(reps), COORDINATES - least + 1)
    heads = posted.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("common", "rep")).getField("rep").alias("hub")).where("n > 1")
    lists = stored(posted.select("key", "rep").join(heads, "key"), "lists")
    best = lists.where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("hits")).groupBy("rep").agg(F.max(F.struct("hits", "hub")).getField("hub").alias("hub"))
    first = confirmed(agreeing(best.select(F.col("rep").alias("a"), F.col("hub").alias("b")), reps, least, similarity), docs, similarity, words, id_col, text_col)
    labels = components(first)
    more = open_links(lists, reps, labels, docs, least, similarity, words, id_col, text_col)
    discard(lists, labels)
    # A set may be shared by rows with different ids, and rows with one id may have different sets: both link.
    split = linked.groupBy("doc_id").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x < y").select("doc_id")
    by_id = linked.join(split, "doc_id").join(reps.select("set", "rep"), "set").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(first.union(more).union(by_id))
    discard(first, more)
    named = reps.select("set", "rep").join(final.withColumnRenamed("v", "rep"), "rep", "left").select("set", F.coalesce("label", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, similarity: float = 0.8, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that name their component, with all their columns: one document of each group stays."""
    [gone_id] = unused(docs, "gone_id")
    gone = near_dedup(docs, similarity, words, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
