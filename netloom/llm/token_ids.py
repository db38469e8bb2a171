"""Token ids in a binary format: canonical length-limited Huffman codes in independent blocks.

Format: a table of blocks in ascending id order. Each row is a block that is read without any other: `start` (ids before
it in the whole corpus), the documents in it (`doc_ids`, `lengths`), `payload` (the codes, most significant bit first)
and `offsets` (the bit offset of every CHECKPOINT-th code). A second table has each id's code length; canonical codes
follow from the lengths. A block holds whole documents, about BLOCK ids.

Decoding is driven by a table over LIMIT bits; the checkpoints of a block are decoded side by side.

Edge cases: a null or empty text is its end id alone; documents with equal ids are neighbours in any order; a null id
comes first; an empty table gives a file of no blocks.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .bpe import WORD_END, WORDS
from .common import Generations, batches, columns, discard, gathered, once, partitions, stored, tuned, words_of

#: Longest code in bits, ids between checkpoints, ids in a block (or one document, if it is longer).
LIMIT, CHECKPOINT, BLOCK = 17, 64, 131_072
#: Pieces and words in each of two generations of a worker's tables.
PIECES = 300_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Huffman code lengths of at most `limit` bits for the ids with counts above 0, by package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit in codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    packages, levels = np.empty(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        both = both[order]
        pairs = len(both) // 2
        packages = both[0 : 2 * pairs : 2] + both[1 : 2 * pairs : 2]
    lengths, take = np.zeros(len(used), np.uint8), 2 * len(used) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[used] = lengths
    return out


class Codes:
    """Canonical codes and their decoding table, from the code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint32)
        self.code = np.zeros(len(lengths), np.uint32)
        self.at_prefix = np.ones(1 << LIMIT, np.uint32)  # id * 32 + code length for every LIMIT bits that a code begins
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        if len(used):
            span = np.left_shift(1, LIMIT - lengths[used].astype(np.int64))
            first = np.cumsum(span) - span
            self.code[used] = first >> (LIMIT - lengths[used].astype(np.int64))
            self.at_prefix[: span.sum()] = np.repeat(used << 5 | lengths[used], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The payload and the bit offsets of every CHECKPOINT-th id."""
        n = self.lengths[ids].astype(np.int64)
        end = np.cumsum(n)
        at = end - n
        value = self.code[ids].astype(np.int64) << (63 - n - (at & 31))  # bit 62 is the first of its 32-bit word
        size = (int(end[-1]) >> 5) + 2 if len(ids) else 1
        place = at >> 5
        out = np.bincount(place, weights=value >> 31, minlength=size) + np.bincount(place + 1, weights=(value & 0x7FFFFFFF) << 1, minlength=size)[:size]
        return out.astype(np.int64).astype(">u4").tobytes(), at[::CHECKPOINT].astype("<u4").tobytes()

    def decode(self, payload: bytes, offsets: bytes, n: int) -> np.ndarray:
        raw = np.frombuffer(payload + bytes(CHECKPOINT * LIMIT // 8 + 8), np.uint8).astype(np.int64)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.frombuffer(offsets, "<u4").astype(np.int64)
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        for k in range(CHECKPOINT):
            x = (window[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - LIMIT)
            x = self.at_prefix[x]
            out[k] = x >> 5
            at += x & 31
        return out.T.ravel()[:n]


class PieceIds:
    """The library's ids of pieces without ASCII white space, as bytes of little-endian unsigned 32-bit integers.

    A piece is normalised and split into words as the vocabulary's pre-tokenizer does, so that words met in other
    pieces aren't encoded again; pieces with special strings or of unstable normal form go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.pieces, self.words = Generations(PIECES), Generations(PIECES)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for s, i in vocab.items() if s.endswith(WORD_END)]] = True

    @staticmethod
    def split(piece: bytes) -> list[str]:
        text = piece.decode()
        if "<|" in text:
            return [text]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            low = text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))  # one character at a time
            if not unicodedata.is_normalized("NFC", low) or low.lower() != low:
                return [piece.decode()]
        else:
            low = text.lower()
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return [low[:-1], low[-1]]
        return WORDS.findall(low)

    def encode(self, words: list[str], code: str, at_once: int = 200) -> None:
        """Words go to the library joined by spaces; its ids are cut after each id that ends a word."""
        cut = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        for own, e in zip(cut, self.tok.encode_batch_fast([" ".join(c) for c in cut], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, code)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(stops) == len(own):  # else one of them is more or less than a word
                data, a = ids.tobytes(), 0
                for w, b in zip(own, stops.tolist(), strict=True):
                    self.words[w] = data[a:b]
                    a = b

    def encode_each(self, words: list[str], code: str) -> None:
        for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.words[w] = array(code, e.ids).tobytes()

    def __call__(self, texts: pa.Array, code: str) -> list[bytes]:
        """The ids of each text, as bytes of the array type code."""
        if not any(pc.match_substring(texts, "<|").to_pylist()):  # special strings are told by case
            texts = pc.ascii_lower(texts)
        pieces, place, offsets = words_of(texts)
        parts = {p: self.split(p) for p in self.pieces.lacking(pieces)}
        new = self.words.lacking({w for ws in parts.values() for w in ws})
        self.encode([w for w in new if " " not in w and "<|" not in w], code)
        self.encode_each([w for w in new if w not in self.words], code)
        known, words = self.pieces, self.words
        for p, ws in parts.items():
            known[p] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        joined = pa.array(list(map(known.__getitem__, pieces)), pa.binary()).take(pa.array(place))  # one after the other in its buffer
        if joined.offset or not len(joined):
            joined = pa.concat_arrays([joined, pa.array([b""], pa.binary())])
        for p in parts:
            if len(p) > 96:
                del known[p]
        for w in new:
            if len(w) > 96:
                del words[w]
        ends = np.frombuffer(joined.buffers()[1], np.int32)[offsets].tolist()
        data = joined.buffers()[2]
        data = data.to_pybytes() if data else b""
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, width: str, bounds: list[int], id_col: str, text_col: str) -> DataFrame:
    """(part, doc_id, ids): the library's ids of every whole text with the end id, as little-endian unsigned integers of
    `width`, and the place of the id among the bounds.

    The vocabulary drops white space and no token crosses it, so texts are cut at ASCII white space.
    """
    schema, code = columns("part int, doc_id long, ids binary"), {"<u2": "H", "<u4": "I"}[width]

    def run(it):
        of, end = once(("piece ids", tokenizer_path, code), lambda: PieceIds(tokenizer_path)), np.array([end_id], width).tobytes()
        for b in gathered(it, 4096):
            if b.num_rows:
                ids = b.column(id_col).to_pylist()
                parts = [0 if i is None else bisect(bounds, i) for i in ids]
                yield batches(schema, [parts, ids, [x + end for x in of(pc.fill_null(b.column(text_col), ""), code)]])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the ids of all texts in the format; the tables of blocks and of code lengths, as read from the shared folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tuned(spark)
    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    size_of, n = np.dtype(width).itemsize, partitions(docs)
    # Ranges of ids with about equal numbers of rows, from the id column alone.
    bounds = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    tokens = tokenize(docs, tokenizer_path, end_id, width, sorted(set(bounds)), id_col, text_col)
    run_schema = columns("run int, before long, doc_id long, ids binary")

    def in_order(it):
        run, before = TaskContext.get().partitionId(), 0
        for b in it:
            ids = b.column("ids").to_pylist()
            at = []
            for x in ids:
                at.append(before)
                before += len(x) // size_of
            yield batches(run_schema, [[run] * len(ids), at, b.column("doc_id").to_pylist(), ids])

    dealt = tokens.repartitionById(n + 1, F.col("part")).drop("part").sortWithinPartitions("doc_id")
    ordered = stored(dealt.mapInArrow(in_order, run_schema), "ordered", "snappy")

    count_schema = columns("run int, id int, n long")

    def count(it):
        total, runs = np.zeros(0, np.int64), Counter()
        for b in it:
            ids = b.column("ids").to_pylist()
            for run, x in zip(b.column("run").to_pylist(), ids, strict=True):
                runs[run] += len(x) // size_of
            x = np.bincount(np.frombuffer(b"".join(ids), width))
            if len(x) > len(total):
                x, total = total, x.astype(np.int64)
            total[: len(x)] += x
        used = np.flatnonzero(total)
        yield batches(count_schema, [[None] * len(used) + list(runs), used.tolist() + [None] * len(runs), total[used].tolist() + list(runs.values())])

    # A row for each id of the vocabulary and for each range at most.
    counts = ordered.select("run", "ids").mapInArrow(count, count_schema).groupBy("run", "id").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(max((r.id for r in counts if r.run is None), default=0) + 1, np.int64)
    starts, before = {}, 0
    for r in sorted((r for r in counts if r.run is not None), key=lambda r: r.run):
        starts[r.run] = before
        before += r.n
    for r in counts:
        if r.run is None:
            table[r.id] = r.n
    lengths = code_lengths(table)
    lengths_table = stored(
        spark.createDataFrame([Row(id=int(i), n_bits=int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, n_bits int").coalesce(1), "codes"
    )
    shared = spark.sparkContext.broadcast((lengths, starts))
    block_schema = columns("start long, doc_ids binary, lengths binary, no_id array<int>, n_ids long, payload binary, offsets binary")

    def block(it):
        lengths, starts = shared.value
        codes = Codes(lengths)

        def made(run, before, rows):
            ids = np.frombuffer(b"".join([x for _, x in rows]), width)
            payload, offsets = codes.encode(ids)
            names = np.array([d or 0 for d, _ in rows], "<i8").tobytes()
            sizes = np.array([len(x) // size_of for _, x in rows], "<i8").tobytes()
            return batches(block_schema, [[starts[run] + before], [names], [sizes], [[k for k, (d, _) in enumerate(rows) if d is None]], [len(ids)], [payload], [offsets]])

        rows, size, first = [], 0, None
        for b in it:
            for run, before, d, ids in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if rows and (size >= BLOCK or first != (run, before - size)):
                    yield made(*first[:1], first[1], rows)
                    rows, size = [], 0
                if not rows:
                    first = (run, before)
                rows.append((d, ids))
                size += len(ids) // size_of
        if rows:
            yield made(*first, rows)

    blocks = stored(ordered.mapInArrow(block, block_schema), "blocks", "uncompressed")  # Huffman codes are as short as they get
    discard(ordered)
    return blocks, lengths_table


def read_ids(blocks: DataFrame, lengths_table: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the blocks, each decoded on its own."""
    rows = lengths_table.collect()  # a row for each id of the vocabulary at most
    lengths = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r.id] = r.n_bits
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)
    schema = columns("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

    def run(it: Iterator[pa.RecordBatch]):
        codes = Codes(shared.value)
        for b in it:
            for x in b.to_pylist():
                names, sizes = np.frombuffer(x["doc_ids"], "<i8").tolist(), np.frombuffer(x["lengths"], "<i8")
                for k in x["no_id"]:
                    names[k] = None
                ids = codes.decode(x["payload"], x["offsets"], x["n_ids"]).astype("<u4")
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                out = [names, (x["start"] + ends - sizes).tolist(), sizes.tolist(), [zlib.crc32(p.tobytes()) for p in parts]]
                yield batches(schema, out + [[p.tolist() for p in parts]] * with_ids)

    return blocks.mapInArrow(run, schema)
