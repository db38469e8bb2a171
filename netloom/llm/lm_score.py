"""Language-model scores by subword lattice likelihood.

The pieces of a public subword vocabulary are the arcs of a lattice over a text, which is written as its words in lower
case, each with the vocabulary's word-start mark, and an end. A text's probability is that of all its segmentations
together: a forward recursion in log space sums over every path of pieces. Pieces of any length count; a character that
is no piece has an arc of its own. No arc crosses the start of a word, so the recursion passes through each word's start
and a text's marginal is the product of its words' marginals and the end's: words are run through the lattice once for
the whole corpus.

The weights start from the vocabulary's own scores. The file at hand is a BPE model, whose scores are minus the rank of
the piece, so a piece's first share is 1 / (OFFSET - score), Zipf's law over ranks. These shares, with PSEUDO counts for
each piece on average, are the prior of the weights that are learned: PASSES forward-backward passes over the training
documents' distinct words, each weighted by its count, give the expected number of uses of every piece, the end counts
once for each training document, and the sum of both is normalised.

All words of the corpus are counted and scored in a table, which grows with the corpus; documents look up the HEAD most
frequent ones in a broadcast dictionary (bounded) and join the table for the rest. Words with more than 1 / HOT of all occurrences
are in the dictionary too, whatever their length (long ones by their SHA-256) and also if no training document has them, so
that no frequent word is a hot key.

Edge cases: a null or empty text is its end alone; a null id counts as the empty string in the split; rows with equal id
and text get equal results, once for each row; a corpus without training documents scores by the prior alone and the base
by 1 / (V + 1) with V = 0; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, as_bytes, batches, columns, discard, stored, tuned, words_of

#: Words in the broadcast dictionary at most and their bytes at most; flush size; characters in the lattice at once.
HEAD, HEAD_BYTES, FLUSH, AT_ONCE = 150_000, 64, 400_000, 200_000
#: Of the weights: passes over the words, the rank that shares start from, pseudo-counts for each piece on average.
PASSES, OFFSET, PSEUDO = 2, 10.0, 1.0
#: The vocabulary's word-start mark (fixed value); bits by which the share of characters that are no pieces is dealt.
MARK, OTHER_BITS = "▁", 17
#: The split of the contract: the documents whose crc32 has this remainder are held out.
MODULUS, HELD_OUT = 7, 2


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


def load_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """The vocabulary's pieces with their marks, and their shares by the file's scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    shares = 1 / (OFFSET - np.array([min(model.get_score(i), 0.0) for i in ids]))
    return [model.id_to_piece(i) for i in ids], shares / shares.sum()


class Lattice:
    """Pieces with log probabilities. Symbol 0 is a character that is no piece, then come the pieces, the last is the end."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        self.sizes = np.array([1, *map(len, pieces)])
        self.logp = np.log(weights / weights.sum())
        self.end = self.logp[-1]
        self.logp[0] -= OTHER_BITS * math.log(2)
        self.find = ahocorasick.Automaton()
        for k, p in enumerate(pieces):
            self.find.add_word(p, k + 1)
        if pieces:
            self.find.make_automaton()

    def graph(self, words: list[str]):
        """All arcs of the marked words: (symbol, from, to, depth of from, depth of to) and each word's first node and length.

        A word's nodes are the places between its characters; words are laid out one after the other.
        """
        text = "\n".join([MARK + w for w in words])
        lengths = np.array([len(w) + 1 for w in words])
        first = np.cumsum(lengths + 1) - lengths - 1
        depth = np.arange(len(text) + 1) - np.repeat(first, lengths + 1)
        found = np.fromiter(chain.from_iterable(self.find.iter(text) if len(self.find) else ()), np.int64).reshape(-1, 2)
        to, symbol = found[:, 0] + 1, found[:, 1]
        bare = np.ones(len(text), bool)
        bare[first[1:] - 1] = False  # between words
        bare[to[self.sizes[symbol] == 1] - 1] = False
        bare = np.flatnonzero(bare)
        to, symbol = np.concatenate([to, bare + 1]), np.concatenate([symbol, np.zeros(len(bare), np.int64)])
        start = to - self.sizes[symbol]
        return symbol, start, to, depth, first, lengths

    @staticmethod
    def swept(node: np.ndarray, other: np.ndarray, lp: np.ndarray, depth: np.ndarray, values: np.ndarray, backward: bool) -> None:
        """Fill values at `node` by log-sum-exp of values at `other` plus lp, depth by depth."""
        d = depth[node]
        order = np.lexsort((node, -d if backward else d))
        node, other, lp, d = node[order], other[order], lp[order], d[order]
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        steps = np.flatnonzero(np.append(True, d[heads][1:] != d[heads][:-1])) if len(heads) else heads
        ends = np.append(heads, len(node))
        for a, b in zip(steps, np.append(steps[1:], len(heads)), strict=True):
            lo, hi = ends[a], ends[b]
            at = heads[a:b] - lo
            x = values[other[lo:hi]] + lp[lo:hi]
            top = np.maximum.reduceat(x, at)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(at, hi - lo)))), at)
            values[node[heads[a:b]]] = top + np.log(total)

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """The natural log of each marked word's probability over all its segmentations."""
        symbol, start, to, depth, first, lengths = self.graph(words)
        alpha = np.zeros(len(depth))
        self.swept(to, start, self.logp[symbol], depth, alpha, False)
        return alpha[first + lengths]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of the symbols over all segmentations of the words, each as often as it counts."""
        symbol, start, to, depth, first, lengths = self.graph(words)
        lp = self.logp[symbol]
        alpha, beta = np.zeros(len(depth)), np.zeros(len(depth))
        self.swept(to, start, lp, depth, alpha, False)
        self.swept(start, to, lp, depth, beta, True)
        word = np.repeat(np.arange(len(words)), lengths + 1)[start]
        post = np.exp(alpha[start] + lp + beta[to] - alpha[(first + lengths)[word]])
        return np.bincount(symbol, weights=post * counts[word], minlength=len(self.logp))


def in_chunks(words: list[bytes], counts: list[int]):
    """(words, counts) in parts of about AT_ONCE characters."""
    held, size, at = [], 0, 0
    for k, w in enumerate(words):
        held.append(w.decode())
        size += len(w) + 1
        if size >= AT_ONCE:
            yield held, np.array(counts[at : k + 1], float)
            held, size, at = [], 0, k + 1
    if held:
        yield held, np.array(counts[at:], float)


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c, k): every word of the corpus with its count in training documents and in all; the empty word is the end."""
    schema = columns("word binary, c long, k long")

    def run(it):
        train: dict[bytes, int] = defaultdict(int)
        other: dict[bytes, int] = defaultdict(int)  # of held-out documents

        def flushed():
            for w in other:
                train[w] += 0
            rows = batches(schema, [list(train), list(train.values()), [c + other.get(w, 0) for w, c in train.items()]])
            train.clear()
            other.clear()
            return rows

        for b in it:
            for i, text in zip(b.column(id_col).to_pylist(), as_bytes(b, text_col), strict=True):
                counts = other if held_out(i) else train
                for w in text.lower().split():
                    counts[w] += 1
                counts[b""] += 1
            if len(train) + len(other) >= FLUSH:
                yield flushed()
        yield flushed()

    return docs.select(id_col, text_col).mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"), F.sum("k").alias("k"))


def short(word: bytes) -> bytes:
    """The word, or a longer one's digest with a byte before it that no text has."""
    return word if len(word) <= HEAD_BYTES else b"\xfe" + hashlib.sha256(word).digest()


def train_pieces(words: DataFrame, pieces_path: str, passes: int = PASSES) -> tuple[list[str], np.ndarray]:
    """Pieces and the symbols' weights: the vocabulary's shares as prior, and passes over all distinct training words."""
    pieces, shares = load_pieces(pieces_path)
    prior = PSEUDO * np.concatenate([[1.0], len(pieces) * shares, [1.0]])
    weights = prior
    schema = columns("symbol int, n double")
    for _ in range(passes):
        model = words.sparkSession.sparkContext.broadcast((pieces, weights))

        def expect(it, model=model):
            lattice = Lattice(*model.value)
            total = np.zeros(len(lattice.logp))
            for b in it:
                for own, counts in in_chunks(b.column("word").to_pylist(), b.column("c").to_pylist()):
                    total += lattice.expected(own, counts)
            used = np.flatnonzero(total > 0)
            yield batches(schema, [used.tolist(), total[used].tolist()])

        trained = words.where("c > 0 and word <> X''").select("word", "c")
        weights = prior.copy()
        for r in trained.mapInArrow(expect, schema).groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # a row for each symbol at most
            weights[r.symbol] += r.n
        end = words.where("word = X''").first()
        weights[-1] += end.c if end else 0
    return pieces, weights


def tokens_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in lower case, the words' places among them in reading order, and where each text's begin and end."""
    vocabulary, codes, ends = words_of(pc.ascii_lower(texts))
    if b"" in vocabulary:
        real = codes != vocabulary.index(b"")
        ends = np.append(0, np.cumsum(real))[ends]
        codes = codes[real]
    return vocabulary, codes.astype(np.int64), ends.astype(np.int64)


def lm_score(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    spark = docs.sparkSession
    tuned(spark)
    words = stored(count_words(docs, id_col, text_col), "words")
    s = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    n, v, occurrences = s.n, s.v, s.k
    model = spark.sparkContext.broadcast(train_pieces(words, pieces_path))
    scored_schema = columns("word binary, c long, k long, lp double")

    def score(it):
        lattice = Lattice(*model.value)
        for b in it:
            ws, cs, ks = (b.column(c).to_pylist() for c in ("word", "c", "k"))
            lp = np.concatenate([lattice.log_marginals(own) for own, _ in in_chunks(ws, cs)])
            lp = np.where([w == b"" for w in ws], lattice.end, lp) / math.log(10)
            yield batches(scored_schema, [ws, cs, ks, lp.tolist()])

    table = stored(words.mapInArrow(score, scored_schema), "scores")
    discard(words)
    # The head: all words over a count that at most HEAD words reach, and less than HOT words that are hot.
    steps = sorted(((r.least, r.n) for r in table.where("c > 0").groupBy(F.least("c", F.lit(65_536)).alias("least")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, size = 65_537, 0
    for k, m in steps:
        if (size := size + m) > HEAD:
            break
        least = k
    few_bytes = F.octet_length("word") <= HEAD_BYTES
    key = F.when(few_bytes, F.col("word")).otherwise(F.concat(F.lit(b"\xfe"), F.unhex(F.sha2("word", 256))))
    in_head = (F.least("c", F.lit(65_536)) >= least) & few_bytes
    head = table.where(in_head | (F.col("k") > occurrences / HOT)).select(key.alias("word"), "c", "lp").toArrow()
    base_of = lambda c: math.log10((c + 1) / (n + v + 1))
    end = table.where("word = X''").first()
    known = spark.sparkContext.broadcast({w: (base_of(c), lp, c > 0) for w, c, lp in zip(head["word"].to_pylist(), head["c"].to_pylist(), head["lp"].to_pylist(), strict=True)})
    end_c, end_lp = (end.c, end.lp) if end else (0, 0.0)
    row_schema = columns("doc_id long, tid long, word binary, tf long, n_tokens long, n_known long, base double, score double")

    def look_up(it):
        of = known.value
        for x in it:
            ids = x.column(id_col).to_pylist()
            tids = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in as_bytes(x, text_col)]
            vocabulary, codes, ends = tokens_of(x.column(text_col))
            lengths = np.diff(ends)
            doc = np.repeat(np.arange(len(ids)), lengths)
            base_w, lp_w, c_w = np.array([of.get(short(w), (0.0, np.nan, 0)) for w in vocabulary], float).reshape(-1, 3).T
            common = ~np.isnan(lp_w[codes])

            def by_doc(weights, doc=doc, n=len(ids)):
                return np.bincount(doc, weights=weights, minlength=n)

            own = by_doc(c_w[codes]).astype(np.int64) + (end_c > 0)
            spread = [b"\xff" + t.to_bytes(8, "big", signed=True) for t in tids]  # over the join, where no word equals them
            scores = by_doc(np.where(common, lp_w[codes], 0.0)) + end_lp
            yield batches(row_schema, [ids, tids, spread, [0] * len(ids), lengths + 1, own, by_doc(base_w[codes]) + base_of(end_c), scores])
            # The other words: one row for each of a document's with its count there.
            key, tf = np.unique(doc[~common] * max(len(vocabulary), 1) + codes[~common], return_counts=True)
            d, w = np.divmod(key, max(len(vocabulary), 1))
            zeros = [0] * len(key)
            yield batches(row_schema, [[ids[k] for k in d], [tids[k] for k in d], [vocabulary[k] for k in w], tf.tolist(), zeros, zeros, [0.0] * len(key), [0.0] * len(key)])

    rows = docs.select(id_col, text_col).mapInArrow(look_up, row_schema)
    joined = rows.join(table.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    more = F.col("tf") > 0
    each = joined.groupBy("doc_id", "tid").agg(
        F.sum(F.when(more, 0).otherwise(1)).alias("m"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(more, F.col("tf") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(more, F.col("tf") * F.col("lp")).otherwise(0.0)).alias("score"),
    )
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))  # rows with equal id and text
    return each.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT).alias("held_out"),
        F.expr("n_tokens div m").alias("n_tokens"),
        F.expr("n_known div m").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("m")).alias("base_score"),
        (F.col("score") / F.col("m")).alias("score"),
    )
