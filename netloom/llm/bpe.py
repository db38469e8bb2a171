"""BPE encoding and decoding with a public vocabulary.

Encoding: a text is cut at ASCII white space (which this vocabulary drops), each piece is normalised and split as the
vocabulary's file says, and each word's bytes become a doubly linked list of symbols. A priority queue holds (merge
rank, place) of neighbouring pairs; entries whose symbols have changed since are stale and skipped. Decoding joins the
vocabulary strings of the ids. Words and pieces that a task has met are remembered, in bounded tables of two generations.

Edge cases: a null or empty text has no ids and decodes to an empty text; special strings in a text become their ids;
repeated rows are encoded each; columns named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import regex
from pyspark.sql import DataFrame

from .common import as_bytes, columns, once, tuned, with_new

#: Entries of a generation of a task's tables of pieces and words; longer ones than CACHED_BYTES are not kept.
CACHED, CACHED_BYTES = 250_000, 96
#: The vocabulary's own pre-tokenizer pattern and word end (fixed values).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Remembered(dict):
    """A dict that computes what it lacks and forgets all when it is full."""

    def __init__(self, function, limit: int = CACHED):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= CACHED_BYTES:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Renewed(Remembered):
    """The same in two generations: what is asked for again comes back from the full table before."""

    def __init__(self, function, limit: int = CACHED):
        super().__init__(function, limit)
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.function(key)
        if len(key) <= CACHED_BYTES:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.ranks, self.made, self.base = {}, {}, 1 + max(vocab.values())
        for rank, (a, b) in enumerate(model["merges"]):
            if a in vocab and b in vocab and a + b in vocab:
                self.ranks.setdefault(vocab[a] * self.base + vocab[b], rank)
                self.made[rank] = vocab[a + b]
        self.first = [vocab.get(s) for s in byte_symbols()]
        self.last = [vocab.get(s + WORD_END) for s in byte_symbols()]
        self.decimal = {i: str(i) for i in self.strings}
        self.words = Renewed(self.word)
        self.pieces = Renewed(self.piece)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        n, base, rank, made = len(symbols), self.base, self.ranks.get, self.made
        pairs = [rank(a * base + b, -1) for a, b in pairwise(symbols)]  # of each place with the one after it
        pairs.append(-1)
        queue = [r * n + i for i, r in enumerate(pairs) if r >= 0]  # rank and place in one number
        if not queue:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            r, i = divmod(heappop(queue), n)
            if pairs[i] != r:
                continue  # stale: one of its symbols has changed
            j = after[i]
            new = symbols[i] = made[r]
            symbols[j] = pairs[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pairs[i] = rank(new * base + symbols[k], -1)
                if r >= 0:
                    heappush(queue, r * n + i)
            else:
                pairs[i] = -1
            h = before[i]
            if h >= 0:
                r = pairs[h] = rank(symbols[h] * base + new, -1)
                if r >= 0:
                    heappush(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[tuple[int, ...], str, str]:
        """As piece, of one word."""
        raw = word.encode()
        symbols = [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return self.shown(tuple(self.merge(symbols)))

    def shown(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, str]:
        return ids, " ".join(map(self.decimal.__getitem__, ids)), " ".join(map(self.strings.__getitem__, ids))

    def parts(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        """Of the words and special strings of a text."""
        out = []
        for k, part in enumerate(self.special_cut.split(text)):
            if k % 2:
                out.append(self.shown((self.special[part],)))
            elif part:
                if part.isascii():
                    part = part.lower()
                else:
                    part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))  # one character at a time
                out += map(self.words.__getitem__, WORDS.findall(part))
        return out

    def piece(self, piece: bytes) -> tuple[tuple[int, ...], str, str]:
        """Ids, ids in decimal and vocabulary strings of a piece without ASCII white space."""
        parts = self.parts(piece.decode())
        if len(parts) != 1:
            parts = [self.shown(tuple([i for p in parts for i in p[0]]))]
        return parts[0]

    def encode(self, text: bytes) -> list[int]:
        return [i for p in map(self.pieces.__getitem__, text.split()) for i in p[0]]

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: its strings are joined by a space, as the library joins them."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


FIELDS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def bpe_encode(docs: DataFrame, tokenizer_path: str, outputs=("ids", "n_tokens"), text_col: str = "text") -> DataFrame:
    """docs with the asked columns of FIELDS for every whole text: its ids, their number, what they decode to, digests."""
    tuned(docs.sparkSession)
    fields = columns(", ".join(f"{c} {FIELDS[c]}" for c in outputs))

    def make():
        bpe = once(("bpe", tokenizer_path), lambda: Bpe(tokenizer_path))

        def of(batch):
            out = {c: [] for c in outputs}
            for text in as_bytes(batch, text_col):
                parts = [p for p in map(bpe.pieces.__getitem__, text.split()) if p[0]]
                ids, decimal, strings = zip(*parts, strict=True) if parts else ((), (), ())
                if "ids" in out:
                    out["ids"].append(list(chain.from_iterable(ids)))
                if "n_tokens" in out:
                    out["n_tokens"].append(sum(map(len, ids)))
                if "ids_sha256" in out:
                    out["ids_sha256"].append(sha256(" ".join(decimal).encode()).hexdigest())
                if "decoded" in out or "decoded_sha256" in out:
                    decoded = " ".join(strings)
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
            return [out[c] for c in outputs]

        return of

    return with_new(docs, make, fields)


def bpe_decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded, the text of each row's ids; null ids give an empty text."""
    tuned(tokens.sparkSession)

    def make():
        bpe = once(("bpe", tokenizer_path), lambda: Bpe(tokenizer_path))
        return lambda batch: [[bpe.decode(x or []) for x in batch.column(ids_col).to_pylist()]]

    return with_new(tokens, make, columns("decoded string"))
