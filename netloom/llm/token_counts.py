"""Token counts: batch encoding inside Arrow functions that returns lengths only.

Long texts, like all others, are cut at safe boundaries: a place between a character that is not white space and one
that is, and in runs of over LONG characters without white space also a place after a letter or digit where its kind
ends. The byte-level pre-tokenizer never lets a token cross such a place and looks no further back, so the counts of the
pieces add up to the count of the text. Special strings hold no white space; a long run that holds one is not cut, nor is
a run of one kind, which is one word to the vocabulary. Pieces that a task has not counted yet go to the library in
batches of about equal bytes; of its answer only the lengths are kept.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; other columns pass through,
and a column named like a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from .common import as_str, columns, tuned, with_new

#: Bytes of text that go to the encoder at once.
BATCH_BYTES = 1 << 20
#: Pieces whose counts a task remembers; longer ones than CACHED_CHARS are counted each time.
CACHED_PIECES, CACHED_CHARS = 400_000, 128
#: Unicode's White_Space characters (fixed values).
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Longer pieces are cut inside: ends of letters before what is none and of digits before what is none.
LONG, INSIDE = 4096, regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")


def balanced(pieces: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of pieces of about `limit` bytes each."""
    out, size = [], 0
    for p in pieces:
        out.append(p)
        size += len(p) if p.isascii() else len(p.encode())
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


class PieceCounter:
    """Counts of pieces by the tokenizers library (.json) or sentencepiece (.model)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split = lambda text: [text] if text else []  # it normalises runs of white space across the text
            self.encode = lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            special = [t.content for t in tok.get_added_tokens_decoder().values()]

            def split(text: str) -> list[str]:
                if len(text) <= LONG:
                    return PIECE.findall(text)
                out = []
                for p in PIECE.findall(text):
                    out += INSIDE.split(p) if len(p) > LONG and not any(x in p for x in special) else [p]
                return [p for p in out if p]

            self.split = split
            self.encode = lambda batch: [len(x) for x in tok.encode_batch_fast(batch, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHED_PIECES:
            known.clear()
        cut = [self.split(t) for t in texts]
        new = set()
        for pieces in cut:
            new.update(pieces)
        new = [p for p in new if p not in known]
        for batch in balanced(new):
            known.update(zip(batch, self.encode(batch), strict=True))
        out = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    tuned(docs.sparkSession)
    fields = columns("n_bytes long, n_tokens long, over_limit boolean")

    def make():
        counter = PieceCounter(tokenizer_path)

        def of(batch):
            texts = as_str(batch, text_col)
            counts = counter(texts)
            return [[len(t.encode()) for t in texts], counts, [c > limit for c in counts]]

        return of

    return with_new(docs, make, fields)
