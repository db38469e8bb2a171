"""Secret scans: patterns of known kinds, and a sliding window of Shannon entropy over candidate strings.

Candidates are the longest runs of [A-Za-z0-9+/_=-] with at least WINDOW characters. A run has one of three classes,
hexadecimal digits only, letters without digits, or the wider alphabet, each with its threshold. A window of WINDOW
characters slides over it; its entropy follows from counts that change by one character in and one out. Windows over the
threshold that hold letters, and digits too where the class has any, are joined into spans, unless the candidate is on the
allow-list.

Edge cases: a null or empty text has no spans; positions are code points, ends exclusive; repeated rows are scanned
each; columns named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import sha256
from math import log2

from pyspark.sql import DataFrame

from .common import as_str, columns, tuned, with_new

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_wide", "entropy_letters")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_ONLY, NO_DIGIT = re.compile(r"[0-9A-Fa-f]+"), re.compile(r"[^0-9]+")
#: Characters in a window; bits a character that a window needs, by class.
WINDOW, THRESHOLD = 20, {"entropy_hex": 3.0, "entropy_wide": 3.7, "entropy_letters": 4.0}
#: Candidates that match one of these wholly are no secrets: UUIDs, numbers, words of one case or with a capital joined by - _ / + or =
#: or by capitals, the hexadecimal digits in order.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"[+/_=-]*([A-Z]?[a-z]{1,24}|[A-Z]{1,24})([+/_=-]+([A-Z]?[a-z]{1,24}|[A-Z]{1,24}))+[+/_=-]*",
    r"[A-Z]?[a-z]{2,24}([A-Z][a-z]{2,24})+",
    r"0123456789abcdef(0123456789abcdef)*",
)
_TERM = [0.0, *(n * log2(n) for n in range(1, WINDOW + 2))]  # a character comes in before one goes out


def entropy_spans(candidate: str, kind: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Joined windows of the candidate over its class's threshold."""
    if len(candidate) < WINDOW or allowed.fullmatch(candidate):
        return []
    counts: dict[str, int] = {}
    total = letters = digits = 0
    least, out = THRESHOLD[kind], []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        letters += c.isalpha()
        digits += c.isdigit()
        if i >= WINDOW:
            o = candidate[i - WINDOW]
            n = counts[o]
            counts[o] = n - 1
            total += _TERM[n - 1] - _TERM[n]
            letters -= o.isalpha()
            digits -= o.isdigit()
        if i >= WINDOW - 1 and letters and (digits or kind == "entropy_letters") and _TERM[WINDOW] / WINDOW - total / WINDOW >= least - 1e-9:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def find_spans(text: str, allowed: re.Pattern) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and entropy spans as (start, number of the kind, end)."""
    base, more = [], []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    at = 0
    for word in text.split():
        if len(word) < 20:
            continue
        at = text.index(word, at)  # the other kinds hold no white space and have at least 20 characters
        if "AKIA" in word:
            base += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(word) if m.end() - m.start() >= 20]
        base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= 24]
        for m in CANDIDATE.finditer(word):
            kind = 5 if NO_DIGIT.fullmatch(m[0]) else 3 if HEX_ONLY.fullmatch(m[0]) else 4
            more += [(at + m.start() + a, kind, at + m.start() + b) for a, b in entropy_spans(m[0], KINDS[kind], allowed)]
        at += len(word)
    return sorted(base), more


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def scan_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, text_col: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 (of the base spans as written) and spans (all of them)."""
    tuned(docs.sparkSession)
    fields = columns("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

    def make():
        pattern = re.compile("|".join(f"(?:{p})" for p in allowed) or r"(?!)")

        def of(batch):
            out = [[], [], [], [], []]
            for text in as_str(batch, text_col):
                base, more = find_spans(text, pattern)
                for k in range(3):
                    out[k].append(sum(1 for x in base if x[1] == k))
                out[3].append(sha256(written(base).encode()).hexdigest())
                out[4].append(written(sorted(base + more)))
            return out

        return of

    return with_new(docs, make, fields)
