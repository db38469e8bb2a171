"""Toxicity by a classifier chain.

The chain goes through the categories in order. Each link is a linear model over the words of a text and the log-odds
that the earlier links gave. Links are trained with out-of-fold predictions of the earlier ones, so that they learn to
trust them no more than they deserve; afterwards each link is fitted on the whole sample.

The sample is the SAMPLE labelled documents that come first by a hash of their id (a documented bound: their word hashes
go to the driver). Words enter a link if a log-likelihood ratio test on document counts links them to its category.

Edge cases: a null or empty text has no words and gets the probabilities of the bias; labels of unknown documents and
documents without labels don't train; with fewer than two classes in the sample a link gives the share of its class;
columns named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import as_bytes, batches, columns, tuned, unused, with_new

#: Labelled documents that train, folds, and what the ratio test must give.
SAMPLE, FOLDS, LEAST_RATIO = 20_000, 5, 15.0
#: The categories in the order of the chain: name and the condition on a label's columns.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
STRIPPED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_hash(piece: bytes) -> int:
    """A signed 64-bit hash of the word in lower case without punctuation around it, 0 if nothing is left."""
    word = piece.decode().lower().strip(STRIPPED)
    return xxhash.xxh3_64_intdigest(word) - (1 << 63) if word else 0


def fit_link(rows: np.ndarray, cols: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by gradient descent with momentum on presence features and dense extra ones."""
    w, v, b = np.zeros(width), np.zeros(extra.shape[1]), float(np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5)))
    mw, mv, mb, total = np.zeros_like(w), np.zeros_like(v), 0.0, weight.sum()
    share = np.sqrt(np.bincount(cols, weights=weight[rows], minlength=width) / total + 1e-3)
    for _ in range(300):
        z = b + extra @ v + np.bincount(rows, weights=w[cols], minlength=n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        gw = np.bincount(cols, weights=g[rows], minlength=width) + 1e-5 * w
        mw = 0.9 * mw - 1.0 * gw / share
        mv = 0.9 * mv - 0.05 * (g @ extra + 1e-4 * v)
        mb = 0.9 * mb - 0.3 * g.sum()
        w, v, b = w + mw, v + mv, b + mb
    return w, v, b


def ratio(k1: np.ndarray, n1: float, k0: np.ndarray, n0: float) -> np.ndarray:
    """Twice the log-likelihood ratio of two binomials against one."""

    def ll(k, n, p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    return 2 * (ll(k1, n1, k1 / n1) + ll(k0, n0, k0 / n0) - ll(k1, n1, (k1 + k0) / (n1 + n0)) - ll(k0, n0, (k1 + k0) / (n1 + n0)))


def train_chain(words: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> list[tuple[dict[int, float], np.ndarray, float]]:
    """For each category: weights by word hash, weights of the earlier links' log-odds, bias."""
    n = len(words)
    rows = np.repeat(np.arange(n), [len(w) for w in words]) if n else np.zeros(0, np.int64)
    names, cols = np.unique(np.concatenate(words) if n else np.zeros(0, np.int64), return_inverse=True)
    chain, earlier = [], np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        if not n or y.min() == y.max():
            share = float(y.mean()) if n else 0.0
            chain.append(({}, np.zeros(c), float(np.log((share + 1e-6) / (1 - share + 1e-6)))))
            earlier = np.hstack([earlier, np.full((n, 1), chain[-1][2])])
            continue

        def fitted(keep: np.ndarray, y=y, earlier=earlier):
            on = keep[rows]
            k1 = np.bincount(cols[on], weights=y[rows[on]], minlength=len(names))
            k0 = np.bincount(cols[on], minlength=len(names)) - k1
            good = np.flatnonzero(ratio(k1, max(y[keep].sum(), 1), k0, max((1 - y[keep]).sum(), 1)) >= LEAST_RATIO)
            place = np.full(len(names), -1)
            place[good] = np.arange(len(good))
            used = place[cols] >= 0
            r, k = rows[used], place[cols[used]]
            w, v, b = fit_link(r, k, n, len(good), earlier, y, keep.astype(float))
            return good, w, v, b, b + earlier @ v + np.bincount(r, weights=w[k], minlength=n)

        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                out_of_fold[out] = fitted(~out)[4][out]
        good, w, v, b, _ = fitted(np.ones(n, bool))
        chain.append(({int(names[g]): float(x) for g, x in zip(good, w, strict=True)}, v, float(b)))
        earlier = np.hstack([earlier, np.clip(out_of_fold, -30, 30)[:, None]])
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """The chain, trained on the bounded sample of labelled documents."""
    tuned(docs.sparkSession)
    [label_id] = unused(docs, "label_id")
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(label_id), *[F.expr(f"coalesce({e}, false)").alias(f"y{k}") for k, (_, e) in enumerate(categories)])
    chosen = chosen.groupBy(label_id).agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))]).orderBy(F.xxhash64(label_id), label_id).limit(sample)
    names = [f"y{k}" for k in range(len(categories))]
    schema = columns("id long, y array<boolean>, words binary")

    def words(it):
        of = Remembered(word_hash)
        for b in it:
            ids, ys, out = b.column(id_col).to_pylist(), zip(*[b.column(c).to_pylist() for c in names], strict=True), []
            for text in as_bytes(b, text_col):
                own = set(map(of.__getitem__, text.split())) - {0}
                out.append(np.sort(np.fromiter(own, np.int64, len(own))).tobytes())
            yield batches(schema, [ids, [list(y) for y in ys], out])

    found = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col(label_id))  # SAMPLE rows at most
    found = found.drop(label_id).mapInArrow(words, schema).toArrow().sort_by("id").to_pylist()
    seen, rows = set(), []
    for r in found:  # repeated ids train once
        if r["id"] not in seen:
            seen.add(r["id"])
            rows.append(r)
    y = np.array([r["y"] for r in rows], bool).reshape(len(rows), len(categories))
    fold = np.array([xxhash.xxh3_64_intdigest(str(r["id"])) % FOLDS for r in rows])
    return train_chain([np.frombuffer(r["words"], np.int64) for r in rows], y, fold)


def score(docs: DataFrame, chain, categories=CATEGORIES, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with p_<category> for each category and toxic, whether the last one's reaches the threshold."""
    tuned(docs.sparkSession)
    fields = columns(", ".join([f"p_{name} double" for name, _ in categories] + ["toxic boolean"]))

    def make():
        all_weights = {}
        for c, (weights, _, _) in enumerate(chain):
            for h, w in weights.items():
                all_weights.setdefault(h, [0.0] * len(chain))[c] = w

        def known(piece):
            h = word_hash(piece)
            return h if h in all_weights else 0

        of = Remembered(known)

        def scores(batch):
            out: list[list] = [[] for _ in fields]
            for text in as_bytes(batch, text_col):
                own = set(map(of.__getitem__, set(text.split()))) - {0}
                odds: list[float] = []
                for c, (_, v, b) in enumerate(chain):
                    z = b + sum(x * o for x, o in zip(v, odds, strict=True)) + sum([all_weights[h][c] for h in sorted(own)])
                    odds.append(max(-30.0, min(30.0, float(z))))
                p = [1 / (1 + np.exp(-z)) for z in odds]
                for c, x in zip(out, p + [bool(p[-1] >= threshold)], strict=True):
                    c.append(x)
            return out

        return scores

    return with_new(docs, make, fields)


def toxicity(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train the chain on labels and score every whole text of docs."""
    return score(docs, learn(docs, labels, categories, id_col=id_col, text_col=text_col), categories, text_col=text_col)
