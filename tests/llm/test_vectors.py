"""Hard negatives, the multi-index and the divergence audit against plain loops, and on awkward tables."""

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netloom.llm import divergence, multi_index, negatives, queries, vectors

VECTORS = "vec_id long, embedding array<double>, label int, ID string, vec string, query string, anchor_id string, list string, rest string, grp string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, values that are not finite, zero, short and empty vectors, many copies, repeated rows and clashing columns."""
    r = random.Random(5)
    rows = [(k, [r.choice((-1, 1)) * r.random() for _ in range(5)], r.randrange(3)) for k in range(90)]
    rows += [(100 + k, [0.5, 0.5, -0.25, 0.0, 0.125], k % 2) for k in range(60)] + [(100, [0.5, 0.5, -0.25, 0.0, 0.125], 0)] * 2
    rows += [(None, [1.0] * 5, 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [math.nan] * 5, 1), (203, [math.inf, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(204, [0.0] * 5, 1), (205, [], 1), (206, [0.75, -0.5], 2), (207, [0.5] * 5, None), (-20, [0.3] * 5, 2)]
    return spark.createDataFrame([(*x, *"abcdefg") for x in rows], VECTORS).repartition(3)


def taking_part(df):
    good = [r for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    return [(r.vec_id, r.embedding + [0.0] * (5 - len(r.embedding)), r.label) for r in good]


def plain_negatives(rows, every):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None]
    out = []
    for a, v, y in rows:
        if a % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), b, z == y) for b, w, z in rows if b != a)
            for s, p, _ in [x for x in scored if x[2]][:5]:
                window = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def test_hard_negatives_equal_plain_loops(spark, awkward, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 3)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "PAIRS", 7)
    monkeypatch.setattr(negatives, "GROUP", 4)  # several groups
    got = sorted(tuple(r) for r in negatives.hard_negatives(awkward, F.col("vec_id") % 10 == 0).collect())
    assert got == plain_negatives(taking_part(awkward), 10)


def test_hard_negatives_of_large_numbers_and_few_rows(spark, awkward):
    large = awkward.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6))  # scores over 2**53
    got = sorted(tuple(r) for r in negatives.hard_negatives(large, F.col("vec_id") % 10 == 0).collect())
    assert got == plain_negatives(taking_part(large), 10) and max(r[4] for r in got) > 2**53
    assert negatives.hard_negatives(awkward.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(awkward, F.lit(False)).schema == negatives.SCHEMA
    assert negatives.hard_negatives(awkward.where("vec_id = 10"), F.lit(True)).count() == 0


def test_intervals_hold_every_score():
    r = np.random.default_rng(2)
    rows = np.floor(256 * r.normal(size=(400, 9)))
    books = negatives.codebooks(rows[:50])
    codes, rest = negatives.coded(rows, books)
    off = np.abs(negatives.looked_up(codes, rows[:20], books) - rows @ rows[:20].T)
    assert (off <= rest[:, None] * np.sqrt((rows[:20] ** 2).sum(axis=1)) + 1e-6).all() and off.max() > 0


def test_neighbours_find_nine_of_ten(spark):
    """Recall on 2,000 rows, and each score and order as plain Python has them."""
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    of = dict(zip(t["vec_id"], t["embedding"], strict=True))
    got: dict[int, list] = {}
    for r in queries.op12_multi_index(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in of if i % 20 == 0}
    hits = 0
    ids, x = np.array(list(of)), np.array(list(of.values()))
    for q, found in got.items():
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21)) and found == sorted(found, key=lambda y: (-y[2], y[1]))
        assert all(s == inner(of[q], of[v]) for _, v, s in found)
        scores = x @ np.array(of[q])
        scores[ids == q] = -9
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def inner(a, b):
    """Summed in order; sum() itself compensates."""
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def plain_neighbours(rows, every, k):
    rows = [(i, v) for i, v, _ in rows if any(v)]
    out = []
    for q, v in (x for x in rows if x[0] % every == 0):
        near = sorted((-inner(v, w), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_of_awkward_rows(spark, awkward, monkeypatch):
    """With a spread that takes all lists the result is exact; copies outnumber k."""
    monkeypatch.setattr(multi_index, "GROUP", 5)
    monkeypatch.setattr(multi_index, "CHUNK", 2)
    got = sorted(tuple(r) for r in multi_index.neighbours(awkward, F.col("vec_id") % 20 == 0, k=7, spread=100.0, first=3).collect())
    assert got == plain_neighbours(taking_part(awkward), 20, 7)
    few = awkward.where("vec_id < 4")
    assert sorted(tuple(r) for r in multi_index.neighbours(few, F.col("vec_id") == 0).collect()) == plain_neighbours(taking_part(few), 1000, 20)
    assert multi_index.neighbours(awkward.limit(0), F.lit(True)).collect() == []
    assert multi_index.neighbours(awkward, F.lit(False)).schema == multi_index.SCHEMA
    one = spark.createDataFrame([(k, [float(k + 1)]) for k in range(5)], "vec_id long, embedding array<double>")  # the second half is empty
    assert [r.vec_id for r in multi_index.neighbours(one, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [4, 3]


def test_traversal_goes_by_ascending_sums():
    r = random.Random(3)
    a, b = ([r.random() for _ in range(9)] for _ in range(2))
    sizes = [r.randrange(3) for _ in range(81)]
    sums = sorted((a[i // 9] + b[i % 9], i) for i in range(81) if sizes[i])
    assert multi_index.traversed(np.array(a), np.array(b), sizes, np.inf, 0) == [i for _, i in sums]
    taken = multi_index.traversed(np.array(a), np.array(b), sizes, 10, 0.7)
    assert taken == [i for s, i in sums][: len(taken)] and sum(sizes[i] for i in taken) >= 10
    assert all((s <= 0.7) <= (i in taken) for s, i in sums)


def test_best_of_groups():
    r = np.random.default_rng(1)
    g, s, i = r.integers(0, 4, 300), r.integers(0, 9, 300).astype(float), r.permutation(300)
    held = vectors.Best(4, 6)
    for p in range(0, 300, 50):
        held.add(g[p : p + 50], s[p : p + 50], i[p : p + 50])
    for k in range(4):
        want = sorted((-x, y) for n, x, y in zip(g, s, i, strict=True) if n == k)[:6]
        assert [(-x, y) for n, x, y in zip(held.group, held.score, held.ident, strict=True) if n == k] == want
        assert held.floor[k] == -want[-1][0]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        in_docs: dict[str, int] = {}
        for _, _, w in own:
            for t in set(w):
                in_docs[t] = in_docs.get(t, 0) + 1
        kept = [t for t, n in in_docs.items() if n >= least]

        def shares(words):
            n = [words.count(t) for t in kept]
            return n, [1 + 10**9 * (c + 5) // (sum(n) + 5 * len(kept)) for c in n]

        of = {s: shares([t for _, x, w in own if x == s for t in w]) for s in {x[1] for x in own}}
        _, q = shares([t for _, _, w in own for t in w])
        for s, (n, p) in of.items():
            pair = [(-sum(abs(a - b) for a, b in zip(p, other, strict=True)), o.encode()) for o, (_, other) in of.items() if o != s]
            term = [(-(a - b), t.encode()) for c, a, b, t in zip(n, p, q, kept, strict=True) if c and a > b]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_equals_plain_loops(spark, monkeypatch):
    r = random.Random(8)
    words = ["the", "The", "THE", "é", "É", "ünder", "a b", "x1y", "z", "日本", "𐐷q", "o'clock", "never-ending", "", "Q" * 300]
    rows = [(r.choice((" ", "\n", "_", "\x00", "9")).join(r.choices(words, k=r.randrange(40))), r.choice(("en", "en", "de", None)), r.choice(("s1", "s2", "s3", "é", "", None))) for _ in range(120)]
    rows += [(None, "en", "s1"), ("", "en", "silent"), ("only here", "xx", "s1"), ("", "xx", "s2"), ("", "yy", "s1"), ("the " * 50_000, "de", "long")]
    df = spark.createDataFrame([(*x, "n", "t") for x in rows], "text string, lang string, source string, n string, term string").repartition(4)
    monkeypatch.setattr(divergence, "HELD", 10)
    got = sorted(tuple(x) for x in divergence.divergence(df, least_docs=4, term_ranks=3).collect())
    assert got == plain_divergence(rows, 4, 3)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 7_123_456_789_123, 98_765_432_109_876_543, 3_000_000
    got = spark.range(1).select(divergence.share(*(F.lit(x).cast("long") for x in (n, total, v))).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
