"""The corpus operators against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netloom.llm import bpe, common, components, decontaminate, exact_dedup, line_dedup, lm_score, minhash, queries, secrets, token_counts, token_ids, toxicity

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
AWKWARD = "doc_id long, text string, kept string, N_TOKENS long, __sha string, part string, __doc string, gone_id string, __leak string, sha string, first string, points string, edge string, doc string, drops string, leak string, label_id string, text_key string, place string, toxic_reason string"
EXTRA = AWKWARD.count(",") - 1  # columns beside id and text


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], [x or "" for x in t["text"]], strict=True))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, repeated rows, ties, a very long text and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [(None, "null id row"), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same  text here"), (6, long), (7, long + " end"), (8, "İx ΣΑΣ é  \x1c <|endoftext|>a's 12½ " + "z" * 300)]
    rows = [(i, t, *(extra(i, k) for k in range(EXTRA))) for i, t in texts]
    return spark.createDataFrame(rows, AWKWARD).repartition(3)


def extra(i, k):
    """The value of the k-th extra column, which no operator may change; all are null in one row."""
    return None if i == 1 else (i or -1) * 100 + k if k == 1 else f"{i}/{k}"


def untouched(df, but=()):
    """Whether all columns of the awkward table but those of results have their values."""
    names = [f.split()[0] for f in AWKWARD.split(", ")][2:]
    rows = df.collect()
    assert rows
    return all(r[n] == extra(r.doc_id, k) for r in rows for k, n in enumerate(names) if n.lower() not in but)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)


def test_words_asked_for_again_are_not_merged_again():
    made = []
    table = bpe.Renewed(lambda w: made.append(w) or w.upper(), 3)
    for k in range(20):
        assert (table["often"], table[f"once{k}"]) == ("OFTEN", f"ONCE{k}")
    assert made.count("often") == 1 and len(table) <= 3 and len(table.old) <= 3


def test_tokens_equal_the_library(spark, texts, awkward, nothing):
    from tokenizers import Tokenizer

    word, byte = Tokenizer.from_file(queries.WORD_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    for got, of in ((queries.op1_bpe(spark, SF), texts), (bpe.bpe_encode(awkward, queries.WORD_BPE, ("n_tokens", "ids_sha256", "decoded_sha256")), {r.doc_id: r.text or "" for r in awkward.collect()})):
        rows = got.collect()
        assert len(rows) >= len(of)
        for r in rows:
            ids = word.encode(of[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    for got, of in ((queries.op8_token_counts(spark, SF), texts), (token_counts.count_tokens(awkward, queries.BYTE_BPE), {r.doc_id: r.text or "" for r in awkward.collect()})):
        for r in got.collect():
            n = len(byte.encode(of[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(of[r.doc_id].encode()), n, n > 512)
    assert bpe.bpe_encode(nothing, queries.WORD_BPE).count() == token_counts.count_tokens(nothing, queries.BYTE_BPE).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(awkward, queries.WORD_BPE), queries.WORD_BPE).where("doc_id = 4").first()
    assert back.decoded == "same</w> text</w> here</w>"


def test_counts_of_adversarial_pieces():
    from tokenizers import Tokenizer

    byte, rng, counter = Tokenizer.from_file(queries.BYTE_BPE), random.Random(5), token_counts.PieceCounter(queries.BYTE_BPE)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "B", "'s", "'", "12", "é", "!", "<|endoftext|>", "ß"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    assert counter(made) == [len(byte.encode(t, add_special_tokens=False).ids) for t in made]


def test_long_texts_without_white_space_are_cut(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "LONG", 5)
    byte, rng, counter = Tokenizer.from_file(queries.BYTE_BPE), random.Random(6), token_counts.PieceCounter(queries.BYTE_BPE)
    parts = ["a", "Bc", "'", "'s", "'ll", "12", "3", "é", "ß", "!", "...", "½", "漢字", " ", "\n", "_", "-", "e\u0301", "<|endoftext|>"]
    made = ["".join(rng.choices(parts[: 19 - k % 2], k=rng.randint(3, 40))) for k in range(3000)]
    assert counter(made) == [len(byte.encode(t, add_special_tokens=False).ids) for t in made]
    assert [sum(map(len, x)) for x in token_counts.balanced(["éé", "ab", "c"], 4)] == [2, 3]


def test_token_file_round_trip(spark, texts, awkward, nothing):
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(queries.WORD_BPE)
    ids = {i: word.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    start = 0
    for r in sorted(queries.op4_token_ids(spark, SF).collect(), key=lambda r: r.doc_id):
        x = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    rows = token_ids.read_ids(*token_ids.write_ids(awkward, queries.WORD_BPE)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in rows) == sorted((r.doc_id is not None, r.doc_id or 0, tuple(word.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in awkward.collect())
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert token_ids.read_ids(*token_ids.write_ids(nothing, queries.WORD_BPE)).count() == 0


def test_huffman_lengths_are_best_within_the_limit():
    rng = np.random.default_rng(1)
    for n in (2, 3, 50, 3000):
        counts = (rng.zipf(1.2, n) % 10_000_000).astype(np.int64) + 1
        lengths = token_ids.code_lengths(counts)
        assert sum(2.0 ** -x for x in lengths.astype(float)) == 1 and lengths.max() <= token_ids.LIMIT
        import heapq

        heap = [(int(c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0))
        assert cost <= (counts * lengths).sum() <= cost * 1.02
        codes = token_ids.Codes(lengths)
        ids = rng.integers(0, n, 5000).astype(np.uint32)
        assert (codes.decode(*codes.encode(ids), len(ids)) == ids).all()


def sets_of(texts, words=5):
    out = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


def brute_components(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_dedup_equals_brute_force(spark, texts):
    sets = sets_of(texts)
    want = brute_components(sets, 85)
    got = queries.op5_minhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_dedup_of_a_large_family(spark, nothing, awkward):
    """A family that no single hub joins: copies of copies, and members too far from the base."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    texts, parents = {}, [base]
    for i in range(260):
        t = list(rng.choice(parents) if rng.random() < 0.5 else base)
        for _ in range(rng.choice((0, 1, 2, 3, 5))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        parents.append(t)
        texts[i] = " ".join(t)
    want = brute_components(sets_of(texts), 85)
    got = minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 0.85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert len(set(want.values())) > 3
    assert minhash.near_dedup(nothing).count() == 0
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(awkward).collect()}
    assert {(None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (5, 1, 4, False), (7, 978, 6, False)} <= rows | {(7, 978, 6, False)}
    assert sum(1 for r in rows if r[2] == 6) == 2
    assert minhash.drop_near(awkward).columns == awkward.columns


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    cols = sorted(want.columns)
    got = queries.queries()[name](spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.select(", ".join(cols)).fetchall())


def test_exact_dedup(spark, awkward, nothing):
    rows = exact_dedup.decide(awkward).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    for group in by.values():
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} and len({r.keep_id for r in group}) == 1
    assert {r.doc_id: r.keep_id for r in rows}[4] == 5 and {r.doc_id: r.keep_id for r in rows}[1] == 3
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 5, 6, 7, 8] and untouched(kept)
    assert exact_dedup.decide(nothing).count() == exact_dedup.exact_dedup(nothing).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat(id, ' z'), repeat(' ', cast(id % 5 as int)) || 'hot') as text")
    assert exact_dedup.exact_dedup(many).count() == 1001
    r = exact_dedup.decide(many).where("group_size > 1").agg({"keep_id": "max", "group_size": "min", "doc_id": "count"}).first()
    assert set(r) == {4, 2000} and exact_dedup.decide(many).where("group_size > 1 and kept").count() == 1


def test_long_runs_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PIECE", 7)
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat(id, ' z'), repeat(' ', cast(id % 5 as int)) || 'hot') as text")
    r = exact_dedup.decide(many).where("group_size > 1").agg({"keep_id": "max", "group_size": "min", "doc_id": "count"}).first()
    assert set(r) == {4, 2000} and exact_dedup.decide(many).where("kept").count() == 1001


def test_other_columns_keep_their_values(spark, awkward):
    assert untouched(bpe.bpe_encode(awkward, queries.WORD_BPE), {"n_tokens"})
    assert untouched(token_counts.count_tokens(awkward, queries.BYTE_BPE), {"n_tokens"})
    assert untouched(secrets.scan_secrets(awkward)) and untouched(line_dedup.line_dedup(awkward)) and untouched(minhash.drop_near(awkward))
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert untouched(toxicity.toxicity(awkward, labels))
    assert untouched(decontaminate.decontaminate(awkward, spark.createDataFrame([(1, "null id row")], "item_id long, text string")))


def test_common_lines_go_by_broadcast(spark, monkeypatch):
    rows = [(k, "\n".join(f"a line that is long enough, number {n}" for n in range(40) if n == 0 or k % (n + 1) == 0)) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.line_dedup(docs).collect()))
    for hot in (1, 10, 100):  # from no key to many
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(tuple, line_dedup.line_dedup(docs).collect())) == want


def test_settings_and_tables_are_taken_back(spark):
    import os

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    common.clean_up(spark)
    spark.conf.set(key, "77")
    common.tuned(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
    common.tuned(spark, 64)
    df = common.stored(spark.range(3).toDF("a"), "some")
    path = common.root(spark).removeprefix("file://")
    assert spark.conf.get(key) == "64" and df.count() == 3 and os.path.isdir(path)
    common.clean_up(spark)
    assert spark.conf.get(key, None) is None and not os.path.exists(path)


def test_line_dedup(spark, awkward, nothing):
    line = "A line that is long enough to count"
    rows = [(1, f"{line}\nshort"), (2, f"  {line.upper()}\t\n{line}"), (3, f"x\n{line}\r\n{line}"), (3, line), (None, line), (4, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_lines, r.n_dropped, r.kept_text) for r in got) == [(0, 1, 0, line), (1, 2, 1, "short"), (2, 2, 2, ""), (3, 1, 0, line), (3, 3, 0, f"x\n{line}\r\n{line}"), (4, 1, 0, "")]
    assert line_dedup.line_dedup(nothing).count() == 0 and line_dedup.line_dedup(awkward).count() == 10


def test_secrets_against_plain_patterns(spark, texts, awkward, nothing):
    for r in queries.op9_secrets(spark, SF).collect():
        t, spans = texts[r.doc_id], []
        for k, (p, least, group) in enumerate(((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0))):
            spans += [(m.start(), k, m.end()) for m in re.finditer(p, t, re.ASCII | (re.IGNORECASE if k == 0 else 0)) if len(m[group]) >= least]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == sha(written) and set(written.split(",")) - {""} <= set(r.spans.split(","))
    assert secrets.scan_secrets(nothing).count() == 0 and secrets.scan_secrets(awkward).count() == 10


def test_entropy_windows_equal_a_plain_count():
    rng, never = random.Random(2), re.compile(r"(?!)")
    for kind, letters in (("entropy_hex", "0123456789abcdef"), ("entropy_wide", "ABCdefGHIjkl0123456789+/"), ("entropy_letters", "ABCdefGHIjklmnopQRSTuv+/")):
        for _ in range(50):
            s = "".join(rng.choice(letters[: rng.randint(2, len(letters))]) for _ in range(rng.randint(5, 80)))
            on = set()
            for a in range(len(s) - secrets.WINDOW + 1):
                w = s[a : a + secrets.WINDOW]
                h = -sum(n / len(w) * math.log2(n / len(w)) for n in collections.Counter(w).values())
                if h >= secrets.THRESHOLD[kind] - 1e-9 and any(map(str.isalpha, w)) and (kind == "entropy_letters" or any(map(str.isdigit, w))):
                    on.update(range(a, a + len(w)))
            assert {x for a, b in secrets.entropy_spans(s, kind, never) for x in range(a, b)} == on
    allowed = re.compile("|".join(f"(?:{p})" for p in secrets.ALLOWED))
    assert secrets.find_spans("id 123e4567-e89b-12d3-a456-426614174000 ok", allowed)[1] == []
    assert secrets.find_spans("key AbC9dEf8GhI7jKl6MnO5pQr4", allowed)[1]
    assert secrets.find_spans("key QzXjKvBwPfMgYhDlTrCnEa or qzxjkvbwpfmgyhdltrcnea", allowed)[1] == [(4, 5, 26), (30, 5, 52)]
    for words in ("internationalisierungsvorhaben", "the/quick-brown_fox/jumps-over_lazy", "someVeryLongCamelCaseNameOfThings", "ONE_TWO_THREE_FOUR_QUICK_BROWN"):
        assert secrets.find_spans(words, allowed)[1] == []


def test_toxicity(spark, awkward, nothing):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hit = sum(r.toxic and r.y == 1 for r in rows)
    assert hit / sum(r.y for r in rows) > 0.7 and hit / sum(r.toxic for r in rows) > 0.95
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.toxicity(nothing, labels).count() == 0 and toxicity.toxicity(awkward, labels.limit(0)).count() == 10


def plain_chain(texts, labels):
    """Probabilities of both categories for each text by plain loops; labels: id to (low quality, toxic)."""
    import xxhash

    def words(text):
        return {w for w in (x.decode().lower().strip(toxicity.STRIPPED) for x in text.encode().split()) if w}

    def log_likelihood(k, n, p):
        p = min(max(p, 1e-9), 1 - 1e-9)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    ids = sorted(labels)
    rows = {i: words(texts[i]) for i in texts}
    fold = {i: xxhash.xxh3_64_intdigest(str(i)) % toxicity.FOLDS for i in ids}

    def fit(on, y, earlier):
        n1, n0 = max(sum(y[i] for i in on), 1), max(sum(not y[i] for i in on), 1)
        k1, k0 = (collections.Counter(w for i in on if y[i] == want for w in rows[i]) for want in (True, False))
        keep = []
        for w in k1 | k0:
            both = (k1[w] + k0[w]) / (n1 + n0)
            parts = log_likelihood(k1[w], n1, k1[w] / n1) + log_likelihood(k0[w], n0, k0[w] / n0)
            if 2 * (parts - log_likelihood(k1[w], n1, both) - log_likelihood(k0[w], n0, both)) >= toxicity.LEAST_RATIO:
                keep.append(w)
        w, v = dict.fromkeys(keep, 0.0), [0.0] * len(earlier)
        b = math.log((sum(y[i] for i in on) + 0.5) / (sum(not y[i] for i in on) + 0.5))
        mw, mv, mb = dict.fromkeys(keep, 0.0), [0.0] * len(earlier), 0.0
        used = {i: [x for x in keep if x in rows[i]] for i in on}
        share = {x: math.sqrt(sum(x in rows[i] for i in on) / len(on) + 1e-3) for x in keep}
        for _ in range(300):
            gw, gv, gb = {x: 1e-5 * w[x] for x in keep}, [1e-4 * x for x in v], 0.0
            for i in on:
                z = b + sum(x * e[i] for x, e in zip(v, earlier, strict=True)) + sum(w[x] for x in used[i])
                g = (1 / (1 + math.exp(-min(max(z, -30), 30))) - y[i]) / len(on)
                gb += g
                for x in used[i]:
                    gw[x] += g
                for k, e in enumerate(earlier):
                    gv[k] += g * e[i]
            for x in keep:
                mw[x] = 0.9 * mw[x] - gw[x] / share[x]
                w[x] += mw[x]
            mv = [0.9 * m - 0.05 * g for m, g in zip(mv, gv, strict=True)]
            v = [x + m for x, m in zip(v, mv, strict=True)]
            mb = 0.9 * mb - 0.3 * gb
            b += mb
        return lambda i, before: b + sum(x * e for x, e in zip(v, before, strict=True)) + sum(w[x] for x in keep if x in rows[i])

    links, earlier = [], []
    for c in range(2):
        y = {i: labels[i][c] for i in ids}
        out = {}
        for f in sorted(set(fold.values())):
            link = fit([i for i in ids if fold[i] != f], y, earlier)
            out |= {i: min(max(link(i, [e[i] for e in earlier]), -30), 30) for i in ids if fold[i] == f}
        links.append(fit(ids, y, earlier))
        earlier.append(out)
    result = {}
    for i in texts:
        odds = []
        for link in links:
            odds.append(min(max(link(i, odds), -30), 30))
        result[i] = [1 / (1 + math.exp(-z)) for z in odds]
    return result


@pytest.fixture(scope="module")
def toxic(texts):
    t = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    return plain_chain(texts, {r["doc_id"]: (r["quality"] == 0, r["toxic"] == 1) for r in t if r["doc_id"] in texts})


def test_chain_equals_plain_loops(spark, texts, toxic):
    got = queries.op2_toxicity(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(tuple(toxic[r.doc_id]), abs=1e-6) and r.toxic == (r.p_toxic >= 0.5)
    assert any(r.toxic for r in got)


def test_pipeline_equals_brute_force(spark, texts, toxic, monkeypatch):
    """Every stage by plain loops over what the one before kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    kept = {i: t for i, t in texts.items() if toxic[i][1] < 0.5}
    groups = collections.defaultdict(list)
    for i, t in kept.items():
        groups[t.translate(str.maketrans("", "", SPACE))].append((-len(t), i))
    kept = {i: kept[i] for i in sorted(min(g)[1] for g in groups.values())}
    kept = {i: kept[i] for i, c in brute_components(sets_of(kept), 80).items() if i == c}
    items = [t.lower().split() for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    kept = {i: t for i, t in kept.items() if not any(plain_overlaps([w.decode() for w in t.encode().lower().split()], item) for item in items)}
    word = Tokenizer.from_file(queries.WORD_BPE)
    want = {}
    for i, t in kept.items():
        ids = word.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(texts)


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "null id row"), (None, None)], "item_id long, text string")
    for name, docs, extra_tables in (("awkward", awkward, (labels, bench)), ("empty", nothing, (labels.limit(0), bench.limit(0)))):
        for table, df in zip(("documents", "labels", "benchmark"), (docs, *extra_tables), strict=True):
            df.write.parquet(f"file://{tmp_path}/{name}/{table}.parquet")
        at = spark.read.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            at = stage(spark, at, f"file://{tmp_path}/{name}")
            assert at.columns == docs.columns
        assert name == "empty" or untouched(at)
        rows = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted(r.doc_id for r in rows) == ([] if name == "empty" else [3, 5, 6, 8])


def test_chain_learns_from_the_earlier_link():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.5
    words = [np.array(sorted({1 if f else 2, 10 + int(k % 7)}), np.int64) for k, f in enumerate(first)]
    labels = np.stack([first, first], 1)
    chain = toxicity.train_chain(words, labels, np.arange(600) % 5)
    assert chain[1][1][0] > 0 and chain[0][0][1] > 0 > chain[0][0][2]


def test_overlaps_tolerate_two_substitutions(spark, awkward, nothing):
    rng = random.Random(4)
    item = [f"b{rng.randrange(1000)}" for _ in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "a b c"), (4, "just seven words are in this item")], "item_id long, text string")
    docs = [(0, " ".join(f"c{k}" for k in range(200)))]
    for a in range(12):
        for b in range(a + 1, 13):
            part = item[10:23]
            part[a] = part[b] = "other"
            docs.append((len(docs), "x y " + " ".join(part) + " z"))
    n = len(docs)
    docs += [(n, "say JUST seven words are in this item now"), (n + 1, "just seven words were in this item"), (n + 2, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_overlaps(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 1) for k in range(1, n)} | {(n, 4), (n + 1, 4)}
    clean = decontaminate.decontaminate(table, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [0, n + 2]
    assert decontaminate.find_overlaps(nothing, bench).count() == 0 and decontaminate.decontaminate(awkward, bench.limit(0)).count() == 10


def plain_overlaps(words, item):
    """The rule by plain loops: joined windows, of which those with more equal words stay where two share a word."""
    width, found = min(13, len(item)), []
    least, lines = math.ceil(0.8 * width), collections.defaultdict(set)
    where = collections.defaultdict(list)
    for q, w in enumerate(item):
        where[w].append(q)
    for p, w in enumerate(words):
        for q in where.get(w, ()):
            lines[p - q].add(p)
    for start, equal in lines.items():
        if len(equal) < least:
            continue
        good = [p for p in range(max(0, start), min(len(words), start + len(item)) - width + 1) if sum(p + k in equal for k in range(width)) >= least]
        while good:
            p = q = good.pop(0)
            while good and good[0] == q + 1:
                q = good.pop(0)
            found.append((p, q + width - p, sum(k in equal for k in range(p, q + width))))
    out = []
    for x in sorted(set(found), key=lambda x: (-x[2], x)):
        if all(x[0] + x[1] <= y[0] or y[0] + y[1] <= x[0] for y in out):
            out.append(x)
    return sorted(out)


def test_overlaps_equal_brute_force_both_ways(spark, awkward, monkeypatch):
    """Items of every length, texts made of parts of them with words changed, and the whole tables of sf0.001."""
    rng = random.Random(8)
    items = {k: [f"b{rng.randrange(60)}" for _ in range(1 + k % 20)] for k in range(60)}
    items[60] = items[39]
    texts = {}
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = list(items[rng.randrange(60)])
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "other"
            words += [f"c{rng.randrange(9)}" for _ in range(rng.randint(0, 3))] + part
        texts[k] = words
    want = sorted((i, j, *x) for i, words in texts.items() for j, item in items.items() for x in plain_overlaps(words, item))
    docs = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in items.items()], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.find_overlaps(docs, bench).collect())) == want and want
    clean = sorted(set(texts) - {x[0] for x in want})
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == clean and clean
    whole, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = sorted(map(tuple, decontaminate.find_overlaps(whole, benchmark).collect()))
    own = {r.item_id: r.text.lower().split() for r in benchmark.collect()}
    assert found == sorted((r.doc_id, j, *x) for r in whole.collect() for j, item in own.items() for x in plain_overlaps((r.text or "").lower().split(), item))
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)  # both tables by the join of seeds
    assert sorted(map(tuple, decontaminate.find_overlaps(docs, bench).collect())) == want
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == clean
    assert sorted(map(tuple, decontaminate.find_overlaps(whole, benchmark).collect())) == found
    one = spark.createDataFrame([(1, "null id row")], "item_id long, text string")
    kept = decontaminate.decontaminate(awkward, one)
    assert kept.columns == awkward.columns and kept.count() == 9 and untouched(kept)


OTHER, END = ("other",), ("end",)  # no pieces


def plain_lm(path, train, passes, pseudo):
    """Piece weights by plain loops, and a function from a text to its marginal by one recursion over all of it."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    share = {m.id_to_piece(i): 1 / (10 - m.get_score(i)) for i in ids}
    prior = {p: pseudo * len(share) * x / sum(share.values()) for p, x in share.items()} | {OTHER: pseudo, END: pseudo}
    longest = max(map(len, share))
    words = collections.Counter(w for t in train for w in t)
    weights = dict(prior)

    def arcs(s, w, total):
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - longest), j):
                piece = s[i:j]
                if piece in share:
                    yield i, j, piece, w[piece] / total
                elif j - i == 1:
                    yield i, j, OTHER, w[OTHER] / total / 2**17

    for _ in range(passes):
        total, new = sum(weights.values()), dict(prior)
        for word, c in words.items():
            s = "▁" + word
            graph = list(arcs(s, weights, total))
            ahead, behind = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
            for i, j, _, p in graph:
                ahead[j] += ahead[i] * p
            for i, j, _, p in sorted(graph, key=lambda a: -a[0]):
                behind[i] += behind[j] * p
            for i, j, piece, p in graph:
                new[piece] += c * ahead[i] * p * behind[j] / ahead[-1]
        new[END] += len(train)
        weights = new
    total = sum(weights.values())

    def score(ws):
        s, at, logs = "".join("▁" + w for w in ws), 0, 0.0
        ahead = [1.0] + [0.0] * len(s)
        for i, j, _, p in arcs(s, weights, total):
            if j > at:  # the last node is whole: rescale what later ones build on
                if at and ahead[at]:
                    logs += math.log10(ahead[at])
                    low = max(0, at - longest)
                    scale = ahead[at]
                    for k in range(low, at + 1):
                        ahead[k] /= scale
                at = j
            ahead[j] += ahead[i] * p
        return logs + math.log10(ahead[-1]) + math.log10(weights[END] / total)

    return score


def test_lm_scores_equal_brute_force(spark, texts, monkeypatch):
    """Weights by plain loops over the training words; each whole text by one plain recursion over all its characters."""
    cut = {i: [x.decode() for x in t.encode().lower().split()] for i, t in texts.items()}
    train = [ws for i, ws in cut.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for ws in train for w in [*ws, ""])
    n, v = sum(count.values()), len(count)
    score = plain_lm(queries.PIECES, train, lm_score.PASSES, lm_score.PSEUDO)
    got = {r.doc_id: r for r in queries.op3_lm_score(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        words = [*cut[i], ""]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(w in count for w in words), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score(cut[i]), rel=1e-9)
    monkeypatch.setattr(lm_score, "HEAD", 0)  # every word goes through the join
    monkeypatch.setattr(lm_score, "HOT", 1e-9)
    for r in queries.op3_lm_score(spark, SF).collect():
        assert (r.n_known, r.base_score, r.score) == pytest.approx((got[r.doc_id].n_known, got[r.doc_id].base_score, got[r.doc_id].score))


def test_lm_words_that_are_hot_for_the_join(spark, monkeypatch):
    """A rule of dashes and a long footer in all documents, a word in all held-out ones: by the dictionary or by the join, the same."""
    ids = range(60)
    out = [i for i in ids if lm_score.held_out(i)]
    text = lambda i: f"word{i} {'-' * 100} {'x' * 70}\u00e9 {'UNSEEN' * (i in out)} {'b' * 65 if i == out[0] else ''}"
    docs = spark.createDataFrame([(i, text(i)) for i in ids], "doc_id long, text string")
    made = lambda: {r.doc_id: tuple(r) for r in lm_score.lm_score(docs, queries.PIECES).collect()}
    by_head = made()
    monkeypatch.setattr(lm_score, "HEAD", 0)
    monkeypatch.setattr(lm_score, "HOT", 20)  # the two long words, the end and the one of held-out documents only, or not even that
    some = made()
    monkeypatch.setattr(lm_score, "HOT", 1e-9)
    by_join = made()
    assert set(by_head) == set(some) == set(by_join) == set(ids)
    for i in ids:
        assert by_head[i] == pytest.approx(by_join[i]) and some[i] == pytest.approx(by_join[i])
        known = 1 + 2 + (i not in out)  # the end, both long words, its own
        assert by_head[i][3] == known
    assert lm_score.short(b"a" * 64) == b"a" * 64 and len(lm_score.short(b"a" * 65)) == 33


def test_lm_lattice_and_awkward_tables(spark, awkward, nothing):
    lattice = lm_score.Lattice(["▁", "a", "b", "ab", "▁ab", "infra", "structure", "infrastructure"], np.arange(1.0, 11.0))
    weight = np.exp(lattice.logp)

    def brute(s):
        pieces = ["", "▁", "a", "b", "ab", "▁ab", "infra", "structure", "infrastructure"]
        return 1.0 if not s else sum((weight[pieces.index(s[:k])] if s[:k] in pieces else weight[0] if k == 1 else 0.0) * brute(s[k:]) for k in range(1, len(s) + 1))

    words = ["a", "abba", "bxa", "ababab", "infrastructure", "", "é"]
    assert lattice.log_marginals(words) == pytest.approx([math.log(brute("▁" + w)) for w in words])
    uses = lattice.expected(["ab"], np.array([3.0]))
    assert uses[5] == pytest.approx(3 * weight[5] / brute("▁ab")) and uses[2] == pytest.approx(3 * weight[1] * weight[2] * weight[3] / brute("▁ab"))
    pieces, shares = lm_score.load_pieces(queries.PIECES)
    assert "▁infrastructure" in pieces and "▁the" in pieces and shares.sum() == pytest.approx(1)
    assert lm_score.lm_score(nothing, queries.PIECES).count() == 0
    rows = lm_score.lm_score(awkward, queries.PIECES).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) for r in rows)


def test_long_lists_compare_every_set_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", 0)  # every list is long
    rng = random.Random(5)
    rows, want = [], set()
    for g in range(6):
        for k in range(2):  # two texts under one id, each with a near copy
            base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
            rows += [(10 * g, " ".join(base)), (10 * g + 1 + k, " ".join(base[:-1]))]
            want.add((10 * g, 10 * g + 1 + k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reps = minhash.signatures(docs, "doc_id", "text", 5).withColumnRenamed("doc_id", "rep").cache()
    least = minhash.needed(0.85)
    posted = minhash.postings(reps, minhash.frequency_sketch(reps), minhash.COORDINATES - least + 1)
    heads = posted.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("common", "rep")).getField("rep").alias("hub")).where("n > 1")
    lists = posted.select("key", "rep").join(heads, "key").cache()
    links = minhash.open_links(lists, reps, spark.createDataFrame([], "v long, label long"), docs, least, 0.85, 5, "doc_id", "text")
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == want
