"""Source divergence audit: how far the sources of a language are from each other, and from the language, in their terms.

A task counts its documents' terms by (language, source, term) before anything is shuffled: occurrences, and documents, which
are whole in a task. Terms in enough documents of the language are kept. A group's share p of a term depends on the term's
count alone, so two sources are compared by their joint histogram: how many terms have each combination of counts (a, b).
Terms that both have are tallied by a join on the term, with partial sums in the tasks; combinations with a zero follow from each
source's own histogram and the number of kept terms, by inclusion and exclusion. f is evaluated once for each
combination and weighted with its terms. A pair is computed once for both orders.

Sources of a language pair with each other, as the result has a row for each such pair; a term brings at most one row for
each source to the join. Sums are whole numbers: shares use decimals of 38 digits and whole division.

Edge cases: null texts, languages and sources are ''. Every source of a language has its group, without terms too; with no kept
terms all values are 0. Ties go by the item's UTF-8 bytes. Repeated rows are documents of their own; a text of any length is
read whole, in one pass. Other columns, doc_id too, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batches, columns, discard, stored, tuned

#: Documents of the language that a term needs; what is added to each count; the shares' unit; ranks of the terms' part.
LEAST_DOCS, ADDED, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Counters that a task holds.
HELD = 400_000
#: Bytes of terms, A-Z as lower case; all others become a blank. Every byte of a code point from 0x80 is 0x80 or more.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCHEMA = columns("lang string, source string, part string, item string, value long, rank int")


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of the tasks; a null term stands for the group itself."""
    schema = columns("lang string, source string, term string, n long, docs long")

    def run(it):
        counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def emptied():
            for (lang, source), (n, in_docs) in counts.items():
                terms = list(n)
                size = len(terms) + 1
                rows = [[lang] * size, [source] * size, [*terms, None], [*n.values(), 0], [*map(in_docs.__getitem__, terms), 0]]
                kinds = [f.type for f in batches(schema, [[]] * 5).schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(t) if i < 3 else pa.array(c, t) for i, (c, t) in enumerate(zip(rows, kinds, strict=True))], names=schema.names)
            counts.clear()

        for b in it:
            for text, lang, source in zip(as_bytes(b, text_col), as_bytes(b, lang_col), as_bytes(b, source_col), strict=True):
                n, in_docs = counts[lang, source]
                terms = text.translate(TERM_BYTES).split()
                n.update(terms)
                in_docs.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from emptied()
        yield from emptied()

    return docs.select(text_col, lang_col, source_col).mapInArrow(run, schema)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), exact."""
    wide = lambda c: c.cast("decimal(24,0)")
    return 1 + F.call_function("div", wide(F.lit(UNIT)) * wide(count + ADDED), wide(total + ADDED * terms))


def tallies(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, a, b, terms): of each pair source < other, how many terms have a occurrences in one and b in the other."""
    one = counts.select("lang", "term", "source", F.col("n").alias("a"))
    two = counts.select("lang", "term", F.col("source").alias("other"), F.col("n").alias("b"))
    both = one.join(two, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other", "a", "b").agg(F.count("*").alias("terms"))
    both = stored(both, "both")
    histogram = counts.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count("*").alias("terms"))
    pairs = groups.select("lang", "source", "vocabulary").join(groups.select("lang", F.col("source").alias("other")), "lang").where("source < other")
    mine = pairs.join(histogram, ["lang", "source"]).select("lang", "source", "other", F.col("count").alias("a"), F.lit(0).cast("long").alias("b"), "terms")
    theirs = histogram.withColumnRenamed("source", "other")
    theirs = pairs.join(theirs, ["lang", "other"]).select("lang", "source", "other", F.lit(0).cast("long").alias("a"), F.col("count").alias("b"), "terms")
    # each joint combination (a, b) comes off (a, 0) and (0, b); none of both is left of the vocabulary
    cell = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("terms"))
    zero, n, a, b = F.lit(0).cast("long"), F.col("terms"), F.col("a"), F.col("b")
    spread = lambda df, *cells: df.select("lang", "source", "other", F.explode(F.array(*cells)).alias("c")).select("lang", "source", "other", "c.*")
    cells = spread(both, cell(a, b, n), cell(a, zero, -n), cell(zero, b, -n), cell(zero, zero, n))
    for single in (mine, theirs):
        cells = cells.unionByName(spread(single, cell(a, b, n), cell(zero, zero, -n)))
    cells = cells.unionByName(pairs.select("lang", "source", "other", zero.alias("a"), zero.alias("b"), F.col("vocabulary").alias("terms")))
    return cells.groupBy("lang", "source", "other", "a", "b").agg(F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """SCHEMA: for each source of each language all others by distance (part 'pair'), and the terms that it has more of than
    its language (part 'term', to term_ranks)."""
    tuned(docs.sparkSession)
    summed = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = stored(summed, "terms")
    terms = summed.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = stored(terms.drop("docs"), "kept-terms")
    counts = stored(summed.where("n > 0").drop("docs").join(terms, ["lang", "term"]), "counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("of_lang").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = summed.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "vocabulary", "lang_total")]), "groups")

    of = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), *["vocabulary"] * (name == "source"))
    joint = tallies(counts, groups).where("terms > 0").join(of("source"), ["lang", "source"]).join(of("other"), ["lang", "other"])
    p, q = (share(F.col(c), F.col(t), F.col("vocabulary")) for c, t in (("a", "source_total"), ("b", "other_total")))
    values = joint.groupBy("lang", "source", "other").agg(F.sum(F.abs(p - q) * F.col("terms")).alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("other")), "lang").where("source < other")
    values = stored(pairs.join(values, ["lang", "source", "other"], "left").select("lang", "source", "other", F.coalesce("value", F.lit(0)).alias("value")), "values")
    both_ways = values.select("lang", "source", F.col("other").alias("item"), "value").union(values.select("lang", "other", "source", "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both_ways.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))

    p, q = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("of_lang"), F.col("lang_total"), F.col("vocabulary"))
    more = counts.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    more = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= term_ranks).withColumn("part", F.lit("term"))
    out = stored(ranked.unionByName(more).select(*SCHEMA.names), "divergence")
    discard(summed, terms, counts, groups, values)
    return out
