"""Multifractal address structure of sets of IPv4 addresses, as relational plans over prefix counts.

keys: the columns that name a set; addresses: (keys, a) with distinct addresses. A set of one address has no structure.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import trie
from netloom.operators.trie import DENSE, HALF, Q_FIRST, Q_LAST, Q_STEP


def prefix_counts(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, len, prefix, n) for the lengths 0 to 32. An address is shuffled once; what it is counted in is made where its block is."""
    names = ", ".join(f"{k} {v}" for k, v in addresses.select(*keys).dtypes)
    blocks = _blocks(addresses, keys)
    long = blocks.sortWithinPartitions(*keys, "a").mapInArrow(partial(trie.long_prefixes, keys), f"{names}, {trie.PREFIXES}")
    short = blocks.groupBy(*keys, "block").agg(F.count("*").alias("n")).repartition(*keys).sortWithinPartitions(*keys, "block")
    return long.unionByName(short.mapInArrow(partial(trie.short_prefixes, keys), f"{names}, {trie.PREFIXES}"))


def prefix_bounds(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, total): the first length with a prefix of one address and the first with a nearly full prefix."""
    full = F.col("n") / F.pow(F.lit(2.0), 32 - F.col("len")) >= DENSE
    return counts.groupBy(*keys).agg(
        F.min(F.when((F.col("len") >= 1) & (F.col("n") == 1), F.col("len"))).alias("lo"),
        F.min(F.when((F.col("len") >= 1) & full, F.col("len"))).alias("hi"),
        F.max(F.when(F.col("len") == 0, F.col("n"))).alias("total"),
    ).where("total >= 2 and lo is not null and hi >= lo")


def structure(counts: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q8, tau, sd) for q from -0.5 to 3.5 in steps of 1/8; lengths without a split parent add zero moments."""
    children = counts.select(*keys, (F.col("len") - 1).alias("len"), F.shiftright("prefix", 1).alias("prefix"), F.col("n").alias("m"))
    parents = counts.where("n > 1").join(bounds, keys).where("len between lo and hi")
    split = parents.join(children, [*keys, "len", "prefix"])
    q = F.explode(F.sequence(F.lit(Q_FIRST), F.lit(Q_LAST))).alias("q8")
    per = split.groupBy(*keys, "lo", "hi", "len", "prefix", "n").agg(F.collect_list("m").alias("ms")).select(*keys, "lo", "hi", "len", "n", "ms", q)
    p = F.col("q8") / Q_STEP
    y = F.aggregate(F.transform("ms", lambda m: F.pow(m.cast("double"), p)), F.lit(0.0), lambda s, v: s + v)
    per = per.select(*keys, "lo", "hi", "len", "q8", F.pow(F.col("n").cast("double"), p).alias("x"), y.alias("y"))
    # Σ(x/Z - y/Z')² = Σx²/Z² - 2Σxy/(Z Z') + Σy²/Z'², one aggregation
    x, y = F.col("x"), F.col("y")
    sums = (("z", x), ("w", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))
    moment = per.groupBy(*keys, "lo", "hi", "len", "q8").agg(*[F.sum(v).alias(n) for n, v in sums])
    d2 = F.col("xx") / (F.col("z") * F.col("z")) - 2 * F.col("xy") / (F.col("z") * F.col("w")) + F.col("yy") / (F.col("w") * F.col("w"))
    moment = moment.select(*keys, "lo", "hi", "q8", (F.log2("z") - F.log2("w")).alias("tau"), F.greatest(d2, F.lit(0.0)).alias("d2"))
    lengths = F.col("hi") - F.col("lo") + 1
    sums = moment.groupBy(*keys, "lo", "hi", "q8").agg(F.sum("tau").alias("tau"), F.sum("d2").alias("d2"))
    return sums.select(*keys, "q8", (F.col("tau") / lengths).alias("tau"), F.sqrt(F.col("d2") / lengths).alias("sd"))


def spectrum(structures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q8, alpha, f) of the first strictly decreasing run of alpha, without the run's first point."""
    w = Window.partitionBy(*keys).orderBy("q8")
    alpha = (F.lead("tau").over(w) - F.lag("tau").over(w)) / (2 / Q_STEP)
    s = structures.withColumn("alpha", alpha).where("alpha is not null")
    s = s.withColumn("dec", (F.lag("alpha").over(w) - F.col("alpha") > 1e-9).cast("int"))  # flat is not decreasing
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("seen", F.coalesce(F.sum("dec").over(upto), F.lit(0)))
    s = s.withColumn("stop", F.sum(F.when((F.coalesce("dec", F.lit(0)) == 0) & (F.col("seen") > 0), 1).otherwise(0)).over(upto))
    return s.where("dec = 1 and stop = 0").select(*keys, "q8", "alpha", (F.col("q8") / Q_STEP * F.col("alpha") - F.col("tau")).alias("f"))


def dimensions(counts: DataFrame, bounds: DataFrame, structures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, dim): the information dimension (q = 1) and tau / (q - 1) for q = 0 and 2."""
    share = F.col("n") / F.col("total")
    entropy = counts.join(bounds, keys).where("len between lo and hi").groupBy(*keys, "len").agg(F.sum(share * F.log2(share)).alias("h"))
    one = entropy.groupBy(*keys).agg(F.coalesce(F.regr_slope("h", -F.col("len")), F.lit(0.0)).alias("dim")).select(*keys, F.lit(1).alias("q"), "dim")
    rest = structures.where(F.col("q8").isin(0, 2 * Q_STEP)).select(*keys, (F.col("q8") / Q_STEP).cast("int").alias("q"), (F.col("tau") / (F.col("q8") / Q_STEP - 1)).alias("dim"))
    return one.union(rest)


def _blocks(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """Addresses with their upper half as block, each block of a set (65,536 addresses at most) in one task."""
    rows = addresses.where("a is not null").select(*keys, F.col("a").cast("long").alias("a"), F.shiftright(F.col("a").cast("long"), HALF).alias("block"))
    return rows.repartition(*[F.col(k) for k in keys], F.col("block"))


def measured(addresses: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each set with addresses: (keys, lo, hi, total, splits, points (q8, tau, sd), spectrum (q8, alpha, f), dim).

    splits tells whether a length from lo to hi has a split parent, dim is the information dimension; sets without bounds have no points
    and no dim. An address goes through one shuffle, to the counts of its block; blocks and how often a length has which counts go
    through a second one, to their set. So no task holds a set: it holds a block, or the 65,536 blocks of a set with its counts.
    """
    names = ", ".join(f"{k} {v}" for k, v in addresses.select(*keys).dtypes)
    counts = _blocks(addresses, keys).sortWithinPartitions(*keys, "a").mapInArrow(partial(trie.block_counts, keys), f"{names}, {trie.COUNTS}")
    groups = counts.repartition(*keys).groupBy(*keys, "len", "prefix", "n", "m").agg(F.sum("c").alias("c"))
    return groups.sortWithinPartitions(*keys, "prefix").mapInArrow(partial(trie.measures, keys), f"{names}, {trie.MEASURES}")


def structure_of(sets: DataFrame, keys: list[str], zeros: bool = True) -> DataFrame:
    """As structure, from measured; a set none of whose lengths has a split parent has zeros, or no rows."""
    return (sets if zeros else sets.where("splits")).select(*keys, F.inline("points"))


def spectrum_of(sets: DataFrame, keys: list[str]) -> DataFrame:
    """As spectrum, from measured."""
    return sets.select(*keys, F.inline("spectrum"))


def bounds_of(sets: DataFrame, keys: list[str]) -> DataFrame:
    """As prefix_bounds, from measured."""
    return sets.where("total >= 2 and hi >= lo").select(*keys, "lo", "hi", "total")


def _tau(q8: int) -> Column:
    return F.get("points", F.lit(q8 - Q_FIRST)).getField("tau")


def dimensions_of(sets: DataFrame, keys: list[str], zeros: bool = True) -> DataFrame:
    """As dimensions, from measured. zeros: as for structure_of."""
    dim = lambda q, c: F.struct(F.lit(q).alias("q"), c.alias("dim"))
    some = F.array(dim(1, F.col("dim"))) if not zeros else None
    every = F.array(dim(1, F.col("dim")), dim(2, _tau(2 * Q_STEP)), dim(0, -_tau(0)))
    return sets.where("dim is not null").select(*keys, F.inline(every if zeros else F.when(F.col("splits"), every).otherwise(some)))


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(c, digits) + F.lit(0.0))  # -0 becomes 0


def described(addresses: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, structure_kind, values_json, metadata_json): three rows for each set of the grid, with [] where a set has no points.

    The JSON has the form of the reference's, with values to eight decimals (sd to six): multiples of 1/256, common in small sets, are exact.
    """
    return texts(measured(addresses, keys), grid, keys)


def texts(sets: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """As described, from measured."""

    def listed(points: Column, fields) -> Column:
        text = lambda x: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), fixed(c(x).cast("double"), d)) for n, c, d in fields]), F.lit("}"))
        return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(points, text), ", "), F.lit("")), F.lit("]"))

    at = lambda name: lambda x: x[name]
    dims = F.array(*[F.struct(F.lit(q).alias("q"), c.alias("dim")) for q, c in ((1, F.col("dim")), (2, _tau(2 * Q_STEP)), (0, -_tau(0)))])
    kinds = (
        ("structure", F.col("points"), (("q", lambda x: x["q8"] / Q_STEP, 3), ("sd", at("sd"), 6), ("tauTilde", at("tau"), 8))),
        ("spectrum", F.col("spectrum"), (("alpha", at("alpha"), 8), ("f", at("f"), 8))),
        ("dimension", F.when(F.col("dim").isNotNull(), dims), (("dim", at("dim"), 8), ("q", at("q"), 1))),
    )
    length = lambda c: F.when(F.expr("total >= 2 and hi >= lo"), F.col(c).cast("string")).otherwise("null")
    metadata = lambda low, high, total: F.concat(F.lit('{"input": "-", "maxPrefixLength": '), high, F.lit(', "minPrefixLength": '), low, F.lit(', "totalAddrs": '), total, F.lit("}"))
    # made before the join, in the tasks that have the sets: a grid can be one small partition
    rows = sets.select(*keys, metadata(length("lo"), length("hi"), F.col("total")).alias("metadata_json"), *[listed(points, fields).alias(kind) for kind, points, fields in kinds])
    values = F.array(*[F.struct(F.lit(k).alias("structure_kind"), F.coalesce(k, F.lit("[]")).alias("values_json")) for k, _, _ in kinds])
    none = metadata(F.lit("null"), F.lit("null"), F.lit("0"))
    # merged by key: Spark takes the texts to be as small as the counts that they come from and would send them through the driver
    return grid.join(rows.hint("merge"), keys, "left").select(*keys, F.inline(values), F.coalesce("metadata_json", none).alias("metadata_json"))
