"""Exact statistics of flows per source, bucket, IP family and visibility scope, and their rollups.

Sums shuffle partial aggregates. Distinct counts go in long form, one row for each (key, kind, value), through two
aggregations, so that a frequent source costs no more than its distinct values and no plan expands by kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.functions.calendar import day_start, local

KEY = ("source_id", "granularity", "bucket_start", "ip_version", "src_visibility", "dst_visibility")
#: What names a set of IPv4 addresses.
SET_KEY = ("source_id", "granularity", "bucket_start", "src_visibility", "dst_visibility", "address_side")
#: The same in short, at one granularity: series is twice the place of the pair and the place of the side.
CODED_KEY = ("source_id", "bucket_start", "series")
PAIRS = (("all", "all"), *((a, b) for a in C.VISIBILITIES for b in C.VISIBILITIES))
SIDES = ("source", "destination")
CLASSES = ("tcp", "udp", "icmp", "other")
MEASURES = ("duration", "min_ttl", "max_ttl")
COUNTERS = tuple(f"{m}{c}" for m in ("flows", "packets", "bytes") for c in ("", *(f"_{k}" for k in CLASSES))) + tuple(f"{m}_{s}" for m in MEASURES for s in ("sum", "count"))


def bucketed(flows: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    return flows.withColumns({"granularity": F.lit(granularity), "bucket_start": C.bucket_start(F.col("end_s"), granularity, tz)})


def scoped(flows: DataFrame) -> DataFrame:
    """Each flow under (all, all) and its own pair of visibilities: five of the nine pairs exist."""
    pair = lambda a, b: F.struct(a.alias("src_visibility"), b.alias("dst_visibility"))
    own = pair(C.visibility(F.col("src_tos"), 2), C.visibility(F.col("src_tos"), 1))
    return flows.withColumn("scope", F.explode(F.array(pair(F.lit("all"), F.lit("all")), own))).select("*", "scope.*").drop("scope")


def averages(df: DataFrame) -> DataFrame:
    """Averages from sums, null where nothing was measured."""
    return df.withColumns({f"avg_{m}": F.when(F.col(f"{m}_count") != 0, F.col(f"{m}_sum") / F.col(f"{m}_count")) for m in MEASURES})


def own_scope(flows: DataFrame) -> DataFrame:
    """Each flow under its own pair of visibilities."""
    return flows.withColumns({"src_visibility": C.visibility(F.col("src_tos"), 2), "dst_visibility": C.visibility(F.col("src_tos"), 1)})


def _under_all(df: DataFrame) -> DataFrame:
    return df.withColumns({"src_visibility": F.lit("all"), "dst_visibility": F.lit("all")})


def both_scopes(distinct: DataFrame) -> DataFrame:
    """Distinct rows under their own pairs, and those that are distinct under (all, all). Flows themselves are not doubled."""
    return distinct.unionByName(_under_all(distinct).distinct())


def summed(partial: DataFrame) -> DataFrame:
    """Counters added up by KEY."""
    return partial.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def facts(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """Counters by KEY under the flows' own pairs. Packets and bytes are not multiplied by flow_count, measurements are.

    Coarse buckets come from 5-minute ones, so that the calendar is asked once for each of those and not for each flow.
    """
    kind, n = C.protocol_class(F.col("protocol")), F.col("flow_count")
    sums = []
    for name, value in (("flows", n), ("packets", F.col("packets")), ("bytes", F.col("bytes"))):
        sums.append(F.sum(value).alias(name))
        sums += [F.sum(F.when(kind == c, value).otherwise(0)).alias(f"{name}_{c}") for c in CLASSES]
    for name, value in (("duration", F.col("duration_ms")), ("min_ttl", F.col("min_ttl")), ("max_ttl", F.col("max_ttl"))):
        sums.append(F.coalesce(F.sum(value * n), F.lit(0)).alias(f"{name}_sum"))
        sums.append(F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias(f"{name}_count"))
    out = own_scope(bucketed(flows, "5m", tz)).groupBy(*KEY).agg(*sums)
    return out if granularity == "5m" else summed(moved_to(out, granularity, tz))


def moved_to(five_minutes: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    return five_minutes.withColumns({"granularity": F.lit(granularity), "bucket_start": C.bucket_start(F.col("bucket_start"), granularity, tz)})


def with_all(partial: DataFrame) -> DataFrame:
    """Facts of any origin (flows, or counters that come grouped) under their own pairs and under (all, all), with averages.

    The aggregated rows are doubled, not the flows, and what they come from is computed once.
    """
    pair = lambda a, b: F.struct(a.alias("s"), b.alias("d"))
    both = F.explode(F.array(pair(F.lit("all"), F.lit("all")), pair(F.col("src_visibility"), F.col("dst_visibility"))))
    doubled = partial.withColumn("pair", both).withColumns({"src_visibility": F.col("pair.s"), "dst_visibility": F.col("pair.d")})
    return averages(summed(doubled))


def traffic(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """Counters and averages by KEY, under (all, all) and the flows' own pairs."""
    own = facts(flows, "5m", tz)
    return with_all(own if granularity == "5m" else moved_to(own, granularity, tz))


def roll_up(five_minutes: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    """Coarser traffic from 5-minute rows, without reading flows again."""
    return averages(summed(moved_to(five_minutes, granularity, tz)))


def complete_only(coarse: DataFrame, five_minutes: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    """The coarse rows whose bucket has all its 5-minute children."""
    whole = coverage(five_minutes, granularity, tz).where("complete").select("source_id", "bucket_start")
    return coarse.join(whole, ["source_id", "bucket_start"], "left_semi")


def _values(flows: DataFrame, granularity: str, tz: str, *values) -> DataFrame:
    """Distinct values by KEY, under both scopes."""
    return both_scopes(own_scope(bucketed(flows, granularity, tz)).select(*KEY, *values).distinct())


def protocols(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """Distinct protocols, their number and their list in text order."""
    return _values(flows, granularity, tz, "protocol").groupBy(*KEY).agg(
        F.count("*").alias("unique_protocols_count"), F.array_join(F.array_sort(F.collect_list(F.col("protocol").cast("string"))), ",").alias("protocols_list")
    )


def address_counts(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """Distinct addresses by side, by their text."""
    sides = F.explode(F.create_map(F.lit("source"), F.col("src_ip"), F.lit("destination"), F.col("dst_ip"))).alias("address_side", "ip")
    return _values(flows, granularity, tz, sides).groupBy(*KEY, "address_side").agg(F.count("ip").alias("unique_address_count"))


def coded_sets(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """(CODED_KEY, a): as address_sets. An address has one row a bucket and side until its pairs are laid out, after the shuffle."""
    tos = F.coalesce(F.col("src_tos").cast("long").bitwiseAND(3), F.lit(0)).cast("int")
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("a")) for k, c in enumerate(("src_u32", "dst_u32"))])).alias("x")
    rows = bucketed(flows.where("ip_version = 4"), granularity, tz).select("source_id", "bucket_start", F.call_function("shiftleft", F.lit(1), tos).alias("own"), sides)
    sets = rows.where("x.a is not null").groupBy("source_id", "bucket_start", "x.side", "x.a").agg(F.bit_or("own").alias("own"))
    pairs = [[0, *(1 + k for k in range(4) if own >> k & 1)] for own in range(16)]
    pair = F.explode(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in pairs]), F.col("own") + 1))
    return sets.select("source_id", "bucket_start", "side", "a", pair.alias("pair")).select("source_id", "bucket_start", F.expr("2 * pair + side").alias("series"), "a")


def named(coded: DataFrame, granularity: str) -> DataFrame:
    """CODED_KEY as SET_KEY, other columns as they are."""
    pick = lambda names, place: F.element_at(F.array(*map(F.lit, names)), place + 1)
    pair = F.expr("series div 2").cast("int")
    key = F.lit(granularity).alias("granularity"), pick([p[0] for p in PAIRS], pair).alias("src_visibility"), pick([p[1] for p in PAIRS], pair).alias("dst_visibility")
    return coded.select("source_id", key[0], "bucket_start", *key[1:], pick(SIDES, F.col("series") % 2).alias("address_side"), *[c for c in coded.columns if c not in CODED_KEY])


def coded(sets: DataFrame) -> DataFrame:
    """SET_KEY of one granularity as CODED_KEY, other columns as they are."""
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c) - 1
    pair = place([f"{a}/{b}" for a, b in PAIRS], F.concat_ws("/", "src_visibility", "dst_visibility"))
    return sets.select("source_id", "bucket_start", (2 * pair + place(SIDES, F.col("address_side"))).cast("int").alias("series"), *[c for c in sets.columns if c not in SET_KEY])


def address_sets(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """(SET_KEY, a): the distinct IPv4 addresses of both sides under all five pairs of visibilities, as numbers."""
    return named(coded_sets(flows, granularity, tz), granularity)


def port_counts(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """Distinct ports by side and range (low: below 1024)."""
    sides = F.explode(F.create_map(F.lit("source"), F.col("src_port"), F.lit("destination"), F.col("dst_port"))).alias("port_side", "port")
    d = _values(flows, granularity, tz, sides).where("port is not null")
    return d.groupBy(*KEY, "port_side", F.when(F.col("port") < 1024, "low").otherwise("high").alias("port_range")).agg(F.count("*").alias("unique_port_count"))


def scopes(spark: SparkSession) -> DataFrame:
    """The ten scopes of a dense bucket."""
    return spark.createDataFrame([(v, a, b) for v in (4, 6) for a, b in PAIRS], "ip_version int, src_visibility string, dst_visibility string")


def calendar(bounds: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    """All buckets of a granularity between first and last of each source (source_id, first, last)."""
    if granularity == "1d":
        days = F.sequence(F.to_date(local(F.col("first"), tz)), F.to_date(local(F.col("last"), tz)))
        return bounds.select("source_id", F.explode(days).alias("day")).select("source_id", day_start(F.col("day"), tz).alias("bucket_start"))
    return bounds.select("source_id", F.explode(F.sequence("first", "last", F.lit(C.WIDTHS[granularity]).cast("long"))).alias("bucket_start"))


def observed_bounds(flows: DataFrame, granularity: str = "5m") -> DataFrame:
    """First and last bucket of each source; taken before selections, so that gaps at the edges stay gaps."""
    b = bucketed(flows, granularity)
    return b.groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))


def pairs_grid(flows: DataFrame, granularity: str = "5m", tz: str = C.TIMEZONE) -> DataFrame:
    """All five pairs of visibilities of every bucket between a source's first and last 5 minutes, at any granularity."""
    pairs = scopes(flows.sparkSession).where("ip_version = 4").drop("ip_version")
    start = C.bucket_start(F.col("bucket_start"), granularity, tz)
    starts = calendar(observed_bounds(flows), "5m").select("source_id", F.lit(granularity).alias("granularity"), start.alias("bucket_start"))
    return starts.distinct().crossJoin(F.broadcast(pairs))  # five rows


def dense(stats: DataFrame, bounds: DataFrame, granularity: str) -> DataFrame:
    """Traffic with all ten scopes of every bucket between a source's bounds; what is missing is 0, averages null."""
    grid = calendar(bounds, granularity).crossJoin(F.broadcast(scopes(stats.sparkSession))).withColumn("granularity", F.lit(granularity))  # ten rows
    out = grid.join(stats, list(KEY), "left")
    return out.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS], *[f"avg_{m}" for m in MEASURES])


def coverage(five_minutes: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    """Coarse buckets with the number of their 5-minute children and whether all are there."""
    start = C.bucket_start(F.col("bucket_start"), granularity, tz)
    d = five_minutes.select("source_id", "bucket_start").distinct().select("source_id", start.alias("start"), "bucket_start")
    d = d.groupBy("source_id", "start").agg(F.count("*").alias("children")).withColumn("wanted", F.expr("1") * (C.bucket_end(F.col("start"), granularity, tz) - F.col("start")) / 300)
    return d.select("source_id", F.col("start").alias("bucket_start"), "children", F.col("wanted").cast("long").alias("wanted"), (F.col("children") == F.col("wanted")).alias("complete"))


def logical_sources(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Flows under each logical source that a member belongs to. members: (source_id, member_id); a config table, joined by size."""
    return flows.withColumnRenamed("source_id", "member_id").join(members, "member_id").drop("member_id")


def late_rows(rows: DataFrame, lag_buckets: int = 12, block_rows: int = 1 << 20) -> DataFrame:
    """Rows (source_id, row_no, bucket_start) that come after their bucket was already emitted, in reading order.

    A row is late if the rows before it of its source reach more than the lag past their own minimum and past the row. Row
    numbers of a source must differ. What earlier rows reach goes by blocks of row numbers, or by a column `block` that goes
    before them: one row for each block under a window over the source, then the rows of each block by themselves, so that no
    task has all rows of a large source.
    """
    block = F.col("block") if "block" in rows.columns else F.floor(F.col("row_no") / block_rows)
    blocks = rows.select("source_id", "row_no", "bucket_start", block.alias("block"))
    earlier = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reached = blocks.groupBy("source_id", "block").agg(F.max("bucket_start").alias("hi"), F.min("bucket_start").alias("lo"))
    reached = reached.select("source_id", "block", F.max("hi").over(earlier).alias("hi"), F.min("lo").over(earlier).alias("lo"))
    before = Window.partitionBy("source_id", "block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.greatest("hi", F.max("bucket_start").over(before)) - lag_buckets * 300
    low = F.least("lo", F.min("bucket_start").over(before))
    w = blocks.join(reached, ["source_id", "block"]).select("source_id", "row_no", "bucket_start", cut.alias("cut"), low.alias("low"))
    return w.where("cut > low and bucket_start < cut").select("source_id", "row_no", "bucket_start")


def missing_ranges(covered: DataFrame) -> DataFrame:
    """Gaps (source_id, gap_start, gap_end) between half-open intervals (source_id, start, end) that may overlap."""
    w = Window.partitionBy("source_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return covered.select("source_id", reach.alias("gap_start"), F.col("start").alias("gap_end")).where("gap_end > gap_start")


def merged_ranges(covered: DataFrame) -> DataFrame:
    """The half-open intervals (source_id, start, end), overlapping or touching ones as one."""
    w = Window.partitionBy("source_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = covered.select("source_id", "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("source_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def missing_within(covered: DataFrame, wanted: DataFrame) -> DataFrame:
    """What of each wanted interval (source_id, start, end) the covered ones don't hold: (source_id, gap_start, gap_end)."""
    held = merged_ranges(covered).select("source_id", F.col("start").alias("a"), F.col("end").alias("b"))
    marks = wanted.join(held, "source_id", "left").where("a is null or (a < end and b > start)")
    edges = wanted.select("source_id", "start", "end", F.col("end").alias("a"), F.col("end").alias("b"))  # the end closes the last gap
    inside = marks.where("a is not null").select("source_id", "start", "end", F.greatest("a", "start").alias("a"), F.least("b", "end").alias("b"))
    w = Window.partitionBy("source_id", "start", "end").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = inside.unionByName(edges).select("source_id", F.coalesce(F.max("b").over(w), F.col("start")).alias("gap_start"), F.col("a").alias("gap_end"))
    return gaps.where("gap_start < gap_end")
