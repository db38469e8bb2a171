"""The whole product: five dense statistics tables of all granularities from one set of flows, published together.

Flows are reduced to two tables of 5-minute partial results, counters (facts) and sets of distinct values, which are stored; all
granularities come from these, so that no table reads flows and stored partials can be merged with later ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import constraints, mergeable, structure
from netloom.operators import statistics as S
from netloom.plans import scratch, store

SIDES, RANGES = ("source", "destination"), ("low", "high")
#: The tables and the columns beside KEY that name their rows.
TABLES = {
    "traffic_stats": (), "protocol_stats": (), "address_count_stats": ("address_side",), "port_count_stats": ("port_side", "port_range"),
    "address_structure_stats": ("address_side", "structure_kind"),
}


def grid(bounds: DataFrame, granularity: str, whole_only: bool = False, tz: str = C.TIMEZONE, spans: DataFrame | None = None) -> DataFrame:
    """The ten scopes of every bucket that a source's 5-minute bounds (source_id, first, last) touch, or hold whole, as KEY.
    spans: parts of the bounds (any number for a source) to keep to."""
    starts = S.calendar(bounds if spans is None else spans, "5m").select("source_id", F.lit(granularity).alias("granularity"), C.bucket_start(F.col("bucket_start"), granularity, tz).alias("bucket_start"))
    starts = starts.distinct()
    if whole_only:
        inside = (F.col("bucket_start") >= F.col("first")) & (C.bucket_end(F.col("bucket_start"), granularity, tz) <= F.col("last") + C.FIVE_MINUTES)
        starts = starts.join(bounds, "source_id").where(inside).drop("first", "last")
    return starts.crossJoin(F.broadcast(S.scopes(bounds.sparkSession)))  # ten rows


def filled(stats: DataFrame, cells: DataFrame, zero: dict) -> DataFrame:
    """stats with a row for every cell; what is missing has the values of zero, null for other columns."""
    keys = cells.columns
    out = cells.join(stats, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(zero[c])).alias(c) if c in zero else F.col(c) for c in stats.columns if c not in keys])


def union(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def stored_partials(flows: DataFrame, tz: str = C.TIMEZONE) -> tuple[DataFrame, DataFrame]:
    """(facts, sets): the 5-minute partial results of flows, under their own pairs, as stored tables."""
    return scratch.kept(S.facts(flows, "5m", tz)), scratch.kept(mergeable.sets(flows, tz))


def tables(
    flows: DataFrame, bounds: DataFrame | None = None, granularities: tuple[str, ...] = C.GRANULARITIES, with_structure: bool = True, whole_only: bool = False, tz: str = C.TIMEZONE
) -> dict[str, DataFrame]:
    """The product's tables. bounds: the 5-minute bounds of the scan, before selections; those of the flows without them.
    whole_only: coarse buckets that the bounds don't hold whole have no rows."""
    facts, sets = stored_partials(flows, tz)
    bounds = facts.groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last")) if bounds is None else bounds
    return tables_of(facts, sets, bounds, granularities, with_structure, whole_only, tz)


def tables_of(
    facts: DataFrame, sets: DataFrame, bounds: DataFrame, granularities: tuple[str, ...] = C.GRANULARITIES, with_structure: bool = True, whole_only: bool = False,
    tz: str = C.TIMEZONE, spans: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The product's tables from stored partial results of 5 minutes. spans: as for grid; facts and sets have to be those of
    the local days that the spans touch."""
    side = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    out: dict[str, list[DataFrame]] = {name: [] for name in TABLES if with_structure or name != "address_structure_stats"}
    for g in granularities:
        cells = grid(bounds, g, whole_only, tz, spans)
        scoped = scratch.kept(mergeable.with_all(mergeable.merged(sets, g, tz)))  # four tables come from it
        traffic = S.with_all(facts if g == "5m" else S.moved_to(facts, g, tz))
        out["traffic_stats"].append(filled(traffic, cells, dict.fromkeys(S.COUNTERS, 0)))
        out["protocol_stats"].append(filled(mergeable.protocols(scoped), cells, {"unique_protocols_count": 0, "protocols_list": ""}))
        sides = cells.select("*", side("address_side", SIDES))
        out["address_count_stats"].append(filled(mergeable.address_counts(scoped), sides, {"unique_address_count": 0}))
        ports = cells.select("*", side("port_side", SIDES)).select("*", side("port_range", RANGES))
        out["port_count_stats"].append(filled(mergeable.port_counts(scoped), ports, {"unique_port_count": 0}))
        if with_structure:
            keys = list(S.SET_KEY)
            measured = structure.measured(mergeable.coded_address_sets(scoped), list(S.CODED_KEY))
            rows = structure.texts(S.named(measured, g), sides.where("ip_version = 4").select(*keys), keys)
            out["address_structure_stats"].append(rows.withColumn("ip_version", F.lit(4)))
    ends = lambda df: df.withColumn("bucket_end", _ends(granularities, tz))
    return {name: ends(union(parts)) for name, parts in out.items()}


def _ends(granularities: tuple[str, ...], tz: str):
    return F.coalesce(*[F.when(F.col("granularity") == g, C.bucket_end(F.col("bucket_start"), g, tz)) for g in granularities])


def publish(flows: DataFrame, path: str, **options) -> str:
    """Make the tables and publish them as one version; its name."""
    return store.publish(tables(flows, **options), path)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version that are there."""
    found = {}
    for name in TABLES:
        try:
            found[name] = store.published(spark, path, name)
        except Exception as e:  # a product without structure has no such table
            if name != "address_structure_stats" or "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def verify(tables: dict[str, DataFrame], processed: DataFrame | None = None, **rules) -> DataFrame:
    """The constraints that a product's tables break: as constraints.report(). processed: its inputs (status), all of which must be
    processed. rules: as for constraints.product_rules()."""
    declared = constraints.product_rules(**{"with_structure": "address_structure_stats" in tables} | rules)
    found = constraints.report(tables, declared).where("broken > 0")
    if processed is not None:
        left = processed.agg(F.count("*").alias("checked"), F.count_if(F.coalesce(F.col("status") != "processed", F.lit(True))).alias("broken")).where("broken > 0")
        found = found.unionByName(left.select(F.lit("processed_inputs").alias("table_name"), F.lit("processed").alias("rule"), "checked", "broken", F.lit(None).cast("string").alias("first_broken")))
    return found
