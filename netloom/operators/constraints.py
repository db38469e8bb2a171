"""Declared constraints of a product's tables. All constraints of a table are checked by one aggregation of it.

A constraint holds for a row, for a bucket (source_id, granularity, bucket_start) with all its scopes, or for the whole table. Rows
are reduced to buckets with a count of broken rows for each constraint, buckets to one row, so that the shuffle carries a
partial row for each bucket and no constraint adds a pass. A condition that is null is broken. Constraints of a table's
columns need no pass at all; a missing column is null to the others, so that what names it is broken in every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import statistics as S

BUCKET = ("source_id", "granularity", "bucket_start")
SIDES, RANGES = ("source", "destination"), ("low", "high")
KINDS = ("structure", "spectrum", "dimension")
FOUND = "table_name string, rule string, checked long, broken long, first_broken string"
#: Names of columns that would keep raw addresses, and of tables of older layouts (fixed values).
RAW_ADDRESS_COLUMNS = (
    "address", "client_ip", "da_ip", "destination_address", "destination_ip", "dst_addr", "dst_ip", "ip", "ip_addr", "ip_address", "sa_ip",
    "server_ip", "source_address", "source_ip", "src_addr", "src_ip",
)
OLD_TABLES = (
    "netflow_stats_v2", "ip_stats_v2", "protocol_stats_v2", "structure_stats_v2", "spectrum_stats_v2", "dimension_stats_v2", "processed_inputs_v2",
)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: An IPv4 address in a text, not part of a longer run of digits and dots.
ADDRESS = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9.])"


@dataclass
class Rules:
    """rows and buckets: name to condition, those of buckets over aggregates of rows. columns: name to type. needs: 'rows' where the
    table must have some, 'coarse_rows' where it must have some of granularities over 5 minutes."""

    columns: dict[str, str]
    rows: dict[str, Column] = field(default_factory=dict)
    buckets: dict[str, Column] = field(default_factory=dict)
    needs: tuple[str, ...] = ()


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _place(column: str, values: tuple) -> Column:
    """The place of a column's value among values, null if it isn't one of them."""
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(values)])


def _each_once(sizes: list[tuple[str, tuple]], families: tuple[int, ...] = (4, 6)) -> Column:
    """Every combination of a family, one of the five pairs of visibilities and values of other columns is there once: as many
    rows as combinations, and a bit of each."""
    of = ("all", *C.VISIBILITIES)
    pair = F.when(F.col("src_visibility") == "all", F.when(F.col("dst_visibility") == "all", 0))
    pair = F.coalesce(pair, _place("src_visibility", of[1:]) * 2 + _place("dst_visibility", of[1:]) + 1)
    place, n = _place("ip_version", families) * 5 + pair, 5 * len(families)
    for column, values in sizes:
        place, n = place * len(values) + _place(column, values), n * len(values)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))
    return (F.count("*") == n) & (F.bit_or(bit) == (1 << n) - 1)


def _whole(column: str = "") -> Column:
    return (F.col("src_visibility") == "all") & (F.col("dst_visibility") == "all")


def _additive(columns: tuple[str, ...]) -> Column:
    """Under (all, all) every counter of a family is the sum of the four pairs'."""
    signed = lambda v, c: F.coalesce(F.sum(F.when(F.col("ip_version") == v, F.when(_whole(), F.col(c)).otherwise(-F.col(c)))), F.lit(0)) == 0
    return _all([signed(v, c) for v in (4, 6) for c in columns])


def _distinct(column: str, sizes: list[tuple[str, tuple]]) -> Column:
    """A number of distinct values under (all, all) is at least each pair's, and at most their sum."""
    groups = [F.col("ip_version") == v for v in (4, 6)]
    for name, values in sizes:
        groups = [g & (F.col(name) == v) for g in groups for v in values]
    zero = lambda a: F.coalesce(a, F.lit(0))
    total = lambda g: zero(F.max(F.when(g & _whole(), F.col(column))))
    part = lambda g, f: zero(f(F.when(g & ~_whole(), F.col(column))))
    return _all([(total(g) >= part(g, F.max)) & (total(g) <= part(g, F.sum)) for g in groups])


def _common(tz: str) -> dict[str, Column]:
    """Of rows of all tables: known scopes, bounds of the bucket."""
    at, g = F.col("bucket_start"), F.col("granularity")
    by = lambda f: F.coalesce(*[F.when(g == name, f(at, name, tz)) for name in C.GRANULARITIES])
    pair = _whole() | (F.col("src_visibility").isin(*C.VISIBILITIES) & F.col("dst_visibility").isin(*C.VISIBILITIES))
    return {"scope": F.col("ip_version").isin(4, 6) & pair, "bucket_start": at == by(C.bucket_start), "bucket_end": F.col("bucket_end") == by(C.bucket_end)}


_KEY = {"source_id": "string", "granularity": "string", "bucket_start": "bigint", "bucket_end": "bigint", "ip_version": "int", "src_visibility": "string", "dst_visibility": "string"}


def product_rules(dense: bool = True, need_rows: bool | None = None, every_duration: bool = False, with_structure: bool = True, tz: str = C.TIMEZONE) -> dict[str, Rules]:
    """The constraints of a product's tables. dense: buckets have all their scopes. need_rows: the tables have rows, coarse traffic
    too (else as dense). every_duration: each flow has a duration, as captures have it."""
    need_rows = dense if need_rows is None else need_rows
    col = F.col
    once = lambda *sizes, **more: {"scopes": _each_once(list(sizes), **more)} if dense else {}
    some = ("rows",) if need_rows else ()
    side = lambda name: (name, SIDES)
    t = Rules(_KEY | dict.fromkeys(S.COUNTERS, "bigint"), _common(tz), once() | {"additive": _additive(S.COUNTERS)}, (*some, "coarse_rows") if need_rows else ())
    t.rows["not_negative"] = _all([col(c) >= 0 for c in S.COUNTERS])
    for m in ("flows", "packets", "bytes"):
        t.rows[f"{m}_classes"] = col(m) == sum(col(f"{m}_{c}") for c in S.CLASSES)
    for m in S.MEASURES:
        n, total = col(f"{m}_count"), col(f"{m}_sum")
        t.rows[f"{m}_count"] = (n == col("flows")) if every_duration and m == "duration" else (n <= col("flows"))
        t.rows[f"{m}_sum"] = (total <= n * 255) if m != "duration" else ((n > 0) | (total == 0))
        t.rows[f"avg_{m}"] = F.when(n == 0, col(f"avg_{m}").isNull()).otherwise(F.abs(col(f"avg_{m}") - total / n) <= 1e-5)
        t.columns[f"avg_{m}"] = "double"

    p = Rules(_KEY | {"unique_protocols_count": "bigint", "protocols_list": "string"}, _common(tz), once() | {"distinct": _distinct("unique_protocols_count", [])}, some)
    numbers = F.filter(F.split("protocols_list", ","), lambda x: x != "")
    p.rows["protocols_count"] = col("unique_protocols_count") == F.size(numbers)
    canonical = F.forall(numbers, lambda x: x.rlike("^(0|[1-9][0-9]{0,2})$") & (x.try_cast("int") <= 255)) & (numbers == F.array_sort(F.array_distinct(numbers)))
    p.rows["protocols_list"] = canonical & (F.array_join(numbers, ",") == col("protocols_list"))

    a = Rules(_KEY | {"address_side": "string", "unique_address_count": "bigint"}, _common(tz), once(side("address_side")), some)
    a.buckets["distinct"] = _distinct("unique_address_count", [side("address_side")])
    a.rows |= {"address_side": col("address_side").isin(*SIDES), "not_negative": col("unique_address_count") >= 0}

    q = Rules(_KEY | {"port_side": "string", "port_range": "string", "unique_port_count": "bigint"}, _common(tz), once(side("port_side"), ("port_range", RANGES)), some)
    q.buckets["distinct"] = _distinct("unique_port_count", [side("port_side"), ("port_range", RANGES)])
    most = F.when(col("port_range") == "low", 1024).when(col("port_range") == "high", 65_536 - 1024)
    q.rows |= {"port_side": col("port_side").isin(*SIDES), "port_count": col("unique_port_count").between(0, most)}
    out = {"traffic_stats": t, "protocol_stats": p, "address_count_stats": a, "port_count_stats": q}
    if with_structure:
        s = Rules(_KEY | {"address_side": "string", "structure_kind": "string", "values_json": "string"}, _common(tz), needs=some)
        s.buckets |= once(side("address_side"), ("structure_kind", KINDS), families=(4,))
        s.rows |= {"ip_version": col("ip_version") == 4, "values_json": F.json_array_length("values_json") >= 0}
        out["address_structure_stats"] = s
    return out


def _declared(name: str, df: DataFrame, rules: Rules) -> list[tuple]:
    """What the columns alone tell."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [(name, f"column {c}", 1, int(have.get(c) != t), None) for c, t in rules.columns.items()]
    return out + [(name, f"raw address column {c}", 1, 1, None) for c in have if c.lower() in RAW_ADDRESS_COLUMNS]


def checked(name: str, df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, checked, broken, first_broken) of a table, by one aggregation of it. first_broken: the smallest bucket with a broken row."""
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in rules.columns.items() if c not in df.columns})
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    leaks = {f"no address in {c}": F.coalesce(~F.col(c).rlike(ADDRESS), F.lit(True)) for c in texts}
    rows, buckets = rules.rows | leaks, rules.buckets
    broken = lambda condition: ~F.coalesce(condition, F.lit(False))
    of_rows = [F.count_if(broken(c)).alias(f"r{k}") for k, c in enumerate(rows.values())]
    of_buckets = [broken(c).cast("long").alias(f"b{k}") for k, c in enumerate(buckets.values())]
    per_bucket = df.groupBy(*BUCKET).agg(F.count("*").alias("n"), *of_rows, *of_buckets)
    where = F.concat_ws(" ", F.col("m.source_id"), F.col("m.granularity"), F.col("m.bucket_start").cast("string"))
    names = [(f"r{k}", n, "n") for k, n in enumerate(rows)] + [(f"b{k}", n, "buckets") for k, n in enumerate(buckets)]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c, _, _ in names]
    first = [F.min(F.when(F.col(c) > 0, F.struct(*BUCKET))).alias(f"m{c}") for c, _, _ in names]
    totals = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("buckets"), F.count_if(F.col("granularity") != "5m").alias("coarse")]
    one = per_bucket.agg(*totals, *sums, *first)
    table = {"rows": F.col("n") > 0, "coarse_rows": F.col("coarse") > 0}
    found = [F.struct(F.lit(n).alias("rule"), F.col(of).alias("checked"), F.col(c).alias("broken"), F.col(f"m{c}").alias("m")) for c, n, of in names]
    none = F.lit(None).cast(per_bucket.select(F.struct(*BUCKET).alias("s")).schema["s"].dataType)
    found += [F.struct(F.lit(n).alias("rule"), F.lit(1).cast("long").alias("checked"), broken(table[n]).cast("long").alias("broken"), none.alias("m")) for n in rules.needs]
    return one.select(F.explode(F.array(*found)).alias("x")).select(F.lit(name).alias("table_name"), "x.*").withColumn("first_broken", F.when(F.col("m").isNotNull(), where)).drop("m")


def report(tables: dict[str, DataFrame], rules: dict[str, Rules]) -> DataFrame:
    """(table_name, rule, checked, broken, first_broken) of all constraints: missing tables and columns, columns for raw addresses, tables
    of older layouts, and what rows, buckets and tables break. Every table is read once."""
    spark = next(iter(tables.values())).sparkSession
    known = [(n, "table", 1, int(n not in tables), None) for n in rules] + [(n, "old table", 1, 1, None) for n in tables if n in OLD_TABLES]
    for n in rules.keys() & tables.keys():
        known += _declared(n, tables[n], rules[n])
    out = spark.createDataFrame(known, FOUND)
    for n in sorted(rules.keys() & tables.keys()):
        out = out.unionByName(checked(n, tables[n], rules[n]))
    return out


class Broken(ValueError):
    """A product breaks its constraints."""


def check(tables: dict[str, DataFrame], rules: dict[str, Rules]) -> None:
    """Fail if a constraint is broken; the error names all that are."""
    if wrong := report(tables, rules).where("broken > 0").orderBy("table_name", "rule").collect():  # a row for each constraint at most
        raise Broken("; ".join(f"{r.table_name}: {r.rule} ({r.broken} of {r.checked}{', first ' + r.first_broken if r.first_broken else ''})" for r in wrong))
