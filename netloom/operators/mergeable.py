"""Distinct protocols, ports and addresses in a form that is stored by 5 minutes and merged into coarser buckets.

A set is rows of 64-bit words: `part` is a value's upper bits, `word` has a bit for each value of that part. Words of one part
are merged by bit_or and counted by bit_count, so a coarse bucket comes from finer ones without a flow, a day can be
opened again, and no row grows with its set. Values are IPv4 addresses in plain form, ports and protocols; addresses
whose text says more than their number (IPv6, leading zeros) are rows of their own, with the text as `name` and no word.

Sets are under the flows' own pairs of visibilities; (all, all) is merged from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import statistics as S

#: What has a set in each bucket.
KINDS = ("source_address", "destination_address", "source_port", "destination_port", "protocol")
COLUMNS = (*S.KEY, "kind", "part", "name", "word")
BITS = 6


def _value(kind: str, number: Column, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"), name.alias("name"))


def sets(flows: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """The 5-minute sets of flows, as COLUMNS."""
    none = F.lit(None).cast("string")
    values = [_value("protocol", F.col("protocol"), none)]
    for side, ip, u32, port in (("source", "src_ip", "src_u32", "src_port"), ("destination", "dst_ip", "dst_u32", "dst_port")):
        plain = (F.col("ip_version") == 4) & F.col(u32).isNotNull() & F.col(ip).eqNullSafe(C.ipv4_text(F.col(u32)))
        values.append(_value(f"{side}_address", F.when(plain, F.col(u32)), F.when(~plain, F.col(ip))))
        values.append(_value(f"{side}_port", F.col(port), none))
    rows = S.own_scope(S.bucketed(flows, "5m", tz)).select(*S.KEY, F.explode(F.array(*values)).alias("v")).select(*S.KEY, "v.*")
    number = F.col("number")
    words = rows.where("number is not null or name is not null").select(
        *S.KEY, "kind", F.shiftright(number, BITS).alias("part"), "name", F.expr(f"shiftleft(1L, cast(number & {(1 << BITS) - 1} as int))").alias("word")
    )
    return _together(words)


def _together(words: DataFrame) -> DataFrame:
    return words.groupBy(*COLUMNS[:-1]).agg(F.bit_or("word").alias("word")).select(*COLUMNS)


def merged(finer: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    """Sets of a coarser granularity, or of several runs' rows of the same buckets."""
    return _together(S.moved_to(finer, granularity, tz) if granularity != "5m" else finer)


def with_all(own: DataFrame) -> DataFrame:
    """The sets under their own pairs and under (all, all)."""
    everything = own.withColumns({"src_visibility": F.lit("all"), "dst_visibility": F.lit("all")})
    return own.unionByName(_together(everything))


def _members(low: int = 0, high: int = (1 << BITS) - 1) -> Column:
    """The bits of a word, as numbers."""
    return F.filter(F.sequence(F.lit(low), F.lit(high)), lambda b: F.call_function("shiftright", F.col("word"), b).bitwiseAND(1) == 1)


def protocols(scoped: DataFrame) -> DataFrame:
    """As statistics.protocols, from sets under all pairs."""
    rows = scoped.where("kind = 'protocol'").select(*S.KEY, F.explode(_members()).alias("bit"), "part")
    number = (F.shiftleft("part", BITS) + F.col("bit")).cast("string")
    listed = F.array_join(F.array_sort(F.collect_list(number)), ",")  # 256 protocols at most
    return rows.groupBy(*S.KEY).agg(F.count("*").alias("unique_protocols_count"), listed.alias("protocols_list"))


def _size() -> Column:
    return F.sum(F.coalesce(F.bit_count("word"), F.lit(1))).cast("long")


def _side(kind: str) -> Column:
    return F.regexp_replace("kind", f"_{kind}$", "").alias(f"{kind}_side")


def address_counts(scoped: DataFrame) -> DataFrame:
    """As statistics.address_counts, from sets under all pairs."""
    rows = scoped.where(F.col("kind").endswith("_address"))
    return rows.groupBy(*S.KEY, _side("address")).agg(_size().alias("unique_address_count"))


def port_counts(scoped: DataFrame) -> DataFrame:
    """As statistics.port_counts, from sets under all pairs; a word is in one range."""
    low = F.when(F.col("part") < 1024 >> BITS, "low").otherwise("high").alias("port_range")
    return scoped.where(F.col("kind").endswith("_port")).groupBy(*S.KEY, _side("port"), low).agg(_size().alias("unique_port_count"))


def address_sets(scoped: DataFrame) -> DataFrame:
    """(SET_KEY, a): as statistics.address_sets, from sets under all pairs."""
    return _addresses(scoped.withColumn("address_side", _side("address")), S.SET_KEY)


def coded_address_sets(scoped: DataFrame) -> DataFrame:
    """(CODED_KEY, a): the same in short, from sets of one granularity."""
    place = S.coded(scoped.where(F.col("kind").endswith("_address")).withColumn("address_side", _side("address")))
    return _addresses(place, S.CODED_KEY)


def _addresses(scoped: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = scoped.where(F.col("kind").endswith("_address") & (F.col("ip_version") == 4))
    words = rows.where("word is not null").select(*keys, "part", F.explode(_members()).alias("bit"))
    texts = rows.where("word is null").select(*keys, C.ipv4_number(F.col("name")).alias("a")).where("a is not null")
    plain = words.select(*keys, (F.shiftleft("part", BITS) + F.col("bit")).alias("a"))
    return plain.unionByName(texts).distinct()
