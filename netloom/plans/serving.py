"""Serving queries over the statistics: totals, family pivots, file details, series; and the consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import statistics as S


def window(df: DataFrame, start: int | None = None, end: int | None = None, sources: list[str] | None = None, src: str = "all", dst: str = "all") -> DataFrame:
    """Half-open in time, one visibility pair, some sources."""
    out = df.where((F.col("src_visibility") == src) & (F.col("dst_visibility") == dst))
    if start is not None:
        out = out.where(F.col("bucket_start") >= start)
    if end is not None:
        out = out.where(F.col("bucket_start") < end)
    return out.where(F.col("source_id").isin(sources)) if sources else out


def family_totals(traffic: DataFrame) -> DataFrame:
    """By bucket, over the given sources: counters in all, for IPv4 and for IPv6, and averages."""
    sums = [F.sum(c).alias(c) for c in S.COUNTERS]
    for v in (4, 6):
        sums += [F.sum(F.when(F.col("ip_version") == v, F.col(c)).otherwise(0)).alias(f"{c}_ipv{v}") for c in S.COUNTERS[:15]]
    return S.averages(traffic.groupBy("bucket_start").agg(*sums))


def unique_by_family(counts: DataFrame, value: str, by: str | None = None, kinds: tuple[str, ...] = (), keys: list[str] | None = None) -> DataFrame:
    """One series for each source (unique counts don't add up over sources): a column for each kind and family."""
    out = []
    for v in (4, 6):
        for k in kinds or (None,):
            on = F.col("ip_version") == v
            on = on & (F.col(by) == k) if by else on
            out.append(F.coalesce(F.sum(F.when(on, F.col(value))), F.lit(0)).alias("_".join(x for x in (k, f"ipv{v}") if x)))
    return counts.groupBy(*(keys or ["source_id", "bucket_start"])).agg(*out)


def file_details(traffic: DataFrame, inputs: DataFrame, addresses: DataFrame, structures: DataFrame) -> DataFrame:
    """Traffic with the provenance, address counts and structure points of the same source and bucket, where there are any."""
    key = ["source_id", "bucket_start"]
    ns = traffic.where("src_visibility = 'all' and dst_visibility = 'all'").groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("flows", "packets", "bytes")])
    prov = inputs.groupBy(*key).agg(F.min("locator").alias("first_locator"), F.max("status").alias("status"), F.count("*").alias("n_inputs"))
    ip = unique_by_family(window(addresses), "unique_address_count", "address_side", ("source", "destination"))
    st = structures.groupBy(*key).agg(F.count("*").alias("n_points"), F.min("q8").alias("q8_min"), F.max("q8").alias("q8_max"))
    return ns.join(prov, key, "left").join(ip, key, "left").join(st, key, "left")


def file_details_by_side(grid: DataFrame, traffic: DataFrame, inputs: DataFrame, addresses: DataFrame, structures: DataFrame) -> DataFrame:
    """For each bucket and pair of visibilities of the grid: traffic, provenance, address counts, and the JSON of structure and
    spectrum of either side. structures: as structure.described makes them."""
    bucket = ["source_id", "bucket_start"]
    key = [*bucket, "src_visibility", "dst_visibility"]
    counters = S.COUNTERS[:15]
    ns = traffic.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counters])
    prov = inputs.groupBy(*bucket).agg(F.min("locator").alias("first_locator"), F.max("status").alias("status"), F.count("*").alias("n_inputs"))
    sides = ("source", "destination")
    ip = unique_by_family(addresses, "unique_address_count", "address_side", sides, key)
    on = lambda kind, side: (F.col("structure_kind") == kind) & (F.col("address_side") == side)
    st = structures.groupBy(*key).agg(*[F.max(F.when(on(k, s), F.col("values_json"))).alias(f"{k}_{s}") for k in ("structure", "spectrum") for s in sides])
    out = grid.join(ns, key, "left").join(ip, key, "left").fillna(0).join(prov, bucket, "left").join(st, key, "left")
    return out.select(*key, *counters, *[c for c in ip.columns if c not in key], *[c for c in prov.columns if c not in bucket], *[c for c in st.columns if c not in key])


def rollup_parity(five_minutes: DataFrame, coarse: DataFrame, granularity: str = "1h") -> DataFrame:
    """Rows of the coarse table that its 5-minute children don't add up to, and the other way round.

    A child's coarse bucket follows from its own start, so that children are summed by key and nothing is joined by range.
    """
    key = ["source_id", "ip_version", "src_visibility", "dst_visibility"]
    counters = ("flows", "packets", "bytes")
    child = S.moved_to(five_minutes.select(*key, "bucket_start", *counters), granularity)
    expected = child.groupBy(*key, "bucket_start").agg(*[F.sum(c).alias(c) for c in counters])
    actual = coarse.select(*key, "bucket_start", *counters)
    # One pass: what either side has more often than the other.
    signed = expected.withColumn("n", F.lit(1)).union(actual.withColumn("n", F.lit(-1)))
    differ = signed.groupBy(*key, "bucket_start", *counters).agg(F.sum("n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "expected").otherwise("actual").alias("side")
    return differ.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int")))).select(*key, "bucket_start", *counters, side)


def incomplete_scans(inputs: DataFrame, scans: DataFrame) -> DataFrame:
    """Inputs whose scan is not recorded."""
    return inputs.join(scans, "locator", "left_anti")


def fully_processed(scans: DataFrame, inputs: DataFrame) -> DataFrame:
    """Scans (scan_locator, revision) with no input (scan_locator, revision, status) that is open or of another revision."""
    open_ = (inputs["status"] != "processed") | (inputs["revision"] != scans["revision"])
    return scans.join(inputs, (scans["scan_locator"] == inputs["scan_locator"]) & open_, "left_anti")


def verification_windows(traffic: DataFrame, structures: DataFrame, spectra: DataFrame) -> DataFrame:
    """The first bucket of each source that has traffic, structure points and spectrum points."""
    key = ["source_id", "bucket_start"]
    t = traffic.where("src_visibility = 'all' and dst_visibility = 'all'").select(*key).distinct()
    both = t.join(structures.select(*key).distinct(), key).join(spectra.select(*key).distinct(), key)
    return both.groupBy("source_id").agg(F.min("bucket_start").alias("bucket_start"))


def heat_points(spectra: DataFrame, series: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Spectrum points with the place of their bucket among their series' and the series' bounds of alpha and f."""
    buckets = spectra.select(*series, "bucket_start").distinct()
    places = buckets.withColumn("time_index", F.row_number().over(Window.partitionBy(*series).orderBy("bucket_start")) - 1)
    bounds = spectra.groupBy(*series).agg(*[g(c).alias(f"{c}_{n}") for c in ("alpha", "f") for n, g in (("min", F.min), ("max", F.max))])
    return spectra.join(places, [*series, "bucket_start"]).join(bounds, list(series))


def raw_addresses(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """How many values of each text column hold a literal IPv4 address."""
    pattern = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
    counts = [F.sum(F.col(c).rlike(pattern).cast("long")).alias(c) for c in text_cols]
    return df.agg(*counts).select(F.explode(F.create_map(*[x for c in text_cols for x in (F.lit(c), F.col(c))])).alias("column_name", "n_leaks"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and time span of each table, as a manifest has them."""
    out = None
    for name, df in tables.items():
        s = df.agg(F.count("*").alias("n_rows"), F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last")).select(F.lit(name).alias("table_name"), "*")
        out = s if out is None else out.union(s)
    return out
