"""Parameterised serving queries: checked requests and the ordered rows that answer them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import calendar, text
from netloom.functions import flow_columns as C
from netloom.operators.sources_cover import additive_cover
from netloom.plans import serving

#: The names of granularities in traffic requests (fixed values).
GROUP_BY = {"date": "1d", "hour": "1h", "30min": "30m", "5min": "5m"}
PAIRS = ("all", *C.VISIBILITIES)
SIDES = ("source", "destination")


@dataclass(frozen=True)
class Request:
    """Sources, a half-open window, a granularity and a pair of visibilities."""

    sources: tuple[str, ...]
    start: int
    end: int
    granularity: str = "1h"
    src: str = "all"
    dst: str = "all"

    def __post_init__(self):
        if not self.sources:
            raise ValueError("no sources selected")
        if self.start >= self.end:
            raise ValueError("the start must be before the end")
        for name, v in (("srcVisibility", self.src), ("dstVisibility", self.dst)):
            if v not in PAIRS:
                raise ValueError(f"invalid {name}: expected one of {', '.join(PAIRS)}")

    @classmethod
    def parse(cls, params: Mapping[str, str]) -> Request:
        """The request of URL parameters. An unknown granularity is 1h, an unknown groupBy a date; anything else unknown is an error."""
        times = []
        for name in ("startDate", "endDate"):
            try:
                times.append(int(float(params[name])))
            except (KeyError, ValueError, OverflowError) as e:
                raise ValueError("invalid start or end time") from e
        sources = tuple(s.strip() for s in (params.get("routers") or "").split(",") if s.strip())
        g = GROUP_BY.get(params["groupBy"], "1d") if "groupBy" in params else params.get("granularity")
        return cls(sources, *times, g if g in C.GRANULARITIES else "1h", params.get("srcVisibility") or "all", params.get("dstVisibility") or "all")

    def select(self, table: DataFrame, sources: list[str] | None = None) -> DataFrame:
        """The table's rows of the request: predicates that reach the scan of a stored table."""
        return serving.window(table.where(F.col("granularity") == self.granularity), self.start, self.end, sources or list(self.sources), self.src, self.dst)


def traffic_stats(traffic: DataFrame, definitions: dict[str, set[str]], request: Request) -> DataFrame:
    """Totals by bucket over the stored sources that cover the requested ones without counting a member twice."""
    return serving.family_totals(request.select(traffic, additive_cover(definitions, list(request.sources)))).orderBy("bucket_start")


def address_stats(counts: DataFrame, request: Request) -> DataFrame:
    return serving.unique_by_family(request.select(counts), "unique_address_count", "address_side", SIDES).orderBy("source_id", "bucket_start")


def protocol_stats(counts: DataFrame, request: Request) -> DataFrame:
    return serving.unique_by_family(request.select(counts), "unique_protocols_count").orderBy("source_id", "bucket_start")


def _by_side(structures: DataFrame, kind: str, points) -> DataFrame:
    """A list of points for each side; a side without a row has none."""
    of = [F.max(F.when(F.col("address_side") == s, F.col("values_json"))).alias(s) for s in SIDES]
    wide = structures.where(F.col("structure_kind") == kind).groupBy("source_id", "bucket_start").agg(*of)
    return wide.select("source_id", "bucket_start", *[points(F.coalesce(s, F.lit("[]"))).alias(f"{kind}_{s}") for s in SIDES])


def structure_stats(structures: DataFrame, request: Request) -> DataFrame:
    """(source_id, bucket_start, structure_source, structure_destination) with points (q, tau, sd)."""
    return _by_side(request.select(structures), "structure", text.structure_points).orderBy("source_id", "bucket_start")


def spectrum_stats(structures: DataFrame, request: Request) -> DataFrame:
    """(source_id, bucket_start, spectrum_source, spectrum_destination) with points (alpha, f)."""
    return _by_side(request.select(structures), "spectrum", text.spectrum_points).orderBy("source_id", "bucket_start")


def at_slug(table: DataFrame, slug: str, source: str | None = None, src: str = "all", dst: str = "all") -> DataFrame:
    """The 5-minute rows of a capture's local time YYYYMMDDHHmm."""
    if not (len(slug) == 12 and slug.isdecimal()):
        raise ValueError(f"invalid slug {slug!r}")
    if src not in PAIRS or dst not in PAIRS:
        raise ValueError(f"a visibility is one of {', '.join(PAIRS)}")
    rows = table.where((F.col("granularity") == "5m") & (F.col("src_visibility") == src) & (F.col("dst_visibility") == dst))
    rows = rows.where(F.col("bucket_start") == calendar.slug_start(F.lit(slug)))
    return rows.where(F.col("source_id") == source) if source else rows


def file_address_counts(counts: DataFrame, slug: str, source: str, of_sources: bool, src: str = "all", dst: str = "all") -> DataFrame:
    """(ipv4, ipv6) of one file and side; no row where the file has none."""
    side = SIDES[not of_sources]
    wide = serving.unique_by_family(at_slug(counts, slug, source, src, dst), "unique_address_count", "address_side", SIDES)
    return wide.select(F.col(f"{side}_ipv4").alias("ipv4"), F.col(f"{side}_ipv6").alias("ipv6"))


def file_points(structures: DataFrame, kind: str, slug: str, source: str, of_sources: bool, src: str = "all", dst: str = "all") -> DataFrame:
    """The points of one file, side and kind (structure or spectrum) with their number and ranges; no row where there are none."""
    rows = at_slug(structures, slug, source, src, dst).where((F.col("address_side") == SIDES[not of_sources]) & (F.col("structure_kind") == kind))
    points = (text.structure_points if kind == "structure" else text.spectrum_points)(F.col("values_json")).alias("points")
    field = "q" if kind == "structure" else "alpha"
    return rows.limit(1).select("source_id", "bucket_start", points).where("size(points) > 0").select("*", *text.ranges(F.col("points"), field))


def source_list(traffic: DataFrame) -> DataFrame:
    return traffic.where("granularity = '5m'").select("source_id").distinct().orderBy("source_id")


def source_definitions(traffic: DataFrame, configured: DataFrame, inferred: DataFrame) -> DataFrame:
    """(source_id, members): the configured members, or the inferred ones where none is configured at all; a source that has
    none of either is its own member. configured, inferred: (source_id, member_id)."""
    any_ = configured.limit(1).select(F.lit(True).alias("some"))
    stored = source_list(traffic).select("source_id")
    chosen = configured.select("source_id", "member_id").union(inferred.join(any_, F.lit(True), "left_anti").join(stored, "source_id", "left_semi").select("source_id", "member_id"))
    both = chosen.union(stored.join(chosen, "source_id", "left_anti").select("source_id", F.col("source_id").alias("member_id")))
    return both.groupBy("source_id").agg(F.array_sort(F.collect_set("member_id")).alias("members")).orderBy("source_id")


def catalogue(datasets: DataFrame, traffic: DataFrame) -> DataFrame:
    """The datasets (dataset_id, label, sort_order, ...) with their numbers of sources, in their order. traffic: (dataset_id, source_id, granularity)."""
    counts = traffic.where("granularity = '5m'").groupBy("dataset_id").agg(F.countDistinct("source_id").alias("source_count"))
    return datasets.join(counts, "dataset_id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0))).orderBy("sort_order", "dataset_id")


def family(totals: DataFrame, which: str = "all") -> DataFrame:
    """Traffic totals with one family's counters under the plain names (all, ipv4 or ipv6)."""
    if which == "all":
        return totals.select([c for c in totals.columns if not c.endswith(("_ipv4", "_ipv6"))])
    own = [c for c in totals.columns if c.endswith(f"_{which}")]
    return totals.select("bucket_start", *[F.col(c).alias(c.removesuffix(f"_{which}")) for c in own])
