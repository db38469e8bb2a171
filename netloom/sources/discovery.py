"""Which inputs there are: CSV files in a folder, captures in a tree, and the gaps between them.

Listings go to Spark as tables of paths, so that a tree of any size is handled there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import calendar
from netloom.functions import flow_columns as C
from netloom.sources.captures import bucket_of
from netloom.sources.csv_files import CsvMapping

#: Names of months in file names (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def csv_files(paths: DataFrame, mapping: CsvMapping) -> DataFrame:
    """(path, month, week, name) of the files (path) to scan, in chronological order: what the mapping includes and doesn't
    exclude and no download leaves open (a sidecar with .aria2 behind the name)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    parts = F.split(F.regexp_replace(name, r"[.-]", "_"), "_")
    month = F.coalesce(F.array_min(F.transform(F.filter(parts, lambda p: p.isin(*MONTHS)), lambda p: F.array_position(F.array(*map(F.lit, MONTHS)), p))), F.lit(99))
    weeks = F.filter(parts, lambda p: p.rlike(r"^week\d+$"))
    week = F.coalesce(F.regexp_extract(F.get(weeks, F.lit(0)), r"(\d+)", 1).try_cast("int"), F.lit(99))
    ends = lambda suffixes: name.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$") if suffixes else F.lit(False)
    holds = lambda texts: name.rlike("|".join(map(re.escape, texts))) if texts else F.lit(False)
    open_ = paths.where(F.lower("path").endswith(".aria2")).select(F.expr("substr(path, 1, length(path) - 6)").alias("path"))
    wanted = paths.where(~ends(mapping.exclude_suffixes) & (ends(mapping.include_suffixes) | holds(mapping.include_contains))).join(open_, "path", "left_anti")
    return wanted.select("path", month.cast("int").alias("month"), week.alias("week"), name.alias("name")).orderBy("month", "week", "name")


def files_below(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, size) of the files below a folder, by Spark's file listing; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    return found.select("path", F.col("length").alias("size"))


def captures(paths: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """(source_id, bucket_start, path) of the capture files (path) of a tree."""
    ok = F.col("path").rlike(r"/[^/]+/\d{4}/\d\d/\d\d/nfcapd\.\d{12}$")
    return paths.where(ok).select(F.element_at(F.split("path", "/"), -5).alias("source_id"), bucket_of(F.col("path"), tz).alias("bucket_start"), "path").where("bucket_start is not null")


def source_bounds(found: DataFrame) -> DataFrame:
    """(source_id, first, last) of the captures that are there."""
    return found.groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))


def extended(bounds: DataFrame, sources: DataFrame, first: int, last: int) -> DataFrame:
    """The bounds of all sources (source_id), widened to the requested first and last bucket."""
    joined = sources.select("source_id").join(bounds, "source_id", "left")
    return joined.select("source_id", F.least("first", F.lit(first)).alias("first"), F.greatest("last", F.lit(last)).alias("last"))


def with_gaps(found: DataFrame, bounds: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """(source_id, bucket_start, locator, gap): the captures, and for each bucket within the bounds without one a gap, whose
    locator names source and local time."""
    grid = bounds.select("source_id", F.explode(F.sequence("first", "last", F.lit(C.FIVE_MINUTES).cast("long"))).alias("bucket_start"))
    joined = grid.join(found.select("source_id", "bucket_start", "path"), ["source_id", "bucket_start"], "left")
    gap = F.concat_ws("/", F.lit("gap://nfcapd"), "source_id", calendar.slug(F.col("bucket_start"), tz))
    return joined.select("source_id", "bucket_start", F.coalesce("path", gap).alias("locator"), F.col("path").isNull().alias("gap"))


def logical_inputs(inputs: DataFrame, members: DataFrame) -> DataFrame:
    """(source_id, bucket_start, present, missing): for each logical source and bucket how many members have a capture.

    inputs: as with_gaps() gives them, by member. A source with some of its members takes what is there; none present is a
    gap of the logical source.
    """
    joined = inputs.withColumnRenamed("source_id", "member_id").join(members, "member_id")
    return joined.groupBy("source_id", "bucket_start").agg(F.count_if(~F.col("gap")).alias("present"), F.count_if("gap").alias("missing"))
