"""Guards of the inputs and tables: overlapping owners, files that move backwards, inferred members, metric identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import statistics as S


def overlapping_owners(owned: DataFrame) -> DataFrame:
    """Buckets of a source that more than one input claims. owned: (source_id, bucket_start, locator)."""
    d = owned.select("source_id", "bucket_start", "locator").distinct()
    return d.groupBy("source_id", "bucket_start").agg(F.count("*").alias("owners")).where("owners > 1")


def backward_files(files: DataFrame) -> DataFrame:
    """Files that begin before what earlier files of their source, by path, have reached. files: (source_id, path, first, last)."""
    w = Window.partitionBy("source_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("source_id", "path", "first", F.max("last").over(w).alias("reached")).where("first < reached")


def inferred_members(inputs: DataFrame) -> DataFrame:
    """(source_id, member_id): the fifth segment from the end of capture paths names the member."""
    return inputs.select("source_id", F.get(F.reverse(F.split("locator", "/")), F.lit(4)).alias("member_id")).where("member_id is not null").distinct()


def broken_identities(traffic: DataFrame) -> DataFrame:
    """KEY and metric of rows whose total isn't the sum of its protocol classes, or that measured more flows than there are."""
    wrong = [F.when(F.col(m) != sum(F.col(f"{m}_{c}") for c in S.CLASSES), m) for m in ("flows", "packets", "bytes")]
    wrong += [F.when(F.col(f"{m}_count") > F.col("flows"), m) for m in S.MEASURES]
    return traffic.select(*S.KEY, F.explode(F.array_compact(F.array(*wrong))).alias("metric"))
