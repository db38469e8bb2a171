"""A cache of windows by request key: only the ranges that no earlier request has read are read, and what is read is kept.

The cache is a commit log with two tables, the records and the half-open ranges that they were read for. A reading of missing ranges
appends both in one commit, so that a range counts as cached if and only if its records are there, with or without any. Of two
readers that miss the same range at once, one commits; the other sees the conflict, looks again, and finds the range cached.
Requests are a table, any number of keys at once; missing ranges are found and records merged by joins and grouping on keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators import statistics as S
from netloom.plans import commits, scratch
from netloom.plans.store import Conflict

RANGES = "source_id string, start long, end long"
#: Times that a reader looks again after others' commits.
TRIES = 10


class WindowCache:
    """Records at path. read_ranges: from ranges (source_id, start, end), in which source_id is the request key, to their records, which
    have source_id, `time` (start <= time < end) and record_key; the record read last is kept of those with the same key."""

    def __init__(self, spark: SparkSession, path: str, read_ranges: Callable[[DataFrame], DataFrame], record_key: Sequence[str] = (), time: str = "bucket_start"):
        self.spark, self.read_ranges, self.time = spark, read_ranges, time
        self.key = ["source_id", time, *[c for c in record_key if c not in ("source_id", time)]]
        self.log = commits.Log(spark, path)

    def cached(self, number: int | None = None) -> DataFrame:
        """(source_id, start, end): the ranges that are cached, overlapping and touching ones as one."""
        number = self.log.latest() if number is None else number
        if number < 0:
            return self.spark.createDataFrame([], RANGES)
        return S.merged_ranges(self.log.read("ranges", number).select("source_id", "start", "end"))

    def missing(self, requests: DataFrame, number: int | None = None) -> DataFrame:
        """(source_id, start, end): what isn't cached of the requests (source_id, start, end). Empty requests miss nothing."""
        wanted = S.merged_ranges(requests.where("start < end").select("source_id", "start", "end"))
        return S.missing_within(self.cached(number), wanted).select("source_id", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))

    def ensure(self, requests: DataFrame) -> int:
        """Read what the requests miss; the commit at which all of them are cached."""
        for _ in range(TRIES):
            head = self.log.latest()
            gaps = scratch.kept(self.missing(requests, head))
            if head >= 0 and gaps.isEmpty():
                return head
            # partitions of the log are named by commit and never replaced
            part = lambda df: df.withColumns({"granularity": F.lit("-"), "day": F.lit(f"{head + 1:010d}")})  # noqa: E731, B023
            try:
                return self.log.commit({"records": part(self.read_ranges(gaps)), "ranges": part(gaps)}, head)
            except Conflict:
                continue
        raise Conflict(f"others have committed to {self.log.path} {TRIES} times")

    def read(self, requests: DataFrame) -> DataFrame:
        """The records of the requests, each once, ordered by key and time. Requests of a key may overlap."""
        number = self.ensure(requests)
        wanted = S.merged_ranges(requests.where("start < end").select("source_id", "start", "end"))
        keys = wanted.select("source_id").distinct()
        records = self.log.read("records", number, within=keys)
        names = [c for c in records.columns if c not in ("granularity", "day")]
        at = F.col(self.time)
        within = records.join(wanted, "source_id").where((at >= F.col("start")) & (at < F.col("end")))
        rest = [c for c in names if c not in self.key]
        last = F.max_by(F.struct(*rest), "day").alias("last") if rest else F.lit(None).alias("last")
        one = within.groupBy(*self.key).agg(last)
        return one.select(*[F.col(f"last.{c}").alias(c) if c in rest else F.col(c) for c in names]).orderBy(*self.key)

    def forget(self, keys: DataFrame) -> int:
        """Drop all that is cached of the keys (source_id)."""
        head = self.log.latest()
        live = self.log.state(head).join(keys.select("source_id").distinct(), "source_id", "left_semi")
        return self.log.commit({}, head, gone=live.select("table_name", *commits.PARTITION))


def of_table(table: DataFrame, time: str = "bucket_start") -> Callable[[DataFrame], DataFrame]:
    """A read_ranges of a table with source_id and time: its rows in the ranges. The bounds of all ranges reach the scan."""

    def read(ranges: DataFrame) -> DataFrame:
        low, high = ranges.agg(F.min("start"), F.max("end")).first()  # one row
        near = table.where((F.col(time) >= F.lit(low).cast(T.LongType())) & (F.col(time) < F.lit(high).cast(T.LongType())))
        return near.join(ranges, "source_id").where((F.col(time) >= F.col("start")) & (F.col(time) < F.col("end"))).select(*table.columns)

    return read
