"""A stream of flows into a product: buckets close source by source, and closed buckets are published dense at all granularities.

Each micro-batch is one commit of the log (plans.commits). Its flows become 5-minute facts and sets, which are merged into the
stored ones of their days; they are what is known of open buckets, so no state has flows and a large source is summed in
many tasks. A source's horizon is its own: with `high` its greatest bucket so far, buckets up to high - (lag + 1) * 5 minutes are
closed. A flow of a closed bucket is an error of the whole micro-batch, nothing is dropped; what a slow source sends late
against a fast one isn't late.

What closes is published: every 5-minute bucket from the source's first one on, with zeros where it had no flow, and the rows of
30 minutes, an hour and a local day once their last child is closed. Days come from stored partial results, so
distinct counts are exact and only days in which something closes are written. gaps() names the buckets without a flow.

The commit has the micro-batch's number: a micro-batch that is sent again after a failure isn't counted twice. finish() closes
what is open when a stream has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.functions import flow_columns as C
from netloom.functions import text
from netloom.operators import mergeable
from netloom.operators import statistics as S
from netloom.plans import commits, product, scratch
from netloom.sources.flows import CONTRACT

#: first, high: the least and greatest bucket of a source so far; closed: the greatest closed one, null if none is.
HORIZONS = "source_id string, first long, high long, closed long"
#: The number before a stream's first micro-batch.
NONE = -1


class Late(ValueError):
    """A flow came for a bucket that was closed."""


def table(log: commits.Log, name: str, like: DataFrame, number: int, within: DataFrame | None = None) -> DataFrame:
    """A table of the log with the columns of `like`, empty before it has rows."""
    if name not in log.about(number)["schemas"]:
        return like.limit(0)
    return log.read(name, number, within).select(*like.columns)


def horizons(spark: SparkSession, log: commits.Log, number: int) -> DataFrame:
    return table(log, "horizons", spark.createDataFrame([], HORIZONS), number)


def moved(before: DataFrame, seen: DataFrame, lag_buckets: int) -> DataFrame:
    """HORIZONS of all sources after buckets `seen` (source_id, lo, hi). A source's first bucket is fixed once it has closed."""
    joined = before.join(seen, "source_id", "full")
    high = F.greatest("high", "hi")
    cut = high - (lag_buckets + 1) * C.FIVE_MINUTES
    first = F.least("first", "lo")
    closed = F.greatest("closed", F.when(cut >= first, cut))
    return joined.select("source_id", first.alias("first"), high.alias("high"), closed.alias("closed"))


def closing(before: DataFrame, after: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """(source_id, first, last, done): for each local day in which something closes, the closed part of it; done: the source's
    closed buckets end there."""
    a = after.where("closed is not null").select("source_id", "first", "closed")
    joined = a.join(before.select("source_id", F.col("closed").alias("was")), "source_id", "left").where("was is null or closed > was")
    from_ = joined.select("source_id", F.coalesce(F.col("was") + C.FIVE_MINUTES, F.col("first")).alias("first"), F.col("closed").alias("last"))
    days = S.calendar(from_, "1d", tz).select("source_id", F.col("bucket_start").alias("day"))
    end = C.bucket_end(F.col("day"), "1d", tz) - C.FIVE_MINUTES
    return days.join(a, "source_id").select("source_id", "day", F.greatest("first", "day").alias("first"), F.least("closed", end).alias("last"), (F.col("closed") + C.FIVE_MINUTES).alias("done"))


def _published(log: commits.Log, facts: DataFrame, sets: DataFrame, spans: DataFrame, whole: bool, with_structure: bool, granularities: tuple[str, ...], tz: str) -> dict[str, DataFrame]:
    """The product's tables of the days of spans, of whole buckets alone if asked. facts, sets: those of these days, open buckets too."""
    upto = spans.select("source_id", "done").distinct()
    closed = lambda df: df.join(upto, "source_id").where("bucket_start < done").drop("done")
    bounds = spans.groupBy("source_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    made = product.tables_of(closed(facts), closed(sets), bounds, granularities, with_structure=with_structure, tz=tz, spans=spans.select("source_id", "first", "last"))
    return {n: df.join(upto, "source_id").where("bucket_end <= done").drop("done") for n, df in made.items()} if whole else made


def step(
    flows: DataFrame, epoch: int, path: str, lag_buckets: int = 12, with_structure: bool = False, granularities: tuple[str, ...] = C.GRANULARITIES, tz: str = C.TIMEZONE
) -> None:
    """Take one micro-batch."""
    spark = flows.sparkSession
    log = commits.Log(spark, path)
    head = log.latest()
    if log.about(head).get("epoch", NONE) >= epoch:
        return
    flows.persist()  # its source is read once for both
    facts, sets = product.stored_partials(flows, tz)
    flows.unpersist()
    before = horizons(spark, log, head)
    late = facts.join(before.where("closed is not null"), "source_id").where("bucket_start <= closed").select("source_id", "bucket_start").first()
    if late:
        raise Late(f"a flow of {late.source_id} came for {late.bucket_start}, which is closed")
    after = scratch.kept(moved(before, facts.groupBy("source_id").agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi")), lag_buckets))
    _commit(log, head, facts, sets, before, after, True, with_structure, granularities, tz, {"epoch": epoch})


def finish(spark: SparkSession, path: str, with_structure: bool = False, granularities: tuple[str, ...] = C.GRANULARITIES, tz: str = C.TIMEZONE) -> None:
    """Close all buckets up to each source's greatest one, and publish coarse buckets as far as they have come."""
    log = commits.Log(spark, path)
    head = log.latest()
    before = horizons(spark, log, head)
    texts = {"source_id": "string", "src_ip": "string", "dst_ip": "string", "ip_version": "int"}
    none = product.stored_partials(spark.createDataFrame([], ", ".join(f"{c} {texts.get(c, 'long')}" for c in CONTRACT)), tz)
    about = {"epoch": log.about(head).get("epoch", NONE), "finished": True}
    _commit(log, head, *none, before, scratch.kept(before.withColumn("closed", F.col("high"))), False, with_structure, granularities, tz, about)


def _commit(
    log: commits.Log, head: int, facts: DataFrame, sets: DataFrame, before: DataFrame, after: DataFrame, whole: bool, with_structure: bool, granularities: tuple[str, ...],
    tz: str, about: dict,
) -> None:
    """Merge new partial results into the stored ones of their days, and publish what closes from `before` to `after`."""
    spans = scratch.kept(closing(before, after, tz))
    day = lambda c: commits.local_day(F.col(c), tz).alias("day")
    new_days = facts.select("source_id", day("bucket_start")).distinct()
    days = scratch.kept(new_days.union(spans.select("source_id", day("day"))).distinct())
    all_facts = scratch.kept(S.summed(table(log, "facts", facts, head, days).unionByName(facts)))
    all_sets = scratch.kept(mergeable.merged(table(log, "sets", sets, head, days).unionByName(sets), "5m", tz))
    changed = lambda df: df.withColumn("day", day("bucket_start")).join(new_days, ["source_id", "day"], "left_semi").select(*df.columns)
    made = {"facts": changed(all_facts), "sets": changed(all_sets), "horizons": after.withColumn("day", F.lit("-"))}
    if spans.limit(1).count():
        made |= _published(log, all_facts, all_sets, spans, whole, with_structure, granularities, tz)
    log.commit(made, head, about=about, tz=tz)


def ingest(flows: DataFrame, path: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Run the stream of flows (by the contract) into the product at path. options: as for step."""
    writer = flows.writeStream.foreachBatch(lambda df, epoch: step(df, epoch, path, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def gaps(spark: SparkSession, path: str, scan: str, number: int | None = None) -> DataFrame:
    """(source_id, bucket_start, locator) of the closed buckets that had no flow; the locator names the scan, source and bucket."""
    log = commits.Log(spark, path)
    grid = S.calendar(log.read("horizons", number).where("closed is not null").select("source_id", "first", F.col("closed").alias("last")), "5m")
    none = grid.join(log.read("facts", number).select("source_id", "bucket_start").distinct(), ["source_id", "bucket_start"], "left_anti")
    return none.select("source_id", "bucket_start", text.gap_locator(F.lit(scan), F.col("source_id"), F.col("bucket_start")).alias("locator"))
