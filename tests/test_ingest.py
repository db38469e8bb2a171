"""A stream into a product: equal to the batch, each source with its own horizon, late flows fail, no micro-batch twice."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import statistics as S
from netloom.plans import commits, product
from netloom.sources import flows as src
from netloom.streaming import ingest

NIGHT = 1762066800  # midnight in Los Angeles, a day of 25 hours
TABLES = ("traffic_stats", "protocol_stats", "address_count_stats", "port_count_stats")


def flows(spark, *rows):
    """Flows (source, seconds after the night's midnight, k)."""
    base = spark.createDataFrame([(s, NIGHT + t, k, k * 31, (6, 17, 1, 132)[k % 4]) for s, t, k in rows], "s string, end_s long, k long, u long, protocol int")
    return src.derived(base, "s").withColumn("source_id", F.col("s")).select(*src.CONTRACT)


def equal(got, want):
    got = got.select(*want.columns)
    return got.exceptAll(want).count() == want.exceptAll(got).count() == 0


#: A fast source over two days and a slow one that is always more than a day behind it.
BATCHES = [
    [("fast", t, t) for t in (0, 10, 310, 4000, 3900, 7300)] + [("slow", -90_000, 3)],
    [("fast", t, t) for t in (30_000, 92_000, 89_000)] + [("slow", t, -t) for t in (-89_900, -86_000)],
    [("slow", t, -t) for t in (-81_000, -80_000, -79_000)] + [("fast", 92_100, 7)],
]


def test_stream_equals_batch_over_a_day_of_25_hours(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    log = commits.Log(spark, path)
    for n, rows in enumerate(BATCHES):
        ingest.step(flows(spark, *rows), n, path)
    closed = {r.source_id: r.closed for r in log.read("horizons").collect()}
    assert closed == {"fast": NIGHT + 92_100 - 92_100 % 300 - 3900, "slow": NIGHT - 79_000 - (NIGHT - 79_000) % 300 - 3900}
    want = product.tables(flows(spark, *sum(BATCHES, [])), with_structure=False)
    done = F.when(F.col("source_id") == "fast", closed["fast"]).otherwise(closed["slow"]) + 300
    for name in TABLES:  # so far: what is closed, dense, at every granularity
        assert equal(log.read(name), want[name].where(F.col("bucket_end") <= done))
    assert log.read("traffic_stats").where(f"granularity = '1d' and bucket_start = {NIGHT} and bucket_end = {NIGHT + 25 * 3600}").count() == 0
    ingest.finish(spark, path)
    for name in TABLES:
        assert equal(log.read(name), want[name])
    assert log.read("traffic_stats").where(f"granularity = '1d' and bucket_end = {NIGHT + 25 * 3600}").count() == 10
    empty = ingest.gaps(spark, path, "/data/a b.csv")
    have = S.bucketed(flows(spark, *sum(BATCHES, [])), "5m").select("source_id", "bucket_start").distinct().count()
    dense = want["traffic_stats"].where("granularity = '5m'").select("source_id", "bucket_start").distinct().count()
    assert empty.count() == dense - have and empty.where(F.col("locator").startswith("gap://csv/%2Fdata%2Fa%20b.csv/fast/")).count() > 0


def test_late_flows_fail_source_by_source_and_nothing_counts_twice(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    log = commits.Log(spark, path)
    ingest.step(flows(spark, ("a", 0, 1), ("a", 7200, 2), ("b", -9000, 3)), 0, path, lag_buckets=2)
    with pytest.raises(ingest.Late, match="of a"):
        ingest.step(flows(spark, ("a", 6300, 4), ("b", -8000, 3)), 1, path, lag_buckets=2)
    assert log.latest() == 0
    ingest.step(flows(spark, ("a", 6600, 4), ("b", -8000, 3)), 1, path, lag_buckets=2)  # within the horizon, however far b is behind
    ingest.step(flows(spark, ("a", 6600, 4), ("b", -8000, 3)), 1, path, lag_buckets=2)  # sent again
    assert log.latest() == 1
    ingest.finish(spark, path)
    all_rows = flows(spark, ("a", 0, 1), ("a", 7200, 2), ("b", -9000, 3), ("a", 6600, 4), ("b", -8000, 3))
    assert equal(log.read("traffic_stats"), product.tables(all_rows, with_structure=False)["traffic_stats"])


def test_a_stream_of_files(spark, tmp_path):
    stored, path = f"file://{tmp_path}/in", f"file://{tmp_path}/p"
    flows(spark, *BATCHES[0]).coalesce(1).write.parquet(stored)
    stream = lambda: spark.readStream.schema(spark.read.parquet(stored).schema).parquet(stored)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(stream(), path, f"file://{tmp_path}/c", available_now=True).awaitTermination()
    log = commits.Log(spark, path)
    assert log.latest() == 0 and log.read("facts").agg(F.sum("flows").alias("n")).first().n == flows(spark, *BATCHES[0]).agg(F.sum("flow_count").alias("n")).first().n
