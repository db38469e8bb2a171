import pytest
from pyspark.sql import functions as F

from netloom.plans import window_cache
from netloom.plans.store import Conflict

ROWS = [(s, t, p, t * 10) for s in ("a", "b") for t in range(0, 100, 10) for p in (1, 2)]


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), window_cache.RANGES)


def cache_of(spark, tmp_path, rows=ROWS):
    asked = []
    table = spark.createDataFrame(rows, "source_id string, bucket_start long, port int, v long")
    of = window_cache.of_table(table)

    def read(ranges):
        asked.append(sorted(map(tuple, ranges.collect())))
        return of(ranges).withColumn("nth", F.lit(len(asked)))

    return window_cache.WindowCache(spark, f"file://{tmp_path}/cache", read, ["port"]), asked


def test_only_missing_ranges_are_read(spark, tmp_path):
    cache, asked = cache_of(spark, tmp_path)
    first = cache.read(requests(spark, ("a", 20, 50), ("b", 0, 15)))
    assert asked == [[("a", 20, 50), ("b", 0, 15)]]
    assert [(r.source_id, r.bucket_start, r.port) for r in first.collect()] == [(s, t, p) for s, t, p, _ in ROWS if (s == "a" and 20 <= t < 50) or (s == "b" and t < 15)]
    got = cache.read(requests(spark, ("a", 0, 80), ("a", 10, 30))).collect()  # a range before and one behind the cached one; overlapping requests
    assert asked[1:] == [[("a", 0, 20), ("a", 50, 80)]]
    assert [(r.bucket_start, r.port, r.v, r.nth) for r in got] == [(t, p, v, 1 if 20 <= t < 50 else 2) for s, t, p, v in ROWS if s == "a" and t < 80]
    assert cache.read(requests(spark, ("a", 30, 60))).count() == 6 and len(asked) == 2  # all of it is there
    assert sorted(map(tuple, cache.cached().collect())) == [("a", 0, 80), ("b", 0, 15)]


def test_empty_requests_and_ranges_without_records(spark, tmp_path):
    cache, asked = cache_of(spark, tmp_path)
    assert cache.read(requests(spark, ("a", 50, 50), ("a", 60, 40))).count() == 0
    assert cache.read(requests(spark, ("c", 0, 10))).count() == 0
    assert cache.read(requests(spark, ("c", 2, 8))).count() == 0
    assert [x for x in asked if x] == [[("c", 0, 10)]]  # cached though it has no record


def test_the_record_read_last_stays_and_keys_are_forgotten(spark, tmp_path):
    cache, asked = cache_of(spark, tmp_path)
    cache.read(requests(spark, ("a", 0, 20), ("b", 0, 20)))
    cache.forget(spark.createDataFrame([("a",)], "source_id string"))
    assert sorted(map(tuple, cache.cached().collect())) == [("b", 0, 20)]
    other, _ = cache_of(spark, tmp_path, [("a", 0, 1, -1), ("b", 30, 1, -3)])
    got = other.read(requests(spark, ("a", 0, 20), ("b", 0, 40))).collect()
    assert [(r.source_id, r.bucket_start, r.v) for r in got] == [("a", 0, -1), ("b", 0, 0), ("b", 0, 0), ("b", 10, 100), ("b", 10, 100), ("b", 30, -3)]


def test_readers_that_miss_the_same_range(spark, tmp_path):
    slow, asked = cache_of(spark, tmp_path)
    fast, _ = cache_of(spark, tmp_path)
    inner, once = slow.read_ranges, []

    def overtaken(ranges):
        if not once:
            once.append(fast.ensure(requests(spark, ("a", 0, 30))))
        return inner(ranges)

    slow.read_ranges = overtaken
    assert slow.read(requests(spark, ("a", 0, 40))).count() == 8
    assert asked == [[("a", 0, 40)], [("a", 30, 40)]]  # the first reading was in vain
    slow.log.commit = lambda *a, **k: (_ for _ in ()).throw(Conflict("taken"))
    with pytest.raises(Conflict, match="10 times"):
        slow.ensure(requests(spark, ("b", 0, 10)))
