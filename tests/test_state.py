import datetime as dt

import pytest
from pyspark.sql import functions as F

from netloom.functions import calendar
from netloom.operators import statistics as S
from netloom.plans import pipeline, product, requests, state, store
from netloom.sources import captures, config
from netloom.sources import flows as src
from netloom.streaming import tumbling


def test_extract_window(spark, tmp_path):
    rows = [("r1", "5m", 100, 10), ("r1", "5m", 200, 20), ("r2", "5m", 200, 30), ("r1", "1h", 200, 40), ("r1", "5m", 500, 50)]
    df = spark.createDataFrame(rows, "source_id string, granularity string, bucket_start long, flows long")
    m = store.extract({"traffic_stats": df}, f"file://{tmp_path}/x", 150, 500, "r1", ["5m"])
    assert m["tables"]["traffic_stats"] == {"rows": 1, "first": 200, "last": 200}
    assert [r.flows for r in store.published(spark, f"file://{tmp_path}/x", "traffic_stats").collect()] == [20]
    empty = store.extract({"traffic_stats": df}, f"file://{tmp_path}/y", 9000, 9001)
    assert empty["tables"]["traffic_stats"] == {"rows": 0, "first": None, "last": None} and store.published(spark, f"file://{tmp_path}/y", "traffic_stats").columns == df.columns
    store.write_stats(df, f"file://{tmp_path}/t")
    store.write_stats(df.where("granularity = '1h'"), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 5


def test_publishing_moves_all_tables_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    table = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    with pytest.raises(store.Conflict):
        store.published(spark, path, "a")
    store.publish({"a": table(1), "b": table(1)}, path)
    old = store.published(spark, path, "a")
    store.publish({"a": table(2), "b": table(2)}, path)
    assert [store.published(spark, path, t).first().n for t in "ab"] == [2, 2] and old.first().n == 1  # a reader of the old version goes on
    bad = table(3).select(F.when(F.col("n") == 3, F.raise_error(F.lit("no"))).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        store.publish({"a": table(3), "b": bad}, path)
    assert [store.published(spark, path, t).first().n for t in "ab"] == [2, 2]
    store.views(spark, path, ["a", "b"])
    assert spark.sql("select a.n + b.n as n from a join b on a.n = b.n").first().n == 4
    store.rollback(spark, path)
    assert store.published(spark, path, "a").first().n == 1
    with pytest.raises(store.Conflict):
        store.rollback(spark, path)
    for n in (5, 6, 7):
        store.publish({"a": table(n)}, path, keep=1)
    assert store.published(spark, path, "a").first().n == 7 and len([f for f in (tmp_path / "p").iterdir() if f.is_dir()]) == 1
    for overlap in (["/a/b", "/a/b/c"], ["/a/b", "file:///a/b/"]):
        with pytest.raises(store.Conflict):
            store.separate(overlap)
    store.separate(["/a/b", "/a/bc"])


def test_deleted_buckets(spark):
    stats = spark.createDataFrame([("a", "5m", 0), ("a", "1h", 0), ("b", "5m", 0), ("a", "5m", 300)], "source_id string, granularity string, bucket_start long")
    left = store.delete_buckets(stats, spark.createDataFrame([("a", "5m", 0), ("a", "5m", 0)], stats.schema))
    assert {tuple(r) for r in left.collect()} == {("a", "1h", 0), ("b", "5m", 0), ("a", "5m", 300)}
    gone = spark.createDataFrame([("a", 300)], "source_id string, bucket_start long")
    day = 1704096000  # midnight in Los Angeles
    more = stats.union(spark.createDataFrame([("a", "1d", day)], stats.schema))
    assert {tuple(r) for r in state.stale_rows(more, gone).collect()} == {("a", "5m", 300), ("a", "1h", 0)}
    assert {tuple(r) for r in state.stale_rows(more, gone.withColumn("bucket_start", F.lit(day + 300))).collect()} == {("a", "1d", day)}


def test_processed_state(spark):
    cols = "source_id string, bucket_start long, locator string, revision string, status string"
    done = spark.createDataFrame([("a", 0, "x", "1", "processed"), ("a", 0, "y", "1", "processed"), ("a", 300, "z", "1", "processed"), ("a", 600, "w", "1", "pending")], cols)
    want = spark.createDataFrame([("a", 0, "x", "1"), ("a", 0, "y", "2"), ("a", 300, "z", "1"), ("a", 600, "w", "1"), ("a", 900, "v", "1")], "source_id string, bucket_start long, locator string, revision string")
    assert {tuple(r) for r in state.processed_buckets(want, done).collect()} == {("a", 0, "conflict"), ("a", 300, "done"), ("a", 600, "open"), ("a", 900, "open")}
    assert [tuple(r) for r in state.changed_inputs(want, done).select("locator", "stored", "requested").collect()] == [("y", "1", "2")]
    outcome = want.where("locator = 'w'").withColumn("status", F.lit("processed"))
    assert {(r.locator, r.status) for r in state.marked(done, outcome).collect()} == {(x, "processed") for x in "xyzw"}
    with pytest.raises(Exception, match="changed"):
        state.marked(done, outcome.withColumn("revision", F.lit("9"))).collect()


def test_scan_lifecycle(spark):
    scans = spark.createDataFrame([("s1", "1", "processed"), ("s2", "1", "processed"), ("s3", "1", "pending"), ("s4", "1", "processed"), ("s5", "1", "processed")], "scan_locator string, revision string, status string")
    rows = [("s1", "a", 0, "1", "processed"), ("s2", "a", 300, "1", "pending"), ("s2", "a", 600, "1", "processed"), ("s3", "a", 900, "1", "processed"), ("s4", "a", 1200, "2", "processed")]
    inputs = spark.createDataFrame(rows, "scan_locator string, source_id string, bucket_start long, revision string, status string")
    states = state.scan_states(scans, inputs)
    assert {tuple(r) for r in states.collect()} == {("s1", "complete"), ("s2", "incomplete"), ("s3", "incomplete"), ("s4", "conflict"), ("s5", "complete")}
    keep, gone = state.retried(inputs, states)
    assert {r.scan_locator for r in keep.collect()} == {"s1", "s4"} and {r.bucket_start for r in gone.collect()} == {300, 600, 900}
    gaps = spark.createDataFrame([("/a/nfcapd.1",), ("/a/nfcapd.2",)], "expected_path string")
    assert [tuple(r) for r in state.still_absent(spark, gaps, spark.createDataFrame([("/a/nfcapd.2",)], "path string")).collect()] == [("/a/nfcapd.2",)]


def test_days_of_another_run_stay_closed(spark):
    day = 1704096000
    b = lambda *starts: spark.createDataFrame([("a", s) for s in starts], "source_id string, bucket_start long")
    assert [tuple(r) for r in state.reopened_days(b(day + 600, day + 86_400), b(day, day + 300, day + 600), b(day + 600)).collect()] == [("a", day + 600, day)]
    assert state.reopened_days(b(day + 600), b(day + 600), b()).count() == 0
    coarse = b(day, day + 3600, day + 7200)
    assert [r.bucket_start for r in state.flushable(coarse, b(day + 7200), "1h").orderBy("bucket_start").collect()] == [day, day + 3600]
    assert state.flushable(coarse.limit(1), b(day + 7200), "1d").count() == 0


def test_products_are_bound_once(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    one = state.product_identity({"v": 1}, {"kind": "all"}, {"maad": True})
    assert one == state.product_identity({"v": 1}, {"kind": "all"}, {"maad": True}) and len(one["fingerprint"]) == 64
    state.bind(spark, path, one)
    state.bind(spark, path, one)
    with pytest.raises(store.Conflict, match="selection"):
        state.bind(spark, path, state.product_identity({"v": 1}, {"kind": "flows"}, {"maad": True}))
    state.bind_layout(spark, path, {"all": ["b", "a"]})
    state.bind_layout(spark, path, {"all": ["a", "b"]})
    for other in ({"all": ["a"]}, {"all": ["a", "b"], "more": ["a"]}, {}):
        with pytest.raises(store.Conflict):
            state.bind_layout(spark, path, other)
    store.publish({"t": spark.range(1)}, f"file://{tmp_path}/r")
    with pytest.raises(store.Conflict, match="no product"):
        state.bind(spark, f"file://{tmp_path}/r", one)
    (tmp_path / "in.bin").write_bytes(b"abc")
    assert state.revisions(spark, f"file://{tmp_path}/in.bin").first().revision == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    found = state.verification({"a": spark.createDataFrame([(1, "x")], "n long, src_ip string"), "b": spark.range(0)}, {"a": ["n", "m"], "c": []})
    assert {tuple(r) for r in found.collect()} == {("a", "missing column m"), ("a", "raw address column src_ip"), ("b", "no rows"), ("c", "missing table")}


def test_requests_are_checked():
    good = {"routers": " a, ,b", "startDate": "0", "endDate": "10"}
    r = requests.Request.parse(good)
    assert r == requests.Request(("a", "b"), 0, 10) and r.granularity == "1h"
    assert requests.Request.parse(good | {"groupBy": "30min"}).granularity == "30m" and requests.Request.parse(good | {"groupBy": "year"}).granularity == "1d"
    assert requests.Request.parse(good | {"granularity": "5m"}).granularity == "5m" and requests.Request.parse(good | {"granularity": "2h"}).granularity == "1h"
    for bad in ({"routers": " ,"}, {"startDate": "x"}, {"endDate": ""}, {"startDate": "10"}, {"endDate": "inf"}, {"srcVisibility": "some"}, {"dstVisibility": "ALL"}):
        with pytest.raises(ValueError):
            requests.Request.parse(good | bad)


def test_file_look_ups(spark):
    rows = [("r1", "5m", 1762071300, "all", "all", "source", "structure", '[{"q": 1, "tauTilde": 2, "sd": 0.5}, {"q": 2, "tau": 1}]'), ("r1", "5m", 1762071300, "all", "all", "destination", "structure", "not-json")]
    table = spark.createDataFrame(rows, "source_id string, granularity string, bucket_start long, src_visibility string, dst_visibility string, address_side string, structure_kind string, values_json string")
    r = requests.file_points(table, "structure", "202511020115", "r1", True).first()
    assert ([tuple(p) for p in r.points], r.n_points, r.q_min, r.q_max) == ([(1, 2, 0.5), (2, 1, 0)], 2, 1, 2)
    assert requests.file_points(table, "structure", "202511020115", "r1", False).count() == requests.file_points(table, "spectrum", "202511020115", "r1", True).count() == 0
    for slug in ("20251102011", "20251102011x"):
        with pytest.raises(ValueError):
            requests.at_slug(table, slug)
    both = requests.structure_stats(table, requests.Request(("r1",), 0, 1 << 40, "5m")).first()
    assert len(both.structure_source) == 2 and both.structure_destination == []


def test_windows_of_whole_days():
    first, last = dt.date(2025, 11, 1), dt.date(2025, 11, 2)
    low, high = calendar.whole_window(first, last)
    assert high - low == 49 * 3600
    assert calendar.whole_window(first, last, low + 86_400, None) == (low + 86_400, high)
    for start, end in ((low + 300, None), (low + 3600, None), (low - 86_400, None), (None, high + 86_400), (low + 86_400, low + 86_400)):
        with pytest.raises(ValueError):
            calendar.whole_window(first, last, start, end)
    assert calendar.parse_time("2025-11-02T01:15") == calendar.parse_time("2025-11-02 01:15:00") == 1762071300 and calendar.parse_time("") is None
    with pytest.raises(ValueError):
        calendar.parse_time("tomorrow")


def test_labels_of_a_monday(spark):
    days = [calendar.midnight(dt.date(2026, 3, d)) for d in (2, 3)]
    df = spark.createDataFrame([(t,) for t in days], "t long")
    got = df.select(calendar.label(F.col("t"), "1d"), calendar.label(F.col("t"), "1h"), calendar.tick(F.col("t"), "1d")).collect()
    assert [tuple(r) for r in got] == [("2026-03-02", "2026-03-02 00:00", "Mon 03/02"), ("2026-03-03", "2026-03-03 00:00", "")]
    starts = spark.createDataFrame([(dt.date(2025, 11, 2),), (dt.date(2026, 3, 8),), (dt.date(2026, 3, 9),)], "d date").select(F.size(calendar.day_starts(F.col("d")))).collect()
    assert [r[0] for r in starts] == [300, 276, 288]
    texts = spark.createDataFrame([("2025-11-02",), ("2025-13-02",), ("soon",), ("1762071300",), ("2025-11-02T01:15:00Z",), ("2025-11-02T01:15+05:30",)], "t string")
    assert [r[0] for r in texts.select(calendar.date_range(F.col("t"))).collect()][:3] == [1762066800, 0, 0]
    assert [r[0] for r in texts.select(calendar.boundary(F.col("t"))).collect()] == [1762066800, None, None, 1762071300, 1762046100, 1762026300]


def test_late_rows_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(f"r{k % 2}", k, (k * 7919) % 97 * 300) for k in range(200)]
    df = spark.createDataFrame(rows, "source_id string, row_no long, bucket_start long")
    for part in range(4):  # in reading order
        df.where(f"row_no div 50 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tumbling.run_available(tumbling.late_by_source(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in S.late_rows(df, block_rows=7).collect()} and got
    with pytest.raises(Exception, match="after their bucket"):
        tumbling.run_available(tumbling.late_by_source(stream, fail=True), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()


def test_ranges(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("a", 20, 30), ("b", 0, 1)], "source_id string, start long, end long")
    assert {tuple(r) for r in S.merged_ranges(spans).collect()} == {("a", 0, 12), ("a", 20, 30), ("b", 0, 1)}
    wanted = spark.createDataFrame([("a", 5, 25), ("b", 0, 1), ("c", 1, 3), ("a", 40, 41), ("a", -5, 0)], spans.schema)
    assert {tuple(r) for r in S.missing_within(spans, wanted).collect()} == {("a", 12, 20), ("c", 1, 3), ("a", 40, 41), ("a", -5, 0)}


def test_product_is_dense_and_published_whole(spark, tmp_path):
    flows = src.from_events(spark, "/root/testdata/sf0.001").where("end_s < 1704200000")
    path = f"file://{tmp_path}/product"
    product.publish(flows, path, granularities=("1h", "1d"))
    tables = product.read(spark, path)
    assert set(tables) == set(product.TABLES)
    per_bucket = {"traffic_stats": 10, "protocol_stats": 10, "address_count_stats": 20, "port_count_stats": 40, "address_structure_stats": 30}
    for name, df in tables.items():
        keys = [*S.KEY, *product.TABLES[name]]
        assert df.select(*keys).distinct().count() == df.count()
        for r in df.groupBy("source_id", "granularity", "bucket_start", "bucket_end").count().collect():
            assert r["count"] == per_bucket[name] and r.bucket_end - r.bucket_start == (3600 if r.granularity == "1h" else 86_400)
    wide = S.observed_bounds(flows).withColumn("last", F.col("last") + 7200)
    more = product.tables(flows, bounds=wide, granularities=("5m",), with_structure=False)
    last = more["port_count_stats"].groupBy("bucket_start").agg(F.sum("unique_port_count").alias("n"), F.count("*").alias("m")).orderBy(F.col("bucket_start").desc()).first()
    assert (last.n, last.m % 40, set(more)) == (0, 0, set(product.TABLES) - {"address_structure_stats"})


CSV = {"columns": {"time_end": "t", "src_ip": "a", "dst_ip": "b", "packets": "p"}, "source_id": {"value": "c1"}, "has_header": False, "fieldnames": ["t", "a", "b", "p"]}


def test_a_run_from_files_to_a_product(spark, tmp_path):
    rows = ["1762071310,192.0.2.1,192.0.2.2,3", "1762072000,198.51.100.1,198.51.100.2,4", "1762071320,192.0.2.300,192.0.2.2,3"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join(rows) + "\n")
    row = "1762071310.0,1762071310.0,1762071300.0,10.0.0.1,10.0.0.2,0,443,6,5,500,0,0,1,0,64"
    for member, stamps in (("m1", ("202511020115", "202511020125")), ("m2", ("202511020120",))):
        d = tmp_path / f"tree/{member}/2025/11/02"
        d.mkdir(parents=True)
        for stamp in stamps:
            (d / f"nfcapd.{stamp}").write_text(",".join(captures.CAPTURE_FIELDS) + f"\n{row}\n")
    tree = {"kind": "captures", "path": f"file://{tmp_path}/tree", "sources": [{"source_id": "both", "members": ["m1", "m2"]}, {"source_id": "m1", "members": ["m1"]}]}
    settings = {"inputs": [{"kind": "csv_tree", "path": f"file://{tmp_path}/in", "mapping": CSV}, tree], "selection": {"ip_prefix": "0.0.0.0/1"}, "run_structure": False}
    path = f"file://{tmp_path}/product"
    pipeline.run(spark, settings, path)
    five = store.published(spark, path, "traffic_stats").where("granularity = '5m' and ip_version = 4 and src_visibility = 'all'")
    got = {(r.source_id, r.bucket_start): r.packets for r in five.collect()}
    both = {("both", 1762071300 + k): 5 for k in (0, 300, 600)} | {("m1", 1762071300): 5, ("m1", 1762071600): 0, ("m1", 1762071900): 5}
    assert got == both | {("c1", 1762071300): 0, ("c1", 1762071600): 0, ("c1", 1762071900): 0}  # the selection leaves nothing of the CSV but its buckets
    assert store.published(spark, path, "source_members").count() == 3
    with pytest.raises(store.Conflict, match="selection"):
        pipeline.run(spark, settings | {"selection": None}, path)
    with pytest.raises(store.Conflict, match="more than one input"):
        csv = {"kind": "csv", "mapping": CSV}
        (tmp_path / "in/b.csv").write_text(rows[0] + "\n")
        pipeline.run(spark, {"inputs": [csv | {"path": f"file://{tmp_path}/in/a.csv"}, csv | {"path": f"file://{tmp_path}/in/b.csv"}]}, f"file://{tmp_path}/other")
    whole = pipeline.run(spark, {"inputs": [tree | {"first_date": "2025-11-01", "last_date": "2025-11-02"}], "run_structure": False}, f"file://{tmp_path}/days")
    days = store.published(spark, f"file://{tmp_path}/days", "traffic_stats").where("source_id = 'both' and ip_version = 4 and src_visibility = 'all'")
    assert whole and {(r.granularity, r["count"]) for r in days.groupBy("granularity").count().collect()} == {("5m", 588), ("30m", 98), ("1h", 49), ("1d", 2)}
    pipeline.run(spark, {"inputs": [tree], "run_structure": False}, f"file://{tmp_path}/part")
    assert {r.granularity for r in store.published(spark, f"file://{tmp_path}/part", "traffic_stats").select("granularity").distinct().collect()} == {"5m"}


def test_configurations_are_checked():
    good = {"dataset_id": "a_b", "root_path": "/r", "product_path": "/p"}
    one, two = config.registry([good, good | {"dataset_id": "c", "label": "C", "sources": [{"source_id": "s", "members": ["m", "n"]}]}])
    assert (one.label, one.source_mode, one.discovery_mode, two.sources, two.sort_order) == ("A B", "subdirs", "static", {"s": ["m", "n"]}, 1)
    bad = [[], [1], [good, good], [good | {"root_path": " "}], [good | {"source_ids": "x"}], [good | {"source_ids": [], "sources": []}]]
    bad += [[good | {"sources": s}] for s in ([], [1], [{"source_id": "", "members": ["m"]}], [{"source_id": "s", "members": []}], [{"source_id": "s", "members": ["m", " "]}], [{"source_id": "s", "members": ["m", "m"]}], [{"source_id": "s", "members": ["m"]}] * 2)]
    for b in bad:
        with pytest.raises(ValueError):
            config.registry(b)
    tree = {"kind": "captures", "path": "/x", "sources": [{"source_id": "s", "members": ["m"]}]}
    for b in ({}, {"inputs": []}, {"inputs": [{"kind": "x", "path": "/x"}]}, {"inputs": [{"kind": "csv", "path": "/x"}]}, {"inputs": [{"kind": "captures"}]}, {"inputs": [tree, tree]}):
        with pytest.raises(ValueError):
            config.pipeline_inputs(b)
