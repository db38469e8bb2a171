"""Runs by state: nothing twice, only changed days, conflicts, and what a failed or killed run leaves."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import statistics as S
from netloom.plans import commits, incremental, product, state
from netloom.plans.store import Conflict
from netloom.sources import captures, csv_files

DAY = 1704096000  # midnight in Los Angeles
CSV = {"columns": {"time_end": "t", "src_ip": "a", "dst_ip": "b", "packets": "p", "src_port": "q"}, "source_id": {"column": "r"}, "has_header": False, "fieldnames": ["t", "a", "b", "p", "q", "r"]}


def lines(*rows):
    return "".join(f"{DAY + t},192.0.2.{a},198.51.100.{a % 3},{p},{a * 7},{r}\n" for t, a, p, r in rows)


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    settings = {"inputs": [{"kind": "csv_tree", "path": f"file://{tmp_path}/in", "mapping": CSV}], "run_structure": False}
    return tmp_path / "in", settings, f"file://{tmp_path}/product"


def tables_equal_one_scan(spark, place, names=("traffic_stats", "protocol_stats", "address_count_stats", "port_count_stats")):
    """Whether the product's tables are those of one scan over all files."""
    folder, _, path = place
    log = commits.Log(spark, path)
    scan = csv_files.scan_csv(spark, f"file://{folder}", csv_files.CsvMapping.from_payload(CSV))
    want = product.tables(scan.flows(), scan.observed_bounds(), with_structure=False)
    return all(
        (got := log.read(n).select(*want[n].columns)).exceptAll(want[n]).count() == want[n].exceptAll(got).count() == 0 < got.count() for n in names
    )


def test_a_second_run_reads_nothing_and_a_new_file_changes_its_days(spark, place, monkeypatch):
    folder, settings, path = place
    log = commits.Log(spark, path)
    (folder / "a.csv").write_text(lines((0, 1, 5, "r1"), (400, 2, 6, "r1"), (90_000, 3, 7, "r1"), (100, 4, 8, "r2")))
    head = incremental.run(spark, settings, path)
    assert head == 1 and [r.status for r in log.read("processed_files").collect()] == ["processed"]
    assert tables_equal_one_scan(spark, place)
    with monkeypatch.context() as m:
        m.setattr(csv_files, "scan_csv", None)  # neither scanned
        m.setattr(state, "content_revisions", lambda files: files.withColumn("revision", F.raise_error(F.lit("hashed")).cast("string")))  # nor hashed
        assert incremental.run(spark, settings, path) == head
    before = {(r.table_name, r.granularity, r.source_id, r.day): r.writer for r in log.state().collect()}
    (folder / "b.csv").write_text(lines((700, 9, 9, "r1")))  # into the first day, between stored buckets
    assert incremental.run(spark, settings, path) == 3
    after = {(r.table_name, r.granularity, r.source_id, r.day): r.writer for r in log.state().collect()}
    moved = {k[2:] for k in after if before.get(k) != after[k] and k[0] in ("traffic_stats", "port_count_stats", "facts", "sets")}
    assert moved == {("r1", "2024-01-01")} and tables_equal_one_scan(spark, place)
    (folder / "c%d é.csv").write_text(lines((3 * 86_400, 5, 1, "r2"), (-86_400, 5, 1, "r1")))  # later and sooner: days between get zeros
    incremental.run(spark, settings, path)
    assert tables_equal_one_scan(spark, place)
    assert {r.locator[-10:] for r in log.read("processed_inputs").collect()} == {f"{folder}/{n}.csv"[-10:] for n in ("a", "b", "c%d é")}
    assert {r.day for r in log.read("traffic_stats").where("source_id = 'r2'").select("day").distinct().collect()} == {f"2024-01-0{k}" for k in (1, 2, 3, 4)}
    assert log.read("traffic_stats", 1).where("source_id = 'r2'").select("day").distinct().count() == 1  # the first commit is as it was


def test_changed_files_and_buckets_of_two_files_are_conflicts(spark, place):
    folder, settings, path = place
    log = commits.Log(spark, path)
    (folder / "a.csv").write_text(lines((0, 1, 5, "r1")))
    head = incremental.run(spark, settings, path)
    (folder / "a.csv").write_text(lines((0, 1, 6, "r1"), (1, 1, 5, "r1")))
    with pytest.raises(Conflict, match="content changed"):
        incremental.run(spark, settings, path)
    (folder / "a.csv").write_text(lines((0, 1, 5, "r1")))  # the content again, at another time: hashed, and as before
    assert incremental.run(spark, settings, path) == head == log.latest()
    other = {"inputs": [settings["inputs"][0] | {"mapping": CSV | {"delimiter": ";"}}], "run_structure": False}
    with pytest.raises(Conflict, match="decoder changed"):
        incremental.run(spark, other, path)
    assert [(r.locator, r.bucket_start, r.status) for r in log.read("processed_inputs").collect()] == [(f"file:{folder}/a.csv", DAY, "processed")]
    (folder / "b.csv").write_text(lines((10, 2, 5, "r1")))
    with pytest.raises(Conflict, match="more than one input"):
        incremental.run(spark, settings, path)
    with pytest.raises(Conflict, match="bound to another product"):
        incremental.run(spark, settings | {"selection": {"ip_prefix": "192.0.2.0/24"}}, path)


def test_failed_and_killed_runs_are_taken_again(spark, place, monkeypatch):
    folder, settings, path = place
    log = commits.Log(spark, path)
    (folder / "a.csv").write_text(lines((0, 1, 5, "r1")))
    (folder / "b.csv").write_text("1,2\n")  # a row of the wrong shape
    with pytest.raises(Exception, match="wrong number of fields"):
        incremental.run(spark, settings, path)
    rows = log.read("processed_files").collect()
    assert {r.status for r in rows} == {"failed"} and all("wrong number" in r.error for r in rows)
    assert "traffic_stats" not in log.about()["schemas"]
    (folder / "b.csv").write_text(lines((600, 2, 5, "r1")))

    def killed(*a, **more):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(incremental, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            incremental.run(spark, settings, path)
    assert {r.status for r in log.read("processed_files").collect()} == {"pending"}
    monkeypatch.setattr(incremental, "BATCH", 1)  # and now file by file
    incremental.run(spark, settings, path)
    assert sorted((r.locator[-5:], r.status, r.error) for r in log.read("processed_files").collect()) == [("a.csv", "processed", None), ("b.csv", "processed", None)]
    assert tables_equal_one_scan(spark, place)


def test_a_capture_that_comes_late_stops_the_commit(spark, tmp_path, monkeypatch):
    row = "1762071310.0,1762071310.0,1762071300.0,10.0.0.1,10.0.0.2,0,443,6,5,500,0,0,1,0,64"
    folder = tmp_path / "tree/m1/2025/11/02"
    folder.mkdir(parents=True)
    put = lambda stamp: (folder / f"nfcapd.{stamp}").write_text(",".join(captures.CAPTURE_FIELDS) + f"\n{row}\n")
    put("202511020115")
    put("202511020125")
    settings = {"inputs": [{"kind": "captures", "path": f"file://{tmp_path}/tree"}], "run_structure": False}
    path = f"file://{tmp_path}/product"
    tables_of = product.tables_of
    with monkeypatch.context() as m:
        m.setattr(product, "tables_of", lambda *a, **more: (put("202511020120"), tables_of(*a, **more))[1])
        with pytest.raises(Conflict, match="about to be published without it"):
            incremental.run(spark, settings, path)
    incremental.run(spark, settings, path)
    five = commits.Log(spark, path).read("traffic_stats").where("granularity = '5m' and ip_version = 4 and src_visibility = 'all'")
    assert [r.packets for r in five.orderBy("bucket_start").collect()] == [5, 5, 5]


def test_changed_days_reach_from_the_old_bounds(spark):
    b = lambda *rows: spark.createDataFrame(rows, incremental.BOUNDS)
    owned = lambda *starts: spark.createDataFrame([("a", s) for s in starts], "source_id string, bucket_start long")
    days = lambda *x: sorted((r.start - DAY) // 86_400 for r in incremental.changed_days(*x).collect())
    assert days(b(), b(("a", DAY, DAY + 86_400)), owned(DAY)) == [0, 1]
    assert days(b(("a", DAY, DAY + 9 * 86_400)), b(("a", DAY + 300, DAY + 600)), owned(DAY + 300)) == [0]
    assert days(b(("a", DAY, DAY + 86_400)), b(("a", DAY + 3 * 86_400, DAY + 3 * 86_400)), owned(DAY + 3 * 86_400)) == [1, 2, 3]
    assert days(b(("a", DAY, DAY + 600)), b(("a", DAY - 2 * 86_400, DAY - 2 * 86_400)), owned(DAY - 2 * 86_400)) == [-2, -1, 0]


def test_large_files_are_hashed_in_chunks(spark, tmp_path):
    with (tmp_path / "big name.bin").open("wb") as f:
        f.truncate(3 << 30)  # sparse, over what one value can hold
    want = __import__("hashlib").sha256()
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    files = incremental.listing(spark, [{"kind": "csv", "path": f"file://{tmp_path}/big name.bin"}])
    assert state.content_revisions(files).first().revision == want.hexdigest()
