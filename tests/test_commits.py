"""The commit log: partitions replaced alone, pinned readers, one of two publishers fails."""

import threading

import pytest
from pyspark.sql import functions as F

from netloom.operators import mergeable
from netloom.operators import statistics as S
from netloom.plans import commits
from netloom.plans.store import Conflict
from netloom.sources import flows as src

DAY = 1704096000  # midnight in Los Angeles
SCHEMA = "source_id string, granularity string, bucket_start long, flows long"


@pytest.fixture
def log(spark, tmp_path):
    return commits.Log(spark, f"file://{tmp_path}/p")


def table(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def files(tmp_path):
    return {p.relative_to(tmp_path) for p in tmp_path.rglob("data/**/*.parquet")}


def read(log, name="t", number=None, **more):
    return sorted((r.source_id, r.granularity, r.bucket_start, r.flows) for r in log.read(name, number, **more).collect())


def test_a_commit_replaces_its_partitions_alone(spark, log, tmp_path):
    assert log.latest() == -1 and log.state().count() == 0
    with pytest.raises(Conflict):
        log.read("t")
    old = [("1", "5m", DAY, 1), ("1", "5m", DAY + 300, 2), ("1", "5m", DAY + 86_400, 3), ("b", "1h", DAY, 4)]
    assert log.commit({"t": table(spark, *old)}, -1) == 0
    before = files(tmp_path)
    assert log.commit({"t": table(spark, ("1", "5m", DAY + 600, 9))}, 0) == 1
    assert before < files(tmp_path) and len(files(tmp_path)) == len(before) + 1  # one day of one source was written
    assert read(log) == sorted([("1", "5m", DAY + 600, 9), *old[2:]]) and read(log, number=0) == sorted(old)
    assert read(log, within=spark.createDataFrame([("1", "2024-01-02")], "source_id string, day string")) == [old[2]]
    gone = spark.createDataFrame([("t", "1h", "b", "2024-01-01"), ("t", "5m", "1", "2024-01-01")], "table_name string, granularity string, source_id string, day string")
    log.commit({"t": table(spark, ("1", "5m", DAY, 5))}, 1, gone)  # of these the second is replaced, not dropped
    assert read(log) == [("1", "5m", DAY, 5), old[2]] and read(log, number=1)
    names = spark.createDataFrame([("x", 1)], "name string, n long")
    log.commit({"names": names}, 2, about={"run": "r"})
    assert [tuple(r) for r in log.read("names").select("name", "n").collect()] == [("x", 1)] and read(log) == [("1", "5m", DAY, 5), old[2]]
    assert log.about()["run"] == "r" and set(log.about()["schemas"]) == {"t", "names"}
    assert log.vacuum(3) == 3 and read(log) == [("1", "5m", DAY, 5), old[2]]


def test_one_of_two_publishers_fails(spark, log, tmp_path):
    log.commit({"t": table(spark, ("a", "5m", DAY, 0))}, -1)
    with pytest.raises(Conflict):
        log.commit({"t": table(spark, ("a", "5m", DAY, 1))}, -1)
    other, outcome, gate = commits.Log(spark, log.path), [], threading.Barrier(2)
    for one in (log, other):  # both write before either publishes
        publish = one._publish
        one._publish = lambda *a, publish=publish: (gate.wait(60), publish(*a))

    def run(one, n):
        try:
            outcome.append(one.commit({"t": table(spark, ("a", "5m", DAY, n))}, 0))
        except Conflict:
            outcome.append("conflict")

    threads = [threading.Thread(target=run, args=(one, n)) for n, one in ((1, log), (2, other))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, outcome)) == ["1", "conflict"] and len(read(log)) == 1
    assert not list(tmp_path.glob("p/staged/*"))


def test_a_failed_write_publishes_nothing(spark, log):
    log.commit({"t": table(spark, ("a", "5m", DAY, 0))}, -1)
    bad = table(spark, ("a", "5m", DAY, 1)).withColumn("flows", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        log.commit({"t": bad}, 0)
    assert log.latest() == 0 and read(log) == [("a", "5m", DAY, 0)]


def test_snapshots_stand_for_the_commits_before_them(spark, log, monkeypatch, tmp_path):
    monkeypatch.setattr(commits, "SNAPSHOT", 3)
    for n in range(5):
        log.commit({"t": table(spark, ("a", "5m", DAY + 86_400 * (n % 3), n))}, n - 1)
    assert [p.name for p in tmp_path.glob("p/log/*.snapshot.json")] == ["0000000002.snapshot.json"]
    assert [r[3] for r in read(log)] == [3, 4, 2] and [r[3] for r in read(log, number=1)] == [0, 1]
    (tmp_path / "p/log/0000000000.json").unlink()
    assert [r[3] for r in read(log)] == [3, 4, 2]


def test_merged_sets_equal_distinct_values_of_flows(spark):
    """Halves of the flows, merged, as all flows; addresses whose text isn't their number's stay apart."""
    flows = src.from_events(spark, "/root/testdata/sf0.001", "k").withColumn("src_ip", F.when(F.col("k") % 9 == 0, F.concat(F.lit("0"), "src_ip")).otherwise(F.col("src_ip")))
    halves = [mergeable.sets(flows.where(F.col("k") % 2 == n)) for n in (0, 1)]
    for g in ("5m", "1d"):
        scoped = mergeable.with_all(mergeable.merged(halves[0].unionByName(halves[1]), g))
        for made, want in (
            (mergeable.protocols(scoped), S.protocols(flows, g)), (mergeable.address_counts(scoped), S.address_counts(flows, g)),
            (mergeable.port_counts(scoped), S.port_counts(flows, g)), (mergeable.address_sets(scoped), S.address_sets(flows, g)),
        ):
            assert made.exceptAll(want.select(*made.columns)).count() == want.select(*made.columns).exceptAll(made).count() == 0 < want.count()
