import pytest
from pyspark.sql import functions as F

from netloom.operators import constraints
from netloom.plans import product, store
from netloom.sources import flows as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    flows = src.from_events(spark, SF).where("end_s < 1704153600").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    folder = tmp_path_factory.mktemp("made")
    for n, df in product.tables(flows, granularities=("5m", "1d")).items():
        df.write.parquet(f"{folder}/{n}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in product.TABLES}


def broken(tables, **rules):
    return {(r.table_name, r.rule): r.broken for r in product.verify(tables, **rules).collect()}


def test_a_product_keeps_its_constraints(made):
    assert broken(made, every_duration=True) == {}


def test_faults_of_rows_and_buckets(spark, made):
    t = made["traffic_stats"]
    day = t.where("granularity = '1d' and source_id = 'r1'").agg(F.min("bucket_start")).first()[0]
    key = f"granularity = '1d' and source_id = 'r1' and bucket_start = {day}"
    lost = t.where(f"not ({key} and ip_version = 4 and src_visibility = 'all')")
    assert set(broken(made | {"traffic_stats": lost})) == {("traffic_stats", "scopes"), ("traffic_stats", "additive")}
    twice = t.unionByName(t.where(f"{key} and flows = 0").limit(1))
    assert set(broken(made | {"traffic_stats": twice})) == {("traffic_stats", "scopes")}
    report = constraints.report(made | {"traffic_stats": lost}, constraints.product_rules())
    assert report.where("rule = 'scopes' and broken = 1").first().first_broken == f"r1 1d {day}"
    null = t.withColumn("bytes", F.when(~F.expr(key), F.col("bytes")))
    assert broken(made | {"traffic_stats": null})["traffic_stats", "bytes_classes"] == 10  # null is broken
    a = made["address_structure_stats"]
    assert broken(made | {"address_structure_stats": a.withColumn("values_json", F.lit("[1"))})["address_structure_stats", "values_json"] == a.count()
    p = made["port_count_stats"].withColumn("unique_port_count", F.lit(1025).cast("long"))
    low = made["port_count_stats"].where("port_range = 'low'").count()
    assert broken(made | {"port_count_stats": p})["port_count_stats", "port_count"] == low


@pytest.mark.parametrize("text, ok", [("", True), ("17,6", True), ("6,17", False), ("06", False), ("6,6", False), ("256", False), ("6,", False), ("x", False), (None, False)])
def test_protocol_lists(spark, made, text, ok):
    p = made["protocol_stats"].limit(1).withColumns({"protocols_list": F.lit(text).cast("string"), "unique_protocols_count": F.lit(0).cast("long")})
    got = constraints.checked("p", p, constraints.product_rules(dense=False)["protocol_stats"]).where("rule = 'protocols_list'").first().broken
    assert got == int(not ok)


@pytest.mark.parametrize("text, leaks", [("10.0.0.1", True), ("at 1.2.3.4:80", True), ("1.2.3.4.5", False), ("1.2.3.256", False), ("v1.2.3", False), (None, False)])
def test_addresses_in_texts(spark, made, text, leaks):
    p = made["protocol_stats"].limit(1).withColumn("note", F.lit(text).cast("string"))
    got = constraints.checked("p", p, constraints.product_rules(dense=False)["protocol_stats"]).where("rule = 'no address in note'").first().broken
    assert got == int(leaks)


def test_columns_tables_and_inputs(spark, made):
    t = made | {"traffic_stats": made["traffic_stats"].drop("flows_udp").withColumn("Src_IP", F.lit("-")), "ip_stats_v2": spark.range(0)}
    del t["port_count_stats"]
    got = broken(t, processed=spark.createDataFrame([("processed",), ("pending",), (None,)], "status string"))
    assert {("traffic_stats", "column flows_udp"), ("traffic_stats", "raw address column Src_IP"), ("ip_stats_v2", "old table"), ("port_count_stats", "table")} <= set(got)
    assert got["processed_inputs", "processed"] == 2


def test_empty_tables(made):
    empty = {n: df.limit(0) for n, df in made.items()}
    assert set(broken(empty)) == {(n, "rows") for n in made} | {("traffic_stats", "coarse_rows")}
    assert broken(empty, need_rows=False) == {}


def test_each_table_is_read_once(spark, made, tmp_path):
    made["traffic_stats"].write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = constraints.checked("traffic_stats", t, constraints.product_rules()["traffic_stats"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_broken_version_is_not_published(spark, made, tmp_path):
    path, rules = str(tmp_path / "p"), {"traffic_stats": constraints.product_rules()["traffic_stats"]}
    small = {"traffic_stats": made["traffic_stats"]}
    first = store.publish(small, path, check=lambda written: constraints.check(written, rules))
    with pytest.raises(constraints.Broken, match=r"traffic_stats: flows_classes \(\d+ of \d+, first r1 "):
        store.publish({"traffic_stats": made["traffic_stats"].withColumn("flows", F.col("flows") + 1)}, path, check=lambda written: constraints.check(written, rules))
    assert [d.name for d in (tmp_path / "p").iterdir() if d.name.startswith("v")] == [first]
