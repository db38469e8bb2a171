import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


#: Queries that are registered for each granularity and differ in nothing else are tested at two of them.
ALIKE = ("address_prefix_counts_", "address_prefix_bounds_", "address_structure_", "address_heat_points_", "address_verification_window_", "file_details_sides_")
TESTED = [n for n in sorted(queries.QUERIES) if not (n.startswith(ALIKE) and n.endswith(("_5m", "_30m")))]


@pytest.mark.parametrize("name", TESTED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda v: round(float(v), 4) if isinstance(v, float) else v
    order = [want.columns.index(c) for c in cols]
    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert a == b
