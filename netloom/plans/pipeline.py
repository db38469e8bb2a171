"""A run from inputs to a published product: scans, selection, logical sources, dense tables, identity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import calendar
from netloom.functions import flow_columns as C
from netloom.operators import constraints, guards
from netloom.operators import statistics as S
from netloom.plans import product, scratch, state, store
from netloom.sources import captures, config, csv_files, discovery
from netloom.sources.selection import Selection

SCHEMA_VERSION = 1


def csv_input(spark: SparkSession, spec: Mapping) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, observed bounds, owned buckets) of a CSV file or archive, or of a folder of them; late rows fail."""
    mapping = csv_files.CsvMapping.from_payload(spec["mapping"])
    if spec["kind"] == "csv_tree":
        return csv_paths(spark, [r.path for r in discovery.csv_files(discovery.files_below(spark, spec["path"]), mapping).collect()], mapping)
    return csv_paths(spark, [spec["path"]], mapping)


def csv_paths(spark: SparkSession, paths: list[str], mapping: csv_files.CsvMapping) -> tuple[DataFrame, DataFrame, DataFrame]:
    """csv_input of files by name, in their order. Their rows are stored by one pass over them, from which all else comes."""
    archives = [p for p in paths if p.lower().endswith((".tar.gz", ".tgz"))]
    plain = [p for p in paths if p not in archives]
    scans = [csv_files.scan_csv(spark, plain, mapping)] if plain else []
    scans += [csv_files.scan_archives(spark, archives, mapping, f"{scratch.folder(spark)}/lines")] if archives else []
    if not scans:
        raise ValueError("there are no CSV files")
    scans = [s.stored(scratch.folder(spark)) for s in scans]
    for s in scans:
        s.check_order()
    rows = [s.rows.where("covers is not null").select("source_id", F.col("covers").alias("bucket_start"), "locator").distinct() for s in scans]
    bounds = product.union([s.observed_bounds() for s in scans]).groupBy("source_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return product.union([s.flows() for s in scans]), bounds, product.union(rows)


def capture_input(spark: SparkSession, spec: Mapping, tz: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, bounds, owned buckets) of a tree of captures by logical source. With an explicit last date, bounds reach over
    the whole requested window; flows of other days are left out."""
    files = discovery.captures(discovery.files_below(spark, spec["path"], "nfcapd.*", recursive=True), tz)
    first, last = (dt.date.fromisoformat(spec[k]) if spec.get(k) else None for k in ("first_date", "last_date"))
    if first or last:
        low, high = calendar.whole_window(first or dt.date(1970, 1, 2), last or dt.date(2200, 1, 1), calendar.parse_time(spec.get("start")), calendar.parse_time(spec.get("end")), tz)
        files = files.where(F.col("bucket_start").between(low, high - 1))
    paths = [r.path for r in files.select("path").collect()]  # names of files
    if not paths:
        raise ValueError(f"no captures at {spec['path']}")
    flows = captures.read_captures(spark, paths, tz)
    bounds = discovery.source_bounds(files)
    if first and last:
        bounds = discovery.extended(bounds, files.select("source_id").distinct(), low, high - C.FIVE_MINUTES)
    owned = files.select("source_id", "bucket_start", F.col("path").alias("locator"))
    logical = config.logical_sources(spec.get("sources"), spec["path"])
    if logical:
        members = spark.createDataFrame([(s, m) for s, ms in logical.items() for m in ms], "source_id string, member_id string")
        flows = S.logical_sources(flows, members).select(*flows.columns)
        bounds = bounds.withColumnRenamed("source_id", "member_id").join(members, "member_id").groupBy("source_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        owned = owned.withColumnRenamed("source_id", "member_id").join(members, "member_id").select("source_id", "bucket_start", F.lit(spec["path"]).alias("locator")).distinct()
    return flows, bounds, owned


def run(spark: SparkSession, settings: Mapping, path: str, tz: str = C.TIMEZONE) -> str:
    """Read all inputs, make the product and publish it at path; the version's name.

    settings: inputs (see sources.config), selection, run_structure. The folder is bound to the schema, selection and
    configuration of its first run. A bucket that two inputs claim, or a file that goes back behind an earlier one of its
    source, fails the run, and nothing is published; nor if the written tables break a constraint.
    """
    inputs = config.pipeline_inputs(settings)
    selection, with_structure = Selection.from_payload(settings.get("selection")), bool(settings.get("run_structure", True))
    identity = state.product_identity({"version": SCHEMA_VERSION, "tables": sorted(product.TABLES)}, selection.payload(), {"structure": with_structure, "timezone": tz})
    parts = [capture_input(spark, s, tz) if s["kind"] == "captures" else csv_input(spark, s) for s in inputs]
    flows, bounds, owned = (product.union([p[k] for p in parts]) for k in range(3))
    if claimed := guards.overlapping_owners(owned).first():
        raise store.Conflict(f"more than one input has the bucket {claimed.bucket_start} of {claimed.source_id}")
    bounds = bounds.groupBy("source_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = all(s["kind"] == "captures" for s in inputs)  # coarse rows of captures are whole or absent
    state.bind(spark, path, identity)
    layout = {s: m for spec in inputs for s, m in config.logical_sources(spec.get("sources"), spec["path"]).items()}
    state.bind_layout(spark, path, layout)
    made = product.tables(selection.select(flows), bounds, with_structure=with_structure, whole_only=whole, tz=tz)
    made["processed_inputs"] = owned.withColumn("status", F.lit("processed"))
    made["source_members"] = spark.createDataFrame([(s, m) for s, ms in layout.items() for m in ms], "source_id string, member_id string")
    rules = constraints.product_rules(need_rows=False, every_duration=whole, with_structure=with_structure, tz=tz)  # a selection may leave nothing
    return store.publish(made, path, check=lambda written: constraints.check(written, rules))
