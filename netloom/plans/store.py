"""Statistics tables as Parquet: versions behind a pointer, whole partitions replaced, window extracts with a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_stats(df: DataFrame, path: str) -> None:
    """Replace the partitions (granularity, source_id, day) that df has rows of; running it again gives the same table.

    Rows are dealt by ranges of (granularity, source_id, time), so that no task has all of a source.
    """
    days = df.withColumn("day", F.date_format(F.timestamp_seconds("bucket_start"), "yyyy-MM-dd"))
    dealt = days.repartitionByRange("granularity", "source_id", "bucket_start").sortWithinPartitions("granularity", "source_id", "bucket_start")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("granularity", "source_id", "day").parquet(path)


def delete_buckets(stats: DataFrame, keys: DataFrame) -> DataFrame:
    """stats without the buckets (source_id, granularity, bucket_start) of keys."""
    return stats.join(keys.select("source_id", "granularity", "bucket_start").distinct(), ["source_id", "granularity", "bucket_start"], "left_anti")


class Conflict(ValueError):
    """What is there doesn't allow what is asked."""


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file, whole or not at all: written beside, then renamed over the old one."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, path)[1].toUri(), spark._jsc.hadoopConfiguration())
    fs, staged = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(content.encode())
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(staged, _fs(spark, path)[1], options)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()) if fs.exists(p) else None


def separate(paths: list[str]) -> None:
    """Refuse outputs of which one is or holds another."""
    parts = [p.rstrip("/").split("://")[-1].split("/") for p in paths]
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            n = min(len(a), len(b))
            if a[:n] == b[:n]:
                raise Conflict(f"outputs overlap: {'/'.join(a)} and {'/'.join(b)}")


def publish(tables: dict[str, DataFrame], path: str, keep: int = 2, check: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Write a new version of all tables, then point to it; the version's name.

    Readers follow the pointer, one small file replaced by a rename, so they see all tables of the old version or all of the
    new one. If a write fails, or check, which gets the written tables, its version is deleted and the pointer stays. The `keep`
    newest versions stay for rollback().
    """
    spark = next(iter(tables.values())).sparkSession
    separate([f"{path}/{name}" for name in tables])
    before = json.loads(read_text(spark, f"{path}/current.json") or '{"versions": []}')
    version = f"v{len(before['versions']) + before.get('gone', 0):08d}-{uuid.uuid4().hex[:8]}"
    fs, folder = _fs(spark, f"{path}/{version}")
    try:
        for name, df in tables.items():
            df.write.parquet(f"{path}/{version}/{name}")
        if check:
            check({name: spark.read.schema(df.schema).parquet(f"{path}/{version}/{name}") for name, df in tables.items()})
    except Exception:
        fs.delete(folder, True)
        raise
    versions = [*before["versions"], version]
    old, versions = versions[:-keep], versions[-keep:]
    write_text(spark, f"{path}/current.json", json.dumps({"versions": versions, "gone": before.get("gone", 0) + len(old)}))
    for v in old:
        fs.delete(_fs(spark, f"{path}/{v}")[1], True)
    return version


def rollback(spark: SparkSession, path: str) -> str:
    """Point to the version before the current one and delete the current one; the version's name."""
    state = json.loads(read_text(spark, f"{path}/current.json") or '{"versions": []}')
    if len(state["versions"]) < 2:
        raise Conflict("there is no version to go back to")
    *versions, dropped = state["versions"]
    write_text(spark, f"{path}/current.json", json.dumps(state | {"versions": versions, "gone": state.get("gone", 0) + 1}))
    fs, folder = _fs(spark, f"{path}/{dropped}")
    fs.delete(folder, True)
    return versions[-1]


def published(spark: SparkSession, path: str, name: str, schema=None) -> DataFrame:
    """A table of the current version."""
    state = json.loads(read_text(spark, f"{path}/current.json") or '{"versions": []}')
    if not state["versions"]:
        raise Conflict(f"nothing is published at {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{state['versions'][-1]}/{name}")


def views(spark: SparkSession, path: str, names: list[str]) -> None:
    """Name the current version's tables as temporary views, for SQL of one's own."""
    for name in names:
        published(spark, path, name).createOrReplaceTempView(name)


def within(df: DataFrame, start: int, end: int, source_id: str | None = None, granularities: list[str] | None = None) -> DataFrame:
    """A half-open window of a table, of one source and some granularities if asked."""
    out = df.where((F.col("bucket_start") >= start) & (F.col("bucket_start") < end))
    out = out.where(F.col("source_id") == source_id) if source_id else out
    return out.where(F.col("granularity").isin(granularities)) if granularities else out


def extract(tables: dict[str, DataFrame], path: str, start: int, end: int, source_id: str | None = None, granularities: list[str] | None = None) -> dict:
    """Publish a window of each table (its schema too where empty) with its manifest, which is returned."""
    manifest: dict = {"window": {"start": start, "end": end}, "source_id": source_id, "granularities": granularities, "tables": {}}
    spark = next(iter(tables.values())).sparkSession
    publish({name: within(df, start, end, source_id, granularities) for name, df in tables.items()}, path)
    for name, df in tables.items():
        s = published(spark, path, name, df.schema).agg(F.count("*").alias("n"), F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b")).first()
        manifest["tables"][name] = {"rows": s.n, "first": s.a, "last": s.b}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest
