"""What has been processed, from which content, and for which product.

Inputs: (locator, source_id, bucket_start, scan_locator, revision, status), one row for each input and bucket; scans:
(scan_locator, revision, status). Every decision is a query over these tables; writing them back is store.publish().
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import flow_columns as C
from netloom.plans.store import Conflict, read_text, write_text

STATUSES = ("pending", "processed", "failed")


def revisions(spark: SparkSession, paths: str) -> DataFrame:
    """(locator, revision): the SHA-256 of each file's content. Files come whole to a task (2 GB at most); see content_revisions."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("locator"), F.sha2("content", 256).alias("revision"))


def content_revisions(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(locator, revision): as revisions, for files (locator) of any size: a task streams each of its files chunk by chunk."""
    schema = T.StructType([T.StructField("locator", T.StringType()), T.StructField("revision", T.StringType())])

    def run(it):
        from pyarrow import fs

        for b in it:
            names, found = b.column("locator").to_pylist(), []
            for name in names:
                local = name.startswith(("/", "file:"))  # such a name isn't escaped
                system, inner = (fs.LocalFileSystem(), name.removeprefix("file:")) if local else fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], names=schema.names)

    return files.select("locator").repartition("locator").mapInArrow(run, schema)


def pending_inputs(inputs: DataFrame, processed: DataFrame) -> DataFrame:
    """Inputs whose content (locator, revision) is not processed yet."""
    return inputs.join(processed.where("status = 'processed'"), ["locator", "revision"], "left_anti")


def changed_inputs(inputs: DataFrame, processed: DataFrame) -> DataFrame:
    """(locator, stored, requested): inputs that were processed with another content. They are conflicts, not new work."""
    done = processed.where("status = 'processed'").select("locator", F.col("revision").alias("stored")).distinct()
    return inputs.select("locator", F.col("revision").alias("requested")).join(done, "locator").where("stored <> requested")


def processed_buckets(wanted: DataFrame, processed: DataFrame) -> DataFrame:
    """(source_id, bucket_start, state): done where the stored inputs are those wanted, conflict where the locators are the
    same and a content differs, else open. wanted, processed: (source_id, bucket_start, locator, revision)."""
    key = ["source_id", "bucket_start"]
    as_set = lambda df, name: df.groupBy(*key).agg(
        F.array_sort(F.collect_set("locator")).alias(f"{name}_locators"), F.array_sort(F.collect_set(F.struct("locator", "revision"))).alias(name)
    )
    both = as_set(wanted, "wanted").join(as_set(processed.where("status = 'processed'"), "stored"), key, "left")
    state = F.when(F.col("wanted") == F.col("stored"), "done").when(F.col("wanted_locators") == F.col("stored_locators"), "conflict").otherwise("open")
    return both.select(*key, state.alias("state"))


def reopened_days(new: DataFrame, stored: DataFrame, run: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """(source_id, bucket_start, other): new 5-minute buckets whose local day has a stored bucket of another run. Distinct
    counts of that day can't be rebuilt without its flows, so the day has to be made anew. All: (source_id, bucket_start)."""
    day = lambda df: df.withColumn("day", C.bucket_start(F.col("bucket_start"), "1d", tz))
    foreign = stored.select("source_id", "bucket_start").distinct().join(run.select("source_id", "bucket_start"), ["source_id", "bucket_start"], "left_anti")
    others = day(foreign).groupBy("source_id", "day").agg(F.collect_set("bucket_start").alias("all"))  # 300 at most
    joined = day(new.select("source_id", "bucket_start")).join(others, ["source_id", "day"])
    other = F.array_min(F.filter("all", lambda b: b != F.col("bucket_start")))
    return joined.select("source_id", "bucket_start", other.alias("other")).where("other is not null")


def flushable(coarse: DataFrame, reached: DataFrame, granularity: str, tz: str = C.TIMEZONE) -> DataFrame:
    """The coarse buckets (source_id, bucket_start) to which no more children can come, as their source has reached their end.
    reached: (source_id, bucket_start), the current 5-minute bucket of each source."""
    now = reached.groupBy("source_id").agg(F.max("bucket_start").alias("now"))
    return coarse.join(now, "source_id").where(C.bucket_end(F.col("bucket_start"), granularity, tz) <= F.col("now")).drop("now")


def marked(inputs: DataFrame, outcome: DataFrame) -> DataFrame:
    """inputs with the status of outcome (locator, source_id, bucket_start, revision, status); a revision that isn't the stored
    one fails the query, as the content has changed in between."""
    new = outcome.select("locator", "source_id", "bucket_start", F.col("revision").alias("seen"), F.col("status").alias("new_status"))
    joined = inputs.join(new, ["locator", "source_id", "bucket_start"], "left")
    same = F.when(F.col("seen").isNull() | (F.col("seen") == F.col("revision")), F.coalesce("new_status", "status"))
    status = same.otherwise(F.raise_error(F.concat(F.lit("the content changed before the status of "), "locator")).cast("string"))
    return joined.withColumn("status", status).select(*inputs.columns)


def scan_states(scans: DataFrame, inputs: DataFrame) -> DataFrame:
    """(scan_locator, state): complete where the scan ended and all its buckets are processed from its content, conflict where
    a bucket has another content, else incomplete."""
    s = scans.select("scan_locator", F.col("revision").alias("wanted"), F.col("status").alias("scan_status"))
    b = inputs.groupBy("scan_locator").agg(F.count_if(F.col("status") != "processed").alias("open"), F.collect_set("revision").alias("seen"))
    other = F.size(F.array_except(F.coalesce("seen", F.array().cast("array<string>")), F.array(F.col("wanted")))) > 0
    state = F.when(other, "conflict").when((F.col("scan_status") == "processed") & (F.coalesce("open", F.lit(0)) == 0), "complete").otherwise("incomplete")
    return s.join(b, "scan_locator", "left").select("scan_locator", state.alias("state"))


def retried(inputs: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs that stay, buckets to delete): what an incomplete scan has written goes before it runs again."""
    again = states.where("state = 'incomplete'").select("scan_locator")
    keep = inputs.join(again, "scan_locator", "left_anti").select(*inputs.columns)
    gone = inputs.join(again, "scan_locator", "left_semi").select("source_id", "bucket_start").distinct()
    return keep, gone


def stale_rows(stats: DataFrame, gone: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """(source_id, granularity, bucket_start) of stored rows that the deleted 5-minute buckets are part of."""
    keys = None
    for g in C.GRANULARITIES:
        part = gone.select("source_id", F.lit(g).alias("granularity"), C.bucket_start(F.col("bucket_start"), g, tz).alias("bucket_start"))
        keys = part if keys is None else keys.union(part)
    return stats.select("source_id", "granularity", "bucket_start").distinct().join(keys.distinct(), ["source_id", "granularity", "bucket_start"], "left_semi")


def still_absent(spark: SparkSession, gaps: DataFrame, listing: DataFrame) -> DataFrame:
    """Gaps (expected_path, ...) whose file has come since: they must not be published as gaps."""
    return gaps.join(listing.select(F.col("path").alias("expected_path")).distinct(), "expected_path", "left_semi")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def product_identity(schema, selection, config) -> dict:
    """What makes two products the same: their schema, selection and configuration."""
    parts = {"schema": schema, "selection": selection, "config": config}
    prints = {k: fingerprint(v) for k, v in parts.items()}
    return {"parts": {k: canonical(v) for k, v in parts.items()}, "fingerprints": prints, "fingerprint": fingerprint({"version": 1, **prints})}


def bind(spark: SparkSession, path: str, identity: dict, name: str = "product") -> None:
    """Bind an empty folder to an identity, or check that it is bound to this one. A folder with tables that is bound to
    nothing, or to something else, is a conflict."""
    stored = read_text(spark, f"{path}/{name}.json")
    if stored is None:
        if name == "product" and read_text(spark, f"{path}/current.json") is not None:
            raise Conflict(f"{path} has tables that are bound to no product")
        write_text(spark, f"{path}/{name}.json", canonical(identity))
        return
    have = json.loads(stored)
    if have != identity:
        differ = [k for k in identity.get("fingerprints", identity) if have.get("fingerprints", have).get(k) != identity.get("fingerprints", identity)[k]]
        raise Conflict(f"{path} is bound to another {name}: {', '.join(differ) or 'parts are gone'}")


def bind_layout(spark: SparkSession, path: str, members: dict[str, list[str]]) -> None:
    """The members of every logical source stay what they were when the tables were begun."""
    bind(spark, path, {k: sorted(v) for k, v in members.items()}, "layout")


def verification(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """(table_name, problem): missing tables and columns, forbidden raw-address columns, and tables without rows."""
    spark = next(iter(tables.values())).sparkSession
    forbidden = {"src_ip", "dst_ip", "source_ip", "destination_ip", "ip_address", "raw_ip"}
    known = [(n, "missing table") for n in required if n not in tables]
    known += [(n, f"missing column {c}") for n, cols in required.items() if n in tables for c in cols if c not in tables[n].columns]
    known += [(n, f"raw address column {c}") for n, df in tables.items() for c in df.columns if c.lower() in forbidden]
    out = spark.createDataFrame(known, "table_name string, problem string")
    for n, df in tables.items():
        out = out.union(df.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(n), F.lit("no rows")))
    return out
