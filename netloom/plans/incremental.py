"""Runs driven by their state tables: each takes the files that are not processed yet, and replaces only the days they touch.

Beside the product's tables the log of commits (plans.commits) has four tables of state:
  processed_files   (locator, file, input, size, modified, revision, decoder, status, error), a row for each file ever seen
  processed_inputs  (locator, source_id, bucket_start, revision, status), a row for each bucket that a file covers
  observed_bounds   (source_id, first, last), what all scans have covered
  facts, sets       the 5-minute partial results of flows, from which all granularities are merged

A file is known by the content's SHA-256 and the fingerprint of how it is decoded. A file whose size and time are those of its row
isn't read again. New files are taken in batches of at most BATCH: a commit marks them as pending, another one publishes
their rows and the days that these change together with the status 'processed', or the status 'failed' with the error. As a
batch's rows and its status are one commit, a killed or failed run leaves nothing to clean: its files are taken again.

Conflicts, which change nothing: a processed file with other content or another decoder, a bucket that another file of the source
has, a file that changes while it is read, a capture that comes for a bucket about to be published as a gap, and another publisher.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import guards, mergeable
from netloom.operators import statistics as S
from netloom.plans import commits, pipeline, product, scratch, state
from netloom.plans.store import Conflict
from netloom.sources import captures, config, csv_files, discovery
from netloom.sources.selection import Selection

#: Files of a batch, whose names the driver holds; parts that processed_files is kept in; what decodes, for fingerprints.
BATCH, PARTS, DECODER = 5_000, 64, "1"
FILES = "locator string, file string, input int, size long, modified long, revision string, decoder string, status string, error string"
INPUTS = "locator string, source_id string, bucket_start long, revision string, status string"
BOUNDS = "source_id string, first long, last long"


def in_parts(files: DataFrame) -> DataFrame:
    """processed_files by parts of the log, so that a commit writes the parts of its files again and no others."""
    return files.withColumn("day", F.pmod(F.xxhash64("locator"), F.lit(PARTS)).cast("string"))


def listing(spark: SparkSession, inputs: list[Mapping], tz: str = C.TIMEZONE) -> DataFrame:
    """(locator, file, input, size, modified) of all files that the inputs name; contents are not read. file: the locator as Spark's
    scans name it, with escapes; input: the place in the list."""
    out = None
    for n, spec in enumerate(inputs):
        tree = spec["kind"] == "captures"
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", tree)
        files = (reader.option("pathGlobFilter", "nfcapd.*") if tree else reader).load(spec["path"]).select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))
        if tree:
            files = files.join(discovery.captures(files.select("path"), tz).select("path"), "path")
        elif spec["kind"] == "csv_tree":
            wanted = discovery.csv_files(files.select("path"), csv_files.CsvMapping.from_payload(spec["mapping"])).select("path")
            files = files.join(wanted, "path")
        part = files.select(F.col("path").alias("locator"), "file", F.lit(n).alias("input"), "size", "modified")
        out = part if out is None else out.union(part)
    return out


def decoders(inputs: list[Mapping], tz: str) -> dict[int, str]:
    """The fingerprint of how each input's files are decoded: changing a mapping changes it."""
    return {n: state.fingerprint({"version": DECODER, "kind": s["kind"], "mapping": s.get("mapping"), "timezone": tz}) for n, s in enumerate(inputs)}


def with_revisions(spark: SparkSession, found: DataFrame, known: DataFrame, decoder: Mapping[int, str]) -> DataFrame:
    """found with revision and decoder. A file whose snapshot (size, modified) is the known one keeps its revision; others are hashed."""
    mine = F.create_map(*[F.lit(x) for kv in decoder.items() for x in kv])
    old = known.select("locator", "size", "modified", F.col("revision").alias("old"))
    joined = scratch.kept(found.join(old, ["locator", "size", "modified"], "left").withColumn("decoder", mine[F.col("input")]))
    fresh = state.content_revisions(joined.where("old is null").select("locator"))
    return joined.join(fresh, "locator", "left").select("locator", "file", "input", "size", "modified", F.coalesce("old", "revision").alias("revision"), "decoder")


def transitions(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with what is to be done: 'done', 'new', 'retry' (pending or failed before), 'content changed' or 'decoder changed'."""
    old = known.select("locator", F.col("revision").alias("old_revision"), F.col("decoder").alias("old_decoder"), F.col("status").alias("old_status"))
    done = F.col("old_status") == "processed"
    step = F.when(F.col("old_status").isNull(), "new").when(~done, "retry").when(F.col("revision") != F.col("old_revision"), "content changed")
    step = step.when(F.col("decoder") != F.col("old_decoder"), "decoder changed").otherwise("done")
    return found.join(old, "locator", "left").withColumn("step", step).drop("old_revision", "old_decoder", "old_status")


def changed_days(before: DataFrame, new: DataFrame, owned: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """(source_id, start): the local days that change as bounds (source_id, first, last) `before` grow by `new`: the days of the
    new buckets, and those from the old bounds to the new ones where these reach further, as they get rows or zeros."""
    b = new.join(before.select("source_id", F.col("first").alias("f"), F.col("last").alias("l")), "source_id", "left")
    later = b.where("l is null or last > l").select("source_id", F.coalesce("l", "first").alias("first"), "last")
    sooner = b.where("first < f").select("source_id", "first", F.col("f").alias("last"))
    grown = S.calendar(later.union(sooner), "1d", tz).select("source_id", F.col("bucket_start").alias("start"))
    return owned.select("source_id", C.bucket_start(F.col("bucket_start"), "1d", tz).alias("start")).union(grown).distinct()


def _table(log: commits.Log, name: str, schema: str, number: int, within: DataFrame | None = None) -> DataFrame:
    """A table of state at a commit, empty before it has rows."""
    if name not in log.about(number)["schemas"]:
        return log.spark.createDataFrame([], schema)
    wanted = [c.split()[0] for c in schema.split(", ")]
    return log.read(name, number, within).select(*wanted)


def scanned(spark: SparkSession, inputs: list[Mapping], batch: DataFrame, tz: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, bounds, owned) of the batch's files (locator, file, input; BATCH at most). owned: (source_id, bucket_start, locator, owner)."""
    parts = []
    for n, spec in enumerate(inputs):
        paths = [r.locator for r in batch.where(F.col("input") == n).orderBy("locator").collect()]
        if not paths:
            continue
        if spec["kind"] != "captures":
            flows, bounds, owned = pipeline.csv_paths(spark, paths, csv_files.CsvMapping.from_payload(spec["mapping"]))
            of_archive = F.regexp_replace("locator", r"(\.tar\.gz|\.tgz):.*$", "$1")
            names = batch.select(F.coalesce("file", "locator").alias("file"), F.col("locator").alias("path"))
            owned = owned.withColumn("file", of_archive).join(names, "file", "left").select("source_id", "bucket_start", F.coalesce("path", "file").alias("locator")).distinct()
            parts.append((flows, bounds, owned.withColumn("owner", F.col("locator"))))
            continue
        flows, files = captures.read_captures(spark, paths, tz), discovery.captures(spark.createDataFrame([(p,) for p in paths], "path string"), tz)
        owned = files.select("source_id", "bucket_start", F.col("path").alias("locator"))
        if logical := config.logical_sources(spec.get("sources"), spec["path"]):
            members = spark.createDataFrame([(s, m) for s, ms in logical.items() for m in ms], "source_id string, member_id string")
            flows = S.logical_sources(flows, members).select(*flows.columns)
            owned = owned.withColumnRenamed("source_id", "member_id").join(members, "member_id").select("source_id", "bucket_start", "locator")
        bounds = owned.groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))
        parts.append((flows, bounds, owned.withColumn("owner", F.lit(spec["path"]) if logical else F.col("locator"))))
    return tuple(product.union([p[k] for p in parts]) for k in range(3))


def run(spark: SparkSession, settings: Mapping, path: str, tz: str = C.TIMEZONE) -> int:
    """Bring the product at path up to its inputs; the last commit's number. settings: as for pipeline.run."""
    inputs = config.pipeline_inputs(settings)
    selection, with_structure = Selection.from_payload(settings.get("selection")), bool(settings.get("run_structure", True))
    tables = {"version": pipeline.SCHEMA_VERSION, "tables": sorted(product.TABLES)}
    state.bind(spark, path, state.product_identity(tables, selection.payload(), {"structure": with_structure, "timezone": tz}))
    state.bind_layout(spark, path, {s: m for spec in inputs for s, m in config.logical_sources(spec.get("sources"), spec["path"]).items()})
    log = commits.Log(spark, path)
    head = log.latest()
    known = _table(log, "processed_files", FILES, head)
    todo = scratch.kept(transitions(with_revisions(spark, listing(spark, inputs, tz), known, decoders(inputs, tz)), known))
    if changed := todo.where("step like '% changed'").orderBy("locator").first():
        raise Conflict(f"{changed.locator} is processed, but its {changed.step}")
    after = F.lit(True)
    while True:
        open_ = todo.where(F.col("step").isin("new", "retry")).where(after).orderBy("locator").limit(BATCH)
        batch = scratch.kept(open_.select(*[c.split()[0] for c in FILES.split(", ")[:-2]]))
        last = batch.agg(F.max("locator").alias("x")).first().x
        if last is None:
            return head
        head = marked(log, head, batch, "pending")
        try:
            head = _publish(log, head, inputs, batch, selection, with_structure, tz)
        except Conflict:
            raise
        except Exception as e:
            marked(log, head, batch, "failed", str(e)[:2000])
            raise
        after = F.col("locator") > last


def with_status(log: commits.Log, head: int, batch: DataFrame, status: str, error: str | None = None) -> DataFrame:
    """The parts of processed_files that have files of the batch, with their new status."""
    parts = in_parts(batch.withColumns({"status": F.lit(status), "error": F.lit(error).cast("string")}))
    old = in_parts(_table(log, "processed_files", FILES, head, parts.select("day").distinct()))
    return old.join(parts.select("locator"), "locator", "left_anti").unionByName(parts)


def marked(log: commits.Log, head: int, batch: DataFrame, status: str, error: str | None = None) -> int:
    return log.commit({"processed_files": with_status(log, head, batch, status, error)}, head, about={"step": status})


def _publish(log: commits.Log, head: int, inputs: list[Mapping], batch: DataFrame, selection: Selection, with_structure: bool, tz: str) -> int:
    """Scan a batch, merge it into the stored partial results of the days that it changes, and publish these days' tables."""
    spark = log.spark
    flows, new, owned = scanned(spark, inputs, batch, tz)
    owned, new = scratch.kept(owned), scratch.kept(new.groupBy("source_id").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    before = _table(log, "observed_bounds", BOUNDS, head)
    days = scratch.kept(changed_days(before, new, owned, tz))
    within = days.select("source_id", commits.local_day(F.col("start"), tz).alias("day"))
    stored_inputs = _table(log, "processed_inputs", f"{INPUTS}, owner string", head, within)
    if claimed := guards.overlapping_owners(stored_inputs.select("source_id", "bucket_start", F.col("owner").alias("locator")).union(owned.select("source_id", "bucket_start", "owner"))).first():
        raise Conflict(f"more than one input has the bucket {claimed.bucket_start} of {claimed.source_id}")
    inputs_now = owned.join(batch.select("locator", "revision"), "locator").select("locator", "source_id", "bucket_start", "revision", F.lit("processed").alias("status"), "owner")

    fresh = product.stored_partials(selection.select(flows), tz)
    old = [_table(log, n, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), head, within) for n, df in zip(("facts", "sets"), fresh, strict=True)]
    facts = scratch.kept(S.summed(old[0].unionByName(fresh[0])))
    sets = scratch.kept(mergeable.merged(old[1].unionByName(fresh[1]), "5m", tz))
    bounds = scratch.kept(before.unionByName(new).groupBy("source_id").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    end = C.bucket_end(F.col("start"), "1d", tz) - C.FIVE_MINUTES
    spans = days.join(bounds, "source_id").select("source_id", F.greatest("first", "start").alias("first"), F.least("last", end).alias("last")).where("first <= last")
    whole = all(s["kind"] == "captures" for s in inputs)  # coarse rows of captures are whole or absent
    made = product.tables_of(facts, sets, bounds, with_structure=with_structure, whole_only=whole, tz=tz, spans=spans)
    touched = bounds.join(new.select("source_id"), "source_id", "left_semi").select(*[c.split()[0] for c in BOUNDS.split(", ")], F.lit("-").alias("day"))
    made |= {"facts": facts, "sets": sets, "processed_inputs": stored_inputs.unionByName(inputs_now), "observed_bounds": touched}
    made["processed_files"] = with_status(log, head, batch, "processed")

    def unchanged() -> None:
        now = scratch.kept(listing(spark, inputs, tz))
        here = now.select("locator", F.col("size").alias("s"), F.col("modified").alias("m"))
        if other := batch.join(here, "locator", "left").where("s is null or s <> size or m <> modified").first():
            raise Conflict(f"{other.locator} changed while it was read")
        seen = batch.select("locator").union(_table(log, "processed_files", FILES, head).select("locator"))
        come = discovery.captures(now.join(seen, "locator", "left_anti").select(F.col("locator").alias("path")), tz)
        gaps = _logical(spark, inputs, come).join(bounds, "source_id").where("bucket_start between first and last")
        if gap := gaps.first():
            raise Conflict(f"{gap.path} came for a bucket that was about to be published without it")

    return log.commit(made, head, about={"step": "processed"}, tz=tz, check=unchanged)


def _logical(spark: SparkSession, inputs: list[Mapping], found: DataFrame) -> DataFrame:
    """Captures (source_id, bucket_start, path) under the logical sources that their members belong to, or their own."""
    pairs = [(s, m) for spec in inputs for s, ms in config.logical_sources(spec.get("sources"), spec["path"]).items() for m in ms]
    members = spark.createDataFrame(pairs, "logical string, source_id string")
    joined = found.join(members, "source_id", "left")
    return joined.select(F.coalesce("logical", "source_id").alias("source_id"), "bucket_start", "path")
