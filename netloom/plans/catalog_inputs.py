"""Registered queries of sources and state: mapped CSVs, captures, discovery, gaps, what has been processed; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import calendar, text
from netloom.functions import flow_columns as C
from netloom.operators import statistics as S
from netloom.plans import scratch, state
from netloom.plans.catalog import BASE, _floor, _with, members, register
from netloom.plans.catalog import MEMBERS as LOGICAL
from netloom.sources import captures, csv_files, discovery
from netloom.sources import flows as src
from netloom.sources.selection import Selection

#: A mapped CSV's fields, and what is wrong with the rows of some remainders of k % 50.
FIELDS = ["when", "from", "to", "proto", "packets", "bytes", "tos", "sport", "dport", "seconds", "ttl1", "ttl2", "n", "router"]
LOGICAL_NAMES = ["time_end", "src_ip", "dst_ip", "protocol", "packets", "bytes", "src_tos", "src_port", "dst_port", "duration", "min_ttl", "max_ttl", "flow_count", "source_id"]
WRONG = {1: "address", 2: "packets", 3: "protocol", 4: "src_tos", 5: "shape", 6: "shape", 7: "timestamp", 8: "source_id", 9: "duration", 10: "ttl", 11: "src_port"}
_REASON = "CASE k % 50 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WRONG.items()) + " END"
_FLOWS = "source_id, ip_version, src_ip, dst_ip, protocol, packets, bytes, src_tos, src_port, dst_port, duration_ms, min_ttl, max_ttl, flow_count, end_s"


def csv_lines(s, d) -> DataFrame:
    """Lines of a CSV without header, made of all events; some have something wrong."""
    k = F.col("k") % 50
    f = src.from_events(s, d, "k").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src_port", "dst_port", "min_ttl", "max_ttl")})
    name = F.when((F.col("protocol") == 6) & (F.col("k") % 2 == 0), "tcp").when(F.col("protocol") == 132, " Sctp ").otherwise(F.col("protocol").cast("string"))
    values = [
        F.when(k == 7, "").otherwise(F.col("end_s").cast("string")), F.when(k == 1, "300.1.2.3").otherwise(F.col("src_ip")), F.col("dst_ip"), F.when(k == 3, "NOPE").otherwise(name),
        F.when(k == 2, "-1").otherwise(F.col("packets").cast("string")), F.col("bytes").cast("string"), F.when(k == 4, "256").otherwise(F.col("src_tos").cast("string")),
        F.when(k == 11, "3.1").otherwise(F.col("src_port")), F.col("dst_port"), F.when(k == 9, "0.0005").otherwise(F.coalesce((F.col("duration_ms") / 1000).cast("decimal(18,3)").cast("string"), F.lit(""))),
        F.when(k == 10, "200").otherwise(F.col("min_ttl")), F.when(k == 10, "100").otherwise(F.col("max_ttl")), F.when(F.col("flow_count") == 1, "").otherwise(F.col("flow_count").cast("string")), F.when(k == 8, " ").otherwise(F.col("source_id")),
    ]
    whole = F.concat_ws(",", *values)
    return f.select(F.when(k == 5, F.concat(whole, F.lit(",more"))).when(k == 6, F.concat_ws(",", *values[:5])).otherwise(whole).alias("value"))


def csv_scan(s, d) -> csv_files.Scan:
    path = scratch.folder(s)
    csv_lines(s, d).write.text(path)
    return csv_files.scan_csv(s, path, csv_files.CsvMapping(dict(zip(LOGICAL_NAMES, FIELDS, strict=True)), fieldnames=FIELDS, skip_bad_column_count=True))


register("csv_scan", _with(more=f"SELECT {_FLOWS} FROM flows WHERE {_REASON} IS NULL"))(
    lambda s, d: csv_scan(s, d).flows().select(*_FLOWS.split(", ")))
register("csv_rejected_rows", _with(more=f""", r AS (SELECT {_REASON} AS reason FROM flows) SELECT reason, count(*) AS n FROM r WHERE reason <> 'shape'
        GROUP BY ALL"""))(
    lambda s, d: csv_scan(s, d).rejected().groupBy("reason").agg(F.count("*").alias("n"))
)
register("csv_scan_report", _with(more=f""", r AS (SELECT {_REASON} AS reason FROM flows) SELECT count(*) AS rows,
        count(*) FILTER (WHERE reason <> 'shape') AS rejected_rows,
        count(*) FILTER (WHERE reason = 'shape') AS skipped_bad_column_count FROM r"""))(
    lambda s, d: csv_scan(s, d).report().agg(*[F.sum(c).alias(c) for c in ("rows", "rejected_rows", "skipped_bad_column_count")])
)
register("csv_observed_bounds", _with(more=f"""SELECT source_id, min({_floor('5m')}) AS first, max({_floor('5m')}) AS last FROM flows WHERE k % 50 NOT IN (5, 6, 7,
        8) GROUP BY ALL"""))(lambda s, d: csv_scan(s, d).observed_bounds())


def scan_metrics(s, d) -> DataFrame:
    """What the pass that stores a scan has seen."""
    schema = "rows long, accepted_rows long, rejected_rows long, skipped_bad_column_count long, first long, last long"
    return s.createDataFrame([csv_scan(s, d).stored(scratch.folder(s)).metrics], schema)


register("csv_scan_metrics", _with(more=f""", r AS (SELECT {_REASON} AS reason, k, {_floor('5m')} AS t FROM flows) SELECT count(*) AS rows, count(*) FILTER (WHERE reason IS NULL) AS accepted_rows,
        count(*) FILTER (WHERE reason <> 'shape') AS rejected_rows, count(*) FILTER (WHERE reason = 'shape') AS skipped_bad_column_count,
        min(t) FILTER (WHERE k % 50 NOT IN (5, 6, 7, 8)) AS first, max(t) FILTER (WHERE k % 50 NOT IN (5, 6, 7, 8)) AS last FROM r"""))(scan_metrics)


def csv_with_header(s, d, form: str) -> csv_files.Scan:
    """A scan of CSV files with header, made of all events: quoted notes with line breaks, commas and quotes, and times as local
    wall clock without leading zeros or as milliseconds."""
    f = src.from_events(s, d, "k")
    wall = F.date_format(calendar.local(F.col("end_s")), "M/d/yyyy  H:m:s.SSS")
    time = wall if form == "datetime" else (F.col("end_s") * 1000 + F.col("k") % 1000).cast("string")
    note = F.when(F.col("k") % 3 == 0, F.concat(F.lit('a "note", of\n'), F.col("k").cast("string"), F.lit("\r\n\nlines"))).otherwise("plain")
    texts = {c: F.col(c).cast("string") for c in ("src_ip", "dst_ip", "protocol", "packets", "bytes", "src_tos", "src_port", "dst_port", "min_ttl", "max_ttl", "flow_count", "source_id")}
    texts |= {"time_end": time, "duration": (F.col("duration_ms") / 1000).cast("decimal(18,3)").cast("string")}
    path = scratch.folder(s)
    f.select(note.alias("note"), *[texts[n].alias(c) for n, c in zip(LOGICAL_NAMES, FIELDS, strict=True)]).write.options(header=True, quoteAll=True, escape='"').csv(path)
    pattern = csv_files.datetime_pattern("%m/%d/%Y %H:%M:%S.%f") if form == "datetime" else form
    return csv_files.scan_csv(s, path, csv_files.CsvMapping(dict(zip(LOGICAL_NAMES, FIELDS, strict=True)), timestamp_format=pattern, timezone=C.TIMEZONE))


for _form, _name in (("datetime", "csv_header_scan"), ("unix_ms", "csv_header_scan_unix_ms")):
    register(_name, _with(more=f"SELECT {_FLOWS} FROM flows"))(lambda s, d, form=_form: csv_with_header(s, d, form).flows().select(*_FLOWS.split(", ")))


def capture_rows(s, d) -> DataFrame:
    """The native reader's rows of all events, a capture a local day; ICMP has dotted pseudo-ports."""
    f = src.from_events(s, d, "k")
    day = C.bucket_start(F.col("end_s"), "1d")
    icmp = F.col("protocol").isin(1, 58)
    path = F.concat(F.lit("/captures/"), "source_id", F.date_format(calendar.local(day), "/yyyy/MM/dd/"), F.lit("nfcapd."), calendar.slug(day))
    port = lambda c: F.when(icmp, F.concat((F.col("k") % 256).cast("string"), F.lit(".0"))).otherwise(F.coalesce(c, F.lit(0)).cast("string"))
    t = lambda ms: F.concat((ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    end = F.col("end_s") * 1000
    values = [t(end + 5), t(end), t(end - F.coalesce("duration_ms", F.lit(0))), F.col("src_ip"), F.col("dst_ip"), port(F.col("src_port")), port(F.col("dst_port"))]
    values += [F.col(c).cast("string") for c in ("protocol", "packets", "bytes", "src_tos")] + [F.lit("0"), F.col("flow_count").cast("string")]
    values += [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("min_ttl", "max_ttl")]
    return f.select(path.alias("locator"), F.lit(None).cast("string").alias("corrupt"), *[v.alias(n) for v, n in zip(values, captures.CAPTURE_FIELDS, strict=True)])


register("capture_scan", _with(more=f"""SELECT source_id, ip_version, src_ip, dst_ip, protocol, packets, bytes, src_tos, CASE WHEN protocol IN (1,
        58) THEN 0 ELSE coalesce(src_port, 0) END AS src_port, CASE WHEN protocol IN (1, 58) THEN 0 ELSE coalesce(dst_port,
        0) END AS dst_port, coalesce(duration_ms, 0) AS duration_ms, min_ttl, max_ttl, flow_count, {_floor('1d')} AS end_s
        FROM flows"""))(
    lambda s, d: captures.capture_flows(capture_rows(s, d)).select(*_FLOWS.split(", "))
)
register("flow_selection_ipv6", _with(more="""SELECT source_id, src_ip, dst_ip, packets, bytes, end_s FROM flows
        WHERE ip_version = 6 AND (dst_u32 BETWEEN 3232239616 AND 3232243711 OR src_u32 BETWEEN 3232239616 AND 3232243711) AND src_tos % 4 >= 2"""))(
    lambda s, d: Selection("2001:db8::c0a8:1fff/116", src_visibility="anonymized").select(src.from_events(s, d)).select("source_id", "src_ip", "dst_ip", "packets", "bytes", "end_s")
)


def found_files(s, d) -> DataFrame:
    """A listing with a file for each user, some of other kinds or still being loaded."""
    u = F.col("u")
    month = F.element_at(F.array(*map(F.lit, discovery.MONTHS)), (u % 12 + 1).cast("int"))
    name = F.concat(F.lit("/data/Flows_"), F.initcap(month), F.lit(".week"), (u % 5).cast("string"), F.lit("-"), u.cast("string"))
    users = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    kind = F.when(u % 7 == 0, ".TGZ").when(u % 7 == 1, ".txt").when(u % 7 == 2, ".json").otherwise(".csv.gz")
    files = users.select(F.concat(name, kind).alias("path"))
    return files.union(users.where(u % 11 == 3).select(F.concat(name, kind, F.lit(".aria2"))))


_CSV = csv_files.CsvMapping({"time_end": "t", "src_ip": "a", "dst_ip": "b"}, "r1")
register("csv_discovery", f"""
    WITH base AS ({BASE}), f AS (SELECT DISTINCT u, u % 12 + 1 AS month, u % 5 AS week, CASE u % 7 WHEN 0 THEN '.TGZ' ELSE '.csv.gz' END AS kind FROM base WHERE u % 7 NOT IN (1, 2) AND u % 11 <> 3),
    n AS (SELECT *, 'Flows_' || list_extract(['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'], cast(month AS INT)) || '.week' || week || '-' || u || kind AS file FROM f)
    SELECT '/data/' || file AS path, cast(month AS INT) AS month, cast(week AS INT) AS week, lower(file) AS name FROM n ORDER BY month, week, name""")(
    lambda s, d: discovery.csv_files(found_files(s, d), _CSV))


def found_captures(s, d) -> DataFrame:
    """Captures of the 5-minute buckets that have flows, but for every seventh."""
    b = S.bucketed(src.from_events(s, d), "5m").select("source_id", "bucket_start").distinct().where("bucket_start div 300 % 7 <> 0")
    at = calendar.local(F.col("bucket_start"))
    paths = b.select(F.concat(F.lit("/captures/"), "source_id", F.date_format(at, "/yyyy/MM/dd/"), F.lit("nfcapd."), calendar.slug(F.col("bucket_start"))).alias("path"))
    return discovery.captures(paths.union(paths.select(F.concat("path", F.lit(".part")))))


_LOCAL = f"timezone('{C.TIMEZONE}', to_timestamp(bucket_start))"
_CAPTURES = f""", fc AS (SELECT DISTINCT source_id, {_floor('5m')} AS bucket_start FROM flows WHERE ({_floor('5m')} // 300) % 7 <> 0),
    bb AS (SELECT source_id, least(min(bucket_start), 1704096000) AS first, greatest(max(bucket_start), 1706687700) AS last FROM fc GROUP BY ALL),
    g AS (SELECT source_id, unnest(generate_series(first, last, 300)) AS bucket_start FROM bb),
    cg AS (SELECT g.source_id, g.bucket_start, fc.source_id IS NULL AS gap FROM g LEFT JOIN fc USING (source_id, bucket_start))"""


def gapped(s, d) -> DataFrame:
    found = found_captures(s, d)
    sources = src.from_events(s, d).select("source_id").distinct()
    return discovery.with_gaps(found, discovery.extended(discovery.source_bounds(found), sources, 1704096000, 1706687700))


register("capture_gaps", _with(more=_CAPTURES + f""" SELECT source_id, bucket_start, gap, CASE WHEN gap THEN 'gap://nfcapd/' || source_id || '/' || strftime({_LOCAL},
        '%Y%m%d%H%M') ELSE '/captures/' || source_id || strftime({_LOCAL}, '/%Y/%m/%d/nfcapd.%Y%m%d%H%M') END AS locator
        FROM cg"""))(gapped)
register("logical_inputs", _with(more=_CAPTURES + f""", m(logical, member) AS (VALUES {', '.join(map(str, LOGICAL))}) SELECT m.logical AS source_id, bucket_start,
        count(*) FILTER (WHERE NOT gap) AS present, count(*) FILTER (WHERE gap) AS missing FROM cg
        JOIN m ON m.member = cg.source_id GROUP BY ALL"""))(
    lambda s, d: discovery.logical_inputs(gapped(s, d), members(s))
)
register("csv_gap_locators", _with(more=f""", c AS (SELECT DISTINCT source_id, {_floor('1h')} AS bucket_start FROM flows), b AS (SELECT source_id,
        unnest(generate_series(min(bucket_start), max(bucket_start), 3600)) AS bucket_start FROM c GROUP BY source_id)
        SELECT source_id, bucket_start, 'gap://csv/%2Fdata%2Fa%20b.csv/' || source_id || '/' || bucket_start AS locator FROM b
        ANTI JOIN c USING (source_id, bucket_start)"""))(
    lambda s, d: _csv_gaps(S.bucketed(src.from_events(s, d), "1h").select("source_id", "bucket_start").distinct())
)


def _csv_gaps(have: DataFrame) -> DataFrame:
    bounds = have.groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))
    gaps = S.calendar(bounds, "1h").join(have, ["source_id", "bucket_start"], "left_anti")
    return gaps.select("source_id", "bucket_start", text.gap_locator(F.lit("/data/a b.csv"), F.col("source_id"), F.col("bucket_start")).alias("locator"))


def stored_inputs(s, d) -> DataFrame:
    """Inputs of hours: a locator for each, under scans of six hours, some pending and some of another content than their scan."""
    hours = S.bucketed(src.from_events(s, d), "1h").select("source_id", "bucket_start").distinct()
    h = F.expr("bucket_start div 3600")
    return hours.select(
        "source_id", "bucket_start", F.concat_ws("/", "source_id", h.cast("string")).alias("locator"), F.concat_ws("/", F.lit("scan"), "source_id", F.expr("bucket_start div 21600").cast("string")).alias("scan_locator"),
        F.when(h % 19 == 0, "b").otherwise("a").alias("revision"), F.when(h % 17 == 0, "pending").otherwise("processed").alias("status"),
    )


def wanted_inputs(s, d) -> DataFrame:
    """What is there now: every 13th hour has another content, every 29th a second file."""
    base = stored_inputs(s, d)
    changed = base.withColumn("revision", F.when(F.expr("bucket_start div 3600 % 13 = 0"), "c").otherwise(F.col("revision")))
    return changed.union(changed.where("bucket_start div 3600 % 29 = 0").withColumn("locator", F.concat("locator", F.lit("+"))))


_INPUTS = f""", si AS (SELECT DISTINCT source_id, {_floor('1h')} AS bucket_start FROM flows),
    st AS (SELECT *, bucket_start // 3600 AS h, source_id || '/' || bucket_start // 3600 AS locator, 'scan/' || source_id || '/' || bucket_start // 21600 AS scan_locator,
        CASE WHEN (bucket_start // 3600) % 19 = 0 THEN 'b' ELSE 'a' END AS revision, CASE WHEN (bucket_start // 3600) % 17 = 0 THEN 'pending' ELSE 'processed' END AS status FROM si)"""
register("changed_inputs", _with(more=_INPUTS + " SELECT locator, revision AS stored, 'c' AS requested FROM st WHERE h % 13 = 0 AND status = 'processed'"))(
    lambda s, d: state.changed_inputs(wanted_inputs(s, d), stored_inputs(s, d)).select("locator", "stored", "requested")
)
register("pending_inputs", _with(more=_INPUTS + """ SELECT locator, revision FROM (SELECT locator, CASE WHEN h % 13 = 0 THEN 'c' ELSE revision END AS revision, h, status
        FROM st UNION ALL SELECT locator || '+', CASE WHEN h % 13 = 0 THEN 'c' ELSE revision END, h, 'new' FROM st
        WHERE h % 29 = 0) WHERE status <> 'processed' OR revision = 'c'"""))(
    lambda s, d: state.pending_inputs(wanted_inputs(s, d), stored_inputs(s, d).select("locator", "revision", "status")).select("locator", "revision")
)
register("processed_buckets", _with(more=_INPUTS + """ SELECT source_id, bucket_start, CASE WHEN status = 'pending' OR h % 29 = 0 THEN 'open' WHEN h % 13 = 0 THEN 'conflict' ELSE 'done' END AS state
        FROM st"""))(
    lambda s, d: state.processed_buckets(wanted_inputs(s, d), stored_inputs(s, d))
)
register("scan_states", _with(more=_INPUTS + """ SELECT scan_locator, CASE WHEN count(*) FILTER (WHERE revision <> 'a') > 0 THEN 'conflict' WHEN count(*) FILTER (WHERE status <> 'processed') > 0 OR max((bucket_start // 21600) % 5) = 0 THEN 'incomplete' ELSE 'complete' END AS state
        FROM st GROUP BY ALL"""))(
    lambda s, d: state.scan_states(stored_scans(s, d), stored_inputs(s, d))
)


def stored_scans(s, d) -> DataFrame:
    ended = F.when(F.element_at(F.split("scan_locator", "/"), -1).cast("long") % 5 == 0, "pending").otherwise("processed")
    return stored_inputs(s, d).select("scan_locator").distinct().select("scan_locator", F.lit("a").alias("revision"), ended.alias("status"))


def stale(s, d) -> DataFrame:
    """Stored rows that go when the incomplete scans run again."""
    inputs = stored_inputs(s, d)
    gone = state.retried(inputs, state.scan_states(stored_scans(s, d), inputs))[1]
    flows = src.from_events(s, d)
    return state.stale_rows(S.traffic(flows, "1h").unionByName(S.traffic(flows, "1d")), gone)


register("stale_rows", _with(more=_INPUTS + f""", sc AS (SELECT scan_locator FROM st GROUP BY ALL HAVING count(*) FILTER (WHERE revision <> 'a') = 0 AND (count(*) FILTER (WHERE status <> 'processed') > 0 OR max((bucket_start // 21600) % 5) = 0)),
    go AS (SELECT source_id, bucket_start FROM st SEMI JOIN sc USING (scan_locator)) SELECT source_id, '1h' AS granularity, bucket_start FROM go UNION SELECT source_id, '1d', {_floor('1d', 'bucket_start')} FROM go"""))(stale)
register("reopened_days", _with(more=f""", b AS (SELECT DISTINCT source_id, {_floor('5m')} AS bucket_start FROM flows), o AS (SELECT *, {_floor('1d', 'bucket_start')} AS day FROM b),
    n AS (SELECT * FROM o WHERE (bucket_start // 300) % 5 = 0), f AS (SELECT * FROM o WHERE (bucket_start // 300) % 5 = 1 AND (bucket_start // 86400) % 2 = 0)
    SELECT n.source_id, n.bucket_start, min(f.bucket_start) AS other FROM n JOIN f ON f.source_id = n.source_id AND f.day = n.day GROUP BY ALL"""))(
    lambda s, d: _reopened(S.bucketed(src.from_events(s, d), "5m").select("source_id", "bucket_start").distinct())
)


def _reopened(buckets: DataFrame) -> DataFrame:
    run = buckets.where("bucket_start div 300 % 5 = 0")
    stored = run.union(buckets.where("bucket_start div 300 % 5 = 1 and bucket_start div 86400 % 2 = 0"))
    return state.reopened_days(run, stored, run)


register("flushable_1h", _with(more=f""", b AS (SELECT source_id, max({_floor('5m')}) - 7200 AS now FROM flows GROUP BY ALL), c AS (SELECT DISTINCT source_id,
        {_floor('1h')} AS bucket_start FROM flows) SELECT source_id, bucket_start FROM c JOIN b USING (source_id)
        WHERE bucket_start + 3600 <= now"""))(
    lambda s, d: _flushable(src.from_events(s, d))
)


def _flushable(flows: DataFrame) -> DataFrame:
    reached = S.observed_bounds(flows).select("source_id", (F.col("last") - 7200).alias("bucket_start"))
    return state.flushable(S.bucketed(flows, "1h").select("source_id", "bucket_start").distinct(), reached, "1h")
