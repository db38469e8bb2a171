"""The registered flow queries and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import guards, sources_cover, structure
from netloom.operators import statistics as S
from netloom.plans import scratch, serving
from netloom.sources import flows as src
from netloom.sources.selection import Selection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = """
    SELECT event_id AS k, user_id AS u, cast(epoch_us(ts) // 1000000 AS BIGINT) AS end_s,
           CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17 WHEN 'purchase' THEN 1 WHEN 'error' THEN 132 ELSE 58 END AS protocol
    FROM events"""
BULK = """
    SELECT l_orderkey * 8 + l_linenumber AS k, l_suppkey * 1000003 + l_partkey AS u,
           cast(epoch_us(l_shipdate) // 1000000 AS BIGINT) + (l_orderkey * 7919) % 86400 AS end_s,
           CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 WHEN 'R' THEN 1 ELSE 58 END AS protocol
    FROM lineitem"""


def _ip(n: str) -> str:
    v4 = f"concat_ws('.', {n} // 16777216, ({n} // 65536) % 256, ({n} // 256) % 256, {n} % 256)"
    return f"CASE WHEN k % 10 = 0 THEN '2001:db8::' || lower(to_hex({n} // 65536)) || ':' || lower(to_hex({n} % 65536)) ELSE {v4} END"


def _with(base: str = BASE, more: str = "") -> str:
    return f"""
    WITH base AS ({base}),
    nums AS (SELECT *, (u * 2654435 + (k % 7) * 16777259) % 4294967296 AS src_u32, 3232235520 + (k * 40503) % 65536 AS dst_u32 FROM base),
    flows AS (
        SELECT 'r' || (u % 3 + 1) AS source_id, CASE WHEN k % 10 = 0 THEN 6 ELSE 4 END AS ip_version, src_u32, dst_u32,
               {_ip("src_u32")} AS src_ip, {_ip("dst_u32")} AS dst_ip, protocol, 1 + k % 97 AS packets,
               (1 + k % 97) * (40 + k % 1400) AS bytes, k % 8 AS src_tos,
               CASE WHEN k % 11 <> 0 THEN (k * 7919) % 65536 END AS src_port, CASE WHEN k % 17 <> 0 THEN (k * 104729) % 65536 END AS dst_port,
               CASE WHEN k % 13 <> 0 THEN (k * 37) % 60000 END AS duration_ms, CASE WHEN k % 5 <> 0 THEN 32 + k % 32 END AS min_ttl,
               CASE WHEN k % 6 <> 0 THEN 64 + k % 128 END AS max_ttl, 1 + k % 3 AS flow_count, end_s, k
        FROM nums),
    scoped AS (
        SELECT *, 'all' AS src_visibility, 'all' AS dst_visibility FROM flows
        UNION ALL
        SELECT *, CASE WHEN src_tos % 4 >= 2 THEN 'anonymized' ELSE 'literal' END, CASE WHEN src_tos % 2 = 1 THEN 'anonymized' ELSE 'literal' END FROM flows)
    {more}"""


def _floor(g: str, s: str = "end_s") -> str:
    if g == "1d":
        return f"cast(epoch(timezone('{C.TIMEZONE}', date_trunc('day', timezone('{C.TIMEZONE}', to_timestamp({s}))))) AS BIGINT)"
    return f"({s} // {C.WIDTHS[g]}) * {C.WIDTHS[g]}"


_CLASS = "CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 58 THEN 'icmp' ELSE 'other' END"
_SUMS = ", ".join(
    f"cast(sum({v}) AS BIGINT) AS {n}, " + ", ".join(f"cast(sum(CASE WHEN {_CLASS} = '{c}' THEN {v} ELSE 0 END) AS BIGINT) AS {n}_{c}" for c in S.CLASSES)
    for n, v in (("flows", "flow_count"), ("packets", "packets"), ("bytes", "bytes"))
) + ", " + ", ".join(
    f"cast(coalesce(sum({v} * flow_count), 0) AS BIGINT) AS {n}_sum, cast(coalesce(sum(CASE WHEN {v} IS NOT NULL THEN flow_count END), 0) AS BIGINT) AS {n}_count"
    for n, v in (("duration", "duration_ms"), ("min_ttl", "min_ttl"), ("max_ttl", "max_ttl"))
)
_KEY = "source_id, '{g}' AS granularity, {f} AS bucket_start, ip_version, src_visibility, dst_visibility"
_AVG = ", ".join(f"round(CASE WHEN {m}_count <> 0 THEN {m}_sum / {m}_count END, 6) AS avg_{m}" for m in S.MEASURES)


def _traffic(g: str, base: str = BASE) -> str:
    return _with(base, f", t AS (SELECT {_KEY.format(g=g, f=_floor(g))}, {_SUMS} FROM scoped GROUP BY ALL)")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None = None):
    def of(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return of


for _g in C.GRANULARITIES:
    register(f"traffic_{_g}", _traffic(_g) + f" SELECT *, {_AVG} FROM t")(lambda s, d, g=_g: rounded(S.traffic(src.from_events(s, d), g)))
for _g in ("30m", "1h", "1d"):
    register(f"rollup_{_g}_from_5m", _traffic(_g) + f" SELECT *, {_AVG} FROM t")(
    lambda s, d, g=_g: rounded(S.roll_up(S.traffic(src.from_events(s, d)), g)))
for _g in ("5m", "1d"):
    register(f"protocols_{_g}", _with(more=f""", d AS (SELECT DISTINCT {_KEY.format(g=_g, f=_floor(_g))}, protocol FROM scoped) SELECT source_id, granularity,
        bucket_start, ip_version, src_visibility, dst_visibility, count(*) AS unique_protocols_count,
        string_agg(cast(protocol AS VARCHAR), ',' ORDER BY cast(protocol AS VARCHAR)) AS protocols_list FROM d GROUP BY ALL"""))(
    lambda s, d, g=_g: S.protocols(src.from_events(s, d), g))
for _g in ("1h", "1d"):
    register(f"address_counts_{_g}", _with(more=f""", d AS (SELECT DISTINCT {_KEY.format(g=_g, f=_floor(_g))}, 'source' AS address_side, src_ip AS ip FROM scoped UNION
        SELECT DISTINCT {_KEY.format(g=_g, f=_floor(_g))}, 'destination', dst_ip FROM scoped) SELECT * EXCLUDE ip,
        count(ip) AS unique_address_count FROM d GROUP BY ALL"""))(lambda s, d, g=_g: S.address_counts(src.from_events(s, d), g))
    register(f"port_counts_{_g}", _with(more=f""", d AS (SELECT DISTINCT {_KEY.format(g=_g, f=_floor(_g))}, 'source' AS port_side, src_port AS port FROM scoped UNION
        SELECT DISTINCT {_KEY.format(g=_g, f=_floor(_g))}, 'destination', dst_port FROM scoped) SELECT source_id, granularity,
        bucket_start, ip_version, src_visibility, dst_visibility, port_side,
        CASE WHEN port < 1024 THEN 'low' ELSE 'high' END AS port_range, count(*) AS unique_port_count FROM d
        WHERE port IS NOT NULL GROUP BY ALL"""))(lambda s, d, g=_g: S.port_counts(src.from_events(s, d), g))

register("flow_normalize", _with(more=f"""SELECT source_id, ip_version, src_ip, dst_ip, protocol, packets, bytes, src_port, dst_port, duration_ms, min_ttl,
        max_ttl, flow_count, end_s, {_floor('5m')} AS bucket_start,
        CASE WHEN src_tos % 4 >= 2 THEN 'anonymized' ELSE 'literal' END AS src_visibility,
        CASE WHEN src_tos % 2 = 1 THEN 'anonymized' ELSE 'literal' END AS dst_visibility, {_CLASS} AS protocol_class
        FROM flows"""))(
    lambda s, d: src.from_events(s, d).select("source_id", "ip_version", "src_ip", "dst_ip", "protocol", "packets", "bytes", "src_port", "dst_port", "duration_ms", "min_ttl", "max_ttl", "flow_count", "end_s", C.bucket_start(F.col("end_s"), "5m").alias("bucket_start"), C.visibility(F.col("src_tos"), 2).alias("src_visibility"), C.visibility(F.col("src_tos"), 1).alias("dst_visibility"), C.protocol_class(F.col("protocol")).alias("protocol_class"))
)
register("traffic_1d_bulk", _traffic("1d", BULK) + f" SELECT *, {_AVG} FROM t")(lambda s, d: rounded(S.traffic(src.from_lineitem(s, d), "1d")))
register("flow_selection", _with(more="""SELECT source_id, src_ip, dst_ip, packets, bytes, end_s FROM flows
        WHERE ip_version = 4 AND (src_u32 BETWEEN 3232235520 AND 3232251903 OR dst_u32 BETWEEN 3232235520 AND 3232251903) AND src_tos % 4 < 2"""))(
    lambda s, d: Selection("192.168.0.0/18", "literal").select(src.from_events(s, d)).select("source_id", "src_ip", "dst_ip", "packets", "bytes", "end_s")
)
register("observed_bounds", _with(more=f"SELECT source_id, min({_floor('5m')}) AS first, max({_floor('5m')}) AS last FROM flows GROUP BY ALL"))(
    lambda s, d: S.observed_bounds(src.from_events(s, d)))


def dense_1h(s, d):
    hours = S.traffic(src.from_events(s, d), "1h")
    bounds = hours.where("src_visibility = 'all'").groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))
    return rounded(S.dense(hours, bounds, "1h"))


register("dense_fill_1h", _traffic("1h") + f"""
    , b AS (SELECT source_id, min({_floor('1h')}) AS a, max({_floor('1h')}) AS z FROM flows GROUP BY ALL),
    cal AS (SELECT source_id, unnest(generate_series(a, z, 3600)) AS bucket_start FROM b),
    sc AS (SELECT * FROM (VALUES (4), (6)) v(ip_version) CROSS JOIN (VALUES ('all','all'),('literal','literal'),('literal','anonymized'),('anonymized','literal'),('anonymized','anonymized')) p(src_visibility, dst_visibility))
    SELECT source_id, '1h' AS granularity, bucket_start, ip_version, src_visibility, dst_visibility, {", ".join(f"coalesce({c}, 0) AS {c}" for c in S.COUNTERS)}, {_AVG}
    FROM cal CROSS JOIN sc LEFT JOIN (SELECT * EXCLUDE granularity FROM t) USING (source_id, bucket_start, ip_version, src_visibility, dst_visibility)""")(dense_1h)
register("coverage_1h", _with(more=f"""SELECT source_id, {_floor('1h')} AS bucket_start, count(DISTINCT {_floor('5m')}) AS children, 12 AS wanted,
        count(DISTINCT {_floor('5m')}) = 12 AS complete FROM flows GROUP BY ALL"""))(
    lambda s, d: S.coverage(S.traffic(src.from_events(s, d)), "1h")
)

MEMBERS = [("r1", "r1"), ("r2", "r2"), ("r3", "r3"), ("all", "r1"), ("all", "r2"), ("all", "r3"), ("pair", "r1"), ("pair", "r2")]


def members(s: SparkSession) -> DataFrame:
    return s.createDataFrame(MEMBERS, "source_id string, member_id string")


register("logical_sources_1d", _with(more=f""", m(logical, member) AS (VALUES {', '.join(map(str, MEMBERS))}),
        t AS (SELECT {_KEY.format(g='1d', f=_floor('1d')).replace('source_id', 'm.logical AS source_id', 1)}, {_SUMS}
        FROM scoped JOIN m ON m.member = scoped.source_id GROUP BY ALL) SELECT *, {_AVG} FROM t"""))(
    lambda s, d: rounded(S.traffic(S.logical_sources(src.from_events(s, d), members(s)), "1d"))
)
_TOTALS = ", ".join([f"cast(sum({c}) AS BIGINT) AS {c}" for c in S.COUNTERS] + [f"cast(sum(CASE WHEN ip_version = {v} THEN {c} ELSE 0 END) AS BIGINT) AS {c}_ipv{v}" for v in (4, 6) for c in S.COUNTERS[:15]])
register("api_netflow_stats_family_pivot", _traffic("1h") + f""", e AS (SELECT bucket_start, {_TOTALS} FROM t
        WHERE src_visibility = 'all' AND dst_visibility = 'all' AND source_id IN ('r1','r2','r3') GROUP BY ALL) SELECT *,
        {_AVG} FROM e""")(
    lambda s, d: rounded(serving.family_totals(serving.window(S.traffic(src.from_events(s, d), "1h"), sources=["r1", "r2", "r3"])))
)


def cover_totals(s, d):
    definitions: dict[str, set[str]] = {}
    for logical, member in MEMBERS:
        definitions.setdefault(logical, set()).add(member)
    chosen = sources_cover.additive_cover(definitions, ["r1", "r2"])
    traffic = S.traffic(S.logical_sources(src.from_events(s, d), members(s)), "1d")
    return rounded(serving.family_totals(serving.window(traffic, sources=chosen)))


register("additive_source_cover", _traffic("1d") + f""", e AS (SELECT bucket_start, {_TOTALS} FROM t
        WHERE src_visibility = 'all' AND dst_visibility = 'all' AND source_id IN ('r1','r2') GROUP BY ALL) SELECT *, {_AVG}
        FROM e""")(cover_totals)
register("api_ip_stats", _with(more=f"""SELECT source_id, {_floor('1h')} AS bucket_start,
        {', '.join(f"count(DISTINCT CASE WHEN ip_version = {v} THEN {c} END) AS {k}_ipv{v}" for v in (4, 6) for k, c in (('source', 'src_ip'), ('destination', 'dst_ip')))}
        FROM flows GROUP BY ALL"""))(
    lambda s, d: serving.unique_by_family(serving.window(S.address_counts(src.from_events(s, d), "1h")), "unique_address_count", "address_side", ("source", "destination"))
)
register("api_protocol_stats", _with(more=f"""SELECT source_id, {_floor('1h')} AS bucket_start, count(DISTINCT CASE WHEN ip_version = 4 THEN protocol END) AS ipv4,
        count(DISTINCT CASE WHEN ip_version = 6 THEN protocol END) AS ipv6 FROM flows GROUP BY ALL"""))(
    lambda s, d: serving.unique_by_family(serving.window(S.protocols(src.from_events(s, d), "1h")), "unique_protocols_count")
)


def inputs(s, d, g: str = "1d") -> DataFrame:
    """Provenance of buckets: one input a source and bucket, the status by the bucket's start."""
    days = S.bucketed(src.from_events(s, d), g).select("source_id", "bucket_start").distinct()
    status = F.when((F.col("bucket_start") / 3600).cast("long") % 7 == 0, "pending").otherwise("processed")
    return days.select("*", F.concat_ws("/", F.lit("csv"), "source_id", F.col("bucket_start").cast("string")).alias("locator"), status.alias("status"))


def addresses(s, d, g: str = "1d") -> DataFrame:
    return S.bucketed(src.from_events(s, d), g).where("ip_version = 4").select("source_id", "bucket_start", F.col("src_u32").alias("a")).distinct()


KEYS = ["source_id", "bucket_start"]


def day_counts(s, d) -> DataFrame:
    return structure.prefix_counts(addresses(s, d), KEYS)


def day_structure(s, d) -> DataFrame:
    return structure.structure_of(structure.measured(addresses(s, d), KEYS), KEYS, zeros=False)


def day_dimensions(s, d) -> DataFrame:
    return structure.dimensions_of(structure.measured(addresses(s, d), KEYS), KEYS, zeros=False)


_IN = f"""inputs AS (SELECT source_id, bucket_start, 'csv/' || source_id || '/' || bucket_start AS locator,
        CASE WHEN (bucket_start // 3600) % 7 = 0 THEN 'pending' ELSE 'processed' END AS status FROM (SELECT DISTINCT source_id,
        {_floor('1d')} AS bucket_start FROM flows))"""
_PC = f""", sets AS (SELECT DISTINCT source_id, {_floor('1d')} AS bucket_start, src_u32 AS a FROM flows WHERE ip_version = 4),
    pc AS (SELECT source_id, bucket_start, len, a // cast(pow(2, 32 - len) AS BIGINT) AS prefix, count(*) AS n FROM sets, (SELECT unnest(range(33)) AS len) GROUP BY ALL),
    pb AS (SELECT * FROM (SELECT source_id, bucket_start, min(len) FILTER (WHERE len >= 1 AND n = 1) AS lo, min(len) FILTER (WHERE len >= 1 AND n / pow(2.0, 32 - len) >= 0.95) AS hi, max(n) FILTER (WHERE len = 0) AS total FROM pc GROUP BY ALL) WHERE total >= 2 AND lo IS NOT NULL AND hi >= lo)"""
_ST = _PC + """, split AS (SELECT p.source_id, p.bucket_start, p.lo, p.hi, p.len, p.prefix, p.n, c.n AS m FROM (SELECT * FROM pc JOIN pb USING (source_id, bucket_start) WHERE n > 1 AND len BETWEEN lo AND hi) p
        JOIN pc c ON c.source_id = p.source_id AND c.bucket_start = p.bucket_start AND c.len = p.len + 1 AND c.prefix // 2 = p.prefix),
    per AS (SELECT source_id, bucket_start, lo, hi, len, q8, prefix, pow(cast(n AS DOUBLE), q8 / 8.0) AS x, sum(pow(cast(m AS DOUBLE), q8 / 8.0)) AS y FROM split, (SELECT unnest(range(-4, 29)) AS q8) GROUP BY source_id, bucket_start, lo, hi, len, q8, prefix, n),
    mo AS (SELECT source_id, bucket_start, lo, hi, len, q8, log2(sum(x)) - log2(sum(y)) AS tau, greatest(sum(x * x) / (sum(x) * sum(x)) - 2 * sum(x * y) / (sum(x) * sum(y)) + sum(y * y) / (sum(y) * sum(y)), 0) AS d2 FROM per GROUP BY ALL),
    st AS (SELECT source_id, bucket_start, q8, sum(tau) / (hi - lo + 1) AS tau, sqrt(sum(d2) / (hi - lo + 1)) AS sd FROM mo GROUP BY source_id, bucket_start, q8, lo, hi)"""
register("maad_prefix_counts", _with(more=_PC + " SELECT * FROM pc"))(day_counts)
register("maad_prefix_bounds", _with(more=_PC + " SELECT * FROM pb"))(lambda s, d: structure.bounds_of(structure.measured(addresses(s, d), KEYS), KEYS))
register("maad_structure", _with(more=_ST + " SELECT source_id, bucket_start, q8, round(tau, 5) AS tau, round(sd, 4) AS sd FROM st"))(
    lambda s, d: day_structure(s, d).select(*KEYS, "q8", F.round("tau", 5).alias("tau"), F.round("sd", 4).alias("sd"))
)
_SP = """, al AS (SELECT *, (lead(tau) OVER w - lag(tau) OVER w) / 0.25 AS alpha FROM st WINDOW w AS (PARTITION BY source_id, bucket_start ORDER BY q8)),
    de AS (SELECT *, lag(alpha) OVER w - alpha > 1e-9 AS dec FROM al WHERE alpha IS NOT NULL WINDOW w AS (PARTITION BY source_id, bucket_start ORDER BY q8)),
    se AS (SELECT *, count(*) FILTER (WHERE dec) OVER w AS seen FROM de WINDOW w AS (PARTITION BY source_id, bucket_start ORDER BY q8)),
    sx AS (SELECT *, count(*) FILTER (WHERE NOT coalesce(dec, false) AND seen > 0) OVER w AS stop FROM se WINDOW w AS (PARTITION BY source_id, bucket_start ORDER BY q8))"""
register("maad_spectrum", _with(more=_ST + _SP + """ SELECT source_id, bucket_start, q8, round(alpha, 4) AS alpha, round(q8 / 8.0 * alpha - tau, 4) AS f FROM sx
        WHERE dec AND stop = 0"""))(
    lambda s, d: structure.spectrum(day_structure(s, d), KEYS).select(*KEYS, "q8", F.round("alpha", 4).alias("alpha"), F.round("f", 4).alias("f"))
)
register("maad_dimensions", _with(more=_ST + """, en AS (SELECT source_id, bucket_start, len, sum(n / total * log2(n / total)) AS h FROM (SELECT source_id, bucket_start, len, cast(n AS DOUBLE) AS n, total FROM pc JOIN pb USING (source_id, bucket_start) WHERE len BETWEEN lo AND hi) GROUP BY ALL)
    SELECT source_id, bucket_start, 1 AS q, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(h, -len) END, 5) AS dim FROM en GROUP BY ALL
    UNION ALL SELECT source_id, bucket_start, q8 // 8, round(tau / (q8 / 8.0 - 1), 5) FROM st WHERE q8 IN (0, 16)"""))(
    lambda s, d: day_dimensions(s, d).select(*KEYS, "q", F.round("dim", 5).alias("dim"))
)


def details(s, d):
    flows = src.from_events(s, d)
    return serving.file_details(S.traffic(flows, "1d"), inputs(s, d), S.address_counts(flows, "1d"), day_structure(s, d))


register("file_details_join", _with(more=_ST + f""", {_IN},
    ns AS (SELECT source_id, {_floor('1d')} AS bucket_start, cast(sum(flow_count) AS BIGINT) AS flows, cast(sum(packets) AS BIGINT) AS packets, cast(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY ALL),
    pv AS (SELECT source_id, bucket_start, min(locator) AS first_locator, max(status) AS status, count(*) AS n_inputs FROM inputs GROUP BY ALL),
    ip AS (SELECT source_id, {_floor('1d')} AS bucket_start, {', '.join(f"count(DISTINCT CASE WHEN ip_version = {v} THEN {c} END) AS {k}_ipv{v}" for v in (4, 6) for k, c in (('source', 'src_ip'), ('destination', 'dst_ip')))} FROM flows GROUP BY ALL),
    pt AS (SELECT source_id, bucket_start, count(*) AS n_points, min(q8) AS q8_min, max(q8) AS q8_max FROM st GROUP BY ALL)
    SELECT * FROM ns LEFT JOIN pv USING (source_id, bucket_start) LEFT JOIN ip USING (source_id, bucket_start) LEFT JOIN pt USING (source_id, bucket_start)"""))(details)


def parity(s, d):
    """Every seventh hour of the coarse table is off by one flow, so that the check has something to find."""
    five = S.traffic(src.from_events(s, d))
    coarse = S.roll_up(five, "1h").withColumn("flows", F.col("flows") + F.when((F.col("bucket_start") / 3600).cast("long") % 7 == 0, 1).otherwise(0))
    return serving.rollup_parity(five, coarse, "1h")


register("rollup_parity", _traffic("1h") + """
    , a AS (SELECT source_id, ip_version, src_visibility, dst_visibility, bucket_start, flows, packets, bytes FROM t WHERE (bucket_start // 3600) % 7 = 0)
    SELECT *, 'expected' AS side FROM a UNION ALL SELECT * REPLACE (flows + 1 AS flows), 'actual' FROM a""")(parity)
register("incomplete_scans", _with(more=f", {_IN} SELECT * FROM inputs WHERE status = 'pending'"))(
    lambda s, d: serving.incomplete_scans(inputs(s, d), inputs(s, d).where("status = 'processed'").select("locator")))
register("raw_ip_leak_scan", _with(more=r"SELECT column_name, cast(sum(cast(regexp_matches(v, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') AS INT)) AS BIGINT) AS n_leaks FROM (SELECT 'source_id' AS column_name, source_id AS v FROM flows UNION ALL SELECT 'src_ip', src_ip FROM flows UNION ALL SELECT 'dst_ip', dst_ip FROM flows) GROUP BY ALL"))(
    lambda s, d: serving.raw_addresses(src.from_events(s, d), ["source_id", "src_ip", "dst_ip"])
)
register("late_rows", _with(more=f""", r AS (SELECT source_id, (k % 97) * 1099511627776 + k // 97 AS row_no, {_floor('5m')} AS b FROM flows),
        w AS (SELECT *, max(b) OVER p - 3600 AS cut, min(b) OVER p AS low FROM r WINDOW p AS (PARTITION BY source_id
        ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT source_id, row_no, b AS bucket_start FROM w
        WHERE cut > low AND b < cut"""))(
    lambda s, d: S.late_rows(s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("r"), (F.col("user_id") % 3 + 1).cast("string")).alias("source_id"), F.expr("(event_id % 97) * 1099511627776 + event_id div 97").alias("row_no"), C.floor_to(C.epoch_of("ts"), 300).alias("bucket_start")), block_rows=64)
)
register("missing_ranges", _with(more=f""", c AS (SELECT DISTINCT source_id, {_floor('5m')} AS s FROM flows), g AS (SELECT source_id,
        lag(s) OVER (PARTITION BY source_id ORDER BY s) + 300 AS gap_start, s AS gap_end FROM c) SELECT * FROM g
        WHERE gap_end > gap_start"""))(
    lambda s, d: S.missing_ranges(S.bucketed(src.from_events(s, d), "5m").select("source_id", F.col("bucket_start").alias("start"), (F.col("bucket_start") + 300).alias("end")).distinct())
)
register("series_pivot", _with(more=f"SELECT {_floor('1d')} AS bucket_start, " + ", ".join(f"cast(sum(CASE WHEN source_id = 'r{k}' THEN bytes END) AS BIGINT) AS r{k}" for k in (1, 2, 3)) + " FROM flows GROUP BY ALL"))(
    lambda s, d: S.bucketed(src.from_events(s, d), "1d").groupBy("bucket_start").pivot("source_id", ["r1", "r2", "r3"]).agg(F.sum("bytes"))
)
register("extract_summary", "".join((_traffic("1h"), """, x AS (SELECT * FROM t WHERE bucket_start >= 1704441600 AND bucket_start < 1705046400 AND source_id = 'r1')
        SELECT 'traffic_stats' AS table_name, count(*) AS n_rows, min(bucket_start) AS first, max(bucket_start) AS last FROM x""")))(
    lambda s, d: serving.summary({"traffic_stats": S.traffic(src.from_events(s, d), "1h").where("bucket_start >= 1704441600 and bucket_start < 1705046400 and source_id = 'r1'")})
)


def owned(s, d) -> DataFrame:
    return S.bucketed(src.from_events(s, d), "1h").select(*KEYS, F.concat(F.lit("f"), F.col("flow_count").cast("string")).alias("locator"))


register("overlapping_owners", _with(more=f"""SELECT source_id, {_floor('1h')} AS bucket_start, count(DISTINCT flow_count) AS owners FROM flows GROUP BY ALL
        HAVING count(DISTINCT flow_count) > 1"""))(lambda s, d: guards.overlapping_owners(owned(s, d)))
register("backward_files", _with(more=f""", f AS (SELECT source_id, 'f' || flow_count AS path, min({_floor('1h')}) AS first, max({_floor('1h')}) AS last
        FROM flows GROUP BY ALL), r AS (SELECT source_id, path, first, max(last) OVER (PARTITION BY source_id
        ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM f) SELECT * FROM r
        WHERE first < reached"""))(
    lambda s, d: guards.backward_files(owned(s, d).groupBy("source_id", F.col("locator").alias("path")).agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last")))
)
register("inferred_members", _with(more="SELECT DISTINCT source_id, 'f' || flow_count AS member_id FROM flows"))(
    lambda s, d: guards.inferred_members(owned(s, d).select("source_id", F.concat(F.lit("/captures/"), "locator", F.lit("/2024/01/02/nfcapd.202401020000")).alias("locator")))
)


def identities(s, d):
    """Every fifth hour has a TCP flow too many, so that the check has something to find."""
    extra = F.when((F.col("bucket_start") / 3600).cast("long") % 5 == 0, 1).otherwise(0)
    return guards.broken_identities(S.traffic(src.from_events(s, d), "1h").withColumn("flows_tcp", F.col("flows_tcp") + extra))


register("broken_identities", _traffic("1h") + """ SELECT source_id, granularity, bucket_start, ip_version, src_visibility, dst_visibility, 'flows' AS metric FROM t
        WHERE (bucket_start // 3600) % 5 = 0""")(identities)


def spectra(s, d) -> DataFrame:
    return structure.spectrum(day_structure(s, d), KEYS).select(*KEYS, "q8", F.round("alpha", 4).alias("alpha"), F.round("f", 4).alias("f"))


_PTS = _ST + _SP + """, pts AS (SELECT source_id, bucket_start, q8, round(alpha, 4) AS alpha, round(q8 / 8.0 * alpha - tau, 4) AS f FROM sx
        WHERE dec AND stop = 0)"""
register("spectrum_heat_points", _with(more=_PTS + """ SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY bucket_start) - 1 AS time_index,
        min(alpha) OVER s AS alpha_min, max(alpha) OVER s AS alpha_max, min(f) OVER s AS f_min, max(f) OVER s AS f_max FROM pts
        WINDOW s AS (PARTITION BY source_id)"""))(
    lambda s, d: serving.heat_points(spectra(s, d))
)
register("verification_window", _with(more=_PTS + f""" SELECT source_id, min(bucket_start) AS bucket_start FROM (SELECT DISTINCT source_id, {_floor('1d')} AS bucket_start
        FROM flows) SEMI JOIN st USING (source_id, bucket_start) SEMI JOIN pts USING (source_id, bucket_start) GROUP BY ALL"""))(
    lambda s, d: serving.verification_windows(S.traffic(src.from_events(s, d), "1d"), day_structure(s, d), spectra(s, d))
)


def scanned(s, d) -> DataFrame:
    """Inputs under scans of two days; every eleventh day is of an older revision."""
    scan = F.concat_ws("/", "source_id", F.expr("cast(bucket_start div 172800 as string)"))
    return inputs(s, d).select(scan.alias("scan_locator"), "status", F.when(F.expr("bucket_start div 86400 % 11 = 0"), 0).otherwise(1).alias("revision"))


register("scan_fully_processed", _with(more=f""", {_IN}, i AS (SELECT source_id || '/' || (bucket_start // 172800) AS scan_locator, status,
        CASE WHEN (bucket_start // 86400) % 11 = 0 THEN 0 ELSE 1 END AS revision FROM inputs) SELECT *
        FROM (SELECT DISTINCT scan_locator, 1 AS revision FROM i) c WHERE NOT EXISTS (SELECT 1 FROM i
        WHERE i.scan_locator = c.scan_locator AND (i.status <> 'processed' OR i.revision <> c.revision))"""))(
    lambda s, d: serving.fully_processed(scanned(s, d).select("scan_locator", F.lit(1).alias("revision")).distinct(), scanned(s, d))
)


#: The address structure whole: both sides, five pairs of visibilities, four granularities, sets without points too.
SETS = list(S.SET_KEY)
_SETS = ", ".join(SETS)


def _structures(g: str, upto: str = "ds") -> str:
    """With scoped, the tables of the structure at one granularity, up to the one that a query needs; k names a set by its key.
    grid has all sets, spans those with addresses."""
    steps = (
        f"""cal AS (SELECT DISTINCT source_id, {_floor(g, "t")} AS bucket_start
        FROM (SELECT source_id, unnest(generate_series(min({_floor("5m")}), max({_floor("5m")}), 300)) AS t
        FROM flows GROUP BY source_id))""",
        f"""pairs AS (SELECT source_id, '{g}' AS granularity, bucket_start, src_visibility, dst_visibility, pair
        FROM cal
        CROSS
        JOIN (VALUES ('all','all',0),('literal','literal',1),('literal','anonymized',2),('anonymized','literal',3),('anonymized','anonymized',4)) p(src_visibility, dst_visibility, pair))""",
        f"""grid AS (SELECT * EXCLUDE (pair, side), ((bucket_start * 8 + cast(substr(source_id, 2) AS BIGINT)) * 8 + pair) * 2 + side AS k
        FROM pairs
        CROSS
        JOIN (VALUES ('source', 0), ('destination', 1)) s(address_side, side))""",
        f"""ends AS (SELECT source_id, {_floor(g)} AS bucket_start, src_visibility, dst_visibility, src_u32, dst_u32 FROM scoped WHERE ip_version = 4)""",
        f"""sets AS (SELECT DISTINCT g.k, e.a
        FROM (SELECT * EXCLUDE (src_u32, dst_u32), 'source' AS address_side, src_u32 AS a
        FROM ends
        UNION ALL SELECT * EXCLUDE (src_u32, dst_u32), 'destination', dst_u32
        FROM ends) e
        JOIN grid g USING (source_id, bucket_start, src_visibility, dst_visibility, address_side))""",
        f"""pc AS (SELECT k, len, a // cast(pow(2, 32 - len) AS BIGINT) AS prefix, count(*) AS n FROM sets, (SELECT unnest(range(33)) AS len) GROUP BY ALL)""",
        f"""spans AS (SELECT k, min(len) FILTER (WHERE len >= 1 AND n = 1) AS lo, min(len) FILTER (WHERE len >= 1 AND n / pow(2.0, 32 - len) >= 0.95) AS hi, max(n) FILTER (WHERE len = 0) AS total
        FROM pc GROUP BY ALL)""",
        f"""pb AS (SELECT * FROM spans WHERE total >= 2 AND lo IS NOT NULL AND hi >= lo)""",
        f"""split AS (SELECT p.*, c.n AS m
        FROM (SELECT *
        FROM pc
        JOIN pb USING (k) WHERE n > 1 AND len BETWEEN lo AND hi) p
        JOIN pc c ON c.k = p.k AND c.len = p.len + 1 AND c.prefix // 2 = p.prefix)""",
        f"""qs AS (SELECT unnest(range(-4, 29)) AS q8)""",
        f"""per AS (SELECT k, lo, hi, len, q8, prefix, pow(cast(n AS DOUBLE), q8 / 8.0) AS x, sum(pow(cast(m AS DOUBLE), q8 / 8.0)) AS y
        FROM split, qs GROUP BY k, lo, hi, len, q8, prefix, n)""",
        f"""mo AS (SELECT k, lo, hi, len, q8, log2(sum(x)) - log2(sum(y)) AS tau, greatest(sum(x * x) / (sum(x) * sum(x)) - 2 * sum(x * y) / (sum(x) * sum(y)) + sum(y * y) / (sum(y) * sum(y)), 0) AS d2
        FROM per GROUP BY ALL)""",
        f"""ss AS (SELECT k, q8, sum(tau) / (hi - lo + 1) AS tau, sqrt(sum(d2) / (hi - lo + 1)) AS sd FROM mo GROUP BY k, q8, lo, hi)""",
        f"""st AS (SELECT k, q8, coalesce(tau, 0) AS tau, coalesce(sd, 0) AS sd FROM (SELECT k, q8 FROM pb, qs) LEFT JOIN ss USING (k, q8))""",
        f"""al AS (SELECT *, (lead(tau) OVER w - lag(tau) OVER w) / 0.25 AS alpha FROM st WINDOW w AS (PARTITION BY k ORDER BY q8))""",
        f"""de AS (SELECT *, lag(alpha) OVER w - alpha > 1e-9 AS dec FROM al WHERE alpha IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY q8))""",
        f"""se AS (SELECT *, count(*) FILTER (WHERE dec) OVER w AS seen FROM de WINDOW w AS (PARTITION BY k ORDER BY q8))""",
        f"""sx AS (SELECT *, count(*) FILTER (WHERE NOT coalesce(dec, false) AND seen > 0) OVER w AS stop FROM se WINDOW w AS (PARTITION BY k ORDER BY q8))""",
        f"""sp AS (SELECT k, q8, alpha, q8 / 8.0 * alpha - tau AS f FROM sx WHERE dec AND stop = 0)""",
        f"""en AS (SELECT k, len, sum(n / total * log2(n / total)) AS h
        FROM (SELECT k, len, cast(n AS DOUBLE) AS n, total
        FROM pc
        JOIN pb USING (k) WHERE len BETWEEN lo AND hi) GROUP BY ALL)""",
        f"""di AS (SELECT k, 1 AS q, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(h, -len) END AS dim
        FROM en GROUP BY k
        UNION ALL SELECT k, q8 // 8, tau / (q8 / 8.0 - 1)
        FROM st WHERE q8 IN (0, 16))""",
        f"""kinds AS (SELECT k, 'structure' AS structure_kind, q8 AS place, printf('{{"q": %.3f, "sd": %.6f, "tauTilde": %.8f}}', q8 / 8.0, round(sd, 6) + 0.0, round(tau, 8) + 0.0) AS v
        FROM st
       
        UNION ALL SELECT k, 'spectrum', q8, printf('{{"alpha": %.8f, "f": %.8f}}', round(alpha, 8) + 0.0, round(f, 8) + 0.0)
        FROM sp
       
        UNION ALL SELECT k, 'dimension', (q + 2) % 3, printf('{{"dim": %.8f, "q": %.1f}}', round(dim, 8) + 0.0, cast(q AS DOUBLE))
        FROM di)""",
        f"""js AS (SELECT k, structure_kind, string_agg(v, ', ' ORDER BY place) AS v FROM kinds GROUP BY ALL)""",
        f"""ds AS (SELECT {_SETS}, structure_kind, '[' || coalesce(v, '') || ']' AS values_json,
            '{{"input": "-", "maxPrefixLength": ' || CASE WHEN total >= 2 AND hi >= lo THEN cast(hi AS VARCHAR) ELSE 'null' END || ', "minPrefixLength": ' || CASE WHEN total >= 2 AND hi >= lo THEN cast(lo AS VARCHAR) ELSE 'null' END || ', "totalAddrs": ' || coalesce(total, 0) || '}}' AS metadata_json
       
        FROM grid
        CROSS
        JOIN (VALUES ('structure'), ('spectrum'), ('dimension')) n(structure_kind)
        LEFT
        JOIN spans USING (k)
        LEFT
        JOIN js USING (k, structure_kind))""",
    )
    last = next(k for k, x in enumerate(steps) if x.startswith(f"{upto} "))
    return ",\n    ".join(("", *steps[: last + 1]))


def measured_sets(s, d, g: str) -> DataFrame:
    return S.named(structure.measured(S.coded_sets(src.from_events(s, d), g), list(S.CODED_KEY)), g)


def side_counts(s, d, g: str) -> DataFrame:
    return S.named(structure.prefix_counts(S.coded_sets(src.from_events(s, d), g), list(S.CODED_KEY)), g)


def side_spectra(s, d, g: str) -> DataFrame:
    """Spectrum points, from a stored table of one row a set, as they are read several times."""
    return structure.spectrum_of(scratch.kept(measured_sets(s, d, g)), SETS).select(*SETS, "q8", F.round("alpha", 4).alias("alpha"), F.round("f", 4).alias("f"))


def address_structure(s, d, g: str) -> DataFrame:
    sides = s.createDataFrame([(k,) for k in S.SIDES], "address_side string")
    return structure.texts(measured_sets(s, d, g), S.pairs_grid(src.from_events(s, d), g).crossJoin(F.broadcast(sides)), SETS)  # two rows


def details_by_side(s, d, g: str) -> DataFrame:
    flows = src.from_events(s, d)
    return serving.file_details_by_side(S.pairs_grid(flows, g), S.traffic(flows, g), inputs(s, d, g), S.address_counts(flows, g), address_structure(s, d, g))


def verification_window(s, d, g: str) -> DataFrame:
    """The first bucket of each series that has traffic, structure and spectrum."""
    traffic = S.traffic(src.from_events(s, d), g).select(*SETS[:-1]).distinct()
    found = scratch.kept(measured_sets(s, d, g).where("size(points) > 0 and size(spectrum) > 0").select(*SETS))  # keys alone go on
    whole = found.join(traffic, SETS[:-1], "left_semi")
    return whole.groupBy(*_SERIES).agg(F.min("bucket_start").alias("bucket_start"))


_SERIES = [c for c in SETS if c != "bucket_start"]
_BY = ", ".join(_SERIES)


for _g in C.GRANULARITIES:
    register(f"address_prefix_counts_{_g}", _with(more=_structures(_g, "pc") + f" SELECT {_SETS}, len, prefix, n FROM pc JOIN grid USING (k)"))(
    lambda s, d, g=_g: side_counts(s, d, g))
    register(f"address_prefix_bounds_{_g}", _with(more=_structures(_g, "pb") + f" SELECT {_SETS}, lo, hi, total FROM pb JOIN grid USING (k)"))(
    lambda s, d, g=_g: structure.bounds_of(measured_sets(s, d, g), SETS))
    _q = _structures(_g)
    register(f"address_structure_{_g}", _with(more=_q + " SELECT * FROM ds"))(lambda s, d, g=_g: address_structure(s, d, g))
    _s = _structures(_g, "sp")
    register(f"address_heat_points_{_g}", _with(more=_s + f""", pts AS (SELECT {_SETS}, q8, round(alpha, 4) AS alpha, round(f, 4) AS f FROM sp JOIN grid USING (k)) SELECT *,
        dense_rank() OVER (s ORDER BY bucket_start) - 1 AS time_index, min(alpha) OVER s AS alpha_min,
        max(alpha) OVER s AS alpha_max, min(f) OVER s AS f_min, max(f) OVER s AS f_max FROM pts
        WINDOW s AS (PARTITION BY {_BY})"""))(
        lambda s, d, g=_g: serving.heat_points(side_spectra(s, d, g), tuple(_SERIES))
    )
    register(f"address_verification_window_{_g}", _with(more=_s + f""", tv AS (SELECT DISTINCT source_id, {_floor(_g)} AS bucket_start, src_visibility, dst_visibility FROM scoped)
        SELECT {_BY}, min(bucket_start) AS bucket_start FROM grid JOIN tv USING (source_id, bucket_start, src_visibility, dst_visibility)
        WHERE k IN (SELECT k FROM st) AND k IN (SELECT k FROM sp) GROUP BY ALL"""))(
        lambda s, d, g=_g: verification_window(s, d, g))
    register(f"file_details_sides_{_g}", _with(more=_q + f""",
        tr AS (SELECT source_id, {_floor(_g)} AS bucket_start, src_visibility, dst_visibility, {_SUMS}, {', '.join(f"count(DISTINCT CASE WHEN ip_version = {v} THEN {c} END) AS {n}_ipv{v}" for v in (4, 6) for n, c in (('source', 'src_ip'), ('destination', 'dst_ip')))} FROM scoped GROUP BY ALL),
        inp AS (SELECT DISTINCT source_id, {_floor(_g)} AS bucket_start FROM flows),
        js2 AS (SELECT source_id, bucket_start, src_visibility, dst_visibility, {', '.join(f"max(CASE WHEN structure_kind = '{n}' AND address_side = '{a}' THEN values_json END) AS {n}_{a}" for n in ('structure', 'spectrum') for a in ('source', 'destination'))} FROM ds GROUP BY ALL)
        SELECT source_id, bucket_start, src_visibility, dst_visibility, {', '.join(f"coalesce({c}, 0) AS {c}" for c in (*S.COUNTERS[:15], 'source_ipv4', 'destination_ipv4', 'source_ipv6', 'destination_ipv6'))},
            CASE WHEN i.source_id IS NOT NULL THEN 'csv/' || source_id || '/' || bucket_start END AS first_locator, CASE WHEN i.source_id IS NOT NULL THEN CASE WHEN (bucket_start // 3600) % 7 = 0 THEN 'pending' ELSE 'processed' END END AS status, CASE WHEN i.source_id IS NOT NULL THEN 1 END AS n_inputs,
            structure_source, structure_destination, spectrum_source, spectrum_destination
        FROM pairs LEFT JOIN tr USING (source_id, bucket_start, src_visibility, dst_visibility) LEFT JOIN inp i USING (source_id, bucket_start) LEFT JOIN js2 USING (source_id, bucket_start, src_visibility, dst_visibility)"""))(
    lambda s, d, g=_g: details_by_side(s, d, g))
