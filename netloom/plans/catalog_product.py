"""Registered queries of what is stored and merged: sets of distinct values, the commit log, incremental runs; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C
from netloom.operators import constraints, mergeable
from netloom.operators import statistics as S
from netloom.plans import commits, incremental, scratch, window_cache
from netloom.plans.catalog import BASE, ORACLES, _floor, _traffic, _with, dense_1h, register, rounded
from netloom.sources import flows as src
from netloom.streaming import ingest


def stored_sets(s, d) -> DataFrame:
    """The 5-minute sets of all events as a stored table; what is merged from it reads no flow."""
    path = scratch.folder(s)
    mergeable.sets(src.from_events(s, d)).write.parquet(path)
    return s.read.parquet(path)


def coarse(s, d, granularity: str) -> DataFrame:
    return mergeable.with_all(mergeable.merged(stored_sets(s, d), granularity))


register("merged_ports_1d", ORACLES["port_counts_1d"])(lambda s, d: mergeable.port_counts(coarse(s, d, "1d")))
register("merged_addresses_1d", ORACLES["address_counts_1d"])(lambda s, d: mergeable.address_counts(coarse(s, d, "1d")))
register("merged_protocols_1h", _with(more=f""", d AS (SELECT DISTINCT source_id, '1h' AS granularity, {_floor('1h')} AS bucket_start, ip_version, src_visibility, dst_visibility, protocol FROM scoped)
        SELECT source_id, granularity, bucket_start, ip_version, src_visibility, dst_visibility, count(*) AS unique_protocols_count,
        string_agg(cast(protocol AS VARCHAR), ',' ORDER BY cast(protocol AS VARCHAR)) AS protocols_list FROM d GROUP BY ALL"""))(
    lambda s, d: mergeable.protocols(coarse(s, d, "1h")))
register("merged_address_members_1d", _with(more=f"""SELECT DISTINCT source_id, '1d' AS granularity, {_floor('1d')} AS bucket_start, src_visibility, dst_visibility, address_side, a
        FROM (SELECT *, 'source' AS address_side, src_u32 AS a FROM scoped UNION ALL SELECT *, 'destination', dst_u32 FROM scoped) WHERE ip_version = 4"""))(
    lambda s, d: mergeable.address_sets(coarse(s, d, "1d")))


#: A local midnight within the events.
CUT = 1705305600
_DAY = f"strftime(timezone('{C.TIMEZONE}', to_timestamp(bucket_start)), '%Y-%m-%d')"


def reopened(s, d) -> DataFrame:
    """Sets of two runs: the first commits those of half of the flows, the second opens the days from CUT on again, merges
    the other half's sets into the stored ones and replaces these days."""
    log, flows = commits.Log(s, scratch.folder(s)), src.from_events(s, d, "k")
    log.commit({"sets": mergeable.sets(flows.where("k % 2 = 0"))}, -1)
    late = scratch.kept(mergeable.sets(flows.where(f"k % 2 = 1 and end_s >= {CUT}")))
    days = commits.partitioned(late).select("source_id", "day")
    log.commit({"sets": mergeable.merged(log.read("sets", within=days).select(*late.columns).unionByName(late), "5m")}, 0)
    return mergeable.with_all(mergeable.merged(log.read("sets").select(*late.columns), "1d"))


_HALF = f"(SELECT * FROM scoped WHERE k % 2 = 0 OR end_s >= {CUT})"
register("reopened_days_ports_1d", ORACLES["port_counts_1d"].replace("FROM scoped", f"FROM {_HALF}"))(
    lambda s, d: mergeable.port_counts(reopened(s, d)))
register("reopened_days_addresses_1d", ORACLES["address_counts_1d"].replace("FROM scoped", f"FROM {_HALF}"))(
    lambda s, d: mergeable.address_counts(reopened(s, d)))


def history(s, d) -> commits.Log:
    """Hourly traffic; then the days of one source from CUT on with other counts; then another source's days before it are dropped."""
    log = commits.Log(s, scratch.folder(s))
    hours = scratch.kept(S.traffic(src.from_events(s, d), "1h").select(*S.KEY, "flows"))
    log.commit({"traffic": hours}, -1)
    log.commit({"traffic": hours.where(f"source_id = 'r1' and bucket_start >= {CUT}").withColumn("flows", F.col("flows") * 10)}, 0)
    old = commits.partitioned(hours.where(f"source_id = 'r2' and bucket_start < {CUT}")).select("granularity", "source_id", "day").distinct()
    log.commit({}, 1, old.withColumn("table_name", F.lit("traffic")))
    return log


_HOURS = _traffic("1h") + f""", h AS (SELECT source_id, granularity, bucket_start, ip_version, src_visibility, dst_visibility,
        CASE WHEN source_id = 'r1' AND bucket_start >= {CUT} THEN flows * 10 ELSE flows END AS flows,
        CASE WHEN source_id = 'r1' AND bucket_start >= {CUT} THEN 1 ELSE 0 END::BIGINT AS commit FROM t WHERE source_id <> 'r2' OR bucket_start >= {CUT})"""
register("commit_log_read", _HOURS + " SELECT * EXCLUDE commit FROM h")(lambda s, d: history(s, d).read("traffic").drop("day"))
register("commit_log_read_pinned", _traffic("1h") + " SELECT source_id, granularity, bucket_start, ip_version, src_visibility, dst_visibility, flows FROM t")(
    lambda s, d: history(s, d).read("traffic", 0).drop("day"))
register("commit_log_state", _HOURS + f""" SELECT 'traffic' AS table_name, granularity, source_id, {_DAY} AS day, commit, count(*) AS rows, min(bucket_start) AS first,
        max(bucket_start) AS last FROM h GROUP BY ALL""")(
    lambda s, d: history(s, d).state().drop("writer"))


def file_steps(s, d) -> DataFrame:
    """What a run has to do with a file for each user, of which it knows some, in other states, contents or decoders."""
    u = F.col("u")
    files = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    found = files.select(F.concat(F.lit("f"), u).alias("locator"), F.concat(F.lit("c"), u).alias("revision"), F.lit("d").alias("decoder"))
    status = F.when(u % 3 == 0, "pending").when(u % 5 == 0, "failed").otherwise("processed")
    known = files.where("u % 4 <> 1").select(F.concat(F.lit("f"), u).alias("locator"), F.concat(F.when(u % 7 == 0, "x").otherwise("c"), u).alias("revision"), F.when(u % 11 == 0, "e").otherwise("d").alias("decoder"), status.alias("status"))
    return incremental.transitions(found, known).select("locator", "step")


register("file_transitions", f"""WITH base AS ({BASE}), f AS (SELECT DISTINCT u FROM base)
    SELECT 'f' || u AS locator, CASE WHEN u % 4 = 1 THEN 'new' WHEN u % 3 = 0 OR u % 5 = 0 THEN 'retry' WHEN u % 7 = 0 THEN 'content changed'
        WHEN u % 11 = 0 THEN 'decoder changed' ELSE 'done' END AS step FROM f""")(file_steps)


def grown_bounds(s, d) -> DataFrame:
    """Days that change as each source's bounds grow from the middle of the events to all of them."""
    b = S.bucketed(src.from_events(s, d), "5m").select("source_id", "bucket_start").distinct()
    bounds = lambda df: df.groupBy("source_id").agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))
    late = b.where(f"bucket_start >= {CUT} and bucket_start % 3600 = 0")
    return incremental.changed_days(bounds(b.where(f"bucket_start < {CUT} - 604800 and source_id <> 'r3'")), bounds(late), late)


register("changed_days", _with(more=f""", b AS (SELECT DISTINCT source_id, {_floor('5m')} AS t FROM flows),
        old AS (SELECT source_id, max(t) AS l FROM b WHERE t < {CUT} - 604800 AND source_id <> 'r3' GROUP BY ALL),
        late AS (SELECT * FROM b WHERE t >= {CUT} AND t % 3600 = 0),
        spans AS (SELECT source_id, unnest(generate_series(coalesce(min(l), min(t)), max(t), 300)) AS t FROM late LEFT JOIN old USING (source_id) GROUP BY source_id)
        SELECT DISTINCT source_id, {_floor('1d', 't')} AS start FROM (SELECT * FROM late UNION ALL SELECT * FROM spans)"""))(grown_bounds)


def streamed(s, d, granularity: str) -> commits.Log:
    """All events as a stream of two micro-batches, in which one source is five days behind the others."""
    path, flows = scratch.folder(s), src.from_events(s, d)
    at = F.col("end_s") - F.when(F.col("source_id") == "r3", 0).otherwise(432_000)
    for n, (low, high) in enumerate(((0, CUT), (CUT, 1 << 40))):
        ingest.step(flows.where((at >= low) & (at < high)), n, path, granularities=(granularity,))
    ingest.finish(s, path, granularities=(granularity,))
    return commits.Log(s, path)


register("stream_traffic_1h", ORACLES["dense_fill_1h"])(
    lambda s, d: rounded(streamed(s, d, "1h").read("traffic_stats").where("granularity = '1h'").select(*S.KEY, *S.COUNTERS, *[f"avg_{m}" for m in S.MEASURES])))
register("stream_ports_1d", ORACLES["port_counts_1d"])(
    lambda s, d: streamed(s, d, "1d").read("port_count_stats").where("granularity = '1d' and unique_port_count > 0").drop("bucket_end", "day"))


def faulty_product(s, d) -> dict[str, DataFrame]:
    """Tables by the hour with planted faults: wrong sums, lost scopes, moved buckets, lists and counts that can't be, an address in a text."""
    at = lambda source, n: (F.col("source_id") == source) & (F.col("bucket_start") % (3600 * n) == 0)
    ended = lambda df: df.withColumn("bucket_end", F.col("bucket_start") + 3600)
    if_ = lambda condition, value, c: F.when(condition, value).otherwise(F.col(c))
    flows = src.from_events(s, d)
    traffic = ended(dense_1h(s, d)).where(~(at("r2", 5) & (F.col("ip_version") == 6) & (F.col("src_visibility") == "literal")))
    traffic = traffic.withColumns({
        "flows_tcp": if_(at("r1", 7), F.col("flows_tcp") + 1, "flows_tcp"), "duration_count": if_(at("r1", 11), F.col("flows") + 1, "duration_count"),
        "min_ttl_sum": if_(at("r3", 9), F.col("min_ttl_count") * 256, "min_ttl_sum"), "bucket_start": if_(at("r2", 13), F.col("bucket_start") + 60, "bucket_start"),
    })
    protocols = S.protocols(flows, "1h").withColumn("protocols_list", if_(at("r1", 3), F.concat("protocols_list", F.lit(",300")), "protocols_list"))
    many = at("r2", 4) & (F.col("src_visibility") == "literal") & (F.col("dst_visibility") == "literal")
    addresses = S.address_counts(flows, "1h").withColumn("unique_address_count", if_(many, F.lit(1 << 40), "unique_address_count"))
    ports = S.port_counts(flows, "1h").withColumn("source_id", if_(F.col("source_id") == "r3", "r3@10.1.2.3", "source_id"))
    return {
        "traffic_stats": traffic, "protocol_stats": ended(protocols), "address_count_stats": ended(addresses).withColumn("src_ip", F.lit("-")),
        "port_count_stats": ended(ports).drop("bucket_end"), "ip_stats_v2": flows.select("end_s").limit(0),
    }


def constraint_report(s, d) -> DataFrame:
    dense, sparse = constraints.product_rules(), constraints.product_rules(dense=False)
    return constraints.report(faulty_product(s, d), {n: dense[n] if n in ("traffic_stats", "address_structure_stats") else sparse[n] for n in dense})


def _constraint_sql() -> str:
    """Each constraint as a condition of its own, counted over the tables by the hour as the faults leave them."""
    at = lambda source, n: f"(source_id = '{source}' AND bucket_start % {3600 * n} = 0)"
    whole = "src_visibility = 'all' AND dst_visibility = 'all'"
    changed = {
        "flows_tcp": f"flows_tcp + CASE WHEN {at('r1', 7)} THEN 1 ELSE 0 END", "duration_count": f"CASE WHEN {at('r1', 11)} THEN flows + 1 ELSE duration_count END",
        "min_ttl_sum": f"CASE WHEN {at('r3', 9)} THEN min_ttl_count * 256 ELSE min_ttl_sum END", "bucket_start": f"bucket_start + CASE WHEN {at('r2', 13)} THEN 60 ELSE 0 END",
    }
    tables = {
        "traffic_stats": f"SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in changed.items())}) FROM ({ORACLES['dense_fill_1h']}) WHERE NOT ({at('r2', 5)} AND ip_version = 6 AND src_visibility = 'literal')",
        "protocol_stats": f"SELECT * REPLACE (protocols_list || CASE WHEN {at('r1', 3)} THEN ',300' ELSE '' END AS protocols_list) FROM ({ORACLES['merged_protocols_1h']})",
        "address_count_stats": f"""SELECT * REPLACE (CASE WHEN {at('r2', 4)} AND src_visibility = 'literal' AND dst_visibility = 'literal' THEN 1099511627776 ELSE unique_address_count END AS unique_address_count)
            FROM ({ORACLES['address_counts_1h']})""",
        "port_count_stats": f"SELECT * REPLACE (CASE WHEN source_id = 'r3' THEN 'r3@10.1.2.3' ELSE source_id END AS source_id) FROM ({ORACLES['port_counts_1h']})",
    }
    never = "false"
    moved = "bucket_start % 3600 <> 0"
    texts = {"traffic_stats": (), "protocol_stats": ("protocols_list",), "address_count_stats": ("address_side", "src_ip"), "port_count_stats": ("port_side", "port_range")}
    rows: dict[str, dict[str, str]] = {n: {"scope": never, "bucket_start": never, "bucket_end": "true" if n == "port_count_stats" else never} for n in tables}
    for n, more in texts.items():
        rows[n] |= {f"no address in {c}": never for c in ("source_id", "granularity", "src_visibility", "dst_visibility", *more)}
    t = rows["traffic_stats"]
    t |= {"bucket_start": moved, "bucket_end": never, "not_negative": never}
    t |= {f"{m}_classes": f"{m} <> " + " + ".join(f"{m}_{c}" for c in S.CLASSES) for m in ("flows", "packets", "bytes")}
    for m in S.MEASURES:
        t |= {f"{m}_count": f"{m}_count > flows", f"{m}_sum": f"{m}_count = 0 AND {m}_sum <> 0" if m == "duration" else f"{m}_sum > {m}_count * 255"}
        t[f"avg_{m}"] = f"CASE WHEN {m}_count = 0 THEN avg_{m} IS NOT NULL ELSE coalesce(abs(avg_{m} - {m}_sum / {m}_count) > 0.0001, true) END"
    rows["protocol_stats"] |= {"protocols_count": "unique_protocols_count <> len(string_split(protocols_list, ','))", "protocols_list": "list_contains(string_split(protocols_list, ','), '300')"}
    rows["address_count_stats"] |= {"address_side": never, "not_negative": never}
    rows["port_count_stats"] |= {"port_side": never, "port_count": never, "no address in source_id": "source_id LIKE '%10.1.2.3%'"}
    additive = " OR ".join(f"sum(CASE WHEN ip_version = {v} AND {whole} THEN {c} ELSE 0 END) <> sum(CASE WHEN ip_version = {v} AND src_visibility <> 'all' THEN {c} ELSE 0 END)" for v in (4, 6) for c in S.COUNTERS)
    split = {"protocol_stats": ("unique_protocols_count", ""), "address_count_stats": ("unique_address_count", ", address_side"), "port_count_stats": ("unique_port_count", ", port_side, port_range")}
    text = lambda at: f"source_id || ' ' || granularity || ' ' || {at}"
    made = []
    for n, of in rows.items():
        # the moved buckets' ends are an hour after their old starts, so that each of their rows breaks this too
        of = of | ({"bucket_end": moved} if n == "traffic_stats" else {})
        made += [f"SELECT '{n}' AS table_name, '{rule}' AS rule, count(*) AS checked, count(*) FILTER (WHERE {broken}) AS broken, min(CASE WHEN {broken} THEN {text('bucket_start')} END) AS first_broken FROM {n}" for rule, broken in of.items()]
    for rule, broken in (("scopes", "count(*) <> 10"), ("additive", additive)):
        inner = f"SELECT source_id, granularity, bucket_start, {broken} AS bad FROM traffic_stats GROUP BY ALL"
        made.append(f"SELECT 'traffic_stats', '{rule}', count(*), count(*) FILTER (WHERE bad), min(CASE WHEN bad THEN {text('bucket_start')} END) FROM ({inner.replace('GROUP BY ALL', 'GROUP BY 1, 2, 3')})")
    for n, (c, more) in split.items():
        a, b, z = (f"coalesce({f}(CASE WHEN {w} THEN {c} END), 0)" for f, w in (("max", whole), ("max", "src_visibility <> 'all'"), ("sum", "src_visibility <> 'all'")))
        inner = f"SELECT source_id, granularity, bucket_start, {a} < {b} OR {a} > {z} AS bad FROM {n} GROUP BY source_id, granularity, bucket_start, ip_version{more}"
        inner = f"SELECT source_id, granularity, bucket_start, bool_or(bad) AS bad FROM ({inner}) GROUP BY 1, 2, 3"
        made.append(f"SELECT '{n}', 'distinct', count(*), count(*) FILTER (WHERE bad), min(CASE WHEN bad THEN {text('bucket_start')} END) FROM ({inner})")
    key = ["source_id", "granularity", "bucket_start", "bucket_end", "ip_version", "src_visibility", "dst_visibility"]
    own = {
        "traffic_stats": [*S.COUNTERS, *[f"avg_{m}" for m in S.MEASURES]], "protocol_stats": ["unique_protocols_count", "protocols_list"],
        "address_count_stats": ["address_side", "unique_address_count"], "port_count_stats": ["port_side", "port_range", "unique_port_count"],
    }
    fixed = [(n, f"column {c}", int(n == "port_count_stats" and c == "bucket_end")) for n, cols in own.items() for c in (*key, *cols)]
    fixed += [(n, "table", int(n == "address_structure_stats")) for n in (*own, "address_structure_stats")]
    fixed += [("ip_stats_v2", "old table", 1), ("address_count_stats", "raw address column src_ip", 1), ("traffic_stats", "rows", 0), ("traffic_stats", "coarse_rows", 0)]
    made += [f"SELECT '{n}', '{rule}', 1, {broken}, NULL" for n, rule, broken in fixed]
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in tables.items()) + " " + " UNION ALL ".join(made)


register("product_constraints", _constraint_sql())(constraint_report)


def cached_windows(s, d) -> DataFrame:
    """Hourly traffic of the second of two requests for a source's window, with the reading that each row is of: the second reads what the
    first hasn't. Another source is asked for only then."""
    hours = scratch.kept(S.traffic(src.from_events(s, d), "1h").select(*S.KEY, "flows").drop("granularity"))
    of, nth = window_cache.of_table(hours), []

    def read(ranges: DataFrame) -> DataFrame:
        nth.append(len(nth) + 1)
        return of(ranges).withColumn("reading", F.lit(nth[-1]))

    cache = window_cache.WindowCache(s, scratch.folder(s), read, S.KEY[3:])
    asked = lambda *rows: s.createDataFrame(list(rows), window_cache.RANGES)
    cache.ensure(asked(("r1", CUT - 86_400, CUT), ("r1", CUT - 43_200, CUT + 172_800)))
    return cache.read(asked(("r1", CUT - 259_200, CUT + 259_200), ("r2", CUT - 7200, CUT)))


register("window_cache", _traffic("1h") + f""" SELECT source_id, bucket_start, ip_version, src_visibility, dst_visibility, flows,
        CASE WHEN source_id = 'r1' AND bucket_start BETWEEN {CUT - 86_400} AND {CUT + 172_799} THEN 1 ELSE 2 END AS reading FROM t
        WHERE (source_id = 'r1' AND bucket_start BETWEEN {CUT - 259_200} AND {CUT + 259_199}) OR (source_id = 'r2' AND bucket_start BETWEEN {CUT - 7200} AND {CUT - 1})""")(cached_windows)
