"""Registered queries of serving and scalars: parameterised requests, point look-ups, catalogues, calendars; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import calendar, text
from netloom.functions import flow_columns as C
from netloom.operators import guards
from netloom.operators import statistics as S
from netloom.plans import product, requests, serving, store
from netloom.plans.catalog import _AVG, _SETS, _TOTALS, MEMBERS, _floor, _structures, _traffic, _with, address_structure, members, register, rounded
from netloom.sources import flows as src

WINDOW = (1704441600, 1705046400)
DEFINITIONS: dict[str, set[str]] = {}
for _logical, _member in MEMBERS:
    DEFINITIONS.setdefault(_logical, set()).add(_member)
_IN_WINDOW = f"bucket_start >= {WINDOW[0]} AND bucket_start < {WINDOW[1]}"
SLUG, SLUG_START = "202401050035", 1704443700

PARAMS = {"routers": "r1, r2", "startDate": str(WINDOW[0]), "endDate": str(WINDOW[1]), "groupBy": "30min", "srcVisibility": "literal", "dstVisibility": "anonymized"}
register("api_netflow_stats_request", _traffic("30m") + f""", e AS (SELECT bucket_start, {_TOTALS} FROM t
        WHERE src_visibility = 'literal' AND dst_visibility = 'anonymized' AND source_id IN ('r1', 'r2') AND {_IN_WINDOW}
        GROUP BY ALL) SELECT *, {_AVG} FROM e ORDER BY bucket_start""")(
    lambda s, d: rounded(requests.traffic_stats(S.traffic(S.logical_sources(src.from_events(s, d), members(s)), "30m"), DEFINITIONS, requests.Request.parse(PARAMS)))
)
ADDRESS = requests.Request(("r1", "r3"), *WINDOW, "5m", "anonymized", "anonymized")
register("api_ip_stats_request", _with(more=f"""SELECT source_id, {_floor('5m')} AS bucket_start,
        {', '.join(f"count(DISTINCT CASE WHEN ip_version = {v} THEN {c} END) AS {k}_ipv{v}" for v in (4, 6) for k, c in (('source', 'src_ip'), ('destination', 'dst_ip')))}
        FROM flows WHERE src_tos % 4 = 3 AND source_id IN ('r1',
        'r3') AND {_floor('5m')} >= {WINDOW[0]} AND {_floor('5m')} < {WINDOW[1]} GROUP BY ALL ORDER BY source_id,
        bucket_start"""))(
    lambda s, d: requests.address_stats(S.address_counts(src.from_events(s, d), "5m"), ADDRESS)
)
PROTOCOL = requests.Request(("r2",), *WINDOW, "30m")
register("api_protocol_stats_request", _with(more=f"""SELECT source_id, {_floor('30m')} AS bucket_start, count(DISTINCT CASE WHEN ip_version = 4 THEN protocol END) AS ipv4,
        count(DISTINCT CASE WHEN ip_version = 6 THEN protocol END) AS ipv6 FROM flows
        WHERE source_id = 'r2' AND {_floor('30m')} >= {WINDOW[0]} AND {_floor('30m')} < {WINDOW[1]} GROUP BY ALL
        ORDER BY source_id, bucket_start"""))(
    lambda s, d: requests.protocol_stats(S.protocols(src.from_events(s, d), "30m"), PROTOCOL)
)
SHAPE = requests.Request(("r1", "r2", "r3"), *WINDOW, "1d", "literal", "literal")


def _points(wide: DataFrame, kind: str, *fields: str) -> DataFrame:
    """One row for each source, bucket, side and point."""
    sides = F.explode(F.create_map(*[x for s in requests.SIDES for x in (F.lit(s), F.col(f"{kind}_{s}"))])).alias("address_side", "points")
    rows = wide.select("source_id", "bucket_start", sides).select("source_id", "bucket_start", "address_side", F.inline("points"))
    return rows.select("source_id", "bucket_start", "address_side", *fields)


_SHAPE = f"granularity = '1d' AND src_visibility = 'literal' AND dst_visibility = 'literal' AND {_IN_WINDOW}"
register("api_structure_stats", _with(more=_structures("1d", "st") + f""" SELECT source_id, bucket_start, address_side, q8 / 8.0 AS q, cast(printf('%.8f', round(tau, 8) + 0.0) AS DOUBLE) AS tau,
        cast(printf('%.6f', round(sd, 6) + 0.0) AS DOUBLE) AS sd FROM st JOIN grid USING (k) WHERE {_SHAPE}"""))(
    lambda s, d: _points(requests.structure_stats(address_structure(s, d, "1d"), SHAPE), "structure", "q", "tau", "sd")
)
register("api_spectrum_stats", _with(more=_structures("1d", "sp") + f""" SELECT source_id, bucket_start, address_side, cast(printf('%.8f', round(alpha, 8) + 0.0) AS DOUBLE) AS alpha, cast(printf('%.8f', round(f, 8) + 0.0) AS DOUBLE) AS f FROM sp
        JOIN grid USING (k) WHERE {_SHAPE}"""))(
    lambda s, d: _points(requests.spectrum_stats(address_structure(s, d, "1d"), SHAPE), "spectrum", "alpha", "f")
)
register("api_file_ip_counts", _with(more=f"""SELECT count(DISTINCT CASE WHEN ip_version = 4 THEN dst_ip END) AS ipv4,
        count(DISTINCT CASE WHEN ip_version = 6 THEN dst_ip END) AS ipv6 FROM flows
        WHERE source_id = 'r3' AND {_floor('5m')} = {SLUG_START} GROUP BY source_id"""))(
    lambda s, d: requests.file_address_counts(S.address_counts(src.from_events(s, d), "5m"), SLUG, "r3", False)
)


def all_source_list(s, d) -> DataFrame:
    return requests.source_list(S.traffic(S.logical_sources(src.from_events(s, d), members(s))))


def inferred(s, d) -> DataFrame:
    """Members as capture paths name them."""
    paths = src.from_events(s, d).select("source_id", F.concat_ws("/", F.lit("/captures/m"), "source_id", F.lit("2024/01/02/nfcapd.202401020000")).alias("locator")).distinct()
    return guards.inferred_members(paths)


register("api_routers", f"""SELECT DISTINCT logical AS source_id FROM (VALUES {', '.join(map(str, MEMBERS))}) m(logical, member) SEMI
        JOIN (SELECT 'r' || (user_id % 3 + 1) AS member FROM events) e USING (member) ORDER BY source_id""")(all_source_list)
register("source_definitions", f"""
    WITH c AS (SELECT * FROM (VALUES {', '.join(map(str, MEMBERS[3:]))}) m(source_id, member_id)), s AS (SELECT DISTINCT 'r' || (user_id % 3 + 1) AS source_id FROM events),
    b AS (SELECT * FROM c UNION ALL SELECT source_id, source_id FROM s ANTI JOIN c USING (source_id))
    SELECT source_id, string_agg(member_id, ',' ORDER BY member_id) AS members FROM b GROUP BY source_id""")(
    lambda s, d: requests.source_definitions(S.traffic(src.from_events(s, d)), members(s).where("source_id in ('all', 'pair')"), inferred(s, d)).withColumn("members", F.array_join("members", ","))
)
register("source_definitions_inferred", "SELECT DISTINCT 'r' || (user_id % 3 + 1) AS source_id, 'r' || (user_id % 3 + 1) AS members FROM events")(
    lambda s, d: requests.source_definitions(S.traffic(src.from_events(s, d)), members(s).limit(0), inferred(s, d)).withColumn("members", F.array_join("members", ","))
)


def dataset_catalogue(s, d) -> DataFrame:
    datasets = s.createDataFrame([("bulk", "Bulk", 2), ("live", "Live", 1), ("empty", "Empty", 1)], "dataset_id string, label string, sort_order int")
    of = lambda name, flows: S.traffic(flows).select(F.lit(name).alias("dataset_id"), "source_id", "granularity")
    return requests.catalogue(datasets, of("live", src.from_events(s, d)).union(of("bulk", src.from_lineitem(s, d))))


register("api_datasets", """SELECT 'bulk' AS dataset_id, 'Bulk' AS label, 2 AS sort_order,
        count(DISTINCT (l_suppkey * 1000003 + l_partkey) % 3) AS source_count FROM lineitem UNION ALL SELECT 'live', 'Live', 1,
        count(DISTINCT user_id % 3) FROM events UNION ALL SELECT 'empty', 'Empty', 1, 0 ORDER BY sort_order, dataset_id""")(dataset_catalogue)
_PLAIN = ", ".join(f"cast(sum({c}) AS BIGINT) AS {c}" for c in S.COUNTERS[:15])
register("traffic_of_ipv6", _traffic("1h") + f""" SELECT bucket_start, cast(sum(CASE WHEN ip_version = 6 THEN flows ELSE 0 END) AS BIGINT) AS flows,
        cast(sum(CASE WHEN ip_version = 6 THEN bytes ELSE 0 END) AS BIGINT) AS bytes FROM t WHERE src_visibility = 'all'
        GROUP BY ALL""")(
    lambda s, d: requests.family(serving.family_totals(serving.window(S.traffic(src.from_events(s, d), "1h"))), "ipv6").select("bucket_start", "flows", "bytes")
)

# Calendars and texts.
_AT = f"timezone('{C.TIMEZONE}', to_timestamp(end_s))"
register("calendar_scalars", _with(more=f"""SELECT k, year({_AT}) AS year, month({_AT}) AS month, day({_AT}) AS day, hour({_AT}) AS hours, minute({_AT}) AS minutes, second({_AT}) AS seconds, dayofweek({_AT}) AS day_of_week,
    strftime({_AT}, '%Y-%m-%d') AS day_label, strftime({_AT}, '%Y-%m-%d %H:%M') AS hour_label, CASE WHEN dayofweek({_AT}) = 1 THEN strftime({_AT}, 'Mon %m/%d') ELSE '' END AS day_tick,
    strftime({_AT}, '%Y%m%d%H%M') AS slug, end_s - end_s % 60 AS slug_start,
    cast(epoch(timezone('{C.TIMEZONE}', date_trunc('day', {_AT}))) AS BIGINT) AS day_first, cast(epoch(timezone('{C.TIMEZONE}', date_trunc('day', {_AT}) + INTERVAL 1 DAY)) AS BIGINT) AS day_end,
    (cast(epoch(timezone('{C.TIMEZONE}', date_trunc('day', {_AT}) + INTERVAL 1 DAY)) AS BIGINT) - cast(epoch(timezone('{C.TIMEZONE}', date_trunc('day', {_AT}))) AS BIGINT)) // 300 AS buckets,
    strftime(timezone('{C.TIMEZONE}', to_timestamp(end_s - 259200)), '%Y-%m-%d') AS drill_first, strftime(timezone('{C.TIMEZONE}', to_timestamp(end_s + 345600)), '%Y-%m-%d') AS drill_last FROM flows"""))(
    lambda s, d: _calendar(src.from_events(s, d, "k"))
)


def _calendar(flows: DataFrame) -> DataFrame:
    t = F.col("end_s")
    day = calendar.label(t, "1d")
    _, first, last = calendar.drill_down("1h", t)
    return flows.select(
        "k", calendar.components(t).alias("c"), day.alias("day_label"), calendar.label(t, "1h").alias("hour_label"), calendar.tick(t, "1d").alias("day_tick"),
        calendar.slug(t).alias("slug"), calendar.slug_start(calendar.slug(t)).alias("slug_start"), calendar.date_range(day).alias("day_first"), calendar.date_range(day, is_end=True).alias("day_end"),
        F.size(calendar.day_starts(F.to_date(calendar.local(t)))).cast("long").alias("buckets"), first.alias("drill_first"), last.alias("drill_last"),
    ).select("c.*", "*").drop("c")


register("boundaries", _with(more=f"""SELECT k, CASE k % 4 WHEN 0 THEN end_s WHEN 1 THEN end_s - end_s % 60 WHEN 2 THEN cast(epoch(timezone('{C.TIMEZONE}',
        date_trunc('day', {_AT}))) AS BIGINT) END AS boundary FROM flows"""))(
    lambda s, d: _boundaries(src.from_events(s, d, "k"))
)


def _boundaries(flows: DataFrame) -> DataFrame:
    t, k = F.col("end_s"), F.col("k") % 4
    zoned = F.concat(F.date_format(C.clock(t), "yyyy-MM-dd'T'HH:mm"), F.lit("Z"))
    written = F.when(k == 0, t.cast("string")).when(k == 1, F.when(F.col("k") % 8 == 1, zoned).otherwise(F.date_format(calendar.local(t), "yyyy-MM-dd HH:mm")))
    return flows.select("k", calendar.boundary(F.coalesce(written, F.when(k == 2, calendar.label(t, "1d")).otherwise("soon"))).alias("boundary"))


def _unit(value: str, units, plain: str) -> str:
    """Halves up on the exact binary quotient, in whole numbers."""
    tenths = lambda size: f"((cast(({value} / {float(size)}) * 4503599627370496 AS HUGEINT) * 10 + 2251799813685248) // 4503599627370496)"
    whens = " ".join(f"WHEN {value} >= {size} THEN {tenths(size)} // 10 || '.' || {tenths(size)} % 10 || '{unit}'" for unit, size in units)
    return f"CASE {whens} ELSE {value} || '{plain}' END"


register("formatted_units", _with(more=f"""SELECT k, {_unit('v', text.COUNT_UNITS, '')} AS plain, {_unit('v', text.BYTE_UNITS, ' bytes')} AS size,
        'a/b c~' || k AS name, 'a%2Fb%20c~' || k AS quoted, 'a-b-c-' || k AS part FROM (SELECT k, bytes * cast(pow(10,
        k % 12) AS BIGINT) AS v FROM flows)"""))(
    lambda s, d: _formatted(src.from_events(s, d, "k").select("k", (F.col("bytes") * F.pow(F.lit(10.0), F.col("k") % 12).cast("long")).alias("v")))
)


def _formatted(df: DataFrame) -> DataFrame:
    name = F.concat(F.lit("a/b c~"), F.col("k").cast("string"))
    return df.select("k", text.with_unit(F.col("v")).alias("plain"), text.with_unit(F.col("v"), text.BYTE_UNITS, " bytes").alias("size"), name.alias("name"), text.quoted(name).alias("quoted"), text.path_part(name).alias("part"))


register("tolerant_points", _with(more="""SELECT k, CASE WHEN k % 3 = 0 THEN 0 ELSE 2 END AS n_points, CASE WHEN k % 3 = 0 THEN NULL ELSE 0.0 END AS q_min,
        CASE WHEN k % 3 = 0 THEN NULL ELSE cast(k % 5 AS DOUBLE) END AS q_max,
        CASE WHEN k % 3 = 0 THEN NULL ELSE 1.5 END AS tau,
        CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 0.5 ELSE 0.25 END AS sd,
        CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 1.0 ELSE 1.25 END AS low FROM flows"""))(
    lambda s, d: _tolerant(src.from_events(s, d, "k"))
)


def _tolerant(flows: DataFrame) -> DataFrame:
    k = F.col("k")
    number = (k % 5).cast("string")
    json = F.when(k % 3 == 0, "not-json").when(k % 3 == 1, F.concat(F.lit('[{"q": 0, "tau": 1.5, "sd": 0.5}, {"q": '), number, F.lit("}]"))).otherwise(F.concat(F.lit('[{"q": 0, "tauTilde": 1.5, "s": 0.25}, {"q": '), number, F.lit("}]")))
    points = text.structure_points(json)
    bars = F.get(text.error_bars(points), F.lit(0))
    return flows.select("k", *text.ranges(points, "q"), F.get(points, F.lit(0)).getField("tau").alias("tau"), F.get(points, F.lit(0)).getField("sd").alias("sd"), bars.getField("low").alias("low"))


# Days, coverage and intervals.
def dense_1d(s, d) -> DataFrame:
    flows = src.from_events(s, d)
    return rounded(S.dense(S.traffic(flows, "1d"), S.observed_bounds(flows, "5m"), "1d"))


register("dense_fill_1d", _traffic("1d") + f"""
    , b AS (SELECT source_id, min({_floor('1d')}) AS a, max({_floor('1d')}) AS z FROM flows GROUP BY ALL),
    cal AS (SELECT DISTINCT source_id, {_floor('1d', 'h')} AS bucket_start FROM (SELECT source_id, unnest(generate_series(a, z, 3600)) AS h FROM b)),
    sc AS (SELECT * FROM (VALUES (4), (6)) v(ip_version) CROSS JOIN (VALUES ('all','all'),('literal','literal'),('literal','anonymized'),('anonymized','literal'),('anonymized','anonymized')) p(src_visibility, dst_visibility))
    SELECT source_id, '1d' AS granularity, bucket_start, ip_version, src_visibility, dst_visibility, {", ".join(f"coalesce({c}, 0) AS {c}" for c in S.COUNTERS)}, {_AVG}
    FROM cal CROSS JOIN sc LEFT JOIN (SELECT * EXCLUDE granularity FROM t) USING (source_id, bucket_start, ip_version, src_visibility, dst_visibility)""")(dense_1d)
register("complete_30m", _traffic("30m") + f""", c AS (SELECT {_floor('30m')} AS bucket_start FROM flows GROUP BY ALL HAVING count(DISTINCT {_floor('5m')}) = 6)
        SELECT 'all' AS source_id, bucket_start, ip_version, src_visibility, dst_visibility,
        cast(sum(flows) AS BIGINT) AS flows, cast(sum(bytes) AS BIGINT) AS bytes FROM t SEMI JOIN c USING (bucket_start)
        GROUP BY ALL""")(
    lambda s, d: _complete(S.traffic(S.logical_sources(src.from_events(s, d), members(s).where("source_id = 'all'"))), "30m")
)


def _complete(five: DataFrame, g: str) -> DataFrame:
    out = S.complete_only(S.roll_up(five, g), five, g)
    return out.select("source_id", "bucket_start", "ip_version", "src_visibility", "dst_visibility", "flows", "bytes")


register("grouped_facts_1h", _traffic("1h") + f" SELECT *, {_AVG} FROM t")(lambda s, d: rounded(_grouped(src.from_events(s, d, "k"))))


def _grouped(flows: DataFrame) -> DataFrame:
    """Half of the facts come as flows, half already grouped."""
    one, two = (S.facts(flows.where(f"k % 2 = {k}"), "1h") for k in (0, 1))
    return S.with_all(one.unionByName(two))


_COVER = f", c AS (SELECT DISTINCT source_id, {_floor('5m')} AS a FROM flows), o AS (SELECT *, CASE WHEN a <= lag(a) OVER w + 300 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY source_id ORDER BY a)), i AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY a) AS n FROM o), m AS (SELECT source_id, min(a) AS start, max(a) + 300 AS \"end\" FROM i GROUP BY source_id, n)"


def covered(s, d) -> DataFrame:
    return S.bucketed(src.from_events(s, d), "5m").select("source_id", F.col("bucket_start").alias("start"), (F.col("bucket_start") + 300).alias("end")).distinct()


register("merged_ranges", _with(more=_COVER + " SELECT * FROM m"))(lambda s, d: S.merged_ranges(covered(s, d)))
register("missing_within_window", _with(more=_COVER + f", x AS (SELECT source_id, greatest(start, {WINDOW[0]}) AS a, least(\"end\", {WINDOW[1]}) AS b FROM m WHERE start < {WINDOW[1]} AND \"end\" > {WINDOW[0]} UNION ALL SELECT DISTINCT source_id, {WINDOW[1]}, {WINDOW[1]} FROM c), g AS (SELECT source_id, coalesce(lag(b) OVER (PARTITION BY source_id ORDER BY a, b), {WINDOW[0]}) AS gap_start, a AS gap_end FROM x) SELECT * FROM g WHERE gap_start < gap_end"))(
    lambda s, d: S.missing_within(covered(s, d), covered(s, d).select("source_id").distinct().select("source_id", F.lit(WINDOW[0]).cast("long").alias("start"), F.lit(WINDOW[1]).cast("long").alias("end")))
)


def extract_tables(s, d) -> DataFrame:
    flows = src.from_events(s, d)
    tables = {"traffic_stats": S.traffic(flows, "1h"), "protocol_stats": S.protocols(flows, "1h"), "address_count_stats": S.address_counts(flows, "1h"), "port_count_stats": S.port_counts(flows, "1h")}
    return serving.summary({n: store.within(t, *WINDOW, granularities=["1h", "1d"]) for n, t in tables.items()})


def _rows(extra: str, source: str) -> str:
    return f"SELECT DISTINCT source_id, {_floor('1h')} AS bucket_start, ip_version, src_visibility, dst_visibility{extra} FROM {source}"


register("extract_tables_summary", _with(more=f""", tr AS ({_rows('', 'scoped')}),
    ad AS ({_rows(", 'source' AS side", 'scoped')} UNION ALL {_rows(", 'destination'", 'scoped')}),
    po AS ({_rows(", 's' AS side, src_port < 1024 AS low", 'scoped WHERE src_port IS NOT NULL')} UNION ALL {_rows(", 'd', dst_port < 1024", 'scoped WHERE dst_port IS NOT NULL')})
    {' UNION ALL '.join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, min(bucket_start) AS first, max(bucket_start) AS last FROM {t} WHERE {_IN_WINDOW}" for n, t in (('traffic_stats', 'tr'), ('protocol_stats', 'tr'), ('address_count_stats', 'ad'), ('port_count_stats', 'po')))}"""))(extract_tables)


# The whole product: five dense tables of all granularities.
_MEASURES = {"traffic_stats": "flows", "protocol_stats": "unique_protocols_count", "address_count_stats": "unique_address_count", "port_count_stats": "unique_port_count"}


def product_totals(s, d) -> DataFrame:
    """Rows, rows with content and sums of each table and granularity."""
    out = None
    for name, df in product.tables(src.from_events(s, d)).items():
        value = F.col(_MEASURES[name]) if name in _MEASURES else F.when(F.col("values_json") == "[]", 0).otherwise(1)
        end = F.max("bucket_end").alias("last_end")
        t = df.groupBy("granularity").agg(F.count("*").alias("n_rows"), F.count_if(value > 0).alias("n_filled"), F.sum(value).cast("long").alias("total"), end).select(F.lit(name).alias("table_name"), "*")
        out = t if out is None else out.union(t)
    return out


def _product_sql(g: str) -> str:
    key = f"source_id, {_floor(g)} AS b, ip_version, src_visibility, dst_visibility"
    end = f"cast(epoch(timezone('{C.TIMEZONE}', timezone('{C.TIMEZONE}', to_timestamp(last)) + INTERVAL 1 DAY)) AS BIGINT)" if g == "1d" else f"last + {C.WIDTHS[g]}"
    values = {
        "traffic_stats": (10, f"""SELECT sum(flow_count) AS v FROM (SELECT {key}, flow_count FROM scoped) GROUP BY source_id, b, ip_version,
        src_visibility, dst_visibility"""),
        "protocol_stats": (10, f"""SELECT count(DISTINCT protocol) AS v FROM (SELECT {key}, protocol FROM scoped) GROUP BY source_id, b, ip_version,
        src_visibility, dst_visibility"""),
        "address_count_stats": (20, " UNION ALL ".join(f"""SELECT count(DISTINCT {c}) AS v FROM (SELECT {key}, {c} FROM scoped) GROUP BY source_id, b, ip_version,
        src_visibility, dst_visibility""" for c in ("src_ip", "dst_ip"))),
        "port_count_stats": (40, " UNION ALL ".join(f"""SELECT count(DISTINCT {c}) AS v FROM (SELECT {key}, {c} FROM scoped WHERE {c} IS NOT NULL) GROUP BY source_id, b,
        ip_version, src_visibility, dst_visibility, {c} < 1024""" for c in ("src_port", "dst_port"))),
    }
    cal = f"""(SELECT DISTINCT source_id, {_floor(g, 't')} AS b FROM (SELECT source_id, unnest(generate_series(min({_floor('5m')}),
        max({_floor('5m')}), 300)) AS t FROM flows GROUP BY source_id))"""
    parts = [f"""SELECT '{n}' AS table_name, '{g}' AS granularity, (SELECT count(*) * {k} FROM {cal}) AS n_rows,
        count(*) FILTER (WHERE v > 0) AS n_filled, cast(sum(v) AS BIGINT) AS total, (SELECT {end} FROM (SELECT max(b) AS last
        FROM {cal})) AS last_end FROM ({q})""" for n, (k, q) in values.items()]
    return " UNION ALL ".join(parts)


def _structure_sql(g: str) -> str:
    end = f"cast(epoch(timezone('{C.TIMEZONE}', timezone('{C.TIMEZONE}', to_timestamp(max(bucket_start))) + INTERVAL 1 DAY)) AS BIGINT)" if g == "1d" else f"max(bucket_start) + {C.WIDTHS[g]}"
    return f"""({_with(more=_structures(g))} SELECT 'address_structure_stats' AS table_name, '{g}' AS granularity,
        count(*) AS n_rows, count(*) FILTER (WHERE values_json <> '[]') AS n_filled,
        count(*) FILTER (WHERE values_json <> '[]') AS total, {end} AS last_end FROM ds)"""


register("product_totals", _with(more=" UNION ALL ".join([_product_sql(g) for g in C.GRANULARITIES] + [_structure_sql(g) for g in C.GRANULARITIES])))(product_totals)
