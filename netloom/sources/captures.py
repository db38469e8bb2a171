"""The native reader's CSV of captures as flows. Unlike in a mapped CSV, one malformed row fails the read.

The capture's file name, not the rows, chooses source and bucket: <root>/<source>/YYYY/MM/DD/nfcapd.YYYYMMDDHHMM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import flow_columns as C
from netloom.sources.csv_files import BIG
from netloom.sources.flows import CONTRACT

#: The fields of the native reader's CSV in their order, and the row that stands for none (fixed values).
CAPTURE_FIELDS = "received,lastSeen,firstSeen,srcAddr,dstAddr,srcPort,dstPort,proto,packets,bytes,srcTos,dstTos,flows,minTTL,maxTTL".split(",")
NO_FLOWS = "No matching flows"
NAME = r"nfcapd\.(\d{12})$"


def bucket_of(locator: Column, tz: str = C.TIMEZONE) -> Column:
    """The bucket that a capture's name tells, of a repeated hour the first; null for other names."""
    stamp = F.regexp_extract(locator, NAME, 1)
    local = F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    parts = F.regexp_replace(stamp, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:00")
    local = F.when(local.isNotNull(), parts.try_cast("timestamp_ntz"))
    return C.epoch_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), local))


def capture_flows(raw: DataFrame, tz: str = C.TIMEZONE) -> DataFrame:
    """Flows of rows (locator, the fields as texts, corrupt); every row is checked in full."""
    text = {c: F.col(c) for c in CAPTURE_FIELDS}
    whole = lambda c, low, high: text[c].rlike(r"^\d+$") & text[c].try_cast("long").between(low, high)
    ms = {c: (text[c].try_cast("decimal(38,6)") * 1000).cast("long") for c in ("received", "lastSeen", "firstSeen")}
    protocol, version = C.protocol_number(text["proto"]), C.ip_version(text["srcAddr"], strict=True)
    ports = {c: C.resolve_port(text[c], protocol) for c in ("srcPort", "dstPort")}
    ttl = {c: C.present_ttl(F.coalesce(F.nullif(text[c], F.lit("")).try_cast("long"), F.lit(0))) for c in ("minTTL", "maxTTL")}
    wrong = F.when(F.col("corrupt").isNotNull(), "row of the wrong number of fields")
    wrong = wrong.when(bucket_of(F.col("locator"), tz).isNull(), "file name")
    for c in ms:
        wrong = wrong.when(~F.coalesce(text[c], F.lit("")).rlike(r"^-?\d+(\.\d{1,3}0*)?$"), c)
    wrong = wrong.when(ms["lastSeen"] < ms["firstSeen"], "duration")
    wrong = wrong.when(version.isNull() | ~version.eqNullSafe(C.ip_version(text["dstAddr"], strict=True)), "address")
    wrong = wrong.when(F.coalesce(text["proto"], F.lit("")) == "", "proto").when(protocol.isNull() | ~protocol.between(0, 255), "proto")
    for c in ports:
        bad = ~text[c].rlike(r"^(\d+|\d+\.\d+)$") | ports[c].isNull() | ~ports[c].between(0, 65_535)
        wrong = wrong.when(F.coalesce(bad, F.lit(True)), c)
    for c, low, high in (("packets", 0, BIG), ("bytes", 0, BIG), ("srcTos", 0, 255), ("dstTos", 0, 255), ("flows", 1, BIG)):
        wrong = wrong.when(~F.coalesce(whole(c, low, high), F.lit(False)), c)
    for c in ttl:
        wrong = wrong.when(~F.coalesce(whole(c, 0, 255) | (text[c] == ""), F.lit(True)), c)
    wrong = wrong.when(ttl["minTTL"] > ttl["maxTTL"], "minTTL")
    none = F.col("received").eqNullSafe(NO_FLOWS) & F.coalesce(*[text[c] for c in CAPTURE_FIELDS[1:]]).isNull()
    checked = raw.where(~none).withColumn("ok", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("malformed "), wrong, F.lit(" in "), "locator"))).otherwise(F.lit(True)).cast("boolean"))
    number = lambda c: text[c].cast("long")
    return checked.where("ok").select(
        F.element_at(F.split("locator", "/"), -5).alias("source_id"), version.alias("ip_version"), text["srcAddr"].alias("src_ip"), text["dstAddr"].alias("dst_ip"),
        C.ipv4_number(text["srcAddr"]).alias("src_u32"), C.ipv4_number(text["dstAddr"]).alias("dst_u32"), protocol.alias("protocol"),
        number("packets").alias("packets"), number("bytes").alias("bytes"), number("srcTos").alias("src_tos"), *[p.cast("long").alias(n) for n, p in zip(("src_port", "dst_port"), ports.values(), strict=True)],
        (ms["lastSeen"] - ms["firstSeen"]).alias("duration_ms"), ttl["minTTL"].alias("min_ttl"), ttl["maxTTL"].alias("max_ttl"), number("flows").alias("flow_count"),
        bucket_of(F.col("locator"), tz).alias("end_s"),
    ).select(*CONTRACT)


def read_captures(spark: SparkSession, paths: str | list[str], tz: str = C.TIMEZONE) -> DataFrame:
    """Flows of the reader's CSV files; a file whose header is not the fields in their order fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*CAPTURE_FIELDS, "corrupt"]])
    options = {"header": True, "enforceSchema": False, "quote": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "columnPruning": False}
    raw = spark.read.options(**options).schema(schema).csv(paths).select("*", F.col("_metadata.file_path").alias("locator"))
    return capture_flows(raw, tz)
