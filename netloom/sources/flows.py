"""The contract that flow records of all sources have, and flows made from tables.

Columns of the contract: source_id, ip_version, src_ip, dst_ip, src_u32, dst_u32, protocol, packets, bytes, src_tos,
src_port, dst_port, duration_ms, min_ttl, max_ttl, flow_count, end_s (the epoch second that chooses the bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C

CONTRACT = (
    "source_id", "ip_version", "src_ip", "dst_ip", "src_u32", "dst_u32", "protocol", "packets", "bytes",
    "src_tos", "src_port", "dst_port", "duration_ms", "min_ttl", "max_ttl", "flow_count", "end_s",
)


def derived(base: DataFrame, *more: str) -> DataFrame:
    """Flows made from base rows (k, u, end_s, protocol) by whole-number arithmetic. more: columns of base to keep."""
    k, u = F.col("k"), F.col("u")
    src = F.expr("(u * 2654435 + (k % 7) * 16777259) % 4294967296")
    dst = F.expr("3232235520 + (k * 40503) % 65536")

    def ip(number):
        high, low = F.lower(F.hex(F.expr("1") * F.shiftright(number, 16))), F.lower(F.hex(number.bitwiseAND(65535)))
        return F.when(k % 10 == 0, F.concat(F.lit("2001:db8::"), high, F.lit(":"), low)).otherwise(C.ipv4_text(number))

    return base.select(
        F.concat(F.lit("r"), (u % 3 + 1).cast("string")).alias("source_id"),
        F.when(k % 10 == 0, 6).otherwise(4).alias("ip_version"),
        ip(src).alias("src_ip"), ip(dst).alias("dst_ip"), src.alias("src_u32"), dst.alias("dst_u32"),
        "protocol", (1 + k % 97).alias("packets"), ((1 + k % 97) * (40 + k % 1400)).alias("bytes"), (k % 8).alias("src_tos"),
        F.when(k % 11 != 0, (k * 7919) % 65536).alias("src_port"), F.when(k % 17 != 0, (k * 104729) % 65536).alias("dst_port"),
        F.when(k % 13 != 0, (k * 37) % 60000).alias("duration_ms"), F.when(k % 5 != 0, 32 + k % 32).alias("min_ttl"),
        F.when(k % 6 != 0, 64 + k % 128).alias("max_ttl"), (1 + k % 3).alias("flow_count"), "end_s", *more,
    )


def from_events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    numbers = {"click": 6, "view": 17, "purchase": 1, "error": 132}
    number = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in numbers.items()], F.lit(58))
    return derived(e.select(F.col("event_id").alias("k"), F.col("user_id").alias("u"), C.epoch_of("ts").alias("end_s"), number.alias("protocol")), *more)


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 17).when(F.col("l_returnflag") == "R", 1).otherwise(58)
    return derived(
        li.select(
            F.expr("l_orderkey * 8 + l_linenumber").alias("k"),
            F.expr("l_suppkey * 1000003 + l_partkey").alias("u"),
            (C.epoch_of("l_shipdate") + F.expr("(l_orderkey * 7919) % 86400")).alias("end_s"),
            number.alias("protocol"),
        )
    )
