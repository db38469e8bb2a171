"""Structured Streaming front ends: 5-minute traffic of a stream of flows, and late rows by source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from netloom.functions import flow_columns as C
from netloom.operators.statistics import own_scope


def five_minute_traffic(flows: DataFrame, lateness: str = "60 minutes") -> DataFrame:
    """Closed buckets in append mode, with all counts under the flows' own pairs and under (all, all). The watermark is one for
    all sources and drops later rows; late_by_source() tells which rows those are for each source."""
    timed = flows.withColumn("at", F.timestamp_seconds("end_s")).withWatermark("at", lateness)
    pairs = F.array(F.struct(F.lit("all").alias("s"), F.lit("all").alias("d")), F.struct(F.col("src_visibility").alias("s"), F.col("dst_visibility").alias("d")))
    scoped = own_scope(timed).withColumn("pair", F.explode(pairs)).withColumns({"src_visibility": F.col("pair.s"), "dst_visibility": F.col("pair.d")})
    w = F.window("at", "5 minutes")
    out = scoped.groupBy(w, "source_id", "ip_version", "src_visibility", "dst_visibility").agg(
        F.sum("flow_count").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes")
    )
    return out.select("source_id", F.unix_timestamp("window.start").alias("bucket_start"), "ip_version", "src_visibility", "dst_visibility", "flows", "packets", "bytes")


def late_by_source(rows: DataFrame, lag_buckets: int = 12, fail: bool = False) -> DataFrame:
    """(source_id, row_no, bucket_start) of rows that come after their bucket was emitted, source by source, as the batch
    operator statistics.late_rows finds them. State: the least and greatest bucket so far. fail: a late row is an error.

    rows: (source_id, row_no, bucket_start); within a micro-batch row_no gives the order.
    """
    lag = lag_buckets * C.FIVE_MINUTES

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(parts)).sort_values("row_no")
        b = batch["bucket_start"].to_numpy(dtype=np.int64)
        low, high = state.get if state.exists else (b[0], b[0])
        before_low, before_high = np.minimum.accumulate(np.r_[low, b]), np.maximum.accumulate(np.r_[high, b])
        is_late = (before_high[:-1] - lag > before_low[:-1]) & (b < before_high[:-1] - lag)
        late = batch.loc[is_late, ["row_no", "bucket_start"]].assign(source_id=key[0])
        if len(late) and fail:
            raise ValueError(f"rows of {key[0]} come after their bucket was emitted: {late.iloc[0].to_dict()}")
        state.update((int(before_low[-1]), int(before_high[-1])))
        yield late[["source_id", "row_no", "bucket_start"]]

    schema = "source_id string, row_no long, bucket_start long"
    return rows.groupBy("source_id").applyInPandasWithState(step, schema, "low long, high long", "append", "NoTimeout")


def run_available(traffic: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes the next run continue."""
    return traffic.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
