"""The ledger as a stream: at most one terminal per idempotency key within the watermark, and counts of calls per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_terminals(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def calls_per_window(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("calls"))
