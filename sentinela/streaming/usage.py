"""Structured Streaming: stateless inspection, windowed usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.plans.guard import Config, inspect


def inspect_stream(stream: DataFrame, text_col: str = "text", config: Config | None = None) -> DataFrame:
    """The same narrow plan as in batch; no state."""
    return inspect(stream, text_col, config)


def windowed_usage(events: DataFrame, tenant_col: str = "user_id", time_col: str = "ts", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Calls by tenant and event-time window; rows later than the watermark are dropped."""
    return (
        events.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window).alias("w"), F.col(tenant_col).alias("tenant_id"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("w.start").alias("window_start"), "tenant_id", "calls")
    )
