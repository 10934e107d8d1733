"""Tenants, usage, budgets and telemetry tables."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_key(raw: Column) -> Column:
    return F.sha2(raw.cast("binary"), 256)


def new_key(prefix: str = "gb_live_") -> str:
    """Prefix and 48 hex digits; drawn on the driver, never in a task."""
    return prefix + secrets.token_hex(24)


def validate_keys(requests: DataFrame, tenants: DataFrame, key_col: str = "api_key") -> DataFrame:
    """Requests with their tenant's id; null unless exactly one active tenant has the key."""
    one = tenants.where("status = 'active'").groupBy("api_key_hash").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("tenant_id"), F.first("tier").alias("tier")).where("n = 1").drop("n")
    return requests.withColumn("api_key_hash", hash_key(F.col(key_col))).join(one, "api_key_hash", "left")


def free_tenant(rows: DataFrame, quota: int = 500) -> DataFrame:
    """rows (id, name, email, api_key): tenant rows of the free tier, to append."""
    return rows.select("id", "name", "email", F.lit("free").alias("tier"), F.lit(quota).cast("long").alias("quota_limit"), F.lit(0).cast("long").alias("calls_this_month"), F.lit("active").alias("status"), hash_key(F.col("api_key")).alias("api_key_hash"))


def usage(events: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    return events.groupBy(tenant_col).agg(F.count(F.lit(1)).alias("calls"))


def budget_warnings(tenants: DataFrame, sent: DataFrame, now: Column, days: int = 31) -> DataFrame:
    """tenants (tenant_id, calls, quota_limit), sent (tenant_id, level, created_at): warnings
    that are due and were not sent in the last ``days`` days."""
    share = (F.col("calls") + 1) / F.col("quota_limit")
    level = F.when(share >= 1.0, "critical").when(share >= 0.8, "warning")
    due = tenants.where("quota_limit > 0").withColumn("level", level).where("level IS NOT NULL").withColumn("pct", F.floor(share * 100 + 0.5).cast("long"))
    recent = sent.where(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("tenant_id", "level").distinct()
    return due.join(recent, ["tenant_id", "level"], "left_anti")


def call_events(inspected: DataFrame, tenant: Column, at: Column, session: Column | None = None, version: str = "v1", duration_ms: Column | None = None) -> DataFrame:
    """Telemetry rows of inspected texts (columns of ``guard.inspect``), to append to the events table."""
    f, v = F.col("findings"), F.col("violations")
    none = F.lit(None).cast("string")
    return inspected.select(
        F.coalesce(tenant, F.lit("default")).alias("tenant_id"), F.lit("pii_inspection").alias("event_type"), F.col("receipt.inputHash").alias("input_hash"), F.array_distinct(F.transform(f, lambda x: x["category"])).alias("pii_types"),
        F.size(f).alias("pii_count"), F.when(F.col("safe"), "safe").otherwise("blocked").alias("verdict"), F.coalesce(duration_ms if duration_ms is not None else F.lit(0), F.lit(0)).cast("long").alias("duration_ms"),
        F.nullif("score", F.lit(0)).alias("ethics_score"), F.size(v).alias("ethics_violations"), F.lit(200).alias("status_code"), none.alias("error_message"),
        (session if session is not None else none).alias("session_id"), F.lit(version).alias("api_version"), at.alias("created_at"),
    )


def error_events(errors: DataFrame, tenant: Column, message: Column, at: Column, session: Column | None = None, version: str = "v1") -> DataFrame:
    """Telemetry rows of failed calls, in the columns of ``call_events``."""
    null = lambda kind: F.lit(None).cast(kind)
    return errors.select(
        F.coalesce(tenant, F.lit("default")).alias("tenant_id"), F.lit("api_error").alias("event_type"), null("string").alias("input_hash"), null("array<string>").alias("pii_types"), null("int").alias("pii_count"),
        F.lit("error").alias("verdict"), null("long").alias("duration_ms"), null("int").alias("ethics_score"), null("int").alias("ethics_violations"), F.lit(500).alias("status_code"), message.alias("error_message"),
        (session if session is not None else null("string")).alias("session_id"), F.lit(version).alias("api_version"), at.alias("created_at"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """Append telemetry rows to the events table, by day."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_warnings(warnings: DataFrame, at: Column, path: str) -> None:
    """Append the warnings that were due (rows of ``budget_warnings``) to the table of those that were sent."""
    warnings.withColumn("created_at", at).write.mode("append").parquet(path)


def append_tenants(tenants: DataFrame, path: str) -> None:
    """Append tenant rows (of ``free_tenant``) to the tenants table."""
    tenants.write.mode("append").parquet(path)


def recent_events(events: DataFrame, limit: int = 50, tenant: str | None = None, tie: str = "event_id") -> DataFrame:
    rows = events if tenant is None else events.where(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc("created_at"), F.desc(tie)).limit(limit)
