"""Freshness, fetch statistics, health and due times of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import DEFAULT_INTERVAL, effective_interval, text


def active_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    found = sources.where(~F.col("deleted"))
    return (found.where("enabled") if enabled_only else found).orderBy("id")


def latest_publish(entries: DataFrame) -> DataFrame:
    """source_id, latest over undeleted entries."""
    return entries.where(~F.col("deleted")).groupBy("source_id").agg(F.max("published_at").alias("latest"))


def fetch_stats(log: DataFrame) -> DataFrame:
    """Per source: runs, successes, time of the last success, time and length of
    the last run; one aggregate."""
    return log.groupBy("source_id").agg(
        F.count("*").alias("total"), F.count_if("success").alias("success"), F.max(F.when(F.col("success"), F.col("started_at"))).alias("last_success_at"),
        F.max_by("started_at", "id").alias("last_started_at"), F.max_by("elapsed_ms", "id").alias("last_elapsed_ms"),
    )


def source_health(log: DataFrame) -> DataFrame:
    """source_id, fail_count (failures since the last success), last_error."""
    last = log.groupBy("source_id").agg(
        F.coalesce(F.max(F.when(F.col("success"), F.col("id"))), F.lit(-1)).alias("ok"), F.max(F.when(~F.col("success"), F.struct("id", text("error").alias("error")))).alias("bad")
    )
    failures = log.where("NOT success").join(last.select("source_id", "ok"), "source_id").where("id > ok").groupBy("source_id").agg(F.count("*").alias("n"))
    joined = last.join(failures, "source_id", "left")
    return joined.select("source_id", F.coalesce("n", F.lit(0)).alias("fail_count"), F.when(F.col("bad.id") > F.col("ok"), F.col("bad.error")).otherwise(F.lit("")).alias("last_error"))


def source_overview(sources: DataFrame, entries: DataFrame, log: DataFrame) -> DataFrame:
    """Undeleted sources with their latest entry and fetch statistics."""
    latest = latest_publish(entries).withColumnRenamed("source_id", "id")
    stats = fetch_stats(log).withColumnRenamed("source_id", "id")
    joined = sources.where(~F.col("deleted")).select("id", "name").join(latest, "id", "left").join(stats, "id", "left")
    total, good = F.coalesce("total", F.lit(0)), F.coalesce("success", F.lit(0))
    return joined.select(
        "id", "name", "latest", total.alias("total"), good.alias("success"), F.when(total > 0, good / total).otherwise(F.lit(0.0)).alias("success_rate"),
        "last_success_at", "last_started_at", "last_elapsed_ms",
    )


def due_sources(sources: DataFrame, log: DataFrame, now: Column, default: int = DEFAULT_INTERVAL) -> DataFrame:
    """id, due_at of the enabled sources whose wait after the last run is over, and
    of those that never ran (due_at null)."""
    last = log.groupBy(F.col("source_id").alias("id")).agg(F.max_by(F.struct("started_at", "elapsed_ms"), "id").alias("run"))
    joined = sources.where("enabled AND NOT deleted").join(last, "id", "left")
    wait = effective_interval("interval", "fail_count", default)
    due = F.timestamp_micros(F.unix_micros("run.started_at") + F.col("run.elapsed_ms") * 1000 + wait * 1_000_000)
    return joined.select("id", due.alias("due_at")).where(F.col("due_at").isNull() | (F.col("due_at") <= now))


def log_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """log with the runs (and a boolean ``cancelled``) that were not cancelled."""
    return log.unionByName(runs.where(~F.coalesce("cancelled", F.lit(False))).select(log.columns))
