"""Stateless and windowed streams: filtered feed, throughput, activity, artifact scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.functions import feed
from opswatch.operators.policy import Policy
from opswatch.plans.pii_scan import scan_artifacts

LATE = "1 hour"


def feed_stream(events: DataFrame, scopes: list[str], permissions: list[str], late: str = LATE) -> DataFrame:
    """Events a reader subscribed to and may see, without noise, each event id once."""
    kind = F.col("event_type")
    wanted = feed.in_scopes(feed.parse_scopes(scopes), kind, F.col("job_id"), F.col("execution_chain_id"))
    shown = events.filter(wanted & feed.visible_to(kind, permissions) & ~feed.is_noise(kind))
    return shown.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["event_id"])


def throughput_stream(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = LATE) -> DataFrame:
    """Finished runs per minute over a sliding window."""
    minutes = F.window("occurred_at", window, slide)
    done = events.filter(F.col("event_type").isin("task.completed", "task.failed")).withWatermark("occurred_at", late)
    counted = done.groupBy(minutes.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    length = (F.unix_seconds("w.end") - F.unix_seconds("w.start")) / 60
    return counted.select(F.col("w.end").alias("window_end"), (F.col("n") / length).alias("per_minute"))


def activity_stream(events: DataFrame, bucket: str, late: str = LATE) -> DataFrame:
    """Events per category in tumbling buckets; empty buckets have no row in a stream."""
    kind = feed.category(F.col("event_type"))
    timed = events.withWatermark("occurred_at", late)
    counted = timed.groupBy(F.window("occurred_at", bucket).alias("w"), kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("bucket_start"), "category", "n")


def artifact_stream(
    artifacts: DataFrame, policy: Policy, source: str, body: str = "body", job_type: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Scanned artifacts, bodies whole unless a limit is given; nothing is kept between rows."""
    return scan_artifacts(artifacts, policy, source, body, job_type, limit=limit)
