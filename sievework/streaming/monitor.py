"""Continuous monitoring: change detection, once-only alerts, and streams of applicants and events.

A pass compares fingerprints with the stored state, screens monitored applicants against changed
sources only, and keeps alerts that are neither in the baseline nor reported before. State is to be
written after the alerts, so a pass that is repeated adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT_KEY = ["applicant_id", "source", "list", "ref"]


def change_status(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source, status): first_seen, changed, unchanged or unavailable for (source, fingerprint, available) against (source, fingerprint)."""
    old = before.select("source", F.col("fingerprint").alias("old"))
    status = (
        F.when(~F.col("available"), "unavailable").when(F.col("old").isNull(), "first_seen").when(F.col("fingerprint") == F.col("old"), "unchanged").otherwise("changed")
    )
    return now.join(old, "source", "left").select("source", status.alias("status"))


def new_alerts(found: DataFrame, baseline: DataFrame, known: DataFrame) -> DataFrame:
    """Matches (applicant_id, source, list, ref, ...) that are neither in the baseline nor alerted before; one row a key."""
    return found.join(baseline, ALERT_KEY, "left_anti").join(known, ALERT_KEY, "left_anti").dropDuplicates(ALERT_KEY)


def next_state(now: DataFrame, before: DataFrame) -> DataFrame:
    """State after a pass: the new fingerprint of every source that was available, else the old one."""
    joined = now.join(before.select("source", F.col("fingerprint").alias("old")), "source", "full_outer")
    return joined.select("source", F.when(F.col("available"), F.col("fingerprint")).otherwise(F.col("old")).alias("fingerprint")).filter("fingerprint IS NOT NULL")


def alert_stream(matches: DataFrame, at: str = "checked_at", delay: str = "1 day") -> DataFrame:
    """A stream of matches with each alert key once within the watermark."""
    return matches.withWatermark(at, delay).dropDuplicatesWithinWatermark(ALERT_KEY)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by tumbling window and kind; the same plan over a stream or a table."""
    source = events.withWatermark(at, delay) if events.isStreaming else events
    return source.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Events by session of a key, closed after a gap."""
    source = events.withWatermark(at, delay) if events.isStreaming else events
    return source.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drain what is available now into ``handle`` batch by batch; a repeated batch id must be harmless to it."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
