"""Registered event queries (J14-J17) over the full pipeline:
requests -> policy verdicts (+ frames, decisions) -> events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import alert_intervals as _alert_intervals
from ..operators.alerts import alert_islands, recent_activity as _recent
from ..operators.cooldown import alert_cooldown as _alert_cooldown
from ..operators.events import build_events as _build_events
from ..operators.events import iso_timestamp
from ..operators.frames import frame_events
from ..sources import fixtures as fx
from .policy import policy_verdicts
from .traffic_queries import TS_FMT, frames_as_of


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_verdicts(spark, fx.requests(spark, sf_dir), fx.decisions(spark, sf_dir),
                           fx.connections(spark, sf_dir))


def verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The J8 verdict sink as a table, computed once per run."""
    return fx.stored_log(spark, sf_dir, "verdicts", _verdicts, per_run=True)


def events_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = fx.decisions(spark, sf_dir)
    verdicts = verdict_table(spark, sf_dir)
    return _build_events(verdicts, decisions, frame_events(frames_as_of(spark, sf_dir)))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event sink as a table.  The J14 pipeline appends it once per
    source state; the operator-view jobs (J15-J17) read it."""
    return fx.stored_log(spark, sf_dir, "events", events_pipeline, per_run=True)


def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the pipeline into the event sink table and return it."""
    e = event_table(spark, sf_dir)
    return e.select(
        "id", iso_timestamp(F.col("timestamp")).alias("timestamp"), "kind", "app_name", "provider_host",
        "provider_name", "what", "why", "action", "requires_decision", "model",
        F.concat_ws(", ", "redacted_fields").alias("redacted_fields"), "source", "source_id",
    )


def alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = _alert_intervals(event_table(spark, sf_dir), strategy="range")
    isl = alert_islands(iv)
    return isl.select(
        F.date_format("island_start", TS_FMT).alias("island_start"),
        F.date_format("island_end", TS_FMT).alias("island_end"),
        "n_alerts",
    )


def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recent(spark, event_table(spark, sf_dir))
    return r.select("id", "kind", "badge", "colour", "description", "summary", "time_of_day", "source", "source_id")


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _alert_cooldown(event_table(spark, sf_dir), strategy="range")
    return c.select("id", "kind", "app_name", "source", "source_id", "shown")


def queries() -> dict:
    return {
        "alert_cooldown": alert_cooldown,
        "build_events": build_events,
        "alert_intervals": alert_intervals,
        "recent_activity": recent_activity,
    }
