"""J15-J17 — what the operator sees: cooldown, alert intervals, recent activity.

Event order everywhere: (timestamp, source, source_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    ALERT_KINDS,
    ALERT_RESTORE_MS,
    HISTORY_LENGTH,
    SUMMARY_CHARS,
)
from ..functions.buckets import with_bucket_copies
from ..session import ensure_checkpoint_dir
from .events import with_presentation


def _t(col: str = "timestamp") -> F.Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


# ---------------------------------------------------------------------------
# J16 — alert-state intervals
# ---------------------------------------------------------------------------

def alert_intervals(
    events: DataFrame,
    restore_ms: int = ALERT_RESTORE_MS,
    alert_kinds: list[str] | None = None,
    bucket_s: int = 60,
    strategy: str = "bucket",
    range_partitions: int | None = None,
) -> DataFrame:
    """Per alert event: start and end of the 'issue' state it causes.

    Every event arms a restore timer ``restore_ms`` later; an alert's state
    ends at the first timer that fires after it, i.e.
    end = min(ts of any event in (start - restore, start]) + restore.
    The window is computed per time bucket (never one global partition);
    events within ``restore`` of a bucket's end are copied into the next
    bucket as context.  Adds ``island_start``: the start of the merged
    interval (gaps and islands) the alert belongs to.
    """
    kinds = alert_kinds or ALERT_KINDS
    if strategy == "range":
        return _alert_intervals_ranged(events, int(restore_ms) * 1000, kinds, range_partitions)
    if strategy != "bucket":
        raise ValueError(f"unknown strategy {strategy!r}")
    r_us = int(restore_ms) * 1000
    width = max(int(bucket_s) * 1_000_000, r_us)
    base = events.select(
        "id", "kind", "source", "source_id", _t().alias("__t"),
        F.col("kind").isin(*kinds).alias("__alert"),
    )
    # Events within ``restore`` of a bucket's end are context for the next
    # bucket: one explode, no self-union (the event lineage runs once).
    u = with_bucket_copies(base, "__t", width, r_us, keep=[])
    w = Window.partitionBy("__bk").orderBy("__t").rangeBetween(-(r_us - 1), 0)
    u = u.withColumn("__end", F.min("__t").over(w) + r_us)
    alerts = u.filter(F.col("__own") & F.col("__alert")).select(
        "id", "kind", "source", "source_id", "__bk", F.col("__t").alias("start_us"), F.col("__end").alias("end_us")
    )
    # The narrow alert table feeds three branches below; write it once to
    # the shared checkpoint folder instead of recomputing the event lineage.
    ensure_checkpoint_dir(alerts.sparkSession)
    alerts = alerts.checkpoint(eager=True)
    # Islands: ends are monotone in start, so an alert opens a new island
    # iff it starts after the previous alert's end.
    order = Window.partitionBy("__bk").orderBy("start_us", "source", "source_id")
    alerts = alerts.withColumn("__prev_end", F.lag("end_us").over(order))
    per_bucket = alerts.groupBy("__bk").agg(F.max("end_us").alias("__bk_last_end"))
    # One row per non-empty bucket: a small table, ordered globally.
    bw = Window.orderBy("__bk")
    per_bucket = per_bucket.withColumn("__carry_end", F.lag("__bk_last_end").over(bw))
    alerts = alerts.join(F.broadcast(per_bucket.select("__bk", "__carry_end")), "__bk", "left")
    prev_end = F.coalesce(F.col("__prev_end"), F.col("__carry_end"))
    alerts = alerts.withColumn("__new", prev_end.isNull() | (F.col("start_us") > prev_end))
    alerts = alerts.withColumn(
        "__local_island",
        F.last(F.when(F.col("__new"), F.col("start_us")), ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    starts = alerts.filter("__new").groupBy("__bk").agg(F.max("start_us").alias("__bk_last_start"))
    starts = starts.withColumn(
        "__carry_start", F.max("__bk_last_start").over(bw.rowsBetween(Window.unboundedPreceding, -1))
    )
    alerts = alerts.join(F.broadcast(starts.select("__bk", "__carry_start")), "__bk", "left")
    return alerts.select(
        "id", "kind", "source", "source_id",
        F.timestamp_micros("start_us").alias("start"),
        F.timestamp_micros("end_us").alias("end"),
        F.timestamp_micros(F.coalesce(F.col("__local_island"), F.col("__carry_start"))).alias("island_start"),
    )


def _alert_intervals_ranged(events: DataFrame, r_us: int, kinds: list[str], n_parts: int | None) -> DataFrame:
    """Skew-proof form: no time bucket becomes one task, however dense.

    end(a) = first event strictly after a - restore, + restore: events and one
    probe per alert are range-partitioned on time (sampling splits a dense
    instant); a forward ``first`` inside each range partition finds it, and a
    partition with no later event takes the next partitions' first event
    from a small per-partition table.  Islands use the same scheme on the
    alerts: lag of the end and a running max of island starts inside each
    range partition, carried across partitions by small tables."""
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = events.select(
        "id", "kind", "source", "source_id", _t().alias("__t"), F.col("kind").isin(*kinds).alias("__alert")
    )
    pts = ev.select(F.col("__t"), F.lit(0).alias("__k"), F.lit(None).cast("string").alias("__id"))
    probes = ev.filter("__alert").select((F.col("__t") - r_us).alias("__t"), F.lit(1).alias("__k"),
                                         F.col("id").alias("__id"))
    ranged = pts.unionByName(probes).repartitionByRange(n, "__t", "__k", "__id").withColumn(
        "__pid", F.spark_partition_id()
    )
    # "First event at or after this row" as a running aggregate over the
    # reversed order (frames ending at unbounded following are re-evaluated
    # per row; running frames are incremental).
    back = Window.partitionBy("__pid").orderBy(
        F.col("__t").desc(), F.col("__k").desc(), F.col("__id").desc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumn(
        "__next", F.last(F.when(F.col("__k") == 0, F.col("__t")), ignorenulls=True).over(back)
    ).checkpoint(eager=True)
    firsts = ranged.groupBy("__pid").agg(F.min(F.when(F.col("__k") == 0, F.col("__t"))).alias("__first"))
    firsts = firsts.withColumn("__carry", F.last("__first", ignorenulls=True).over(
        Window.orderBy(F.col("__pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ))  # one row per range partition
    ends = ranged.filter(F.col("__k") == 1).join(F.broadcast(firsts.select("__pid", "__carry")), "__pid", "left")
    ends = ends.select(F.col("__id").alias("id"),
                       (F.coalesce(F.col("__next"), F.col("__carry")) + r_us).alias("end_us"))
    alerts = ev.filter("__alert").join(ends, "id").select(
        "id", "kind", "source", "source_id", F.col("__t").alias("start_us"), "end_us"
    )
    # Islands over the alerts in (start, source, source_id) order.
    ar = alerts.repartitionByRange(n, "start_us", "source", "source_id").withColumn("__pid", F.spark_partition_id())
    order = Window.partitionBy("__pid").orderBy("start_us", "source", "source_id")
    ar = ar.withColumn("__prev_end", F.lag("end_us").over(order)).checkpoint(eager=True)
    bw = Window.orderBy("__pid")  # one row per range partition
    last_end = ar.groupBy("__pid").agg(F.max("end_us").alias("__last_end"))
    last_end = last_end.withColumn("__carry_end", F.max("__last_end").over(bw.rowsBetween(Window.unboundedPreceding, -1)))
    ar = ar.join(F.broadcast(last_end.select("__pid", "__carry_end")), "__pid", "left")
    prev_end = F.coalesce(F.col("__prev_end"), F.col("__carry_end"))
    ar = ar.withColumn("__new", prev_end.isNull() | (F.col("start_us") > prev_end))
    ar = ar.withColumn("__local_island", F.max(F.when(F.col("__new"), F.col("start_us"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ar = ar.checkpoint(eager=True)
    starts = ar.groupBy("__pid").agg(F.max(F.when(F.col("__new"), F.col("start_us"))).alias("__ls"))
    starts = starts.withColumn("__carry_start", F.max("__ls").over(bw.rowsBetween(Window.unboundedPreceding, -1)))
    ar = ar.join(F.broadcast(starts.select("__pid", "__carry_start")), "__pid", "left")
    return ar.select(
        "id", "kind", "source", "source_id",
        F.timestamp_micros("start_us").alias("start"),
        F.timestamp_micros("end_us").alias("end"),
        F.timestamp_micros(F.coalesce(F.col("__local_island"), F.col("__carry_start"))).alias("island_start"),
    )


def alert_islands(intervals: DataFrame) -> DataFrame:
    """Merged 'issue' periods: island_start, island_end, n_alerts."""
    return intervals.groupBy("island_start").agg(
        F.max("end").alias("island_end"), F.count(F.lit(1)).alias("n_alerts")
    )


# ---------------------------------------------------------------------------
# J17 — recent activity
# ---------------------------------------------------------------------------

def recent_activity(spark: SparkSession, events: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """The n most recent events, newest first, as the activity list shows
    them.  orderBy + limit plans as TakeOrderedAndProject: each task keeps
    its own top n, one task merges n x tasks rows."""
    top = events.orderBy(F.col("timestamp").desc(), F.col("source").desc(), F.col("source_id").desc()).limit(n)
    top = with_presentation(spark, top)
    summary = F.when(
        F.length("what") > SUMMARY_CHARS, F.concat(F.substring("what", 1, SUMMARY_CHARS), F.lit("…"))
    ).otherwise(F.col("what"))
    return top.select(
        "id", "kind", "badge", "colour", "description", summary.alias("summary"),
        F.date_format("timestamp", "HH:mm:ss").alias("time_of_day"), "timestamp", "source", "source_id",
    )
