"""J9 — sliding burst count per application.

count(r) = number of requests of the same app in the inclusive window
[ts - 60 s, ts] that come no later than r in (ts, request_id) order.
Exact formula: rn = row_number over (app; ts, id);
count = rn - min(rn) over (app; ts RANGE 60 s PRECEDING .. CURRENT) + 1
(min ignores the later peers that a plain RANGE count would include).

With an eligibility column only eligible rows are counted, in the same
pass: c = running count of eligible rows, and
count = c - min(c - eligible) over the same RANGE frame
(c - eligible is the count *before* a row, non-decreasing in the order).

Two exact strategies:

* ``bucket`` (default): windows over (app, time bucket), not app alone, so
  an app holding a third of all rows is spread over many tasks; rows within
  the window length of a bucket's end are copied into the next bucket as
  context.  One shuffle of the rows.
* ``range``: skew-proof even when one app sends a third of the log inside
  one bucket.  count(r) = R(r) - R'(r), where R is r's rank among the app's
  eligible rows and R' the number of those before ts - 60 s.  Rows and one
  probe per row are range-partitioned on (app, ts, kind, id) -- sampling
  splits any hot app or timestamp over many tasks -- ranked inside
  (range partition, app) and offset by the counts of earlier partitions (a
  small table); the probe's rank joins back to its row by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small, join_null_safe
from ..session import ensure_checkpoint_dir

from ..functions.buckets import with_bucket_copies
from ..functions.constants import BURST_THRESHOLD, BURST_WINDOW_SECONDS


def burst_counts(
    df: DataFrame,
    app_col: str = "app_name",
    ts_col: str = "ts",
    id_col: str = "request_id",
    window_s: int = BURST_WINDOW_SECONDS,
    threshold: int = BURST_THRESHOLD,
    bucket_s: int = 600,
    eligible_col: str | None = None,
    context: DataFrame | None = None,
    strategy: str = "bucket",
    range_partitions: int | None = None,
) -> DataFrame:
    """Append ``burst_count`` and ``burst`` (count >= threshold); both null
    for rows that are not eligible.  ``context``: earlier eligible rows
    (app_col, ts_col, id_col) that count but are not returned (streaming
    state: the previous micro-batches' last window)."""
    if strategy == "range":
        return _burst_counts_ranged(df, app_col, ts_col, id_col, window_s, threshold, eligible_col, context,
                                    range_partitions)
    if strategy != "bucket":
        raise ValueError(f"unknown strategy {strategy!r}")
    win = int(window_s) * 1_000_000
    width = max(int(bucket_s) * 1_000_000, win)
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    elig = F.col(eligible_col).cast("boolean") if eligible_col else F.lit(True)
    base = df.withColumn("__t", t).withColumn("__e", F.coalesce(elig, F.lit(False)).cast("long"))
    # Eligible rows within the window length of a bucket's end also count in
    # the next bucket: emitted twice by one explode (no self-union).
    u = with_bucket_copies(base, "__t", width, win, keep=[app_col, id_col, "__e"],
                           copy_when=F.col("__e") == 1)
    if context is not None:
        prior = context.select(
            app_col, id_col, F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__t")
        ).withColumn("__e", F.lit(1).cast("long"))
        prior = with_bucket_copies(prior, "__t", width, win, keep=[app_col, id_col, "__e"])
        u = u.unionByName(prior.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    by_order = (
        Window.partitionBy(app_col, "__bk").orderBy("__t", id_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    by_time = Window.partitionBy(app_col, "__bk").orderBy("__t").rangeBetween(-win, 0)
    u = u.withColumn("__c", F.sum("__e").over(by_order))
    cnt = F.col("__c") - F.min(F.col("__c") - F.col("__e")).over(by_time)
    u = u.withColumn("burst_count", F.when(F.col("__e") == 1, cnt).cast("long"))
    return (
        u.filter("__own")
        .withColumn("burst", F.when(F.col("__e") == 1, F.col("burst_count") >= threshold))
        .drop("__t", "__bk", "__own", "__c", "__e")
    )


def _burst_counts_ranged(df, app_col, ts_col, id_col, window_s, threshold, eligible_col, context, n_parts):
    win = int(window_s) * 1_000_000
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    elig = F.coalesce(F.col(eligible_col).cast("boolean"), F.lit(False)) if eligible_col else F.lit(True)
    rows = df.filter(elig).select(F.col(app_col).alias("__app"), t.alias("__t"), F.col(id_col).alias("__id"),
                                  F.lit(1).alias("__kind"), F.lit(True).alias("__own"))
    if context is not None:
        rows = rows.unionByName(context.select(
            F.col(app_col).alias("__app"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__t"),
            F.col(id_col).alias("__id"), F.lit(1).alias("__kind"), F.lit(False).alias("__own"),
        ))
    # A probe at ts - window sorts before real rows at the same instant, so
    # its rank counts the rows strictly older than the window.
    probes = rows.filter("__own").select("__app", (F.col("__t") - win).alias("__t"), "__id",
                                         F.lit(0).alias("__kind"), F.lit(True).alias("__own"))
    u = rows.unionByName(probes)
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = u.repartitionByRange(n, "__app", "__t", "__kind", "__id").withColumn("__pid", F.spark_partition_id())
    local = Window.partitionBy("__pid", "__app").orderBy("__t", "__kind", "__id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Range boundaries come from sampling and partition ids from the task:
    # materialise the narrow ranked rows once so the totals below and the
    # join see the same partitioning (and the lineage is cut).
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.withColumn("__local", F.sum("__kind").over(local)).checkpoint(eager=True)
    totals = ranged.groupBy("__pid", "__app").agg(F.sum("__kind").alias("__n"))
    totals = totals.withColumn(
        "__off", F.coalesce(F.sum("__n").over(
            Window.partitionBy("__app").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0))
    )
    ranked = join_null_safe(ranged, broadcast_if_small(totals.select("__pid", "__app", "__off")), ["__pid", "__app"], "inner")
    ranked = ranked.withColumn("__rank", F.col("__local") + F.col("__off"))
    real = ranked.filter((F.col("__kind") == 1) & F.col("__own")).select("__id", F.col("__rank").alias("__r"))
    older = ranked.filter(F.col("__kind") == 0).select("__id", F.col("__rank").alias("__rp"))
    counts = real.join(older, "__id").select(
        F.col("__id").alias(id_col), (F.col("__r") - F.col("__rp")).cast("long").alias("burst_count")
    )
    out = df.join(counts, id_col, "left")
    return out.withColumn("burst", F.when(F.col("burst_count").isNotNull(), F.col("burst_count") >= threshold))
