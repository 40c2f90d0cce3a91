"""J12 — application attribution by source port.

For each request: the process of the latest socket snapshot on the same
port observed at or before the request and strictly younger than the
tolerance (2.0 s); otherwise 'Unknown App'.

As-of join without a hot-key task: requests and snapshots are unioned and
partitioned by (port, time bucket) instead of port alone, so one busy port
is spread over many tasks.  A snapshot that may serve the next bucket
(observed within ``tolerance`` of the bucket end) is copied into it by a
single ``explode``.  One
shuffle of the rows, one sort per partition, no cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import with_bucket_copies
from ..functions.constants import APP_CACHE_TTL_SECONDS, UNKNOWN_APP


def attribute_apps(
    reqs: DataFrame,
    connections: DataFrame,
    port_col: str = "src_port",
    ts_col: str = "ts",
    out_col: str = "app_name",
    tolerance_s: float = APP_CACHE_TTL_SECONDS,
    bucket_s: int = 60,
    keep_col: str | None = None,
    strategy: str = "bucket",
    range_partitions: int | None = None,
) -> DataFrame:
    """``keep_col`` (boolean column name): rows where it is true keep their
    existing ``out_col`` value instead of the attributed one.
    ``strategy='range'``: skew-proof variant (see ``_attribute_ranged``)."""
    if strategy == "range":
        return _attribute_ranged(reqs, connections, port_col, ts_col, out_col, tolerance_s, keep_col,
                                 range_partitions)
    if strategy != "bucket":
        raise ValueError(f"unknown strategy {strategy!r}")
    tol = int(round(tolerance_s * 1_000_000))
    width = max(int(bucket_s) * 1_000_000, tol)
    if out_col in reqs.columns:
        reqs = reqs.withColumnRenamed(out_col, "__prev_out")
    r = reqs.withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp")))
    r = r.withColumn("__bk", F.floor(F.col("__t") / width)).withColumn("__kind", F.lit(1))
    c = connections.select(
        F.col("port").alias(port_col),
        F.unix_micros(F.col("observed_at").cast("timestamp")).alias("__t"),
        F.col("process").alias("__proc"),
    )
    # Snapshots within the tolerance of a bucket's end also serve the next
    # bucket: one explode, one scan of the snapshot table.
    c = with_bucket_copies(c, "__t", width, tol, keep=[port_col, "__proc"]).drop("__own")
    c_all = c.withColumn("__kind", F.lit(0)).withColumn(
        "__conn", F.struct(F.col("__t").alias("t"), F.col("__proc").alias("p"))
    ).drop("__proc")
    u = r.unionByName(c_all, allowMissingColumns=True)
    w = (
        Window.partitionBy(port_col, "__bk")
        .orderBy("__t", "__kind", "__conn.p")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    u = u.withColumn("__last", F.last("__conn", ignorenulls=True).over(w))
    attributed = F.when(F.col("__t") - F.col("__last.t") < tol, F.col("__last.p")).otherwise(F.lit(UNKNOWN_APP))
    if keep_col is not None and "__prev_out" in u.columns:
        attributed = F.when(F.col(keep_col), F.col("__prev_out")).otherwise(attributed)
    out = u.filter(F.col("__kind") == 1).withColumn(out_col, attributed)
    return out.drop("__t", "__bk", "__kind", "__conn", "__last", "__prev_out")


def _attribute_ranged(reqs, connections, port_col, ts_col, out_col, tolerance_s, keep_col, n_parts):
    """Skew-proof as-of: requests (narrow) and snapshots are range-partitioned
    on (port, ts, kind, process) -- sampling splits a hot port, even a hot
    instant -- the latest snapshot is taken inside (range partition, port),
    and a partition without one takes the latest snapshot of the port's
    earlier partitions from a small per-(partition, port) table.  The ranked
    rows are checkpointed so every branch sees one partitioning; the answer
    joins back to the requests by request id."""
    from ..functions.sizing import broadcast_if_small
    from ..session import ensure_checkpoint_dir

    if "request_id" not in reqs.columns:
        raise ValueError("the range strategy needs a request_id column")
    tol = int(round(tolerance_s * 1_000_000))
    narrow = reqs.select(
        F.col(port_col).alias("__port"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__t"),
        F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("__proc"), F.col("request_id").alias("__id"),
    )
    snaps = connections.select(
        F.col("port").alias("__port"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("__t"),
        F.lit(0).alias("__kind"), F.col("process").alias("__proc"), F.lit(None).cast("long").alias("__id"),
    )
    n = n_parts or int(reqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(reqs.sparkSession)
    ranged = narrow.unionByName(snaps).repartitionByRange(n, "__port", "__t", "__kind", "__proc").withColumn(
        "__pid", F.spark_partition_id()
    )
    conn = F.when(F.col("__kind") == 0, F.struct(F.col("__t").alias("t"), F.col("__proc").alias("p")))
    local = Window.partitionBy("__pid", "__port").orderBy("__t", "__kind", "__proc").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranged = ranged.withColumn("__conn", conn).withColumn(
        "__last", F.last("__conn", ignorenulls=True).over(local)
    ).checkpoint(eager=True)
    per = ranged.groupBy("__pid", "__port").agg(F.max_by("__conn", F.col("__conn")).alias("__plast"))
    per = per.withColumn("__carry", F.last("__plast", ignorenulls=True).over(
        Window.partitionBy("__port").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    ))
    ans = ranged.filter(F.col("__kind") == 1).join(
        broadcast_if_small(per.select("__pid", "__port", "__carry")), ["__pid", "__port"], "left"
    )
    last = F.coalesce(F.col("__last"), F.col("__carry"))
    ans = ans.select(
        F.col("__id").alias("request_id"),
        F.when(F.col("__t") - last["t"] < tol, last["p"]).otherwise(F.lit(UNKNOWN_APP)).alias("__attr"),
    )
    out = reqs.join(ans, "request_id", "left")
    attributed = F.col("__attr")
    if keep_col is not None and out_col in reqs.columns:
        attributed = F.when(F.col(keep_col), F.col(out_col)).otherwise(attributed)
    return out.withColumn(out_col, attributed).drop("__attr")
