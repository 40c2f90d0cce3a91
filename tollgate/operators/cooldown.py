"""J15 — alert cooldown per (kind, app).

An event is shown when a decision is required or at least 30 s have passed
since the last *shown* event of the same (kind, app); showing resets the
clock; the first event of a key is shown.  Greedy, so not one window
function, and one key may hold a third of all events, so no per-key task.

Exact distributed form:
* forced(e): decision required, first of its key, or gap to the previous
  event of the key >= 30 s.  Forced events are always shown and start a
  segment.
* next(e): within the segment, the first event at least 30 s after e (the
  next shown event after a shown e); null past the segment end.
* shown = forced roots plus every node on their ``next`` chains.  Chains
  are followed by pointer doubling: J_{k+1} = J_k o J_k (one join per
  level, log2(longest chain) levels), then the roots expand through the
  levels from the highest down (one join per level).  A level holds only
  nodes that still have a pointer, so levels shrink.  Every join is keyed
  by the unique event key, so no key is hot.

Per-key order features (previous event, next forced event) come from
windows over (key, time bucket) plus a per-(key, bucket) summary table for
the carry across buckets; ``next`` uses a bucketed range window with the
next bucket's first 60 s copied in (within a segment the answer lies there).
Intermediate tables are checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ALERT_COOLDOWN_SECONDS
from ..functions.sizing import broadcast_if_small, join_null_safe
from ..session import ensure_checkpoint_dir


def _order() -> F.Column:
    return F.struct(F.col("__t").alias("t"), F.col("source").alias("s"), F.col("source_id").alias("i"))


def alert_cooldown(
    events: DataFrame,
    cooldown_s: int = ALERT_COOLDOWN_SECONDS,
    bucket_s: int = 600,
    key_cols: tuple[str, str] = ("kind", "app_name"),
    strategy: str = "bucket",
    range_partitions: int | None = None,
) -> DataFrame:
    """Return ``events`` (all columns) with a boolean ``shown`` column.
    Events must carry timestamp, requires_decision, source, source_id.
    ``strategy='range'``: order features from range-partitioned rows, so not
    even one (key, bucket) lands in one task."""
    ensure_checkpoint_dir(events.sparkSession)
    if strategy == "range":
        return _cooldown_ranged(events, int(cooldown_s) * 1_000_000, list(key_cols), range_partitions)
    if strategy != "bucket":
        raise ValueError(f"unknown strategy {strategy!r}")
    cd = int(cooldown_s) * 1_000_000
    width = max(int(bucket_s) * 1_000_000, 2 * cd)
    keys = list(key_cols)
    base = events.withColumns({
        "__t": F.unix_micros(F.col("timestamp").cast("timestamp")),
        "__rd": F.coalesce(F.col("requires_decision"), F.lit(False)),
    }).withColumn("__bk", F.floor(F.col("__t") / width)).withColumn("__o", _order())

    kb = Window.partitionBy(*keys, "__bk").orderBy("__t", "source", "source_id")
    bw = Window.partitionBy(*keys).orderBy("__bk")

    # --- previous event of the key -> forced -----------------------------------
    base = base.withColumn("__prev_t", F.lag("__t").over(kb))
    bk_last = base.groupBy(*keys, "__bk").agg(F.max("__t").alias("__last_t"))
    bk_last = bk_last.withColumn("__carry_t", F.lag("__last_t").over(bw))
    # Per-(key, bucket) summaries are small next to the events: broadcast
    # after a bounded count.
    base = join_null_safe(base, broadcast_if_small(bk_last.select(*keys, "__bk", "__carry_t")), [*keys, "__bk"])
    prev_t = F.coalesce(F.col("__prev_t"), F.col("__carry_t"))
    base = base.withColumn("__forced", F.col("__rd") | prev_t.isNull() | (F.col("__t") - prev_t >= cd))

    # --- next forced event after e -----------------------------------------------
    # Running frames over the reversed order: frames ending at unbounded
    # following would be re-evaluated for every row.
    kb_back = Window.partitionBy(*keys, "__bk").orderBy(
        F.col("__t").desc(), F.col("source").desc(), F.col("source_id").desc()
    )
    after = kb_back.rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("__nf_local", F.min(F.when(F.col("__forced"), F.col("__o"))).over(after))
    bk_forced = base.groupBy(*keys, "__bk").agg(F.min(F.when(F.col("__forced"), F.col("__o"))).alias("__ff"))
    bw_back = Window.partitionBy(*keys).orderBy(F.col("__bk").desc())
    bk_forced = bk_forced.withColumn("__nf_carry", F.min("__ff").over(bw_back.rowsBetween(Window.unboundedPreceding, -1)))
    base = join_null_safe(base, broadcast_if_small(bk_forced.select(*keys, "__bk", "__nf_carry")), [*keys, "__bk"])
    base = base.withColumn("__nf", F.coalesce(F.col("__nf_local"), F.col("__nf_carry")))
    base = base.drop("__prev_t", "__nf_local", "__nf_carry", "__carry_t").checkpoint(eager=True)

    # --- first event >= cooldown later (bucket + head of the next bucket) --------
    own = base.select(*keys, "__bk", "__t", "__o", "__forced", "__nf", F.lit(True).alias("__own"))
    head = base.filter(F.col("__t") < F.col("__bk") * width + 2 * cd).select(
        *keys, (F.col("__bk") - 1).alias("__bk"), "__t", "__o", F.lit(False).alias("__own")
    )
    u = own.unionByName(head, allowMissingColumns=True)
    later = Window.partitionBy(*keys, "__bk").orderBy(F.col("__t").desc()).rangeBetween(Window.unboundedPreceding, -cd)
    u = u.withColumn("__n30", F.min("__o").over(later)).filter("__own")
    # Within the segment only: a forced event in between ends the chain.
    nxt = F.when(F.col("__nf").isNull() | (F.col("__n30") < F.col("__nf")), F.col("__n30"))
    nodes = u.select(F.col("__o").alias("node"), nxt.alias("nxt"), "__forced").checkpoint(eager=True)

    return _follow_chains(base, nodes)


def _follow_chains(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """shown = forced roots + every node on their ``nxt`` chains (pointer
    doubling: one self-join per level, then one join per level to expand)."""
    levels = [nodes.filter(F.col("nxt").isNotNull()).select("node", "nxt")]
    while levels[-1].take(1):
        a = levels[-1]
        b = a.select(F.col("node").alias("mid"), F.col("nxt").alias("nxt2"))
        levels.append(
            a.join(b, F.col("nxt") == F.col("mid")).select("node", F.col("nxt2").alias("nxt")).checkpoint(eager=True)
        )
    shown = nodes.filter("__forced").select("node")
    for level in reversed(levels[:-1]):
        step = shown.join(level, "node").select(F.col("nxt").alias("node"))
        shown = shown.unionByName(step).checkpoint(eager=True)
    flagged = shown.select(F.col("node").alias("__o"), F.lit(True).alias("shown"))
    out = base.join(flagged, "__o", "left").withColumn("shown", F.coalesce(F.col("shown"), F.lit(False)))
    return out.drop("__t", "__rd", "__bk", "__o", "__forced", "__nf")


def _cooldown_ranged(events: DataFrame, cd: int, keys: list[str], n_parts: int | None) -> DataFrame:
    spark = events.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = events.withColumns({
        "__t": F.unix_micros(F.col("timestamp").cast("timestamp")),
        "__rd": F.coalesce(F.col("requires_decision"), F.lit(False)),
    }).withColumn("__o", _order()).checkpoint(eager=True)
    # Events (kind 1) and one probe per event at t + cooldown (kind 0: sorts
    # before events at that instant, which count as "30 s later").
    ev = base.select(*keys, "__t", F.lit(1).alias("__kind"), "__o", F.col("__o").alias("__of"), "__rd")
    probes = base.select(*keys, (F.col("__t") + cd).alias("__t"), F.lit(0).alias("__kind"),
                         F.col("__o"), F.col("__o").alias("__of"), F.lit(False).alias("__rd"))
    ranged = ev.unionByName(probes).repartitionByRange(n, *keys, "__t", "__kind", "__o").withColumn(
        "__pid", F.spark_partition_id()
    )
    w = Window.partitionBy("__pid", *keys).orderBy("__t", "__kind", "__o")
    w_back = Window.partitionBy("__pid", *keys).orderBy(F.col("__t").desc(), F.col("__kind").desc(),
                                                          F.col("__o").desc())
    is_ev = F.col("__kind") == 1
    ranged = ranged.withColumns({
        "__prev_local": F.last(F.when(is_ev, F.col("__t")), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)),
        "__n30_local": F.last(F.when(is_ev, F.col("__o")), ignorenulls=True).over(
            w_back.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).checkpoint(eager=True)
    pw = Window.partitionBy(*keys).orderBy("__pid")  # per (partition, key): small
    pw_back = Window.partitionBy(*keys).orderBy(F.col("__pid").desc())
    per = ranged.filter(is_ev).groupBy("__pid", *keys).agg(
        F.max("__t").alias("__last_t"), F.min("__o").alias("__first_o"))
    allp = join_null_safe(ranged.select("__pid", *keys).distinct(), per, ["__pid", *keys])
    allp = allp.withColumns({
        "__carry_prev": F.last("__last_t", ignorenulls=True).over(pw.rowsBetween(Window.unboundedPreceding, -1)),
        "__carry_next": F.last("__first_o", ignorenulls=True).over(pw_back.rowsBetween(Window.unboundedPreceding, -1)),
    })
    carry = broadcast_if_small(allp.select("__pid", *keys, "__carry_prev", "__carry_next"))
    ranged = join_null_safe(ranged, carry, ["__pid", *keys])
    prev_t = F.coalesce(F.col("__prev_local"), F.col("__carry_prev"))
    ranged = ranged.withColumns({
        "__forced": is_ev & (F.col("__rd") | prev_t.isNull() | (F.col("__t") - prev_t >= cd)),
        "__n30": F.coalesce(F.col("__n30_local"), F.col("__carry_next")),
    }).checkpoint(eager=True)
    # Next forced event after each event (second pass, same partitions).
    ranged = ranged.withColumn("__nf_local", F.last(F.when(F.col("__forced"), F.col("__o")), ignorenulls=True).over(
        w_back.rowsBetween(Window.unboundedPreceding, -1)))
    perf = ranged.groupBy("__pid", *keys).agg(F.min(F.when(F.col("__forced"), F.col("__o"))).alias("__ff"))
    perf = perf.withColumn("__nf_carry", F.last("__ff", ignorenulls=True).over(
        pw_back.rowsBetween(Window.unboundedPreceding, -1)))
    ranged = join_null_safe(ranged, broadcast_if_small(perf.select("__pid", *keys, "__nf_carry")), ["__pid", *keys])
    ranged = ranged.withColumn("__nf", F.coalesce(F.col("__nf_local"), F.col("__nf_carry"))).checkpoint(eager=True)
    evs = ranged.filter(is_ev).select(F.col("__o").alias("node"), "__forced", "__nf")
    n30 = ranged.filter(F.col("__kind") == 0).select(F.col("__of").alias("node"), "__n30")
    nodes = evs.join(n30, "node")
    nxt = F.when(F.col("__nf").isNull() | (F.col("__n30") < F.col("__nf")), F.col("__n30"))
    nodes = nodes.select("node", nxt.alias("nxt"), "__forced").checkpoint(eager=True)
    return _follow_chains(base, nodes)
