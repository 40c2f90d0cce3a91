"""J5 — catalogue merge.

* custom catalogue after a log: every key that became known (J7 first-seen
  table) with the state the decision log leaves it in;
* merge: remote entries are added only when their host is in neither the
  built-in nor the custom catalogue (anti join); the result lists built-in,
  then custom, then the added entries (``all providers`` order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small
from .approvals import endpoint_snapshot

ORIGIN_RANK = {"builtin": 0, "custom": 1, "remote": 2}


def custom_after_log(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """Custom entries: name = last approved display name, else the name the
    key was registered with; approved = last endpoint verdict is approve."""
    snap = endpoint_snapshot(decisions).select(
        F.col("host").alias("key"), F.col("name").alias("d_name"), F.col("approved").alias("d_approved"),
        F.col("name").isNotNull().alias("decided"),
    )
    approvals = decisions.filter((F.col("target") == "endpoint") & (F.col("verdict") == "approve"))
    last_ok = approvals.groupBy(F.lower("key").alias("key")).agg(
        F.max_by("display_name", F.struct("ts", "decision_id")).alias("ok_name")
    )
    out = known.join(snap, "key", "left").join(last_ok, "key", "left")
    return out.select(
        F.col("key").alias("host"),
        F.coalesce(F.col("ok_name"), F.col("name")).alias("name"),
        F.array().cast("array<string>").alias("paths"),
        F.lit(False).alias("local"),
        F.coalesce(F.col("d_approved"), F.lit(False)).alias("approved"),
        F.lit("custom").alias("origin"),
        F.unix_micros(F.col("first.ts")).alias("ord"),
    )


def merge_catalogue(builtin: DataFrame, custom: DataFrame, remote: DataFrame) -> DataFrame:
    """N7 + O2.  ``remote`` may be large (a community list); the anti join
    keeps it distributed, with the known hosts broadcast after a bounded
    count."""
    known = broadcast_if_small(builtin.select("host").unionByName(custom.select("host")))
    rest = [c for c in remote.columns if c != "host"]
    # A host listed twice counts once, by its last entry.
    order = F.coalesce(F.col("ord"), F.lit(-1)).alias("place")
    last = remote.groupBy("host").agg(F.max(F.struct(order, F.struct(*rest).alias("e"))).alias("m")).select("host", "m.e.*")
    added = last.join(known, "host", "left_anti").withColumn("origin", F.lit("remote"))
    cols = ["host", "name", "paths", "local", "approved", "origin", "ord"]
    out = builtin.select(*cols).unionByName(custom.select(*cols)).unionByName(added.select(*cols))
    rank = F.create_map(*[x for k, v in ORIGIN_RANK.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("origin_rank", F.element_at(rank, F.col("origin")))
