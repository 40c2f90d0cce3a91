"""Registered traffic queries (J3-J13) over the request log derived from the
driver tables, with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bodies import scan_bodies_udf
from ..functions.sizing import broadcast_if_small
from ..operators.ai_signals import flag_ai_like
from ..operators.approvals import approval_snapshot as _approval_snapshot
from ..operators.approvals import endpoint_snapshot
from ..operators.attribution import attribute_apps as _attribute_apps
from ..operators.burst import burst_counts
from ..operators.discovery import first_seen
from ..operators.payloads import oversize_payloads as _oversize, unusual_models as _unusual, with_json_model
from ..operators.providers import resolve_hosts
from ..sources import fixtures as fx
from ..operators.catalogue_merge import custom_after_log, merge_catalogue
from ..sources.catalogue import builtin_catalogue, empty_catalogue, read_catalogue_lines, write_catalogue_lines
from ..sources.tables import table
from . import oracle_traffic as OT

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def custom_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom catalogue after the whole decision log (endpoint decisions);
    ``ord`` = first-decision time in microseconds (insertion order)."""
    snap = endpoint_snapshot(fx.decisions(spark, sf_dir))
    return snap.select(
        "host", "name", F.array().cast("array<string>").alias("paths"), F.lit(False).alias("local"),
        "approved", F.lit("custom").alias("origin"), F.unix_micros("first_ts").alias("ord"),
    )


def resolve_hosts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct host of the request log and of the page URLs,
    resolved against the built-in and the decided custom catalogue."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", OT.URL_HOST_RX, 1).alias("host")
    )
    reqs = fx.request_heads(spark, sf_dir).select("host")
    hosts = pages.unionByName(reqs).filter(F.col("host") != "")
    custom = custom_catalogue(spark, sf_dir)
    res = resolve_hosts(hosts, "host", builtin_catalogue(spark), custom)
    return res.select(
        "host", "provider_host", "provider_name", "provider_approved", "provider_local", "provider_origin",
        F.col("match_rank").cast("long").alias("match_rank"),
    )


def ai_like_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 (policy mode: body signals count)."""
    r = flag_ai_like(fx.requests(spark, sf_dir), mode="policy")
    return r.select("request_id", "host", "path", "ai_path", F.col("body_signals").cast("long").alias("body_signals"),
                    "ai_like")


def oversize_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    return _oversize(fx.requests(spark, sf_dir)).select("request_id", "app_name", "host", "payload_bytes")


def unusual_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JVM-side model extraction (VARIANT) + as-of approval."""
    r = with_json_model(fx.requests(spark, sf_dir))
    out = _unusual(r, fx.decisions(spark, sf_dir))
    return out.select("request_id", "host", "model", "model_snippet")


def approval_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 snapshot (S6 as a table)."""
    s = _approval_snapshot(fx.decisions(spark, sf_dir))
    return s.select("target", "key", "state", "name", F.array_join("models", ",").alias("models"))


def _with_builtin_rank(spark: SparkSession, reqs: DataFrame) -> DataFrame:
    res = resolve_hosts(reqs, "host", builtin_catalogue(spark), empty_catalogue(spark), matched_only=True).select(
        "host", F.col("match_rank").alias("builtin_rank")
    )
    return reqs.join(broadcast_if_small(res), "host", "left")


def discover_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When every custom key became known, and how."""
    reqs = _with_builtin_rank(spark, fx.request_heads(spark, sf_dir))
    k = first_seen(reqs, fx.decisions(spark, sf_dir))
    return k.select(
        "key", F.date_format(F.col("first.ts"), TS_FMT).alias("first_ts"),
        F.col("first.kind").cast("long").alias("first_kind"), F.col("first.id").alias("first_id"),
        "source", "name", F.col("depth").cast("long").alias("depth"),
    )


def burst_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 on the whole log, keyed by the logged app name (before filtering);
    skew-proof range strategy (no (app, bucket) group lands in one task)."""
    r = fx.request_heads(spark, sf_dir).select("request_id", "ts", "app_name")
    return burst_counts(r, strategy="range").select("request_id", "app_name", "burst_count", "burst")


def attribute_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process owning the source port, as-of with 2 s tolerance
    (skew-proof range strategy: no hot port lands in one task)."""
    r = fx.request_heads(spark, sf_dir).select("request_id", "ts", "src_port")
    out = _attribute_apps(r, fx.connections(spark, sf_dir), strategy="range")
    return out.select("request_id", "src_port", "app_name")


def body_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 labels, body kind and model of every request body."""
    r = fx.request_stream(spark, sf_dir)
    s = r.withColumn("s", scan_bodies_udf()(F.col("body")))
    return s.select(
        "request_id", F.col("s.json_kind").alias("json_kind"), F.col("s.model").alias("model"),
        F.concat_ws(", ", "s.labels").alias("labels"),
        F.size("s.labels").cast("long").alias("n_labels"),
    )


def redact_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 full output including the rewritten body (re-serialised the way
    Python's json.dumps does)."""
    r = fx.request_stream(spark, sf_dir)
    s = r.withColumn("s", scan_bodies_udf()(F.col("body")))
    return s.select(
        "request_id", F.col("s.json_kind").alias("json_kind"), F.col("s.model").alias("model"),
        F.concat_ws(", ", "s.labels").alias("labels"), F.col("s.modified_body").alias("modified_body"),
    )


def frames_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 with hosts known as of the frame's time and the port's owner."""
    from ..operators.frames import scan_frames as _scan

    decisions = fx.decisions(spark, sf_dir)
    known = first_seen(_with_builtin_rank(spark, fx.request_heads(spark, sf_dir)), decisions)
    return _scan(spark, fx.frames(spark, sf_dir), decisions=decisions, known=known, connections=fx.connections(spark, sf_dir))


def scan_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 (see operators.frames)."""
    return frames_as_of(spark, sf_dir).select(
        "frame_id", "host", "app_name", "provider_name", F.concat_ws(", ", "labels").alias("labels"),
        F.col("new_content").isNotNull().alias("rewritten"),
    )


def remote_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A community list derived from the data: the built-in entries plus
    every page host, stored once in line form (S4) and read back (S3)."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", OT.URL_HOST_RX, 1).alias("host"))
    hosts = pages.filter(F.col("host") != "").distinct()
    listed = builtin_catalogue(spark).select("host", "name", "paths", "local", "approved", "ord").unionByName(
        hosts.select("host", F.col("host").alias("name"), F.array().cast("array<string>").alias("paths"),
                     F.lit(False).alias("local"), F.lit(True).alias("approved"), F.lit(None).cast("long").alias("ord"))
    )
    import uuid

    root = fx.stored_path(spark, sf_dir, "remote_catalogue")
    path = fx._completed_attempt(spark, root)
    if path is None:
        path = f"{root}/attempt-{uuid.uuid4().hex[:12]}"
        write_catalogue_lines(listed, path)
    return read_catalogue_lines(spark, path, "remote").withColumn("ord", F.lit(None).cast("long"))


def merge_catalogue_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in + custom (after the whole log) + remote entries new to both."""
    decisions = fx.decisions(spark, sf_dir)
    known = first_seen(_with_builtin_rank(spark, fx.request_heads(spark, sf_dir)), decisions)
    custom = custom_after_log(known, decisions)
    merged = merge_catalogue(builtin_catalogue(spark), custom, remote_catalogue(spark, sf_dir))
    return merged.select("host", "name", "approved", "local", "origin", "ord",
                         F.col("origin_rank").cast("long").alias("origin_rank"))


def queries() -> dict:
    return {
        "merge_catalogue": merge_catalogue_q,
        "resolve_hosts": resolve_hosts_q,
        "ai_like_requests": ai_like_requests,
        "oversize_payloads": oversize_payloads,
        "unusual_models": unusual_models,
        "approval_snapshot": approval_snapshot,
        "discover_endpoints": discover_endpoints,
        "burst_activity": burst_activity,
        "attribute_apps": attribute_apps,
        "body_labels": body_labels,
        "redact_bodies": redact_bodies,
        "scan_frames": scan_frames,
    }


def oracle_sql() -> dict:
    return {
        "merge_catalogue": OT.MERGE_CATALOGUE,
        "resolve_hosts": OT.RESOLVE_HOSTS,
        "ai_like_requests": OT.AI_LIKE,
        "oversize_payloads": OT.OVERSIZE,
        "unusual_models": OT.UNUSUAL_MODELS,
        "approval_snapshot": OT.APPROVAL_SNAPSHOT,
        "discover_endpoints": OT.DISCOVER,
        "burst_activity": OT.BURST,
        "attribute_apps": OT.ATTRIBUTE,
        "body_labels": OT.BODY_LABELS,
        "redact_bodies": OT.REDACT_BODIES,
        "scan_frames": OT.SCAN_FRAMES,
    }
