"""The registered query set: name -> (spark, sf_dir) -> DataFrame, plus the
matching DuckDB oracle SQL.  Every query reads the driver tables (or logs
Spark derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import is_opaque, redact_text
from ..sources.readers import columns as log_columns
from ..sources.tables import table
from ..session import ship_package
from ..sources import fixtures as fx
from . import oracle as O
from . import oracle_traffic as OT
from . import event_queries as EQ
from . import oracle_events as OE
from . import traffic_queries as TQ
from .policy import policy_verdicts

QueryFn = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------------------
# J1 — text redaction over the corpora
# ---------------------------------------------------------------------------

def _redaction_report(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    red = redact_text(df.select(*id_cols, text_col), text_col, "redacted_text", "redacted_fields")
    return red.select(
        *id_cols,
        "redacted_text",
        F.concat_ws(", ", "redacted_fields").alias("labels"),
        F.size("redacted_fields").cast("long").alias("n_labels"),
    )


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redaction_report(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redaction_report(table(spark, sf_dir, "pages"), ["page_id"], "html")


def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redaction_report(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


def _redaction_sql(src: str, id_cols: list[str], text_col: str) -> str:
    ctes, end, p = O.redaction_chain(f"SELECT {', '.join(id_cols)}, {text_col} FROM {src}", text_col)
    return (
        f"WITH {ctes}\nSELECT {', '.join(id_cols)}, {p}_text AS redacted_text, {p}_labels AS labels, "
        f"{p}_n AS n_labels FROM {end}"
    )


def opaque_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 over every document and page string: which would be skipped as opaque."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("s")
    )
    pages = table(spark, sf_dir, "pages")
    both = docs
    for column in ("url", "html"):
        both = both.unionByName(
            pages.select(F.lit(f"pages.{column}").alias("source"), F.col("page_id").alias("id"), F.col(column).alias("s"))
        )
    return both.select(
        "source", "id", F.coalesce(is_opaque(F.col("s")), F.lit(False)).alias("opaque"),
        F.length("s").cast("long").alias("n_chars"),
    )


_OPAQUE_SQL = f"""
SELECT source, id, coalesce(length(s) > {O.OPAQUE_MIN_LENGTH} AND NOT contains(s, ' ')
       AND regexp_full_match(s, {O.q('[' + O.OPAQUE_CHARSET + ']+')}), FALSE) AS opaque,
       CAST(length(s) AS BIGINT) AS n_chars
FROM (SELECT 'documents' AS source, doc_id AS id, text AS s FROM documents
      UNION ALL SELECT 'pages.url', page_id, url FROM pages
      UNION ALL SELECT 'pages.html', page_id, html FROM pages)
"""


def policy_verdicts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 flagship: the policy cascade over the whole derived request log,
    written to the verdict sink (read by the event job) and returned."""
    from .event_queries import verdict_table

    v = verdict_table(spark, sf_dir)
    return v.select(
        "request_id", "app_name", "rule", "allowed", "event_kind", "requires_decision", "provider_name",
        "event_model", F.concat_ws(", ", "labels").alias("labels"), "burst_count",
    )


def _replayed(spark: SparkSession, sf_dir: str, n_parts: int = 4, **kw):
    """The logs in ``n_parts`` arrivals of equal event-time length, through the
    streaming queries (all logs by the one clock of the requests)."""
    import uuid

    from ..streaming.stream_policy import Replay

    logs = {"requests": (fx.requests, "ts"), "decisions": (fx.decisions, "ts"), "connections": (fx.connections, "observed_at")}
    if kw.get("events"):
        logs["frames"] = (fx.frames, "ts")
        kw["frames_custom"] = TQ.custom_catalogue(spark, sf_dir)
    logs = {name: (read(spark, sf_dir), F.unix_micros(F.col(ts))) for name, (read, ts) in logs.items()}
    rows, t = logs["requests"]
    lo, hi = rows.agg(F.min(t), F.max(t)).first()
    replay = Replay(spark, fx.stored_path(spark, sf_dir, f"stream-{uuid.uuid4().hex[:8]}"), **kw)
    for k in range(n_parts):
        part = lambda at: F.least(F.greatest(F.floor((at - lo) * n_parts / (hi - lo + 1)), F.lit(0)), F.lit(n_parts - 1))
        replay.arrive(**{name: log.filter(part(at) == k) for name, (log, at) in logs.items()})
    return replay


def policy_responses_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client gets: the status and body of a block, the digest of
    a rewritten request."""
    from .event_queries import verdict_table

    v = verdict_table(spark, sf_dir)
    return v.select(
        "request_id", "rule", F.col("status_code").cast("long").alias("status_code"), "block_body",
        F.sha2(F.col("modified_body").cast("binary"), 256).alias("modified_sha256"),
    )


def read_request_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as JSON lines, every 97th line cut off after 40
    characters and every 101st without a valid time, read with the fixed schema:
    good rows by their fields, broken ones by the digest of the line."""
    import uuid

    from ..sources.readers import log_lines

    i, path = F.col("request_id"), fx.stored_path(spark, sf_dir, f"lines-{uuid.uuid4().hex[:8]}")
    rows = fx.request_stream(spark, sf_dir).select(*log_columns("requests"))
    when = F.when(i % 101 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    line = F.to_json(F.struct(*(when.alias(c) if c == "ts" else F.col(c) for c in rows.columns)))
    rows.select(F.when(i % 97 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path, compression="gzip")
    lines = log_lines(spark, "requests", path)
    good = F.col("broken_line").isNull()
    return lines.select(
        F.when(good, F.col("request_id")).alias("request_id"), F.when(good, F.unix_micros("ts")).alias("ts_us"),
        *(F.when(good, F.col(c)).alias(c) for c in ("app_name", "host", "path")), F.when(good, F.col("dst_port")).cast("long").alias("dst_port"),
        F.when(good, F.sha2(F.col("body").cast("binary"), 256)).alias("body_sha256"), (~good).alias("broken"),
    )


#: Parts of event time, and how late a request may be, in ``stream_arrivals``.
LATE_PARTS, LATENESS_S = 3, 60


def stream_arrivals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1: every fifth request comes a part late, every 35th two parts: each
    leaves once, as on_time, late (judged as of its time) or rejected."""
    from ..streaming.stream_policy import Replay

    import uuid

    req, dec, con = fx.requests(spark, sf_dir), fx.decisions(spark, sf_dir), fx.connections(spark, sf_dir)
    lo, hi = req.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = lambda ts: F.least(F.greatest(F.floor((F.unix_micros(ts) - lo) * LATE_PARTS / (hi - lo + 1)), F.lit(0)), F.lit(LATE_PARTS - 1))
    waits = F.when(F.col("request_id") % 35 == 0, 2).when(F.col("request_id") % 5 == 0, 1).otherwise(0)
    replay = Replay(spark, fx.stored_path(spark, sf_dir, f"stream-{uuid.uuid4().hex[:8]}"), lateness_s=LATENESS_S)
    for k in range(LATE_PARTS + 2):
        replay.arrive(requests=req.filter(part("ts") + waits == k), decisions=dec.filter(part("ts") == k), connections=con.filter(part("observed_at") == k))
    return replay.verdicts().select("request_id", "arrival", F.col("rule").isNotNull().alias("judged"))


def stream_policy_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, decisions and snapshots in four time-ordered arrivals
    through the streaming job; must equal the batch verdicts."""
    v = _replayed(spark, sf_dir).verdicts()
    return v.select(
        "request_id", "app_name", "rule", "allowed", "event_kind", "requires_decision", "provider_name",
        "event_model", F.concat_ws(", ", "labels").alias("labels"), "burst_count",
    )


def stream_events_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18 events: requests, frames and decisions in one event stream with the
    cooldown flag carried in keyed state."""
    ev = _replayed(spark, sf_dir, events=True).events()
    return ev.select("id", "kind", "app_name", "source", "source_id", "shown")


def _in_utc(fn: QueryFn) -> QueryFn:
    """Event time is compared and printed as UTC; pin the session zone so a
    caller's session settings cannot shift naive timestamps."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    return {name: _in_utc(fn) for name, fn in _raw_queries().items()}


def _raw_queries() -> dict[str, QueryFn]:
    return {
        "policy_verdicts": policy_verdicts_q,
        "stream_policy": stream_policy_q,
        "stream_events": stream_events_q,
        "stream_arrivals": stream_arrivals_q,
        "policy_responses": policy_responses_q,
        "read_request_log": read_request_log_q,
        **TQ.queries(),
        **EQ.queries(),
        "redact_documents": redact_documents,
        "redact_pages": redact_pages,
        "redact_conversations": redact_conversations,
        "opaque_text": opaque_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "policy_verdicts": OT.POLICY,
        "stream_policy": OT.POLICY,
        "read_request_log": OT.READ_REQUESTS,
        "stream_arrivals": OT.arrivals_sql(LATE_PARTS, LATENESS_S),
        **TQ.oracle_sql(),
        **OE.oracle_sql(),
        "redact_documents": _redaction_sql("documents", ["doc_id"], "text"),
        "redact_pages": _redaction_sql("pages", ["page_id"], "html"),
        "redact_conversations": _redaction_sql("conversations", ["conv_id", "turn"], "text"),
        "opaque_text": _OPAQUE_SQL,
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline query: the policy cascade."""
    return queries()["policy_verdicts"](spark, sf_dir)
