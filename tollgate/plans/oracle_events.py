"""DuckDB oracle SQL for the event queries."""

from __future__ import annotations

from ..functions.constants import (
    ALERT_KINDS,
    ALERT_RESTORE_MS,
    DEFAULT_KIND_COLOUR,
    DEFAULT_KIND_DESCRIPTION,
    KIND_PRESENTATION,
)
from ..operators.events import MESSAGE_TEMPLATES, _split
from ..sources.fixtures import EPOCH_US
from .oracle import q
from .oracle_traffic import EVENT_SUBJECT, REDACT_BODIES, _TS, _custom_snapshot, frames_ctes, policy_core


def _sql_fmt(template: str, cols: dict[str, str]) -> str:
    parts = [q(v) if k == "lit" else f"coalesce(CAST({cols[v]} AS VARCHAR), '')" for k, v in _split(template)]
    return "(" + " || ".join(parts) + ")"


def _messages(rule: str, cols: dict[str, str]) -> list[str]:
    out = []
    for i in range(3):
        whens = " ".join(f"WHEN {rule} = {q(r)} THEN {_sql_fmt(t[i], cols)}" for r, t in MESSAGE_TEMPLATES.items())
        out.append(f"CASE {whens} END")
    return out


def events_ctes(sources: tuple[str, ...] = ("request", "frame", "decision"), as_of: bool = True) -> str:
    """WITH-list ending in CTE ``evs`` (the J14 event table)."""
    req_cols = {"a": "app_name", "h": "host", "n": "subject", "m": "substring(model, 1, 60)", "l": "labels"}
    what, why, action = _messages("rule", req_cols)
    fr_cols = {"a": "app_name", "h": "host", "n": "provider_name", "m": "NULL", "l": "fx_labels"}
    fwhat, fwhy, faction = _messages("'FRAME'", fr_cols)
    return policy_core() + f""",
{_custom_snapshot()},
{frames_ctes(as_of)},
pev AS (SELECT *, {EVENT_SUBJECT} AS subject FROM fin2 WHERE event_kind IS NOT NULL),
ev_req AS (
  SELECT substring(sha256(concat_ws('|', 'request', CAST(request_id AS VARCHAR), event_kind)), 1, 12) AS id,
         ts, event_kind AS kind, app_name, host AS provider_host, subject AS provider_name,
         {what} AS what, {why} AS why, {action} AS action,
         rule IN ('R4a', 'R4b', 'R1a', 'R2b', 'R5') AS requires_decision,
         coalesce(CASE WHEN rule = 'R5' THEN model END, '') AS model,
         CASE WHEN event_kind = 'redacted_sensitive_data' THEN labels ELSE '' END AS redacted_fields,
         'request' AS source, CAST(request_id AS BIGINT) AS source_id
  FROM pev),
ev_fr AS (
  SELECT substring(sha256(concat_ws('|', 'frame', CAST(frame_id AS VARCHAR), 'redacted_sensitive_data')), 1, 12) AS id,
         make_timestamp({EPOCH_US} + conv_id * 1000000 + (frame_id - conv_id * 1000) * 10000) AS ts,
         'redacted_sensitive_data' AS kind, app_name, host AS provider_host, provider_name,
         {fwhat} AS what, {fwhy} AS why, {faction} AS action,
         FALSE AS requires_decision, '' AS model, fx_labels AS redacted_fields,
         'frame' AS source, CAST(frame_id AS BIGINT) AS source_id
  FROM fx_end WHERE fx_n > 0),
ev_dec AS (
  SELECT substring(sha256(concat_ws('|', 'decision', CAST(decision_id AS VARCHAR), kind)), 1, 12) AS id,
         ts, kind, app, host, name,
         CASE WHEN kind = 'approved' THEN 'Access granted to ' ELSE 'Access refused to ' END
           || CASE WHEN name <> '' THEN name ELSE app END AS what,
         CASE WHEN kind = 'approved' THEN 'Decision recorded: approve.' ELSE 'Decision recorded: deny.' END AS why,
         CASE WHEN kind = 'approved' THEN 'It applies from its own time on.'
              ELSE 'It applies from its own time on, until changed.' END AS action,
         FALSE AS requires_decision, '' AS model, '' AS redacted_fields,
         'decision' AS source, CAST(decision_id AS BIGINT) AS source_id
  FROM (SELECT *, CASE WHEN verdict = 'approve' THEN 'approved' ELSE 'denied' END AS kind,
               CASE WHEN target = 'app' THEN key ELSE '' END AS app,
               CASE WHEN target <> 'app' THEN key ELSE '' END AS host,
               coalesce(display_name, '') AS name
        FROM decisions)),
evs AS ({" UNION ALL ".join(f"SELECT * FROM {n}" for n, src in
                 (("ev_req", "request"), ("ev_fr", "frame"), ("ev_dec", "decision")) if src in sources)})"""


ISO_TS = ("CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') "
          "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END")

BUILD_EVENTS = events_ctes() + f"""
SELECT id, {ISO_TS} AS timestamp, kind, app_name, provider_host, provider_name, what, why, action,
       requires_decision, model, redacted_fields, source, source_id
FROM evs
"""

_R = ALERT_RESTORE_MS * 1000
_KINDS = "(" + ", ".join(q(k) for k in ALERT_KINDS) + ")"

ALERT_INTERVALS = events_ctes() + f""",
all_t AS (SELECT epoch_us(ts) AS t, kind, source, source_id FROM evs),
ends AS (
  SELECT *, min(t) OVER (ORDER BY t RANGE BETWEEN {_R - 1} PRECEDING AND CURRENT ROW) + {_R} AS end_us FROM all_t),
al AS (SELECT t AS start_us, end_us, source, source_id FROM ends WHERE kind IN {_KINDS}),
al2 AS (SELECT *, lag(end_us) OVER (ORDER BY start_us, source, source_id) AS prev_end FROM al),
al3 AS (
  SELECT *, max(CASE WHEN prev_end IS NULL OR start_us > prev_end THEN start_us END)
            OVER (ORDER BY start_us, source, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM al2)
SELECT strftime(make_timestamp(island), {_TS}) AS island_start, strftime(make_timestamp(max(end_us)), {_TS}) AS island_end,
       count(*) AS n_alerts
FROM al3 GROUP BY island
"""

_DIM = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(k)}, {q(b)}, {q(c)}, {q(d) if d is not None else 'CAST(NULL AS VARCHAR)'})"
    for k, b, c, d in KIND_PRESENTATION
) + ") AS d(kind, badge, colour, description)"

RECENT_ACTIVITY = events_ctes() + f""",
top AS (SELECT * FROM evs ORDER BY ts DESC, source DESC, source_id DESC LIMIT 10),
dim AS ({_DIM})
SELECT t.id, t.kind, coalesce(d.badge, upper(t.kind)) AS badge, coalesce(d.colour, {q(DEFAULT_KIND_COLOUR)}) AS colour,
       coalesce(d.description, {q(DEFAULT_KIND_DESCRIPTION)}) AS description,
       CASE WHEN length(t.what) > 60 THEN substring(t.what, 1, 60) || '…' ELSE t.what END AS summary,
       strftime(t.ts, '%H:%M:%S') AS time_of_day, t.source, t.source_id
FROM top t LEFT JOIN dim d ON d.kind = t.kind
"""


def cooldown_sql(sources: tuple[str, ...] = ("request", "frame", "decision"), as_of: bool = True) -> str:
    return "WITH RECURSIVE " + events_ctes(sources, as_of).lstrip().removeprefix("WITH").lstrip() + """,
seq AS (
  SELECT id, kind, app_name, source, source_id, epoch_us(ts) AS t, requires_decision AS rd,
         row_number() OVER (PARTITION BY kind, app_name ORDER BY ts, source, source_id) AS rn
  FROM evs),
walk(kind, app_name, rn, last_shown, shown) AS (
  SELECT kind, app_name, rn, t, TRUE FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.kind, s.app_name, s.rn,
         CASE WHEN s.rd OR s.t - w.last_shown >= 30000000 THEN s.t ELSE w.last_shown END,
         s.rd OR s.t - w.last_shown >= 30000000
  FROM walk w JOIN seq s ON s.kind = w.kind AND s.app_name = w.app_name AND s.rn = w.rn + 1)
SELECT s.id, s.kind, s.app_name, s.source, s.source_id, w.shown
FROM seq s JOIN walk w ON w.kind = s.kind AND w.app_name = s.app_name AND w.rn = s.rn
"""


ALERT_COOLDOWN = cooldown_sql()


def _responses_sql() -> str:
    cols = {"a": "app_name", "h": "host", "n": "subject", "m": "substring(model, 1, 60)", "l": "labels"}
    why = _messages("rule", cols)[1]
    return policy_core() + f""",
seen AS (SELECT *, {EVENT_SUBJECT} AS subject FROM fin2),
rewritten AS ({REDACT_BODIES})
SELECT s.request_id, s.rule, CASE WHEN blocked THEN 403 END AS status_code,
       CASE WHEN blocked THEN CAST(to_json({{'error': {{'type': 'blocked_by_policy', 'message': why, 'code': 'egress_protection_active'}}}}) AS VARCHAR) END AS block_body,
       CASE WHEN s.rule IN ('R7b', 'R7s', 'R7c', 'R3e') AND coalesce(s.labels, '') <> '' THEN sha256(r.modified_body) END AS modified_sha256
FROM (SELECT *, rule IN ('R4a', 'R4b', 'R1a', 'R1c', 'R2a', 'R2b', 'R5') AS blocked, {why} AS why FROM seen) s
LEFT JOIN rewritten r ON r.request_id = s.request_id
"""


RESPONSES = _responses_sql()


def oracle_sql() -> dict:
    return {
        "alert_cooldown": ALERT_COOLDOWN,
        "stream_events": cooldown_sql(as_of=False),  # frames of a stream: see README
        "policy_responses": RESPONSES,
        "build_events": BUILD_EVENTS,
        "alert_intervals": ALERT_INTERVALS,
        "recent_activity": RECENT_ACTIVITY,
    }
