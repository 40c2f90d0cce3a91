"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: each string derives the same
fixture rows from the driver tables (pre-registered as views) with plain
SQL and computes the result the Spark job must return.
"""

from __future__ import annotations

from ..functions.constants import (
    AI_BODY_SIGNALS,
    AI_PATH_SIGNALS,
    DEFAULT_PLACEHOLDER,
    DETECTION_RULES,
    OPAQUE_CHARSET,
    OPAQUE_MIN_LENGTH,
)
from ..sources.catalogue_data import BUILTIN_CATALOGUE
from ..sources.fixtures import (
    EPOCH_US,
    FIXTURE_BROWSERS,
    FIXTURE_HALFWAY_DECISIONS,
    FIXTURE_HOSTS,
    FIXTURE_MODELS,
    FIXTURE_PATHS,
    HALFWAY_US,
    TIME_COMPRESSION,
)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


# RE2 has no look-ahead: the "unformatted SSN" rule is the same language
# written as alternatives (area not 000/666/9xx, group not 00, serial not 0000).
_SSN_RE2 = (
    r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d{2}|6[0-57-9]\d|66[0-57-9])"
    r"(?:0[1-9]|[1-9]\d)"
    r"(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
)


def re2_rules() -> list[tuple[str, str]]:
    out = []
    for label, pattern, ic in DETECTION_RULES:
        if "(?!" in pattern:
            pattern = _SSN_RE2
        out.append((label, ("(?i)" if ic else "") + pattern))
    return out


def app_name_sql(u: str) -> str:
    return (
        f"CASE WHEN {u} % 10 = 0 THEN {sql_list(FIXTURE_BROWSERS)}[({u} // 10) % {len(FIXTURE_BROWSERS)} + 1] "
        f"ELSE 'app_' || CAST({u} AS VARCHAR) END"
    )


def _json_escape_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    out = f"replace({out}, '\"', '\\\"')"
    out = f"replace({out}, chr(10), '\\n')"
    out = f"replace({out}, chr(13), '\\r')"
    return f"replace({out}, chr(9), '\\t')"


def requests_cte() -> str:
    """SQL body producing the derived request log (see sources.fixtures)."""
    hosts = sql_list([h for h, _ in FIXTURE_HOSTS])
    ports = sql_list([p for _, p in FIXTURE_HOSTS])
    models = sql_list(FIXTURE_MODELS)
    path_case = "CASE " + " ".join(f"WHEN e.event_type = {q(t)} THEN {q(p)}" for t, p in FIXTURE_PATHS) + " ELSE '/' END"
    prompt = "CASE WHEN e.event_id % 9 = 0 THEN repeat(d.text || chr(10), 3) ELSE d.text END"
    model = f"{models}[(e.event_id // 16) % {len(FIXTURE_MODELS)} + 1]"
    obj = f"'{{\"model\": \"' || {model} || '\", \"prompt\": \"' || {_json_escape_sql(prompt)} || '\"}}'"
    body = (
        f"CASE WHEN e.event_id % 50 = 0 THEN '[' || {obj} || ']' "
        f"WHEN e.event_id % 70 = 0 THEN {prompt} ELSE {obj} END"
    )
    return f"""
    SELECT e.event_id AS request_id,
           make_timestamp({EPOCH_US} + (epoch_us(e.ts) - {EPOCH_US}) // {TIME_COMPRESSION}) AS ts,
           CAST(20000 + e.user_id % 40000 AS INTEGER) AS src_port,
           {app_name_sql('e.user_id')} AS app_name,
           {hosts}[e.event_id % {len(FIXTURE_HOSTS)} + 1] AS host,
           {path_case} AS path,
           CAST({ports}[e.event_id % {len(FIXTURE_HOSTS)} + 1] AS INTEGER) AS dst_port,
           coalesce({body}, '') AS body,
           e.user_id AS user_id,
           {prompt} AS prompt
    FROM events e
    LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
    """


def decisions_cte() -> str:
    start = f"make_timestamp({EPOCH_US})"
    half = f"make_timestamp({HALFWAY_US})"
    parts = []
    plans = [
        ("u.user_id % 10 BETWEEN 1 AND 4", start, "approve", 0),
        ("u.user_id % 10 = 5", start, "deny", 0),
        ("u.user_id % 10 = 6", half, "approve", 0),
        ("u.user_id % 10 = 7", start, "approve", 0),
        ("u.user_id % 10 = 7", half, "deny", 1),
    ]
    for cond, ts, verdict, seq in plans:
        parts.append(
            f"SELECT u.user_id * 10 + {seq} AS decision_id, {ts} AS ts, CAST(NULL AS VARCHAR) AS event_id, "
            f"'app' AS target, {app_name_sql('u.user_id')} AS key, CAST(NULL AS VARCHAR) AS model, "
            f"{app_name_sql('u.user_id')} AS display_name, {q(verdict)} AS verdict "
            f"FROM (SELECT DISTINCT user_id FROM events) u WHERE {cond}"
        )
    for target, key, model, name, verdict, did in FIXTURE_HALFWAY_DECISIONS:
        m = q(model) if model is not None else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT CAST({did} AS BIGINT), {half}, CAST(NULL AS VARCHAR), {q(target)}, {q(key)}, {m}, "
            f"{q(name)}, {q(verdict)}"
        )
    return "\nUNION ALL\n".join(parts)


def connections_cte() -> str:
    ts_us = f"({EPOCH_US} + (epoch_us(ts) - {EPOCH_US}) // {TIME_COMPRESSION})"
    return f"""
    SELECT make_timestamp({ts_us} - CASE WHEN user_id % 3 = 0 THEN 2000000 ELSE 1000000 END) AS observed_at,
           CAST(20000 + user_id % 40000 AS INTEGER) AS port,
           {app_name_sql('user_id')} AS process
    FROM events
    """


def catalogue_values() -> str:
    rows = []
    for i, (host, name, _paths, local, approved) in enumerate(BUILTIN_CATALOGUE):
        rows.append(f"({q(host)}, {q(name)}, {str(local).upper()}, {str(approved).upper()}, {i})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS c(host, name, local, approved, ord)"


def redaction_chain(src_sql: str, text_expr: str, placeholder: str = DEFAULT_PLACEHOLDER,
                    prefix: str = "rx") -> tuple[str, str, str]:
    """CTE chain redacting ``text_expr`` of relation ``src_sql``.

    Returns (ctes, final_relation, prefix): ``ctes`` is a comma-separated CTE
    list ending in relation ``{prefix}_end`` that carries all source columns
    plus ``{prefix}_text``, ``{prefix}_labels`` (a ', '-joined string) and
    ``{prefix}_n`` (number of rules that hit).
    """
    rules = re2_rules()
    ctes = [
        f"{prefix}0 AS (SELECT *, CASE WHEN NOT (length({text_expr}) > {OPAQUE_MIN_LENGTH} "
        f"AND NOT contains({text_expr}, ' ') AND regexp_full_match({text_expr}, {q('[' + OPAQUE_CHARSET + ']+')})) "
        f"THEN {text_expr} END AS {prefix}_s0 FROM ({src_sql}) src)"
    ]
    for i, (_, pattern) in enumerate(rules, start=1):
        ctes.append(
            f"{prefix}{i} AS (SELECT *, regexp_replace({prefix}_s{i - 1}, {q(pattern)}, {q(placeholder)}, 'g') "
            f"AS {prefix}_s{i} FROM {prefix}{i - 1})"
        )
    n = len(rules)
    labels = ", ".join(
        f"CASE WHEN {prefix}_s{i} <> {prefix}_s{i - 1} THEN {q(label)} END" for i, (label, _) in enumerate(rules, 1)
    )
    count = " + ".join(f"(CASE WHEN {prefix}_s{i} <> {prefix}_s{i - 1} THEN 1 ELSE 0 END)" for i in range(1, n + 1))
    drop = ", ".join(f"{prefix}_s{i}" for i in range(n + 1))
    ctes.append(
        f"{prefix}_end AS (SELECT * EXCLUDE ({drop}), coalesce({prefix}_s{n}, {text_expr}) AS {prefix}_text, "
        f"concat_ws(', ', {labels}) AS {prefix}_labels, CAST({count} AS BIGINT) AS {prefix}_n "
        f"FROM {prefix}{n})"
    )
    return ",\n".join(ctes), f"{prefix}_end", prefix


def ai_path_sql(path: str) -> str:
    return "(" + " OR ".join(f"contains({path}, {q(s)})" for s in AI_PATH_SIGNALS) + ")"


def body_signals_sql(body: str) -> str:
    return "(" + " + ".join(f"CAST(contains({body}, {q(s)}) AS INTEGER)" for s in AI_BODY_SIGNALS) + ")"

