"""DuckDB oracle SQL for the traffic queries.

Plain SQL over the pre-registered driver views: the request, decision and
connection logs are re-derived with the same arithmetic as
``sources.fixtures``; catalogue lookups, first-seen levels, as-of state and
the burst window are written directly in SQL.
"""

from __future__ import annotations

from ..functions.constants import (
    BROWSER_APPS,
    LOCAL_AI_PORTS,
    LOOPBACK_HOSTS,
    SELF_HOSTS,
    DEFAULT_PROXY_PORT,
    UNKNOWN_APP,
)
from ..sources.fixtures import EPOCH_US, FIXTURE_HOSTS
from .oracle import (
    ai_path_sql,
    body_signals_sql,
    catalogue_values,
    connections_cte,
    decisions_cte,
    q,
    redaction_chain,
    requests_cte,
)

URL_HOST_RX = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PREFIX_RX = r"^(?:www\.|chat\.|app\.|web\.)"
_DEPTH_RX = r"^((?:www\.|chat\.|app\.|web\.)*)"
_TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _in(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _base_ctes() -> str:
    return (
        f"requests AS ({requests_cte()}),\n"
        f"decisions AS ({decisions_cte()}),\n"
        f"connections AS ({connections_cte()}),\n"
        f"cat AS ({catalogue_values()})"
    )


def _lookup(src: str, name: str) -> str:
    """CTEs {name}_h (src + c, b, depth) and {name} (+ built-in match)."""
    return f"""
{name}_h AS (
  SELECT x.*, split_part(lower(x.host), ':', 1) AS c,
         CASE WHEN regexp_matches(split_part(lower(x.host), ':', 1), '{_PREFIX_RX}')
              THEN regexp_replace(split_part(lower(x.host), ':', 1), '{_PREFIX_RX}', '') END AS b,
         CAST(length(regexp_extract(split_part(lower(x.host), ':', 1), '{_DEPTH_RX}', 1))
              - length(replace(regexp_extract(split_part(lower(x.host), ':', 1), '{_DEPTH_RX}', 1), '.', ''))
              AS BIGINT) AS depth
  FROM ({src}) x),
{name}_sfx AS (
  SELECT u.c, arg_min(k.host, k.ord) AS shost
  FROM (SELECT DISTINCT c FROM {name}_h) u JOIN cat k ON starts_with(k.host, '.') AND ends_with(u.c, k.host)
  GROUP BY u.c),
{name} AS (
  SELECT h.*,
         CASE WHEN ce.host IS NOT NULL THEN 1 WHEN cb.host IS NOT NULL THEN 3
              WHEN cs.host IS NOT NULL THEN 5 END AS brank,
         coalesce(ce.name, cb.name, cs.name) AS bname,
         coalesce(ce.local, cb.local, cs.local) AS blocal,
         coalesce(ce.approved, cb.approved, cs.approved) AS bapproved,
         coalesce(ce.host, cb.host, cs.host) AS bhost
  FROM {name}_h h
  LEFT JOIN cat ce ON ce.host = h.c
  LEFT JOIN cat cb ON cb.host = h.b
  LEFT JOIN {name}_sfx sx ON sx.c = h.c
  LEFT JOIN cat cs ON cs.host = sx.shost)"""


def _custom_snapshot() -> str:
    return """
ep AS (SELECT lower(key) AS k, key, ts, decision_id, verdict, display_name FROM decisions WHERE target = 'endpoint'),
custom AS (
  SELECT k AS host,
         coalesce(arg_max(CASE WHEN verdict = 'approve' THEN display_name END,
                          CASE WHEN verdict = 'approve' THEN {'ts': ts, 'id': decision_id} END),
                  arg_min(key, {'ts': ts, 'id': decision_id})) AS name,
         arg_max(verdict, {'ts': ts, 'id': decision_id}) = 'approve' AS approved
  FROM ep GROUP BY k)"""


RESOLVE_HOSTS = f"""
WITH {_base_ctes()},
{_custom_snapshot()},
hosts AS (
  SELECT DISTINCT host FROM (
    SELECT regexp_extract(url, '{URL_HOST_RX}', 1) AS host FROM pages
    UNION ALL SELECT host FROM requests) WHERE host <> ''),
{_lookup("SELECT host FROM hosts", "lk")}
SELECT l.host,
       CASE WHEN l.brank = 1 THEN l.bhost WHEN cx.host IS NOT NULL THEN cx.host WHEN l.brank = 3 THEN l.bhost
            WHEN cb.host IS NOT NULL THEN cb.host WHEN l.brank = 5 THEN l.bhost END AS provider_host,
       CASE WHEN l.brank = 1 THEN l.bname WHEN cx.host IS NOT NULL THEN cx.name WHEN l.brank = 3 THEN l.bname
            WHEN cb.host IS NOT NULL THEN cb.name WHEN l.brank = 5 THEN l.bname END AS provider_name,
       CASE WHEN l.brank = 1 THEN l.bapproved WHEN cx.host IS NOT NULL THEN cx.approved WHEN l.brank = 3 THEN l.bapproved
            WHEN cb.host IS NOT NULL THEN cb.approved WHEN l.brank = 5 THEN l.bapproved END AS provider_approved,
       CASE WHEN l.brank = 1 THEN l.blocal WHEN cx.host IS NOT NULL THEN FALSE WHEN l.brank = 3 THEN l.blocal
            WHEN cb.host IS NOT NULL THEN FALSE WHEN l.brank = 5 THEN l.blocal END AS provider_local,
       CASE WHEN l.brank = 1 THEN 'builtin' WHEN cx.host IS NOT NULL THEN 'custom' WHEN l.brank = 3 THEN 'builtin'
            WHEN cb.host IS NOT NULL THEN 'custom' WHEN l.brank = 5 THEN 'builtin' END AS provider_origin,
       CAST(CASE WHEN l.brank = 1 THEN 1 WHEN cx.host IS NOT NULL THEN 2 WHEN l.brank = 3 THEN 3
            WHEN cb.host IS NOT NULL THEN 4 WHEN l.brank = 5 THEN 5 END AS BIGINT) AS match_rank
FROM lk l
LEFT JOIN custom cx ON cx.host = l.c
LEFT JOIN custom cb ON cb.host = l.b
"""

AI_LIKE = f"""
WITH requests AS ({requests_cte()})
SELECT request_id, host, path, {ai_path_sql('path')} AS ai_path,
       CAST({body_signals_sql('body')} AS BIGINT) AS body_signals,
       ({ai_path_sql('path')} OR {body_signals_sql('body')} >= 2) AS ai_like
FROM requests
"""

OVERSIZE = f"""
WITH requests AS ({requests_cte()})
SELECT request_id, app_name, host, CAST(strlen(body) AS BIGINT) AS payload_bytes
FROM requests WHERE strlen(body) > 50000
"""

_MODEL_SQL = """CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.model') = 'VARCHAR'
     THEN nullif(json_extract_string(body, '$.model'), '') END"""

UNUSUAL_MODELS = f"""
WITH requests AS ({requests_cte()}),
decisions AS ({decisions_cte()}),
m AS (SELECT request_id, ts, host, {_MODEL_SQL} AS model FROM requests)
SELECT request_id, host, model, substring(model, 1, 60) AS model_snippet
FROM m
WHERE model IS NOT NULL
  AND (length(model) > 80 OR contains(model, '/') OR starts_with(model, 'http'))
  AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.target = 'model' AND d.verdict = 'approve'
                  AND d.key = m.host AND d.model = m.model AND d.ts <= m.ts)
"""

APPROVAL_SNAPSHOT = f"""
WITH decisions AS ({decisions_cte()}),
{_custom_snapshot()},
apps AS (
  SELECT 'app' AS target, key,
         CASE WHEN arg_max(verdict, {{'ts': ts, 'id': decision_id}}) = 'approve' THEN 'approved' ELSE 'blocked' END AS state,
         CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS models
  FROM decisions WHERE target = 'app' GROUP BY key),
models AS (
  SELECT 'model' AS target, key, 'approved' AS state, CAST(NULL AS VARCHAR) AS name,
         string_agg(DISTINCT model, ',' ORDER BY model) AS models
  FROM decisions WHERE target = 'model' AND verdict = 'approve' AND model IS NOT NULL GROUP BY key)
SELECT * FROM apps
UNION ALL SELECT 'endpoint', host, CASE WHEN approved THEN 'approved' ELSE 'blocked' END, name, NULL FROM custom
UNION ALL SELECT * FROM models
"""


def _known_ctes(lookup_name: str, levels: int = 4) -> str:
    """K table ``kt`` (key, first, name, source) solved level by level."""
    ports = _in([p for p, _ in LOCAL_AI_PORTS])
    parts = [f"""
elig AS (
  SELECT c, b, host, depth, {{'ts': ts, 'kind': 1, 'id': request_id}} AS o
  FROM {lookup_name}
  WHERE brank IS NULL AND {ai_path_sql('path')}
    AND NOT (host IN {_in(LOOPBACK_HOSTS)} AND dst_port IN {ports})
    AND NOT (host IN {_in(SELF_HOSTS)} AND dst_port = {DEFAULT_PROXY_PORT})
    AND lower(host) = c),
kd AS (
  SELECT lower(key) AS key, min({{'ts': ts, 'kind': 0, 'id': decision_id}}) AS first,
         arg_min(key, {{'ts': ts, 'kind': 0, 'id': decision_id}}) AS name, 'decision' AS source
  FROM decisions WHERE target = 'endpoint' GROUP BY 1)"""]
    prev = "kd"
    for d in range(levels):
        if d == 0:
            reg = "SELECT c AS key, min(o) AS first, arg_min(host, o) AS name, 'request' AS source FROM elig WHERE depth = 0 GROUP BY c"
        else:
            reg = (
                f"SELECT e.c AS key, min(e.o) AS first, arg_min(e.host, e.o) AS name, 'request' AS source "
                f"FROM elig e LEFT JOIN {prev} p ON p.key = e.b "
                f"WHERE e.depth = {d} AND (p.first IS NULL OR e.o < p.first) GROUP BY e.c"
            )
        parts.append(
            f"k{d} AS (SELECT key, min(first) AS first, arg_min(name, first) AS name, arg_min(source, first) AS source "
            f"FROM (SELECT key, first, name, source FROM {prev} UNION ALL {reg}) GROUP BY key)"
        )
        prev = f"k{d}"
    parts.append(f"kt AS (SELECT * FROM {prev})")
    return ",\n".join(parts)


DISCOVER = f"""
WITH {_base_ctes()},
{_lookup("SELECT request_id, ts, host, path, CASE WHEN dst_port IS NULL OR dst_port = 0 THEN 443 ELSE dst_port END AS dst_port FROM requests", "lk")},
{_known_ctes("lk")}
SELECT key, strftime(first.ts, {_TS}) AS first_ts, CAST(first.kind AS BIGINT) AS first_kind,
       CAST(first.id AS BIGINT) AS first_id, source, name,
       CAST(length(regexp_extract(key, '{_DEPTH_RX}', 1)) - length(replace(regexp_extract(key, '{_DEPTH_RX}', 1), '.', ''))
            AS BIGINT) AS depth
FROM kt
"""

BURST = f"""
WITH requests AS ({requests_cte()}),
w AS (
  SELECT request_id, app_name, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY app_name ORDER BY ts, request_id) AS rn
  FROM requests),
x AS (
  SELECT request_id, app_name,
         rn - min(rn) OVER (PARTITION BY app_name ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) + 1 AS cnt
  FROM w)
SELECT request_id, app_name, CAST(cnt AS BIGINT) AS burst_count, cnt >= 20 AS burst FROM x
"""

ATTRIBUTE = f"""
WITH requests AS ({requests_cte()}),
connections AS ({connections_cte()})
SELECT r.request_id, r.src_port,
       CASE WHEN c.observed_at IS NOT NULL AND epoch_us(r.ts) - epoch_us(c.observed_at) < 2000000
            THEN c.process ELSE {q(UNKNOWN_APP)} END AS app_name
FROM requests r ASOF LEFT JOIN connections c ON r.src_port = c.port AND r.ts >= c.observed_at
"""

_KIND_SQL = """CASE WHEN body = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'text'
  ELSE CASE json_type(body) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
       WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END"""


def _body_labels_sql() -> str:
    # Every fixture body carries exactly one free-text string, the prompt
    # (the model names hit no rule), so its labels are the body's labels.
    ctes, end, p = redaction_chain(
        f"SELECT request_id, body, prompt, {_KIND_SQL} AS json_kind, {_MODEL_SQL} AS model FROM requests",
        "prompt",
    )
    return f"""
WITH requests AS ({requests_cte()}),
{ctes}
SELECT request_id, json_kind, model, {p}_labels AS labels, {p}_n AS n_labels FROM {end}
"""


BODY_LABELS = _body_labels_sql()


def json_ascii_sql(x: str) -> str:
    """SQL for Python's json.dumps string escaping with ensure_ascii (the
    text between the quotes): escapes, \\uXXXX for all but printable ASCII,
    surrogate pairs above the BMP."""
    ch = (
        "CASE WHEN ch = '\"' THEN '\\\"' WHEN ch = '\\' THEN '\\\\' "
        "WHEN ch = chr(10) THEN '\\n' WHEN ch = chr(13) THEN '\\r' WHEN ch = chr(9) THEN '\\t' "
        "WHEN ch = chr(8) THEN '\\b' WHEN ch = chr(12) THEN '\\f' "
        "WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch "
        "WHEN unicode(ch) < 65536 THEN printf('\\u%04x', unicode(ch)) "
        "ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(ch) - 65536) >> 10), "
        "56320 + ((unicode(ch) - 65536) & 1023)) END"
    )
    return f"CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_transform(string_split({x}, ''), lambda ch: {ch}), '') END"


def _redact_bodies_sql() -> str:
    # Fixture bodies: a {"model", "prompt"} object, a list holding one, or the
    # raw prompt.  A hit re-serialises the parsed body the json.dumps way.
    ctes, end, p = redaction_chain(
        f"SELECT request_id, body, prompt, {_KIND_SQL} AS json_kind, "
        f"CASE WHEN json_valid(body) THEN json_extract_string(body, CASE WHEN {_KIND_SQL} = 'array' "
        f"THEN '$[0].model' ELSE '$.model' END) END AS any_model, {_MODEL_SQL} AS model FROM requests",
        "prompt",
    )
    obj = (f"'{{\"model\": \"' || {json_ascii_sql('any_model')} || '\", \"prompt\": \"' || "
           f"{json_ascii_sql(p + '_text')} || '\"}}'")
    return f"""
WITH requests AS ({requests_cte()}),
{ctes}
SELECT request_id, json_kind, model, {p}_labels AS labels,
       CASE WHEN {p}_n = 0 THEN NULL
            WHEN json_kind = 'text' THEN {p}_text
            WHEN json_kind = 'array' THEN '[' || {obj} || ']'
            ELSE {obj} END AS modified_body
FROM {end}
"""


REDACT_BODIES = _redact_bodies_sql()


def frames_ctes(as_of: bool = True) -> str:
    """CTEs ending in ``fx_end``: one row per outbound frame to a known host
    with app_name and labels (fx_labels).  ``as_of``: hosts known at the frame's
    time and the port's owner (needs decisions, connections, cat, kt); else the
    catalogue after the log and the logged application (needs cat, custom)."""
    hosts = "[" + ", ".join(q(h) for h, _ in FIXTURE_HOSTS) + "]"
    ctes, end, p = redaction_chain(
        "SELECT frame_id, conv_id, host, app_name, provider_name, CASE WHEN json_valid(text) THEN NULL ELSE text END AS t "
        "FROM fknown2", "t", prefix="fx",
    )
    name = """coalesce(CASE WHEN brank = 1 THEN bname WHEN x_name IS NOT NULL THEN x_name WHEN brank = 3 THEN bname
                  WHEN b_name IS NOT NULL THEN b_name WHEN brank = 5 THEN bname END, host)"""
    if as_of:
        # The entry's name at the frame's time, null while the key is unknown.
        def at(key: str) -> str:
            return (f"(SELECT coalesce((SELECT arg_max(d.display_name, {{'ts': d.ts, 'id': d.decision_id}}) FROM decisions d "
                    f"WHERE d.target = 'endpoint' AND d.verdict = 'approve' AND lower(d.key) = k.key AND d.ts <= l.ts), k.name) "
                    f"FROM kt k WHERE k.key = l.{key} AND k.first.ts <= l.ts)")

        named = f"fnamed AS (SELECT l.*, {at('c')} AS x_name, {at('b')} AS b_name FROM flk l)"
        owned = f"""fknown2 AS (
  SELECT f.*, CASE WHEN c.observed_at IS NOT NULL AND epoch_us(f.ts) - epoch_us(c.observed_at) < 2000000
                   THEN c.process ELSE {q(UNKNOWN_APP)} END AS app_name
  FROM fknown f ASOF LEFT JOIN connections c ON f.src_port = c.port AND f.ts >= c.observed_at)"""
    else:
        named = """fnamed AS (
  SELECT l.*, cx.name AS x_name, cb.name AS b_name
  FROM flk l LEFT JOIN custom cx ON cx.host = l.c LEFT JOIN custom cb ON cb.host = l.b)"""
        owned = "fknown2 AS (SELECT *, 'app_' || CAST(conv_id AS VARCHAR) AS app_name FROM fknown)"
    return f"""
fr AS (
  SELECT conv_id * 1000 + turn AS frame_id, conv_id, turn, {hosts}[conv_id % {len(FIXTURE_HOSTS)} + 1] AS host, text,
         make_timestamp({EPOCH_US} + conv_id * 1000000 + turn * 10000) AS ts, CAST(20000 + conv_id % 40000 AS INTEGER) AS src_port
  FROM conversations WHERE role = 'user' AND coalesce(text, '') <> ''),
{_lookup("SELECT frame_id, conv_id, ts, src_port, host, text FROM fr", "flk")},
{named},
fknown AS (
  SELECT frame_id, conv_id, ts, src_port, host, text, {name} AS provider_name
  FROM fnamed WHERE brank IS NOT NULL OR x_name IS NOT NULL OR b_name IS NOT NULL),
{owned},
{ctes}"""


def _frames_sql() -> str:
    return f"""
WITH {_base_ctes()},
{_lookup("SELECT request_id, ts, host, path, CASE WHEN dst_port IS NULL OR dst_port = 0 THEN 443 ELSE dst_port END AS dst_port FROM requests", "lk")},
{_known_ctes("lk")},
{frames_ctes()}
SELECT frame_id, host, app_name, provider_name, fx_labels AS labels, fx_n > 0 AS rewritten FROM fx_end
"""


SCAN_FRAMES = _frames_sql()


def policy_core() -> str:
    """WITH-list (no final SELECT) ending in CTE ``fin2``: one row per
    request with rule, event_kind, labels, model, p_name, cnt, ts, host."""
    ports = _in([p for p, _ in LOCAL_AI_PORTS])
    lookup_src = (
        "SELECT request_id, ts, src_port, app_name AS logged_app, host, path, "
        "CASE WHEN dst_port IS NULL OR dst_port = 0 THEN 443 ELSE dst_port END AS dst_port, body, prompt FROM requests"
    )
    scan_ctes, scan_end, p = redaction_chain(
        "SELECT request_id, CASE WHEN scanned THEN prompt END AS ptxt FROM pre2", "ptxt"
    )
    return f"""
WITH {_base_ctes()},
{_lookup(lookup_src, "lk")},
{_known_ctes("lk")},
dec_ep AS (SELECT lower(key) AS k, ts, decision_id, verdict, display_name FROM decisions WHERE target = 'endpoint'),
st AS (
  SELECT l.*, {{'ts': l.ts, 'kind': 1, 'id': l.request_id}} AS o,
         kx.first AS kx_first, kx.name AS kx_name, kb.first AS kb_first, kb.name AS kb_name,
         (SELECT arg_max(verdict, {{'ts': ts, 'id': decision_id}}) FROM dec_ep d WHERE d.k = l.c AND d.ts <= l.ts) AS cx_verdict,
         (SELECT arg_max(display_name, {{'ts': ts, 'id': decision_id}}) FROM dec_ep d
            WHERE d.k = l.c AND d.ts <= l.ts AND d.verdict = 'approve') AS cx_aname,
         (SELECT arg_max(verdict, {{'ts': ts, 'id': decision_id}}) FROM dec_ep d WHERE d.k = l.b AND d.ts <= l.ts) AS cb_verdict,
         (SELECT arg_max(display_name, {{'ts': ts, 'id': decision_id}}) FROM dec_ep d
            WHERE d.k = l.b AND d.ts <= l.ts AND d.verdict = 'approve') AS cb_aname
  FROM lk l LEFT JOIN kt kx ON kx.key = l.c LEFT JOIN kt kb ON kb.key = l.b),
st2 AS (
  SELECT *,
         coalesce(kx_first < o, FALSE) AS cx_present,
         coalesce(kb_first < o, FALSE) AS cb_present
  FROM st),
pv AS (
  SELECT *,
         CASE WHEN brank = 1 THEN 'builtin' WHEN cx_present THEN 'cx' WHEN brank = 3 THEN 'builtin'
              WHEN cb_present THEN 'cb' WHEN brank = 5 THEN 'builtin' END AS src
  FROM st2),
pv2 AS (
  SELECT *,
         src IS NOT NULL AS known,
         CASE src WHEN 'builtin' THEN bname WHEN 'cx' THEN coalesce(cx_aname, kx_name)
                  WHEN 'cb' THEN coalesce(cb_aname, kb_name) END AS p_name,
         CASE src WHEN 'builtin' THEN bapproved WHEN 'cx' THEN coalesce(cx_verdict = 'approve', FALSE)
                  WHEN 'cb' THEN coalesce(cb_verdict = 'approve', FALSE) END AS p_approved,
         coalesce(src = 'builtin' AND blocal, FALSE) AS p_local,
         ((src IS NULL AND NOT {ai_path_sql('path')})
           OR (host IN {_in(SELF_HOSTS)} AND dst_port = {DEFAULT_PROXY_PORT})) AS r0
  FROM pv),
att AS (
  SELECT v.*,
         CASE WHEN v.r0 THEN v.logged_app
              WHEN c.observed_at IS NOT NULL AND epoch_us(v.ts) - epoch_us(c.observed_at) < 2000000 THEN c.process
              ELSE {q(UNKNOWN_APP)} END AS app_name
  FROM pv2 v ASOF LEFT JOIN connections c ON v.src_port = c.port AND v.ts >= c.observed_at),
app AS (
  SELECT a.*,
         (SELECT arg_max(verdict, {{'ts': ts, 'id': decision_id}}) FROM decisions d
            WHERE d.target = 'app' AND d.key = a.app_name AND d.ts <= a.ts) AS app_verdict,
         a.app_name IN {_in(BROWSER_APPS)} AS is_browser
  FROM att a),
pre AS (
  SELECT *,
         CASE WHEN r0 THEN 'R0'
              WHEN p_local THEN 'R4a'
              WHEN host IN {_in(LOOPBACK_HOSTS)} AND dst_port IN {ports} THEN 'R4b'
              WHEN NOT known AND ({ai_path_sql('path')} OR {body_signals_sql('body')} >= 2) THEN 'R1a'
              WHEN NOT known THEN 'R1b'
              WHEN NOT coalesce(p_approved, FALSE) THEN 'R1c'
              WHEN NOT is_browser AND app_verdict = 'deny' THEN 'R2a'
              WHEN NOT is_browser AND (app_verdict IS NULL OR app_verdict <> 'approve') THEN 'R2b'
         END AS pre_rule
  FROM app),
pre2 AS (SELECT *, pre_rule IS NULL AND body <> '' AS scanned FROM pre),
{scan_ctes},
mid AS (
  SELECT x.*, coalesce(s.{p}_labels, '') AS labels,
         CASE WHEN x.scanned THEN {_KIND_SQL} END AS json_kind,
         CASE WHEN x.scanned THEN {_MODEL_SQL} END AS model
  FROM pre2 x JOIN {scan_end} s ON s.request_id = x.request_id),
mid2 AS (
  SELECT *,
         coalesce(pre_rule,
           CASE WHEN body <> '' AND json_kind IN ('array', 'string', 'number', 'boolean', 'null') THEN 'R8x'
                WHEN model IS NOT NULL
                     AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.target = 'model' AND d.verdict = 'approve'
                                     AND d.key = mid.host AND d.model = mid.model AND d.ts <= mid.ts)
                     AND (length(model) > 80 OR contains(model, '/') OR starts_with(model, 'http')) THEN 'R5'
                WHEN is_browser THEN 'R7b'
                WHEN strlen(body) > 50000 THEN 'R7s' END) AS rule1
  FROM mid),
rem AS (
  SELECT request_id, app_name, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY app_name ORDER BY ts, request_id) AS rn
  FROM mid2 WHERE rule1 IS NULL),
rem2 AS (
  SELECT request_id,
         rn - min(rn) OVER (PARTITION BY app_name ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) + 1 AS cnt
  FROM rem),
fin AS (
  SELECT m.*, r.cnt,
         coalesce(m.rule1, CASE WHEN r.cnt >= 20 THEN 'R7c' WHEN m.labels <> '' THEN 'R3e' ELSE 'R9' END) AS rule
  FROM mid2 m LEFT JOIN rem2 r ON r.request_id = m.request_id),
fin2 AS (
  SELECT *,
         CASE WHEN rule IN ('R4a', 'R4b') THEN 'new_local_model'
              WHEN rule IN ('R1a', 'R1c') THEN 'blocked_unknown_endpoint'
              WHEN rule IN ('R2a', 'R2b') THEN 'blocked_unknown_app'
              WHEN rule = 'R5' THEN 'blocked_unknown_model'
              WHEN rule IN ('R7s', 'R7c') THEN 'suspicious_activity'
              WHEN rule = 'R3e' OR (rule = 'R7b' AND labels <> '') THEN 'redacted_sensitive_data' END AS event_kind
  FROM fin)"""


PORT_CASE = "CASE dst_port " + " ".join(f"WHEN {p} THEN {q(n)}" for p, n in LOCAL_AI_PORTS) + " END"
EVENT_SUBJECT = f"CASE WHEN event_kind IS NULL THEN NULL WHEN rule = 'R4b' THEN {PORT_CASE} WHEN rule = 'R1a' THEN host ELSE p_name END"


def _policy_sql() -> str:
    return policy_core() + f"""
SELECT request_id, app_name, rule,
       rule NOT IN ('R4a', 'R4b', 'R1a', 'R1c', 'R2a', 'R2b', 'R5') AS allowed,
       event_kind,
       CASE WHEN event_kind IS NOT NULL THEN rule IN ('R4a', 'R4b', 'R1a', 'R2b', 'R5') END AS requires_decision,
       {EVENT_SUBJECT} AS provider_name,
       CASE WHEN rule = 'R5' THEN model END AS event_model,
       labels,
       CAST(cnt AS BIGINT) AS burst_count
FROM fin2
"""


POLICY = _policy_sql()


MERGE_CATALOGUE = f"""
WITH {_base_ctes()},
{_lookup("SELECT request_id, ts, host, path, CASE WHEN dst_port IS NULL OR dst_port = 0 THEN 443 ELSE dst_port END AS dst_port FROM requests", "lk")},
{_known_ctes("lk")},
ep AS (SELECT lower(key) AS k, ts, decision_id, verdict, display_name FROM decisions WHERE target = 'endpoint'),
last_v AS (SELECT k, arg_max(verdict, {{'ts': ts, 'id': decision_id}}) AS verdict FROM ep GROUP BY k),
last_ok AS (SELECT k, arg_max(display_name, {{'ts': ts, 'id': decision_id}}) AS ok_name FROM ep WHERE verdict = 'approve' GROUP BY k),
custom AS (
  SELECT kt.key AS host, coalesce(o.ok_name, kt.name) AS name, coalesce(v.verdict = 'approve', FALSE) AS approved,
         FALSE AS local, 'custom' AS origin, epoch_us(kt.first.ts) AS ord
  FROM kt LEFT JOIN last_v v ON v.k = kt.key LEFT JOIN last_ok o ON o.k = kt.key),
ph AS (SELECT DISTINCT regexp_extract(url, '{URL_HOST_RX}', 1) AS host FROM pages),
remote AS (SELECT host, name, approved, local FROM cat UNION ALL SELECT host, host, TRUE, FALSE FROM ph WHERE host <> ''),
added AS (
  SELECT host, name, approved, local, 'remote' AS origin, CAST(NULL AS BIGINT) AS ord FROM remote
  WHERE host NOT IN (SELECT host FROM cat) AND host NOT IN (SELECT host FROM custom))
SELECT host, name, approved, local, 'builtin' AS origin, CAST(ord AS BIGINT) AS ord, CAST(0 AS BIGINT) AS origin_rank FROM cat
UNION ALL SELECT host, name, approved, local, origin, ord, CAST(1 AS BIGINT) FROM custom
UNION ALL SELECT host, name, approved, local, origin, ord, CAST(2 AS BIGINT) FROM added
"""


def arrivals_sql(parts: int, lateness_s: int) -> str:
    """The class of every request, from the newest event time of the parts that
    came before its own (requests and decisions)."""
    return f"""
WITH {_base_ctes()},
span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM requests),
came AS (
  SELECT request_id, epoch_us(ts) // 1000 AS ms,
         CAST(floor((epoch_us(ts) - lo) * {parts} / (hi - lo + 1)) AS INT)
         + CASE WHEN request_id % 35 = 0 THEN 2 WHEN request_id % 5 = 0 THEN 1 ELSE 0 END AS k
  FROM requests, span
  UNION ALL
  SELECT NULL, epoch_us(ts) // 1000, CAST(least(greatest(floor((epoch_us(ts) - lo) * {parts} / (hi - lo + 1)), 0), {parts - 1}) AS INT)
  FROM decisions, span),
newest AS (SELECT k, max(ms) AS ms FROM came GROUP BY k),
known AS (SELECT a.k, max(b.ms) AS ms FROM newest a LEFT JOIN newest b ON b.k < a.k GROUP BY a.k)
SELECT request_id,
       CASE WHEN known.ms IS NULL OR came.ms >= known.ms THEN 'on_time' WHEN came.ms >= known.ms - {lateness_s * 1000} THEN 'late' ELSE 'rejected' END AS arrival,
       known.ms IS NULL OR came.ms >= known.ms - {lateness_s * 1000} AS judged
FROM came JOIN known USING (k) WHERE request_id IS NOT NULL
"""


READ_REQUESTS = f"""
WITH {_base_ctes()},
lines AS (SELECT *, request_id % 97 = 0 OR request_id % 101 = 0 AS broken FROM requests)
SELECT CASE WHEN NOT broken THEN request_id END AS request_id, CASE WHEN NOT broken THEN epoch_us(ts) END AS ts_us,
       CASE WHEN NOT broken THEN app_name END AS app_name, CASE WHEN NOT broken THEN host END AS host, CASE WHEN NOT broken THEN path END AS path,
       CASE WHEN NOT broken THEN CAST(dst_port AS BIGINT) END AS dst_port, CASE WHEN NOT broken THEN sha256(body) END AS body_sha256, broken
FROM lines
"""
