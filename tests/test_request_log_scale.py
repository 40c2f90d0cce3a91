"""What the jobs over the request log read, write and spread."""

import random
from datetime import datetime, timedelta

import pytest

from tollgate.functions import redact
from tollgate.functions.bodies import scan_body
from tollgate.plans import queries as Q
from tollgate.sources import fixtures as fx


@pytest.fixture
def tables(spark, tmp_path):
    """Events and documents with repeated and null ids, and no stored log."""
    t0 = datetime(2024, 1, 1)
    events = [(i, t0 + timedelta(hours=i), i % 7, random.Random(i).choice(["view", "click", "error"])) for i in range(60)]
    events += [events[3], (None, t0, 1, "click"), (61, None, 2, "view")]
    docs = [(i, f'call 555-123-4567 "now" {i}\n') for i in range(9)] + [(3, "again"), (None, "no id")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_bodies_are_built_by_many_tasks(spark, tables):
    stored = fx.requests(spark, tables)
    per_file = {}
    for f in stored.inputFiles():
        per_file[f] = spark.read.parquet(f).count()
    assert max(per_file.values()) < stored.count() and len(per_file) > 1


def test_body_tasks_grow_with_the_bodies(spark, tables):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, None)], "doc_id long, text string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fx._body_parts(spark, docs, 10, 2) == least
    assert fx._body_parts(spark, docs, 100_000_000, 2) > 5 * least


def test_jobs_without_bodies_read_the_same_rows_and_build_none(spark, tables):
    heads = rows(fx.request_heads(spark, tables))
    assert heads == rows(fx.derive_requests(spark, tables).drop("body"))
    for name in ("attribute_apps", "burst_activity"):
        Q.queries()[name](spark, tables).collect()
    assert fx._stored_requests(spark, tables) is None


def test_one_pass_jobs_leave_no_copy_of_the_bodies(spark, tables):
    for name in ("body_labels", "redact_bodies", "read_request_log"):
        fresh = rows(Q.queries()[name](spark, tables))
        assert len(fresh) == 70, name
    assert fx._stored_requests(spark, tables) is None
    before = {n: rows(Q.queries()[n](spark, tables)) for n in ("body_labels", "redact_bodies", "read_request_log")}
    fx.requests(spark, tables)
    for name, was in before.items():
        assert rows(Q.queries()[name](spark, tables)) == was, name


def test_request_lines_are_compressed(spark, tables, monkeypatch):
    import tollgate.sources.readers as readers

    seen, real = [], readers.log_lines
    monkeypatch.setattr(readers, "log_lines", lambda s, n, p, *a: seen.extend(s.read.text(p).inputFiles()) or real(s, n, p, *a))
    Q.queries()["read_request_log"](spark, tables).collect()
    assert seen and all(f.endswith(".gz") for f in seen)


class Counting:
    def __init__(self, rx, runs):
        self.rx, self.runs = rx, runs

    def subn(self, *a):
        self.runs.append(self.rx.pattern)
        return self.rx.subn(*a)


def test_rules_that_cannot_match_do_not_run(monkeypatch):
    runs: list = []
    monkeypatch.setattr(redact, "PY_RULES", [(label, Counting(rx, runs)) for label, rx in redact.PY_RULES])
    text = "In 3 of 12 cases, 100 rows were friendly, high or rough; see page 7, line 2"
    assert redact.py_redact_string(text) == (text, []) and runs == []
    assert scan_body('{"model": "m-1", "prompt": "call 555-123-4567"}')[1] == ["US phone number"]


@pytest.mark.parametrize("placeholder", ["[REDACTED]", "", "9", "dl", "-", "a@"])
def test_guards_are_necessary_conditions(placeholder):
    pieces = ["0", "12", "555", "4567", "٣", "²", " ", "-", ".", ":", "/", "x@y.io", "DL", "dl ", "drıver lic", "dob", "acct",
              "ghs_", "é", "\ud800", "ABCDEF1234", "12345678901", "(", "_"]
    pick = random.Random(7)
    always = [{} for _ in redact.PY_RULES]
    for _ in range(3000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(1, 20)))
        redact._GUARD_CACHE.pop(placeholder, None)
        got = redact.py_redact_string(text, placeholder)
        if placeholder:
            redact._GUARD_CACHE[placeholder] = always
            assert got == redact.py_redact_string(text, placeholder), repr(text)
            redact._GUARD_CACHE.pop(placeholder)


def test_no_body_enters_a_stateful_operator(spark, tmp_path, monkeypatch):
    from tollgate.sources.readers import SCHEMAS
    from tollgate.streaming import stream_policy as sp

    logs = {}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
        logs[name] = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    made, real = [], sp.Endpoints

    class Endpoints(real):
        ADDED = real.ADDED

        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    monkeypatch.setattr(sp, "Endpoints", Endpoints)
    assert " body string" not in sp._HOST and " body string" not in sp._CARRIED
    out = sp.policy_stream(logs["requests"], logs["decisions"], logs["connections"])
    assert made and set(sp.VERDICT_COLUMNS) < set(out.columns)


def test_no_body_enters_the_attribution(spark, monkeypatch):
    from tollgate.plans import policy

    seen = []

    def attributed(reqs, *args, **kw):
        seen.append(reqs.columns)
        return attribute(reqs, *args, **kw)

    attribute = policy.attribute_apps
    monkeypatch.setattr(policy, "attribute_apps", attributed)
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    mail = '{"model": "m", "p": "a@example.org"}'
    requests = [(i, at(10 + i), port, "logged", "api.openai.com", "/v1/chat/completions", 443, body)
                for i, (port, body) in enumerate([(1, mail), (2, mail), (3, mail), (1, "[1]"), (1, ""), (1, None), (1, "x" * 60_000)])]
    verdicts = policy.policy_verdicts(
        spark,
        spark.createDataFrame(requests, "request_id long, ts timestamp, src_port int, app_name string, host string, path string, dst_port int, body string"),
        spark.createDataFrame(
            [(1, at(0), None, "app", "tool", None, "tool", "approve"), (2, at(0), None, "app", "bad", None, "bad", "deny")],
            "decision_id long, ts timestamp, event_id string, target string, key string, model string, display_name string, verdict string",
        ),
        spark.createDataFrame([(at(s), p, name) for s in range(20) for p, name in ((1, "tool"), (2, "bad"))], "observed_at timestamp, port int, process string"),
    )
    got = {r["request_id"]: (r["rule"], r["labels"], r["model"], r["modified_body"] is not None) for r in verdicts.collect()}
    none = ([], None, False)
    assert got == {0: ("R3e", ["email address"], "m", True), 1: ("R2a", *none), 2: ("R2b", *none), 3: ("R8x", *none), 4: ("R9", *none),
                   5: ("R9", *none), 6: ("R7s", *none)}
    assert seen and not any("body" in columns for columns in seen)
