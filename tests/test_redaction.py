"""Detection rules: one positive and one negative case each, both engines;
plus the ordered-chain traps (T2-T4, T11, T12) and the two upstream unit
cases (opaque payload untouched, e-mail in JSON redacted)."""

import json

import pytest
from pyspark.sql import functions as F

from tollgate.functions.bodies import scan_body
from tollgate.functions.constants import DEFAULT_PLACEHOLDER as PH
from tollgate.functions.redact import py_redact_string, redact_text

# (label, positive text, negative text)
CASES = [
    ("email address", "write to jane.doe@example.org today", "write to jane.doe at example"),
    ("US phone number", "call 415-555-0134 now", "call 415-55-0134 now"),
    ("Social Security Number", "ssn: 123-45-678x and 078-05-1120", "no number 12-345-6789x"),
    ("unformatted SSN", "id 123456789 end", "id 000123456 end"),
    ("Employer ID Number (EIN)", "ein 12-3456789 end", "ein 12-345678 end"),
    ("US passport number", "passport X12345678 ok", "passport x1234567 ok"),
    ("driver license (generic)", "DL: ABC123456 issued", "DLX ABC issued"),
    ("date of birth", "DOB 01/02/1990", "dob unknown"),
    ("credit card number", "card 4111 1111 1111 1111 exp", "card 4111 1111 1111 exp"),
    ("bank routing number", "routing: 021000021 ok", "routing: 02100002 ok"),
    ("bank account number", "account number: 12345678 ok", "account number: 1234 ok"),
    ("IBAN", "iban GB82WEST12345698765432 ok", "iban GB82 WEST ok"),
    ("API key or token", "use sk-abcdefghijklmnopqrstuvwxyz12 please", "use sk-short please"),
    ("GitHub token", "token ghp_" + "a" * 36 + " end", "token ghp_" + "a" * 10 + " end"),
    ("Slack token", "xoxb-abcdefghijkl ok", "xoxz-abcdefghijkl ok"),
    ("Stripe key", "sk_live_" + "A" * 24 + " ok", "sk_prod_" + "A" * 24 + " ok"),
    ("Google API key", "key AIza" + "B" * 35 + " ok", "key AIza" + "B" * 20 + " ok"),
    ("private key", "-----BEGIN RSA PRIVATE KEY-----\nMII", "-----BEGIN PUBLIC KEY-----"),
    ("AWS access key", "AKIA" + "ABCDEFGHIJKLMNOP" + " ok", "AKIA" + "abc" + " ok"),
    ("AWS secret key", "aws_secret = " + "a" * 40 + " ok", "aws_secret_access_key = " + "a" * 40),
    ("JWT token", "t eyJhbGc.eyJzdWIi.sig_part ok", "t eyJhbGc ok"),
    ("password field", 'cfg {"password": "hunter22"}', 'cfg {"password": "abc"}'),
    ("IP address", "host 192.168.1.20 up", "host 999.1.1.1.1x up"),
    ("MAC address", "mac 00:1A:2b:3C:4d:5E ok", "mac 00:1A:2b ok"),
]


def _native(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = redact_text(df, "t").orderBy("id").collect()
    return [(r["redacted_text"], list(r["redacted_fields"])) for r in out]


@pytest.mark.parametrize("label,pos,neg", CASES, ids=[c[0] for c in CASES])
def test_rule_positive_negative_python(label, pos, neg):
    assert label in py_redact_string(pos)[1]
    assert label not in py_redact_string(neg)[1]


def test_rules_native_equals_python(spark):
    texts = [t for _, p, n in CASES for t in (p, n)]
    texts += ["DL(555) 123-4567", "4155550134", "É123-45-6789", "ſecret", None]
    native = _native(spark, texts)
    for t, (nt, nl) in zip(texts, native):
        if t is None:
            assert nt is None and nl == []
            continue
        assert (nt, nl) == py_redact_string(t), t


def test_chain_runs_on_rewritten_text():
    # Rule 8 matches inside the placeholder left by rule 2.
    text, labels = py_redact_string("DL(555) 123-4567")
    assert labels == ["US phone number", "driver license (generic)"]
    assert text.count("REDACTED") == 1 and text.endswith("]]")


def test_unformatted_phone_never_fires():
    # T4: every 10-digit run is taken by the US phone rule first.
    assert py_redact_string("call 4155550134")[1] == ["US phone number"]


def test_opaque_payload_untouched():
    body = json.dumps({"ciphertext": "A" * 120})
    new, labels, kind, _ = scan_body(body)
    assert new is None and labels == [] and kind == "object"


def test_human_readable_pii_redacted():
    body = json.dumps({"message": "email me at test@example.com"})
    new, labels, kind, _ = scan_body(body)
    assert PH in json.loads(new)["message"] and "email address" in labels


def test_json_mode_scans_values_only():
    # Keys and numbers are not scanned; the same text as raw is.
    assert scan_body('{"password": "hunter22"}')[1] == []
    assert scan_body('{"password": "hunter22"')[1] == ["password field"]
    assert scan_body("4111111111111111")[1] == []


def test_labels_keep_duplicates_and_order():
    # T11
    body = json.dumps({"a": "x@y.io", "b": ["1.2.3.4", "p@q.io"]})
    assert scan_body(body)[1] == ["email address", "IP address", "email address"]


def test_unchanged_body_not_rewritten_and_ascii_escaped():
    # T12
    assert scan_body('{"a":  "héllo"}')[0] is None
    new = scan_body('{"a": "héllo x@y.io"}')[0]
    assert new == '{"a": "h\\u00e9llo ' + PH + '"}'


def test_non_object_json_kinds():
    assert scan_body("[1, 2]")[2] == "array"
    assert scan_body('"just a string"')[2] == "string"
    assert scan_body("null")[2] == "null"
    assert scan_body("NaN")[2] == "number"
    assert scan_body("not json at all")[2] == "text"
    assert scan_body('{"model": 5}')[3] is None
    assert scan_body('{"model": "a/b"}')[3] == "a/b"


def _unguarded(text, placeholder=PH):
    from tollgate.functions.redact import PY_RULES, py_is_opaque

    if py_is_opaque(text):
        return text, []
    labels = []
    for label, rx in PY_RULES:
        new, n = rx.subn(lambda _m: placeholder, text)
        if n:
            labels.append(label)
            text = new
    return text, labels


def test_guards_never_change_results():
    import duckdb

    texts = [r[0] for r in duckdb.sql(
        "SELECT text FROM '/root/testdata/sf0.01/documents.parquet' "
        "UNION ALL SELECT text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall() if r[0]]
    texts += [t for _, p, n in CASES for t in (p, n)]
    texts += ["DRİVER LIC ABC12345", "ſecret_access_key = " + "a" * 40, "AKIA" + "Q" * 16]
    for t in texts:
        assert py_redact_string(t) == _unguarded(t)
    for ph in ("<PII 1>", "-", "x", "@"):
        for t in texts[:50] + texts[-30:]:
            assert py_redact_string(t, ph) == _unguarded(t, ph), (ph, t[:80])


def test_multiword_placeholder_both_engines(spark):
    ph = "[REDACTED BY PROXY]"
    texts = ["DL(555) 123-4567", "call 415-555-0134 or mail a@b.io", "born 01/02/1990 acct 12345678"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    native = [(r["redacted_text"], list(r["redacted_fields"]))
              for r in redact_text(df, "t", placeholder=ph).orderBy("id").collect()]
    assert native == [py_redact_string(t, ph) for t in texts] == [_unguarded(t, ph) for t in texts]
    assert native[0] == ("[REDACTED BY PROXY] BY PROXY]", ["US phone number", "driver license (generic)"])
