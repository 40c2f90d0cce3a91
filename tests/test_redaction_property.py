"""Property: the JVM rule chain equals the Python rule chain on random text
built from rule-relevant pieces (digits incl. non-ASCII ones, separators,
keywords, case-fold letters)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tollgate.functions.redact import py_redact_string, redact_text

PIECES = [
    "0", "1", "4", "5", "9", "123", "4111", "555", "٣", "۷", " ", "  ", "\n", "\t", "-", ".", ":", "/", "@",
    "(", ")", "+1", "_", '"', "=", "#", "a", "Z", "é", "ſ", "K", "ı", "İ", "DL", "dob", "born", "acct",
    "account", "routing", "aba", "api_key", "Bearer ", "sk-", "ghp_", "xoxb-", "sk_live_", "AIza", "AKIA",
    "eyJ", "secret", "password", '"token"', "-----BEGIN RSA PRIVATE KEY-----", "x@y.io", "10.0.0.1",
    "00:1a:2b:3c:4d:5e", "GB82WEST12345698765432", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
]


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=40).map("".join),
                min_size=300, max_size=300))
def test_native_chain_equals_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = redact_text(df, "t").orderBy("id").collect()
    for t, r in zip(texts, got):
        assert (r["redacted_text"], list(r["redacted_fields"])) == py_redact_string(t), repr(t)
