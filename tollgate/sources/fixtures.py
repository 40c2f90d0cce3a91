"""Request, decision, connection and frame logs derived from the driver tables.

The driver ships generic tables (``events``, ``documents``,
``conversations``); the traffic jobs need request logs.  These builders
derive them with deterministic integer arithmetic, so the DuckDB oracle
(``plans.oracle``) builds the very same rows.  Every derived log grows with
the tables it comes from.

Specification (also in FIXTURES.md §4):

* requests: one per ``events`` row.  ``ts`` is compressed 10 000x from
  2024-01-01 (30 days -> about 259 s) so bursts occur.  ``host`` cycles a
  16-entry list by ``event_id``; ``path`` follows ``event_type``; ``body``
  is a flat JSON object ``{"model": m, "prompt": p}`` where ``p`` is the
  text of document ``event_id % count(documents)`` (three copies when
  ``event_id % 9 = 0``), every 50th body is a JSON list and every 70th the
  raw prompt text.
* decisions: app decisions per ``user_id % 10`` plus a few endpoint and
  model decisions half-way.
* connections: one socket snapshot per request, 1 s before it, or exactly
  2 s before it for ``user_id % 3 = 0`` (outside the strict 2 s tolerance).
* frames: conversation turns sent to the host ``conv_id % 16``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tables import table

LOG_VERSION = "v2"

# Fixture parameters (this project's own test-log design).
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC in microseconds
TIME_COMPRESSION = 10_000
HALFWAY_US = EPOCH_US + (15 * 86_400 * 1_000_000) // TIME_COMPRESSION

FIXTURE_HOSTS: list[tuple[str, int]] = [
    ("api.openai.com", 443),
    ("api.anthropic.com", 443),
    ("www.perplexity.ai", 443),
    ("chat.mistral.ai", 443),
    ("contoso.openai.azure.com", 443),
    ("localhost", 11434),
    ("api.groq.com", 443),
    ("gateway.acme-llm.com", 443),
    ("chat.gateway.acme-llm.com", 443),
    ("API.Mistral.AI", 443),
    ("www.bing.com", 443),
    ("127.0.0.1", 9000),
    ("generativelanguage.googleapis.com", 443),
    ("::1", 11434),
    ("inference.ml-lab.org", 443),
    ("www.claude.ai", 443),
]
FIXTURE_MODELS: list[str] = [
    "gpt-4o-mini", "claude-3-5-sonnet", "mistral-large-latest", "llama3.1",
    "gemini-1.5-pro", "command-r-plus", "acme/finetune-v2", "https://models.acme.test/v1/custom",
]
FIXTURE_PATHS: list[tuple[str, str]] = [
    ("view", "/"),
    ("click", "/v1/chat/completions"),
    ("purchase", "/api/generate"),
    ("signup", "/account"),
    ("error", "/v1/embeddings"),
]
FIXTURE_BROWSERS: list[str] = ["chrome.exe", "Safari", "Firefox", "msedge.exe"]
# (target, key, model, display_name, verdict, decision_id)
FIXTURE_HALFWAY_DECISIONS: list[tuple[str, str, str | None, str, str, int]] = [
    ("endpoint", "gateway.acme-llm.com", None, "Acme LLM Gateway", "approve", 9_000_000_001),
    ("endpoint", "inference.ml-lab.org", None, "ML Lab Inference", "approve", 9_000_000_002),
    ("endpoint", "contoso.openai.azure.com", None, "Azure OpenAI", "deny", 9_000_000_003),
    ("model", "api.openai.com", "acme/finetune-v2", "OpenAI", "approve", 9_000_000_004),
]


def _pick(index: F.Column, values: list) -> F.Column:
    """values[index] for a small literal list (evaluated in codegen)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def app_name_col(user_id: F.Column) -> F.Column:
    return F.when(
        user_id % 10 == 0, _pick(F.floor(user_id / 10) % len(FIXTURE_BROWSERS), FIXTURE_BROWSERS)
    ).otherwise(F.concat(F.lit("app_"), user_id.cast("string")))


def json_escape(text: F.Column) -> F.Column:
    """Minimal JSON string escaping (the corpora hold no other control characters)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    out = F.replace(out, F.lit("\r"), F.lit("\\r"))
    return F.replace(out, F.lit("\t"), F.lit("\\t"))


def compressed_ts(ts: F.Column) -> F.Column:
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(F.lit(EPOCH_US) + F.floor((us - F.lit(EPOCH_US)) / TIME_COMPRESSION).cast("long"))


#: Bytes of bodies that one task builds and writes, about.
BODY_BYTES_PER_TASK = 64 << 20


def _body_parts(spark: SparkSession, docs: DataFrame, n_events: int, n_docs: int) -> int:
    """Tasks that build the bodies: by the texts' mean size and the events."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_events * size // max(n_docs, 1) // BODY_BYTES_PER_TASK))


def derive_requests(spark: SparkSession, sf_dir: str, bodies: bool = True) -> DataFrame:
    """Derived request log: request_id, ts, src_port, app_name, host, path,
    dst_port, body (schema of FIXTURES.md §2); without ``bodies`` the same
    rows less that column (the join then moves ids alone)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.count()  # parquet footer count: a scalar, no data moved
    parts = _body_parts(spark, docs, events.count(), n_docs) if bodies else int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = events.select(
        F.col("event_id").alias("request_id"),
        compressed_ts(F.col("ts")).alias("ts"),
        F.col("user_id"),
        F.col("event_type"),
        (F.col("event_id") % F.lit(max(n_docs, 1))).alias("doc_id"),
    )
    # Hash join on doc_id: both sides are large at scale; doc_id is uniform.
    # The rows are narrow here and grow by their texts in the join: they are
    # spread by the size of the bodies, not by that of the events' file.
    joined = ev.repartition(parts, "doc_id").join(docs, "doc_id", "left")
    host_idx = F.col("request_id") % len(FIXTURE_HOSTS)
    model = _pick(F.floor(F.col("request_id") / 16) % len(FIXTURE_MODELS), FIXTURE_MODELS)
    prompt = F.when(F.col("request_id") % 9 == 0, F.repeat(F.concat(F.col("text"), F.lit("\n")), 3)).otherwise(
        F.col("text")
    )
    obj = F.concat(
        F.lit('{"model": "'), model, F.lit('", "prompt": "'), json_escape(prompt), F.lit('"}')
    )
    body = (
        F.when(F.col("request_id") % 50 == 0, F.concat(F.lit("["), obj, F.lit("]")))
        .when(F.col("request_id") % 70 == 0, prompt)
        .otherwise(obj)
    )
    path = F.coalesce(
        *[F.when(F.col("event_type") == F.lit(t), F.lit(p)) for t, p in FIXTURE_PATHS], F.lit("/")
    )
    rows = joined.select(
        F.col("request_id"),
        F.col("ts"),
        (F.lit(20000) + F.col("user_id") % 40000).cast("int").alias("src_port"),
        app_name_col(F.col("user_id")).alias("app_name"),
        _pick(host_idx, [h for h, _ in FIXTURE_HOSTS]).alias("host"),
        path.alias("path"),
        _pick(host_idx, [p for _, p in FIXTURE_HOSTS]).cast("int").alias("dst_port"),
        F.coalesce(body, F.lit("")).alias("body"),
    )
    return rows if bodies else rows.drop("body")


def derive_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived decision log (decision_id, ts, event_id, target, key, model,
    display_name, verdict)."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    start = F.timestamp_micros(F.lit(EPOCH_US))
    half = F.timestamp_micros(F.lit(HALFWAY_US))
    # (condition on user_id % 10, ts, verdict, sequence) — one row each
    plans = [
        ((u % 10 >= 1) & (u % 10 <= 4), start, "approve", 0),
        (u % 10 == 5, start, "deny", 0),
        (u % 10 == 6, half, "approve", 0),
        (u % 10 == 7, start, "approve", 0),
        (u % 10 == 7, half, "deny", 1),
    ]
    app_rows = None
    for cond, ts, verdict, seq in plans:
        part = users.filter(cond).select(
            (u * 10 + seq).alias("decision_id"),
            ts.alias("ts"),
            F.lit(None).cast("string").alias("event_id"),
            F.lit("app").alias("target"),
            app_name_col(u).alias("key"),
            F.lit(None).cast("string").alias("model"),
            app_name_col(u).alias("display_name"),
            F.lit(verdict).alias("verdict"),
        )
        app_rows = part if app_rows is None else app_rows.unionByName(part)
    fixed = spark.createDataFrame(
        [(did, None, t, k, m, d, v) for t, k, m, d, v, did in FIXTURE_HALFWAY_DECISIONS],
        "decision_id long, event_id string, target string, key string, model string, "
        "display_name string, verdict string",
    ).withColumn("ts", half)
    return app_rows.unionByName(fixed)


def derive_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket snapshots: observed_at, port, process."""
    events = table(spark, sf_dir, "events").select("ts", "user_id")
    u = F.col("user_id")
    lag_us = F.when(u % 3 == 0, F.lit(2_000_000)).otherwise(F.lit(1_000_000))
    ts_us = F.unix_micros(compressed_ts(F.col("ts")))
    return events.select(
        F.timestamp_micros(ts_us - lag_us).alias("observed_at"),
        (F.lit(20000) + u % 40000).cast("int").alias("port"),
        app_name_col(u).alias("process"),
    )


def derive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WebSocket frame log from conversations: frame_id, ts, src_port,
    app_name, host, from_client, content (binary)."""
    conv = table(spark, sf_dir, "conversations")
    c = F.col("conv_id")
    return conv.select(
        (c * 1000 + F.col("turn")).alias("frame_id"),
        F.timestamp_micros(F.lit(EPOCH_US) + c * 1_000_000 + F.col("turn") * 10_000).alias("ts"),
        (F.lit(20000) + c % 40000).cast("int").alias("src_port"),
        F.concat(F.lit("app_"), c.cast("string")).alias("app_name"),
        _pick(c % len(FIXTURE_HOSTS), [h for h, _ in FIXTURE_HOSTS]).alias("host"),
        (F.col("role") == "user").alias("from_client"),
        F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("content"),
    )


# ---------------------------------------------------------------------------
# Stored form.  A request log is a table in real use; the derived logs are
# written once as parquet under the shared checkpoint folder and read back,
# so every job gets column pruning / filter pushdown on them and nothing
# re-derives (or, through predicate pushdown, re-inlines) the body build.
# ---------------------------------------------------------------------------

_BUILDERS = {
    "requests": derive_requests,
    "decisions": derive_decisions,
    "connections": derive_connections,
    "frames": derive_frames,
}


def _source_stamp(spark: SparkSession, sf_dir: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = [LOG_VERSION, sf_dir]
    for name in ("events", "documents", "conversations", "pages"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            st = fs.getFileStatus(p)
            parts.append(f"{name}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def stored_path(spark: SparkSession, sf_dir: str, name: str, per_run: bool = False) -> str:
    """Folder of a derived table.  Inputs are keyed by the source state and
    shared by later runs; ``per_run`` tables (job outputs such as the event
    sink) are keyed by the application too, so every run computes them."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"/{spark.sparkContext.applicationId}" if per_run else ""
    return f"{base}/tollgate-logs/{_source_stamp(spark, sf_dir)}{run}/{name}"


def path_done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(done.getFileSystem(conf).exists(done))


def _completed_attempt(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = sorted(st.getPath().getName() for st in fs.listStatus(root) if st.isDirectory())
    for name in names:
        if name.startswith("attempt-") and path_done(spark, f"{path}/{name}"):
            return f"{path}/{name}"
    return None


def stored_log(spark: SparkSession, sf_dir: str, name: str, builder=None, per_run: bool = False) -> DataFrame:
    """The derived table ``name``, materialised once per source state
    (``builder(spark, sf_dir)`` makes it; default: the log builders above).

    Every writer uses its own attempt folder and readers take a completed
    one (``_SUCCESS``), so concurrent or retried writers never clobber each
    other and a crashed partial write is ignored."""
    import uuid

    path = stored_path(spark, sf_dir, name, per_run=per_run)
    done = _completed_attempt(spark, path)
    if done is None:
        attempt = f"{path}/attempt-{uuid.uuid4().hex[:12]}"
        (builder or _BUILDERS[name])(spark, sf_dir).write.mode("errorifexists").option("compression", "zstd").parquet(attempt)
        done = _completed_attempt(spark, path) or attempt
    return spark.read.parquet(done)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_log(spark, sf_dir, "requests")


def _stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    done = _completed_attempt(spark, stored_path(spark, sf_dir, "requests"))
    return None if done is None else spark.read.parquet(done)


def request_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the request log without their bodies, for the jobs that read
    none: they neither build nor write the texts."""
    stored = _stored_requests(spark, sf_dir)
    if stored is not None:
        return stored.drop("body")
    return stored_log(spark, sf_dir, "request_heads", lambda spark, sf_dir: derive_requests(spark, sf_dir, bodies=False))


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log for a job that reads every body once: the stored log if
    there is one, else its rows as they are built, without a copy on disk."""
    stored = _stored_requests(spark, sf_dir)
    return stored if stored is not None else derive_requests(spark, sf_dir)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_log(spark, sf_dir, "decisions")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_log(spark, sf_dir, "connections")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_log(spark, sf_dir, "frames")
