"""The training-data pipeline: stages over ``documents``, each one of the
operators of ``tollgate.llm`` applied to everything its predecessor kept.

Every stage takes (spark, docs, sf_dir) and all but the last return the
columns of ``documents``.  Each result is written as Parquet to the shared
folder and read back as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import bpe, mixing, ngram_join, pii, quality_lm
from tollgate.llm.common import prepare, stored
from tollgate.llm.queries import MAX_REPEATS, PUBLIC_KEY, vocabulary
from tollgate.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps."""
    prepare(spark)
    return quality_lm.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return ngram_join.deduplicated(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    prepare(spark)
    return pii.replace(docs, PUBLIC_KEY).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, scarce sources' documents again in
    further epochs, up to ``MAX_REPEATS`` uses on average."""
    prepare(spark)
    return mixing.mixed(docs, max_repeats=MAX_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document."""
    prepare(spark)
    path = vocabulary("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", surrogates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: A language model and keyed surrogates have no SQL form; tests/llm holds the
#: pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
