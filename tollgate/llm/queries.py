"""The registered ``opN_`` queries: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .common import prepare
from .oracle import COSINE_SQL, DIALOGUE_SQL, JACCARD_SQL, MIXING_SQL, REVISIT_SQL, SUBSTRING_SQL, VARIANTS_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file (the default of each path parameter)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The most often that a source's documents are used.
MAX_REPEATS = 1.5


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import schedule

    out = schedule(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)
    return out.select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "epoch", "block", F.round("at", 9).alias("at"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lm import classify

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    path = vocabulary("byte_bpe_50k.json")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_pca_tiled_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import header_block, page_records, resolve

    out = resolve(page_records(table(spark, sf_dir, "pages")))
    return out.select(
        "record_id", "url", "ref_id", "outcome",
        F.sha2(header_block(F.col("headers")).cast("binary"), 256).alias("headers_sha256"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"),
    )


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"),
    )
    return out


#: Production keys come from the caller's secret store; this one is public.
PUBLIC_KEY = b"tollgate surrogates"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace

    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PUBLIC_KEY)


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_mixing import score

    return score(table(spark, sf_dir, "documents"))


def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group_variants, word_counts

    return group_variants(word_counts(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogue import repaired_conversations

    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup

    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _prepared(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    return {f.__name__: _prepared(f) for f in (
        op1_word_backoff_langid, op2_pca_tiled_dedup, op3_parity_sketch_join, op4_temperature_mixing,
        op5_kneser_ney_quality, op6_bpe_codec, op7_revisit_resolution,
        op8_fertility_rules, op9_surrogates, op10_context_mixing,
        op11_permuterm_variants, op12_conversation_repair, op13_cover_substrings,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pca_tiled_dedup": COSINE_SQL,
        "op3_parity_sketch_join": JACCARD_SQL,
        "op4_temperature_mixing": MIXING_SQL,
        "op7_revisit_resolution": REVISIT_SQL,
        "op11_permuterm_variants": VARIANTS_SQL,
        "op12_conversation_repair": DIALOGUE_SQL,
        "op13_cover_substrings": SUBSTRING_SQL,
    }
