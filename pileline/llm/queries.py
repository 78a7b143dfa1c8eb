"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, iblt, labelled, lines, media, mixing, pii, quality, simhash, spelling, tokens, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a parameter of the operators, looked up only here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, tau=2).withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")).drop("fp")


def op2_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled.sample(docs, labels, "quality", labelled.remainder(F.col("doc_id"), 5) != 0, quality.MOST_ROWS)
    return quality.score(docs, quality.learn(rows)).select(
        "doc_id", (labelled.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled.sample(docs, labels, "toxic", labelled.remainder(F.col("doc_id"), 3) != 1, toxicity.MOST_ROWS)
    return toxicity.score(docs, toxicity.learn(rows)).select(
        "doc_id", (labelled.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.read_pieces(tokenizer_path("piece_bpe_32k.model")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.RULES, urls.learn(pages))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compared(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged_lines(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.text_media(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")), copies="copies")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.slipped(spelling.runs(table(spark, sf_dir, "documents")))))


def op13_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_attention": op2_quality_attention,
    "op7_toxicity_grammar": op7_toxicity_grammar,
    "op3_token_counts": op3_token_counts,
    "op6_url_filter": op6_url_filter,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_source_mixing": op5_source_mixing,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_line_dedup": op9_line_dedup,
    "op10_media_columns": op10_media_columns,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_pii_spans": op13_pii_spans,
}

SQL: dict[str, str] = {"op5_source_mixing": mixing.sql()}
