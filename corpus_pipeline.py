"""From documents to token ids: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pileline.llm import bpe, labelled, lines, mixing, simhash, toxicity
from pileline.llm.queries import table, tokenizer_path
from pileline.llm.util import staged

#: Documents of this toxicity score or more go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity grammar rejects; it is learned from the labelled rows op7 learns from."""
    all_docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled.sample(all_docs, labels, "toxic", labelled.remainder(F.col("doc_id"), 3) != 1, toxicity.MOST_ROWS)
    return toxicity.keep_clean(docs, toxicity.learn(rows), TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one line of each class of like lines; documents that lose all their lines go."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each class of near copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids, and digest of what they decode to, of each document of the mix."""
    return bpe.round_trip_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_round_trip", encode),
]

#: No SQL: learned scores, fuzzy classes and tokenizer ids. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
