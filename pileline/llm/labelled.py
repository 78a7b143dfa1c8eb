"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import staged, text_of


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label 0.0 or 1.0) of at most ``most`` labelled documents, those of the least hashes of their ids, of the rows
    of ``labels`` where ``may_learn`` holds. ``most`` bounds what the join broadcasts and what fitting has to hold."""
    rows = labels.filter(may_learn & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("double").alias("label"))
    chosen = rows.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), id_col).limit(most)
    return staged(docs.select(id_col, text_of(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label"))
