"""Reads, genome and known SNPs made by arithmetic from the ``events`` table, for queries and tests.

One read of 36 bases for each event, five contigs, one start per place; quality errors, planted heterozygous sites, N in the
reference at every 97th place and known SNPs at every 50th.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pileup import BLOCK
from ..params import CallParams

READ = 36
PARAMS = CallParams(read_length=READ)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref_base(pos: str, contig: str) -> str:
    return f"((({pos}) * ({pos}) * 7 + ({pos}) * 13 + ({contig}) * 5) div 11) % 4"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with 1-based positions, as a file has them."""
    # a small file is one split, but each of its rows is made into much more
    e = table(spark, sf_dir, "events").select("event_id").repartition(spark.sparkContext.defaultParallelism)
    e = e.select("event_id", (F.col("event_id") % 5).alias("contig"), F.expr("(event_id) div 5").alias("pos0"))
    ref = ref_base("pos0 + c", "contig")
    base = f"CASE WHEN (event_id * 31 + c * 17) % 23 = 0 THEN ({ref} + 1 + event_id % 3) % 4 WHEN (pos0 + c) % 50 = 0 AND event_id % 2 = 0 THEN ({ref} + 2) % 4 ELSE {ref} END"
    seq = f"array_join(transform(sequence(0L, {READ - 1}L), c -> substring('ACTG', cast({base} as int) + 1, 1)), '')"
    qual = f"array_join(transform(sequence(0L, {READ - 1}L), c -> char(74 + (event_id * 3 + c * 5) % 30)), '')"
    return e.select(
        F.col("event_id").alias("read_idx"), F.concat(F.lit("r"), F.col("event_id")).alias("read_id"), F.expr(seq).alias("seq"), F.expr(qual).alias("qual"),
        F.when(F.col("event_id") % 11 == 0, 2).otherwise(1).alias("hit"), F.lit("a").alias("ab"), F.lit(READ).alias("read_len"), F.when((F.col("event_id") % 3) % 2 == 0, "+").otherwise("-").alias("strand"),
        F.col("contig").cast("string").alias("chr"), (F.col("pos0") + 1).alias("pos"), F.lit(0).alias("mismatch"), F.lit(None).cast("int").alias("indel_pos"),
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("event_id") % 5).cast("string").alias("chr")).agg((F.max(F.expr("(event_id) div 5")) + READ + 101).alias("length"))


def genome(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """The genome in blocks."""
    b = contigs(spark, sf_dir).select("chr", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")).alias("block")).withColumn("start", F.col("block") * block)
    # the blocks come out of one row a contig, but each is made into much more
    b = b.repartition(spark.sparkContext.defaultParallelism)
    letter = f"CASE WHEN p % 97 = 0 THEN 'N' ELSE substring('ACTG', cast({ref_base('p', 'cast(chr as bigint)')} as int) + 1, 1) END"
    return b.select("chr", "block", "start", F.expr(f"array_join(transform(sequence(start, least(start + {block}, length) - 1), p -> {letter}), '')").alias("seq"))


def dbsnp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known SNPs with 0-based positions; f0 to f3 in order of the base codes."""
    rows = contigs(spark, sf_dir).select("chr", F.explode(F.expr("sequence(0L, length - 1, 50L)")).alias("pos")).withColumn("own", F.expr(ref_base("pos", "cast(chr as bigint)")))
    freq = [F.when(F.col("own") == k, 0.7).when((F.col("own") + 2) % 4 == k, 0.3).otherwise(0.0).alias(f"f{k}") for k in range(4)]
    return rows.select("chr", "pos", F.expr("((pos) div 50) % 2").cast("int").alias("hapmap"), F.expr("((pos) div 100) % 2").cast("int").alias("validated"), F.lit(0).alias("indel"), *freq, F.col("pos").alias("row_id"))
