"""Calibration counts, their roll-ups, the calibration matrix and the log likelihood matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import GENOTYPES
from ..params import CallParams
from .pileup import bases, with_ref_pieces

#: A count over this is taken as it is (fixed value).
ENOUGH = 10


def counts(reads: DataFrame, blocks: DataFrame, dbsnp: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """(q, cycle, t_base, o_base, n) over eligible bases of reads of one hit, at places that are neither N nor known SNPs.

    Counted by map-side partial sums; the result has as many rows as there are cells, whatever the reads."""
    own = bases(with_ref_pieces(reads.filter("hit = 1"), blocks), params).filter("eligible AND ref_code < 4").select("chr", "pos", "q", "cycle", "ref_code", "base")
    known = dbsnp.select("chr", "pos").distinct()
    grouped = own.join(known, ["chr", "pos"], "left_anti").groupBy("q", "cycle", F.col("ref_code").alias("t_base"), F.col("base").alias("o_base"))
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def rollups(n: DataFrame) -> DataFrame:
    """Sums of the counts by (q, cycle, t), (q, t, o), (q, t) and (q), with the sum of mismatches: one pass of grouping sets."""
    sets = [["q", "cycle", "t_base"], ["q", "t_base", "o_base"], ["q", "t_base"], ["q"]]
    keys = ["q", "cycle", "t_base", "o_base"]
    source = n.select("n", *keys, F.col("t_base").alias("__t"), F.col("o_base").alias("__o"))
    return source.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("__t") != F.col("__o"), F.col("n")).otherwise(0)).alias("mismatch"))


def matrix(spark: SparkSession, n: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """The calibration matrix: a row for each q, cycle, t_base, o_base in range. What is exactly 0 or 1, told by the counts,
    gives way to the value of the quality."""
    grid = spark.range(params.q_max - params.q_min + 1).select(F.col("id").cast("int").alias("q"))
    for name, size in (("cycle", params.read_length), ("t_base", 4), ("o_base", 4)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    cells = grid.join(n, ["q", "cycle", "t_base", "o_base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    over = lambda *keys: F.sum("n").over(W.partitionBy(*keys))
    cells = cells.withColumn("n_qct", over("q", "cycle", "t_base")).withColumn("n_qto", over("q", "t_base", "o_base")).withColumn("n_qt", over("q", "t_base")).withColumn("n_q", over("q"))
    cells = cells.withColumn("bad", F.sum(F.when(F.col("t_base") != F.col("o_base"), F.col("n")).otherwise(0)).over(W.partitionBy("q")))
    same = F.col("t_base") == F.col("o_base")
    part = F.when(F.col("n") > ENOUGH, F.col("n")).when(F.col("n_qto") > ENOUGH, F.col("n_qto")).when(same, F.col("n_q") - F.col("bad")).otherwise(F.col("bad"))
    whole = F.when(F.col("n") > ENOUGH, F.col("n_qct")).when(F.col("n_qto") > ENOUGH, F.col("n_qt")).otherwise(F.col("n_q"))
    error = F.pow(F.lit(10.0), -(F.col("q") / 10.0))
    by_quality = F.when(same, F.greatest(F.lit(0.25), 1.0 - error)).otherwise(F.least(F.lit(0.25), error / 3.0))
    p = F.when((whole == 0) | (part == 0) | (part == whole), by_quality).otherwise(part / whole)
    return cells.select("q", "cycle", "t_base", "o_base", p.alias("p"))


def log_matrix(p: DataFrame) -> DataFrame:
    """(q, cycle, o_base, lp): log10 of the mean of the two alleles' values, for the ten genotypes in order."""
    wide = p.groupBy("q", "cycle", "o_base").agg(*[F.max(F.when(F.col("t_base") == t, F.col("p"))).alias(f"p{t}") for t in range(4)])
    return wide.select("q", "cycle", "o_base", F.array(*[F.log10(0.5 * F.col(f"p{g >> 2}") + 0.5 * F.col(f"p{g & 3}")) for g in GENOTYPES]).alias("lp"))
