"""Tiles against the windows by place: edges, hot tiles, known sites, odd reads."""

import random

import pytest
from pileline.operators import calibrate, pileup, posterior, tiles
from pileline.params import CallParams
from pyspark.sql import functions as F

READ = "read_idx long, chr string, pos long, seq string, qual string, hit int, strand string, read_len int"
SNP = "chr string, pos long, hapmap int, validated int, indel int, f0 double, f1 double, f2 double, f3 double, row_id long"
BLOCK = 16


def genome(spark, text, names=("c", "d"), block=BLOCK):
    rows = [(n, k, k * block, text[k * block : (k + 1) * block]) for n in names for k in range(-(-len(text) // block))]
    return spark.createDataFrame(rows, "chr string, block long, start long, seq string")


def some_reads(seed, n, size):
    r = random.Random(seed)
    out = []
    for i in range(n):
        length = r.randrange(1, 20)
        bases, signs = "".join(r.choice("ACGTNacg") for _ in range(length)), "".join(chr(r.randrange(60, 104)) for _ in range(length))
        cut = r.choice([length, length, max(0, length - 2)])  # a deletion leaves a shorter text
        pos = r.choice([r.randrange(0, size - length), BLOCK - 1, BLOCK, 3]) if i % 3 else 7
        out.append((i, r.choice("cccd"), pos, bases[:cut], signs[:cut], r.choice([1, 1, 1, 2]), r.choice("+-"), length))
    return out


def known(spark):
    return spark.createDataFrame([("c", 7, 1, 1, 0, 0.7, 0.0, 0.3, 0.0, 1), ("c", 7, 0, 0, 0, 0.5, 0.5, 0.0, 0.0, 2), ("d", 31, 0, 1, 1, 0.0, 1.0, 0.0, 0.0, 3), ("e", 1, 0, 1, 1, 0.0, 1.0, 0.0, 0.0, 3)], SNP)


@pytest.mark.parametrize("hot", [tiles.HOT_BASES, 200])
def test_tiles_give_what_windows_give(spark, hot):
    params = CallParams(read_length=20, depth_cap=9, rank_sum=True, refine=True)
    text = "ACGTNACGTTGCAAACCGTNNACGGTTACCAGTACG"
    blocks, reads, snps = genome(spark, text), spark.createDataFrame(some_reads(1, 400, 36), READ), known(spark)
    packed = tiles.staged_tiles(reads, blocks, snps, BLOCK, hot)
    assert (packed.agg(F.max("salts")).first()[0] > 1) == (hot == 200)
    key = lambda rows: sorted((r["q"], r["cycle"], r["t_base"], r["o_base"], r["n"]) for r in rows)
    counts = calibrate.counts(reads, genome(spark, text, block=pileup.BLOCK), snps, params)
    assert key(tiles.calibration_counts(packed, params).collect()) == key(counts.collect())
    lp = calibrate.log_matrix(calibrate.matrix(spark, counts, params)).cache()
    observed = pileup.with_dependencies(pileup.bases(reads, params), params)
    slow = posterior.consensus(posterior.call(pileup.ref_sites(blocks), posterior.likelihoods(observed, lp, True), pileup.known_sites(snps), params))
    fast = posterior.consensus(posterior.called(tiles.site_rows(packed, tiles.log_cube(lp), params), params))
    assert fast.columns == slow.columns
    rows = [sorted(tuple(r) for r in x.collect()) for x in (fast, slow)]
    assert len(rows[0]) == 72 and rows[0] == rows[1]


def test_reads_on_edges_count_once_a_place(spark):
    reads = spark.createDataFrame([(0, "c", 14, "ACGT", "hhhh", 1, "+", 4), (1, "c", 15, "A" * 18, "h" * 18, 1, "-", 18), (2, "x", 0, "A", "h", 1, "+", 1)], READ)
    packed = tiles.staged_tiles(reads, genome(spark, "A" * 60, ("c",)), known(spark), BLOCK)
    rows = {r["pos"]: r for r in tiles.site_rows(packed, tiles.log_cube(spark.createDataFrame([], "q int, cycle int, o_base int, lp array<double>"))).collect()}
    assert [rows[p]["depth"] for p in range(12, 36)] == [0, 0, 1, 2, 2, 2] + [1] * 15 + [0] * 3 and len(rows) == 60 and rows[55]["lik"] == [0.0] * 10
    assert rows[7]["hapmap"] == 1 and rows[8]["hapmap"] is None  # the first of the file's


def test_a_place_of_a_hundred_thousand_reads(spark):
    reads = spark.range(100_000).select(
        F.col("id").alias("read_idx"), F.lit("c").alias("chr"), F.lit(5).cast("long").alias("pos"), F.expr("CASE WHEN id % 2 = 0 THEN repeat('A', 30) ELSE repeat('C', 30) END").alias("seq"), F.lit("h" * 30).alias("qual"),
        F.expr("IF(id % 10 = 0, 2, 1)").alias("hit"), F.lit("+").alias("strand"), F.lit(30).alias("read_len"),
    )
    packed = tiles.staged_tiles(reads, genome(spark, "A" * 64, ("c",), 64), known(spark), 64)
    assert packed.count() > 1
    cube = tiles.log_cube(spark.createDataFrame([], "q int, cycle int, o_base int, lp array<double>"))
    rows = {r["pos"]: r for r in tiles.site_rows(packed, cube).collect()}
    ids = [i for i in range(100_000) if i % 10][:255]
    at = rows[20]
    assert (at["depth"], at["repeat_time"], at["dep_uni"]) == (100_000, 110_000, 255)
    assert (at["uni0"], at["uni1"]) == (sum(i % 2 == 0 for i in ids), sum(i % 2 for i in ids))
    assert at["all0"] == sum(i % 2 == 0 for i in range(ids[-1] + 1)) and rows[4]["depth"] == 0


def test_second_pass_reads_the_staged_tiles_without_an_exchange(spark):
    reads = spark.createDataFrame(some_reads(2, 50, 36), READ)
    packed = tiles.staged_tiles(reads, genome(spark, "ACGT" * 9), known(spark), BLOCK)
    cube = tiles.log_cube(spark.createDataFrame([], "q int, cycle int, o_base int, lp array<double>"))
    plan = posterior.consensus(posterior.called(tiles.site_rows(packed, cube)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1
