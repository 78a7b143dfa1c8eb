"""Streamed calls against the batch: several micro-batches, a place over the cap, blocks without reads, restarts, late reads."""

import pytest
import test_tiles as T
from pileline.operators import calibrate, posterior, tiles
from pileline.params import CallParams
from pileline.streaming import calls

PARAMS = CallParams(read_length=20, depth_cap=9, rank_sum=True, refine=True)
TEXT = "ACGTNACGTTGCAAACCGTNNACGGTTACCAGTACG" * 3


def matrix(spark):
    return calibrate.matrix(spark, spark.createDataFrame([], "q int, cycle int, t_base int, o_base int, n bigint"), PARAMS)


def put(spark, path, rows):
    spark.createDataFrame(rows, T.READ).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, late="error", **more):
    reads = spark.readStream.schema(T.READ).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    sites = calls.site_stream(reads, T.genome(spark, TEXT), T.known(spark), matrix(spark), PARAMS, T.BLOCK, lateness=20, late=late, **more)
    out = posterior.consensus(posterior.called(sites, PARAMS))
    query = out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress), sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp}/out").collect())


def batch(spark, rows):
    packed = tiles.staged_tiles(spark.createDataFrame(rows, T.READ), T.genome(spark, TEXT), T.known(spark), T.BLOCK)
    lp = calibrate.log_matrix(matrix(spark))
    return sorted(tuple(r) for r in posterior.consensus(posterior.called(tiles.site_rows(packed, tiles.log_cube(lp), PARAMS), PARAMS)).collect())


END = [(10**6, "end", 10**6, "A", "h", 1, "+", 1)]


def test_streamed_calls_equal_the_batch_over_a_restart_and_refuse_late_reads(spark, tmp_path):
    rows = sorted((r for r in T.some_reads(1, 300, 60) if r[1] == "c"), key=lambda r: r[2])
    half = len(rows) // 2
    put(spark, f"{tmp_path}/in", rows[:half])
    put(spark, f"{tmp_path}/in", [(9_000, "c", 60, "ACGT", "hhhh", 1, "+", 4)])  # closes the first blocks
    batches, first = run(spark, tmp_path, most=200)
    assert batches == 2 and first and all(r[1] <= 2 * T.BLOCK for r in first)
    rest = [r for r in rows[half:] if r[2] >= 40] + [(9_001, "d", 90, "ACGTA", "hhhhh", 1, "-", 5)]
    put(spark, f"{tmp_path}/in", rest)
    put(spark, f"{tmp_path}/in", END)
    _, found = run(spark, tmp_path, most=200)  # goes on from its state
    assert found == batch(spark, rows[:half] + rest + [(9_000, "c", 60, "ACGT", "hhhh", 1, "+", 4)])
    assert len(found) == 216  # also of contig d, which hardly has a read
    put(spark, f"{tmp_path}/in", [(9_002, "c", 3, "A", "h", 1, "+", 1)])
    with pytest.raises(Exception, match="late read 9002"):
        run(spark, tmp_path, most=200)
    _, again = run(spark, tmp_path, late="drop", most=200)
    assert again == found


def test_late_reads_are_dropped_or_refused_and_nothing_else():
    with pytest.raises(ValueError, match="late: drop or error"):
        calls.site_stream(None, None, None, None, late="maybe")
