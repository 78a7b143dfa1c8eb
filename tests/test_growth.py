"""Steps that must grow with their input only: what they give, and how often they make it."""

import pytest
from pileline.operators import codec, pileup, tiles
from pileline.params import CallParams
from pileline.plans import domain, packed, synth
from pileline.sources import text
from pyspark.sql import functions as F

import test_tiles as T

DIR = "/root/testdata/sf0.001"
SITE = ["chr", "pos"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hot", [tiles.HOT_BASES, 200])
def test_sums_of_tiles_are_those_of_windows(spark, hot):
    params = CallParams(read_length=20, depth_cap=9)
    reads = spark.createDataFrame(T.some_reads(4, 400, 36), T.READ)
    tiled = tiles.staged_tiles(reads, tiles.covered_blocks(reads, T.BLOCK), None, T.BLOCK, hot)
    assert (tiled.agg(F.max("salts")).first()[0] > 1) == (hot == 200)
    observed = pileup.with_dependencies(pileup.bases(reads, params), params).cache()
    unique = observed.filter("unique")
    folds = [f(c).cast("long") for c in ("t", "g", "q", "q_adj") for f in (F.sum, F.max)]
    assert rows(tiles.base_sums(tiled, params)) == rows(unique.groupBy(*SITE, "base").agg(F.count(F.lit(1)), *folds))
    counts = tiles.site_counts(tiled, params)
    assert rows(counts) == rows(pileup.pileup(observed).select(counts.columns))
    got = {}
    for chrom, pos, q, n, below in rows(tiles.quality_counts(tiled, params)):
        assert below == got.get((chrom, pos), 0)
        got[chrom, pos] = below + n
    assert got == {(r["chr"], r["pos"]): r["count"] for r in unique.groupBy(*SITE).count().collect()}


@pytest.mark.parametrize("name", ["quality_adjust", "pcr_rank", "global_dep", "site_pileup", "depth_cap", "mid_rank"])
def test_single_steps_order_no_bases_by_place(spark, name):
    plan = domain.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def given_to_python(plan):
    """What each step in Python of a plan is given, as DDL."""
    nodes = [plan]
    for node in nodes:
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return [n.children().apply(0).schema().simpleString() for n in nodes if n.nodeName() == "MapInArrow"]


@pytest.mark.parametrize("name", ["diff_encode", "consensus_rows", "sparse_nonzero", "sparse_exceptions"])
def test_no_packed_rows_go_to_python(spark, name):
    """A packed row is as large as a tile: a batch of them would grow with the tiles that a task has."""
    given = given_to_python((domain.QUERIES | packed.QUERIES)[name](spark, DIR)._jdf.queryExecution().optimizedPlan())
    assert given and not [x for x in given if "array<" in x]


@pytest.mark.parametrize("hot", [tiles.HOT_BASES, 200])
@pytest.mark.parametrize("most", [1, 7])
def test_tiles_don_t_depend_on_batches(spark, hot, most):
    params = CallParams(read_length=20, depth_cap=9)
    reads = spark.createDataFrame(T.some_reads(4, 400, 36), T.READ)
    tiled = tiles.staged_tiles(reads, T.genome(spark, "ACGTNACGTTGCAAACCGTNNACGGTTACCAGTACG"), T.known(spark), T.BLOCK, hot)

    def found():
        return [sorted(map(repr, df.collect())) for df in (tiles.site_counts(tiled, params), tiles.reference_rows(tiled), tiles.calibration_counts(tiled, params))]

    want = found()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        assert found() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_reference_is_put_together_from_its_pieces(spark):
    text = "".join("ACGTN"[k * k % 5] for k in range(2 * tiles.PIECE + 3))
    blocks = spark.createDataFrame([("1", 0, 0, text), ("1", 1, len(text), "")], "chr string, block long, start long, seq string")
    packed_rows = tiles.staged_tiles(tiles.no_reads(spark), blocks, None, len(text))
    assert max(len(r["a"]) for r in tiles._opened(packed_rows).collect()) == tiles.PIECE
    got = tiles.reference_rows(packed_rows).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(text)))
    assert [r["ref_code"] for r in got] == [(ord(c) >> 1) & 7 for c in text]


def test_calls_from_a_matrix_pack_the_tiles_once(spark, monkeypatch):
    made, own = [], tiles.staged_tiles
    monkeypatch.setattr(tiles, "staged_tiles", lambda *a, **k: made.append(1) or own(*a, **k))
    packed.calls_from_matrix(spark, DIR)
    assert len(made) == 1


def counted(spark, df):
    """The same rows, and how many were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


@pytest.mark.parametrize("write", [text.write_consensus, text.write_consensus_table, lambda df, path: codec.write_blocks(df, path, 64)])
def test_rows_are_made_once_for_a_table_in_order(spark, tmp_path, write):
    df, made = counted(spark, domain.consensus_rows(spark, DIR))
    write(df, str(tmp_path / "out"))
    assert made.value == 1680


def test_known_sites_meet_blocks_not_places(spark):
    blocks, snps = T.genome(spark, "ACGTNACGTTGCAAACCGTNNACGGTTACCAGTACG"), T.known(spark)
    got = tiles.reference_rows(tiles.staged_tiles(tiles.no_reads(spark), blocks, snps, T.BLOCK))
    known = pileup.known_sites(snps).drop("row_id").withColumn("known", F.lit(True))
    want = pileup.ref_sites(blocks).join(known, SITE, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    plan = domain.dbsnp_prior(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_a_streams_files_are_in_order_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(packed, "FILE_READS", 100)
    reads = pileup.normalise(synth.reads(spark, DIR)).select("read_idx", "chr", "pos")
    last = reads.limit(1).withColumn("pos", F.lit(1 << 32).cast("long"))
    source, files = packed._ordered(spark, reads, last)
    found = spark.read.parquet(source).select("pos", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("at"))
    each = found.groupBy("f", "at").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("at").collect()
    assert files == 3 and len(each) == 4 * files + 1 and spark.read.parquet(source).count() == 1001
    rounds = [each[k : k + files] for k in range(0, len(each), files)]
    ends = [(min(x["a"] for x in r), max(x["b"] for x in r)) for r in rounds]
    assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
