import math
import random
from itertools import combinations

import gold
import pytest
from pileline import schema
from pileline.functions import bases as B
from pileline.operators import calibrate, codec, pileup, posterior, seq
from pileline.params import CallParams
from pileline.sources import text
from pileline.streaming.pileup import refuse_late
from pyspark.sql import functions as F

READS = "read_idx bigint, read_id string, seq string, qual string, hit int, ab string, read_len int, strand string, chr string, pos bigint, mismatch int, indel_pos int"
PARAMS = CallParams(read_length=8)


def read(k, seq, pos, hit=1, strand="+", qual=30, mismatch=0, at=None, chr="c"):
    return (k, f"r{k}", seq, chr_(qual) * len(seq), hit, "a", len(seq), strand, chr, pos, mismatch, at)


def chr_(q):
    return chr(64 + q)


def phred(q, cycle, t, o):
    e = 10 ** (-q / 10)
    return max(0.25, 1 - e) if t == o else min(0.25, e / 3)


def calls(spark, reads, genome, params=PARAMS, known=None):
    df = spark.createDataFrame(reads, READS)
    blocks = spark.createDataFrame([(c, 0, 0, s) for c, s in genome.items()], "chr string, block bigint, start bigint, seq string")
    contigs = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chr string, length bigint")
    observed = pileup.with_dependencies(pileup.bases(pileup.in_bounds(pileup.normalise(df), contigs), params), params)
    lp = calibrate.log_matrix(calibrate.matrix(spark, spark.createDataFrame([], "q int, cycle int, t_base int, o_base int, n bigint"), params))
    return posterior.call(pileup.ref_sites(blocks), posterior.likelihoods(observed, lp, params.rank_sum), known, params)


def test_calls_against_the_sequential_twin(spark):
    r = random.Random(11)
    genome = {"c": "".join(r.choice("ACGTRYNacgt") for _ in range(40)), "d": "".join(r.choice("ACGT") for _ in range(30))}
    reads = []
    for k in range(150):
        c = r.choice("cd")
        pos = r.randrange(1, len(genome[c]) - 7)
        seq = "".join(r.choice("ACGTN") if r.random() < 0.2 else x for x in genome[c][pos - 1 : pos + 7].upper().translate(str.maketrans("RYN", "AAA")))
        reads.append(read(k, seq, pos, r.choice([1, 1, 1, 2]), r.choice("+-"), r.choice([0, 5, 20, 30, 39]), chr=c))
    reads += [read(1000 + k, "ACGTACGT", 3) for k in range(300)]  # beyond the depth cap
    got = {(x.chr, x.pos): x for x in calls(spark, reads, genome).collect()}
    assert len(got) == 70
    for (c, pos), x in got.items():
        seen = []
        for k, _, seq, qual, hit, _, n, strand, chr, start, _, _ in sorted(reads, key=lambda t: (t[9], t[0])):
            at = pos - (start - 1)
            if chr == c and 0 <= at < n and start - 1 + n < len(genome[c]):
                seen.append((gold.CODE.get(seq[at]), ord(qual[at]) - 64, at if strand == "+" else n - 1 - at, strand == "-", hit))
        want = gold.site(seen, (ord(genome[c][pos]) >> 1) & 7, phred)
        assert [x.depth, x.repeat_time, x.dep_uni, x.base1, x.base2, x.type1, x.type2] == [want[k] for k in ("depth", "repeat_time", "dep_uni", "base1", "base2", "type1", "type2")], (c, pos)
        assert [x[f"uni{k}"] for k in range(4)] == want["uni"] and [x[f"all{k}"] for k in range(4)] == want["all"] and [x[f"qs{k}"] for k in range(4)] == want["qs"]
        if not x.nflag:
            assert x.quality == want["quality"], (c, pos)


def test_zero_depth_rows_and_bounds(spark):
    rows = {x.pos: x for x in posterior.consensus(calls(spark, [read(0, "ACGTACGT", 33)], {"c": "A" * 20 + "N" * 20})).collect()}
    assert len(rows) == 40 and all(x.depth == 0 for x in rows.values())  # the read ends at the contig's end
    assert (rows[1].base1, rows[1].base2, rows[1].quality, rows[1].genotype) == ("A", "T", 1, "A")
    assert (rows[30].ref, rows[30].genotype, rows[30].rank_p, rows[30].copy_number) == ("N", "N", 1.0, 255.0)


def test_unknown_contig_is_an_error(spark):
    with pytest.raises(Exception, match="unknown contig"):
        calls(spark, [read(0, "ACGTACGT", 1, chr="zz")], {"c": "A" * 20}).collect()


def test_deletion_counts_in_depth_only(spark):
    rows = pileup.normalise(spark.createDataFrame([read(0, "ACGTACGT", 1, mismatch=102, at=3), read(1, "ACGTACGT", 1, mismatch=203, at=3)], READS)).collect()
    assert [x.seq for x in rows] == ["ACGCGT", "ACGNNNTACGT"]
    cover = pileup.bases(pileup.normalise(spark.createDataFrame([read(0, "ACGTACGT", 1, mismatch=102, at=3)], READS)), PARAMS)
    assert cover.count() == 8 and cover.filter("eligible").count() == 6


def test_rank_table_against_enumeration(spark):
    table = {(x.n, x.n1, x.t): x.p for x in posterior.rank_table_frame(spark).filter("n <= 9").collect()}
    for n in range(1, 10):
        for n1 in range(n + 1):
            sums = sorted(sum(c) for c in combinations(range(1, n + 1), n1))
            for t in set(sums):
                left = sum(s <= t for s in sums) / len(sums)
                right = sum(s >= t for s in sums) / len(sums)
                assert abs(table[n, n1, t] - min(left, right)) < 1e-9


def test_two_bit_codes_refuse_other_letters(spark):
    with pytest.raises(Exception, match="no base"):
        spark.createDataFrame([("N",)], "b string").select(codec.base2bit(F.col("b"))).collect()


@pytest.mark.parametrize("n", [0, 1, 5, 9000])
def test_scans_over_several_blocks(spark, n):
    r = random.Random(n)
    keys, values = [r.choice("ab") if r.random() < 0.3 else "c" for _ in range(n)], [r.randrange(-9, 9) for _ in range(n)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(keys, values, strict=True))], "idx bigint, k string, v bigint")
    got = sorted(seq.scan_by_key(seq.scan(df, "idx", F.col("v"), "s"), "idx", F.col("k"), F.col("v"), "t").select("idx", "s", "t").collect())
    total = run = 0
    for i in range(n):
        total += values[i]
        run = values[i] + (run if i and keys[i] == keys[i - 1] else 0)
        assert (got[i].s, got[i].t) == (total, run)
    assert len(got) == n


def test_reduce_by_key_as_in_the_manual(spark):
    df = spark.createDataFrame(list(enumerate(zip([1, 3, 3, 3, 2, 2, 1], [9, 8, 7, 6, 5, 4, 3], strict=True))), "idx bigint, kv struct<k:int,v:int>").select("idx", "kv.*")
    got = seq.reduce_by_key(df, "idx", F.col("k"), F.sum("v").alias("v")).orderBy("run").collect()
    assert [(x.key, x.v) for x in got] == [(1, 9), (3, 21), (2, 9), (1, 3)]


def test_six_digits(spark):
    df = spark.createDataFrame([(1.0,), (255.0,), (0.0123456789,), (0.0,), (1.0909090909,), (0.00001234567,)], "x double")
    assert [x[0] for x in df.select(text.six_digits(F.col("x"))).collect()] == ["1.00000", "255.000", "0.0123457", "0.00000", "1.09091", "1.23457e-05"]


def test_word_round_trip(spark):
    df = spark.createDataFrame([(3, 40, 255, 1, 9), (0, 1, 0, 0, 1)] + [(b, q, 7, 1, 2) for b in range(4) for q in (0, 1, 40, 63, 64)], "base int, q int, cycle int, strand int, n int")
    w = df.select("*", B.pack_word(F.col("base"), F.col("q"), F.col("cycle"), F.col("strand"), F.col("n")).alias("w"))
    for x in w.select("base", "q", "cycle", "strand", "n", *[c.alias(f"u_{k}") for k, c in B.unpack_word(F.col("w")).items()]).collect():
        assert tuple(x[:5]) == tuple(x[5:])


def test_malformed_lines_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("r1 ACGT hhhh 1 a 4 + c 5 0\nshort line\nr2 ACGT hhhh x a 4 + c 5 0\nr3\tACGT\thhhh\t1\ta\t4\t-\tc\t6\t102\t2\n")
    got = text.read_alignments(spark, str(tmp_path / "a.txt")).orderBy("read_idx").collect()
    assert [(x.read_id, x.pos, x.strand, x.indel_pos) for x in got] == [("r1", 5, "+", None), ("r3", 6, "-", 2)]


def test_fasta_lines_headers_and_blocks(spark, tmp_path):
    (tmp_path / "g.fa").write_text("junk\n>c1 first contig\nACGT\nAC\n\nGTA\n>c2\nNNN\n")
    blocks, contigs = text.read_fasta(spark, str(tmp_path / "g.fa"), block=4)
    assert sorted((x.chr, x.block, x.seq) for x in blocks.collect()) == [("c1", 0, "ACGT"), ("c1", 1, "ACGT"), ("c1", 2, "A"), ("c2", 0, "NNN")]
    assert sorted(map(tuple, contigs.collect())) == [("c1", 9), ("c2", 3)]


def tail(z):
    """Normal tail by the error function."""
    return 0.5 * math.erfc(abs(z) / math.sqrt(2))


def test_rank_sums_of_many_observations_are_normal(spark):
    r = random.Random(17)
    rows, want = [], []
    for n1, n2, shift in ((40, 30, 0), (33, 31, 4), (100, 20, -3), (32, 32, 0)):
        a, b = [r.randrange(10, 40) for _ in range(n1)], [r.randrange(10, 40) + shift for _ in range(n2)]
        every = sorted(a + b)
        mid = {q: every.index(q) + (1 + every.count(q)) / 2 for q in every}
        deviates = []
        for own, other in ((a, b), (b, a)):
            n = len(every) + 1
            deviates.append((sum(mid[q] for q in own) - len(own) * n // 2) / math.sqrt(len(own) * len(other) * n / 12))
        want.append(tail(max(deviates, key=abs)))
        seen = [(0, q) for q in a] + [(1, q) for q in b] + [(3, 20)] * 5
        r.shuffle(seen)
        rows.append((1, n1, n2, 0, 5, seen))  # type 1: bases 0 and 1
    df = spark.createDataFrame(rows, "type1 int, uni0 int, uni1 int, uni2 int, uni3 int, seen array<struct<base:int,q:int>>")
    got = [x.rank_p for x in posterior.rank_sums(df).collect()]
    assert all(abs(g - w) < 1e-6 for g, w in zip(got, want, strict=True))


def test_exact_rank_interpolates_between_neighbours(spark):
    a, b = [10, 12, 14, 15], [12, 13, 20, 21, 22]
    every = sorted(a + b)
    mid = {q: every.index(q) + (1 + every.count(q)) / 2 for q in every}
    t = sum(mid[q] for q in a)
    table = {(x.n, x.n1, x.t): x.p for x in posterior.rank_table_frame(spark).filter("n = 9").collect()}
    low = int(t)
    want = table[9, 4, low] + (t - low) * (table[9, 4, low + 1] - table[9, 4, low])
    df = spark.createDataFrame([(1, 4, 5, 0, 0, [(0, q) for q in a] + [(1, q) for q in b])], "type1 int, uni0 int, uni1 int, uni2 int, uni3 int, seen array<struct<base:int,q:int>>")
    assert t != low and abs(posterior.rank_sums(df, exact=True).first().rank_p - want) < 1e-9


def test_late_reads_stop_a_stream(spark, tmp_path):
    reads = [read(0, "ACGTACGT", 5), read(1, "ACGTACGT", 90)]
    spark.createDataFrame(reads, READS).write.parquet(str(tmp_path / "in"))
    closed = spark.createDataFrame([("c", 50)], "chr string, upto bigint")
    seen = []

    def batch(df, _):
        seen.append(refuse_late(df, closed).count())

    def run(rows, name):
        rows.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run(source.filter("pos >= 50"), "a")
    assert sum(seen) == 1
    with pytest.raises(Exception, match="late read 0"):
        run(source, "b")


def test_calls_compile_to_whole_stages(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # a method that grows too large is then an error
    try:
        r = random.Random(2)
        genome = {"c": "".join(r.choice("ACGT") for _ in range(40))}
        known = spark.createDataFrame([("c", 9, 1, 0, 0, 0.7, 0.3, 0.0, 0.0)], "chr string, pos bigint, hapmap int, validated int, indel int, f0 double, f1 double, f2 double, f3 double")
        reads = [read(k, "".join(r.choice("ACGT") for _ in range(8)), 1 + k % 30) for k in range(60)]
        params = CallParams(read_length=8, refine=True, rank_sum=True)
        assert posterior.consensus(calls(spark, reads, genome, params, known)).count() == 40
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_fasta_over_many_splits(spark, tmp_path):
    r = random.Random(8)
    contigs = {f"c{k}": "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 400))) for k in range(60)}
    body = "".join(f">{c} x\n" + "".join(s[k : k + 37] + "\n" for k in range(0, len(s), 37)) for c, s in contigs.items())
    (tmp_path / "g.fa").write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        blocks, lengths = text.read_fasta(spark, str(tmp_path / "g.fa"), block=64)
        found = {}
        for x in sorted(blocks.collect(), key=lambda x: (x.chr, x.block)):
            found[x.chr] = found.get(x.chr, "") + x.seq
        assert found == {c: s for c, s in contigs.items() if s}
        assert dict(map(tuple, lengths.collect())) == {c: len(s) for c, s in contigs.items() if s}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_places_of_more_rows_than_a_sample_of_ranges_holds(spark):
    # bounds of ranges come from a sample; so many rows aren't all in it
    n = 60_000
    rows = spark.range(n, numPartitions=6).select(F.concat(F.lit("k"), F.col("id") % 7).alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("idx"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    keys = {x.idx: (x.k, x.v) for x in rows.collect()}
    want = {i: place for place, i in enumerate(sorted(keys, key=lambda i: (keys[i][0], i)), 1)}
    got = seq.stable_sort_by_key(rows, "idx", "k").collect()
    assert len(got) == n and {x.idx: x.place for x in got} == want and all(keys[x.idx] == (x.k, x.v) for x in got)
    # every value once, and the probes between and beside them
    found = {x.probe: (x.lower, x.upper, x.found) for x in seq.bounds(rows.select((F.col("v") * 2).alias("w")), "w", spark.range(-1, 2 * n, 7).withColumnRenamed("id", "probe"), "probe").collect()}
    assert found == {p: ((p + 1) // 2, p // 2 + 1, p % 2 == 0) for p in range(-1, 2 * n, 7)}
    codes = codec.dictionary(rows.select("idx", F.format_string("%06d", F.col("v")).alias("s")), "s").collect()
    assert len(codes) == n and all(int(x.value) == x.code for x in codes)


def test_null_keys_and_places_come_last(spark):
    rows = spark.createDataFrame([(None, 1), ("b", 2), ("a", None), ("a", 4), (None, 0)], "k string, idx long")
    assert sorted((x.place, x.k, x.idx) for x in seq.stable_sort_by_key(rows, "idx", "k").collect()) == [(1, "a", 4), (2, "a", None), (3, "b", 2), (4, None, 0), (5, None, 1)]


def consensus_sample(spark, n, seed=5):
    r = random.Random(seed)
    rows = []
    for c in "ab":
        for pos in range(1, n):
            if r.random() < 0.1:
                continue
            if 300 < pos < 500 or r.random() < 0.2:
                rows.append((c, pos, "N", "N", 0, "N", 0, 0, 0, "N", 0, 0, 0, 0, 1.0, 255.0, 0))
            else:
                rows.append((c, pos, r.choice("ACGTM"), r.choice("ACGTRN"), r.randrange(99), r.choice("ACGTN"), r.randrange(40), r.randrange(4), r.randrange(9), r.choice("NNNACGT"), r.choice([0, 0, 7]), r.choice([0, 3]), r.choice([0, 300]), r.randrange(50), r.choice([1.0, 0.25]), r.choice([1.0, 1.25]), r.choice([0, 0, 1])))
    return spark.createDataFrame(rows, schema.CONSENSUS), sorted(rows)


@pytest.mark.parametrize("size", [1, 32, 64, 4096])
def test_codec_blocks_round_trip(spark, size):
    df, rows = consensus_sample(spark, 700)
    blocks = codec.compress(df, size).cache()
    assert sorted(tuple(r) for r in codec.decompress(blocks).collect()) == rows
    assert size > 64 or blocks.filter("all_n").count() > 0


def test_a_region_opens_the_blocks_it_needs_only(spark, tmp_path):
    df, rows = consensus_sample(spark, 3000)
    path = str(tmp_path / "blocks")
    codec.write_blocks(df, path, 64)
    for start, end in ((1, 1), (60, 70), (64, 64), (65, 1000), (2990, 9999), (5000, 6000)):
        found = sorted(tuple(r) for r in codec.read_region(spark, path, "b", start, end, 64).collect())
        assert found == [r for r in rows if r[0] == "b" and start <= r[1] <= end]
    opened = codec.region_blocks(spark, path, "b", 60, 70, 64)
    assert opened.count() == 2 and codec.region_blocks(spark, path, "b", 1, 3000, 64).count() == 47
    plan = codec.read_region(spark, path, "b", 60, 70, 64)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block,0)" in plan and "PartitionFilters: [isnotnull(chr" in plan and "(chr#" in plan


def test_folds_of_any_operator_over_many_levels(spark, monkeypatch):
    monkeypatch.setattr(seq, "FAN", 3)
    monkeypatch.setattr(seq, "_CHUNK", 2)
    r = random.Random(8)
    places = sorted(r.sample(range(200), 80))
    data = [(i, r.choice("xxy"), r.choice("abcdef"), "own") for i in places]
    df = spark.createDataFrame(data, "idx long, k string, s string, __x string")
    got = seq.fold(df, "idx", F.col("s"), "upto", lambda a, b: F.concat(a, b))
    got = seq.fold(got, "idx", F.col("s"), "before", lambda a, b: F.concat(a, b), True, F.lit(">"))
    got = seq.fold_by_key(got, "idx", F.col("k"), F.col("s"), "run", lambda a, b: F.concat(a, b))
    got = seq.fold_by_key(got, "idx", F.col("k"), F.col("s"), "run_before", lambda a, b: F.concat(a, b), True, F.lit("<"))
    text, run, last = "", "", None
    for x in sorted(got.collect(), key=lambda x: x.idx):
        run = run if x.k == last else ""
        assert (x.before, x.upto, x.run_before, x.run) == (">" + text, text + x.s, "<" + run, run + x.s), x
        text, run, last = text + x.s, run + x.s, x.k
    assert seq.fold(df.limit(0), "idx", F.col("s"), "upto", lambda a, b: F.concat(a, b)).count() == 0


def test_a_bitmap_has_a_row_a_block_whatever_the_regions(spark):
    r = random.Random(3)
    regions = [("c", s, s + r.randrange(0, 300)) for s in (r.randrange(1, 4000) for _ in range(1000))] + [("d", 64, 64), ("d", 5, 4), ("d", 4090, 4100), ("d", 1, 1)]
    bitmap = pileup.site_bitmap(spark.createDataFrame(regions, "chr string, start bigint, end bigint"))
    assert sorted((x.chr, x.block) for x in bitmap.collect()) == [("c", 0), ("c", 1), ("d", 0), ("d", 1)]
    sites = spark.range(6000).select(F.explode(F.array(F.lit("c"), F.lit("d"), F.lit("e"))).alias("chr"), F.col("id").alias("pos"))
    found = {(x.chr, x.pos) for x in pileup.in_regions(sites, spark.createDataFrame(regions, "chr string, start bigint, end bigint"), 2).collect()}
    assert found == {(c, p) for c, s, e in regions for p in range(max(0, s - 3), min(e, 6000))}


def test_merged_places(spark):
    r = random.Random(4)
    sides = [sorted(r.choice([1, 2, 2, 3, 9, 40]) for _ in range(n)) for n in (30, 17)]
    frames = [spark.createDataFrame(list(enumerate(x)), "idx long, key long") for x in sides]
    found = sorted((x.place, x.key, side, x.idx) for side, df in enumerate(seq.merged(*frames, "idx", "key")) for x in df.collect())
    want = sorted((k, side, i) for side, x in enumerate(sides) for i, k in enumerate(x))
    assert found == [(p, *w) for p, w in enumerate(want)]
