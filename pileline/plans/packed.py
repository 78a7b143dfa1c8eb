"""Queries of the consensus codecs, files, streams and random sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..files import folder, staged
from ..functions import random
from ..operators import calibrate, codec, pileup, posterior
from ..sources import text
from ..streaming import calls
from ..streaming import pileup as stream
from . import domain, synth
from .domain import _TO_BEST, _consensus_sql, _with

QUERIES: dict = {}
SQL: dict = {}
_CONS = [*_TO_BEST, "post", "call", f"cons as ({_consensus_sql('callq')})"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cons(spark, d):
    return domain.consensus_rows(spark, d)


@query(_with(_CONS, "select chr, pos, genotype as value from cons where genotype <> ref"))
def diff_encode(spark, d):
    return codec.diff_encode(cons(spark, d).withColumn("place", F.struct("chr", "pos")), "place", "genotype", "ref").select("place.chr", "place.pos", "value")


@query(_with(_CONS, "select chr, pos, genotype from cons"))
def diff_decode(spark, d):
    rows = cons(spark, d).withColumn("place", F.struct("chr", "pos"))
    changes = codec.diff_encode(rows, "place", "genotype", "ref")
    return codec.diff_decode(rows.select("place", "ref"), "place", "ref", changes, "genotype").select("place.chr", "place.pos", "genotype")


@query(_with(_CONS, "select 'avg_q2' as col, chr, pos, avg_q2::double as value from cons where avg_q2 <> 0 union all select 'uni2', chr, pos, uni2 from cons where uni2 <> 0 union all select 'all2', chr, pos, all2 from cons where all2 <> 0"))
def sparse_nonzero(spark, d):
    return codec.sparse_columns(cons(spark, d), ["chr", "pos"], {"avg_q2": 0, "uni2": 0, "all2": 0})


@query(_with(_CONS, "select 'rank_p' as col, chr, pos, rank_p as value from cons where rank_p <> 1.0 union all select 'is_dbsnp', chr, pos, is_dbsnp from cons where is_dbsnp <> 0"))
def sparse_exceptions(spark, d):
    return codec.sparse_columns(cons(spark, d), ["chr", "pos"], {"rank_p": 1.0, "is_dbsnp": 0})


@query(_with(_CONS, "select chr, (pos - 1) // 262144 as block, min(pos) as first_pos, count(*) as sites, bool_and(ref = 'N') as all_n from cons group by all"))
def window_directory(spark, d):
    return codec.window_directory(cons(spark, d))


_EXACT = "ref genotype quality base1 avg_q1 uni1 all1 base2 avg_q2 uni2 all2 depth is_dbsnp".split()
_NEAR = ["rank_p", "copy_number"]


@query(_with(_CONS, "select u.c as \"column\", case u.c when 'quality' then count(*) filter (pos % 100 = 7) when 'base2' then count(*) filter (pos % 50 = 3 and base2 <> 'Q') when 'rank_p' then count(*) filter (pos % 40 = 9) else 0 end as n "
    f"from cons, (select unnest({[*_EXACT, *_NEAR]}) as c) u group by u.c"))  # fmt: skip
def codec_roundtrip_diff(spark, d):
    """Consensus rows against themselves after the codec of all 17 columns, with some values changed afterwards: only those differ."""
    path = folder(spark, "blocks")
    rows = cons(spark, d)
    codec.compress(rows).write.parquet(path)
    back = codec.decompress(spark.read.parquet(path))
    at = F.col("pos")
    changed = back.withColumn("quality", F.when(at % 100 == 7, F.col("quality") + 1).otherwise(F.col("quality"))).withColumn("base2", F.when(at % 50 == 3, "Q").otherwise(F.col("base2")))
    changed = changed.withColumn("rank_p", F.when(at % 40 == 9, F.col("rank_p") + 2).otherwise(F.col("rank_p")))
    return codec.differing(rows, changed, ["chr", "pos"], _EXACT, _NEAR)


@query(_with(_CONS, "select * from cons"))
def consensus_codec(spark, d):
    path = folder(spark, "blocks")
    codec.compress(cons(spark, d), 512).write.parquet(path)
    return codec.decompress(spark.read.parquet(path))


@query(_with(["reads", "contigs", "ref", "known"], "select chr, pos, hapmap, validated, indel, f0, f1, f2, f3 from known"))
def dbsnp_roundtrip(spark, d):
    """Known SNPs written as the tab-separated file that the reader takes, each position twice; the first row counts."""
    path = folder(spark, "dbsnp")
    rows = synth.dbsnp(spark, d)
    lines = [F.concat_ws("\t", "chr", (F.col("pos") + 1).cast("string"), *[F.col(c).cast("string") for c in ("hapmap", "validated", "indel", "f0", "f1", "f2", "f3")], F.lit("rs1"))]
    again = [F.concat_ws("\t", "chr", (F.col("pos") + 1).cast("string"), F.lit("0\t0\t1\t0\t0\t0\t0\trs2"))]
    rows.select(F.explode(F.array(*lines, *again)).alias("value")).write.text(path)
    known = pileup.known_sites(text.read_dbsnp(spark, path))
    return known.select("chr", "pos", "hapmap", "validated", "indel", "f0", "f1", "f2", "f3")


@query(_with(["reads", "contigs", "regions as (select chr, unnest(range(10, length + 1, 500)) as start from contigs)"], 'select chr, start::bigint as start, (start + 60)::bigint as "end" from regions'))
def region_roundtrip(spark, d):
    path = folder(spark, "regions")
    rows = synth.contigs(spark, d).select("chr", F.explode(F.expr("sequence(10L, length, 500L)")).alias("start"))
    short = F.array(F.concat_ws("\t", "chr", F.col("start").cast("string"), (F.col("start") + 60).cast("string")), F.col("chr"))  # a line without its numbers is left out
    rows.select(F.explode(short).alias("value")).write.text(path)
    return text.read_regions(spark, path)


@query(domain.SQL["genome_blocks"])
def fasta_roundtrip(spark, d):
    path = folder(spark, "fasta")
    text.write_fasta(synth.genome(spark, d), path)
    return text.read_fasta(spark, path + "/*")[0]


@query(domain.SQL["reads_synth"])
def alignment_roundtrip(spark, d):
    path = folder(spark, "reads")
    text.write_alignments(synth.reads(spark, d), path)
    rows = text.read_alignments(spark, path)
    return rows.select(F.substring("read_id", 2, 20).cast("long").alias("read_idx"), "chr", "pos", "seq", "qual", "hit", "strand", "read_len")


@query(domain.SQL["calib_matrix"])
def matrix_file_roundtrip(spark, d):
    path = folder(spark, "matrix")
    text.write_matrix(calibrate.matrix(spark, domain.calibration_counts(spark, d), synth.PARAMS), path)
    return text.read_matrix(spark, path).withColumn("p", F.round("p", 9))


@query(_with(_CONS, "select * replace (" + ", ".join(f"round(case when {c} = 0 then 0 else round({c}, (5 - floor(log10(abs({c}))))::int) end, 6) as {c}" for c in ("rank_p", "copy_number")) + ") from cons"))
def consensus_text_roundtrip(spark, d):
    """All 17 columns; the last two numbers have six significant digits in the text."""
    path = folder(spark, "consensus")
    text.write_consensus(cons(spark, d), path)
    return text.read_consensus_text(spark, path).withColumns({c: F.round(c, 6) for c in ("rank_p", "copy_number")})


@query(_with(_CONS, "select * from cons where chr = '3' and pos between 50 and 150"))
def consensus_region_read(spark, d):
    path = folder(spark, "table")
    text.write_consensus_table(cons(spark, d), path)
    return text.read_consensus(spark, path, "3", 50, 150)


@query(_with(_CONS, "select * from cons where chr = '3' and pos between 50 and 150"))
def codec_region_read(spark, d):
    """The same region, from compressed blocks of 64 places, of which three are opened."""
    path = folder(spark, "blocks")
    codec.write_blocks(cons(spark, d), path, 64)
    return codec.read_region(spark, path, "3", 50, 150, 64)


#: Reads of a file of a stream.
FILE_READS = 500_000


def _ordered(spark, reads, last, rounds: int = 4) -> tuple[str, int]:
    """(folder, files a round) of reads as a stream's source, in order of position: each round, a range of positions, has equally many
    files, more where there are more reads. ``last`` comes after all rounds."""
    source, files = folder(spark, "stream"), max(1, -(-reads.count() // (rounds * FILE_READS)))
    ordered = staged(reads.repartitionByRange(rounds * files, "pos", "chr").withColumn("part", F.spark_partition_id()))
    for k in range(rounds):
        some = ordered.filter(F.col("part").between(k * files, (k + 1) * files - 1)).drop("part")
        (some.coalesce(1) if files == 1 else some.repartition(files)).write.mode("append").parquet(source)
    last.write.mode("append").parquet(source)
    return source, files


def _streamed(spark, rows, last, make):
    """Runs a stream over a table's rows, a round a micro-batch, to its end, closing all windows, and gives the sink's rows."""
    source, files = _ordered(spark, rows, last)
    sink, state = folder(spark, "sink"), folder(spark, "state")
    out = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source))
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query(_with(["reads", "bases", "acc", "sites"], "select s.* from sites s"))
def stream_pileup(spark, d):
    reads = pileup.normalise(synth.reads(spark, d)).drop("indel_pos")
    # a read far beyond each contig's end moves the watermark past all sites
    last = reads.limit(1).withColumn("pos", F.lit(1 << 32).cast("long")).withColumn("chr", F.lit("end"))
    return _streamed(spark, reads, last, stream.pileup_stream).filter("chr <> 'end'")


@query(_with(["reads"], "select chr, start // 500 as block, count(*) as reads, max(start) as last from reads group by all"))
def stream_windows(spark, d):
    reads = pileup.normalise(synth.reads(spark, d)).select("read_idx", "chr", "pos")
    last = reads.limit(1).withColumn("pos", F.lit(1 << 32).cast("long")).withColumn("chr", F.lit("end"))
    return _streamed(spark, reads, last, lambda r: stream.windows_stream(r, 500)).filter("chr <> 'end'")


@query(domain.SQL["consensus_rows"])
def calls_from_matrix(spark, d):
    """Calls that begin with a matrix from a file, as a second run on other reads of the same machine does."""
    path = folder(spark, "matrix")

    def through_file(packed):
        text.write_matrix(domain.calibration_matrix(packed), path)
        return text.read_matrix(spark, path)

    return posterior.consensus(domain.calls(spark, d, through_file))


@query(domain.SQL["consensus_rows"])
def stream_calls(spark, d):
    """Consensus rows of a stream: reads in order of position, a round a micro-batch, with a state a block of 512 places."""
    reads = domain.placed_reads(spark, d).select("read_idx", "chr", "pos", "seq", "qual", "hit", "strand", "read_len")
    # a read far beyond each contig's end moves the watermark past all blocks; where it lies there is no reference
    far = reads.limit(1).withColumn("pos", F.lit(1 << 32).cast("long")).withColumn("chr", F.lit("end"))
    matrix = calibrate.matrix(spark, domain.calibration_counts(spark, d), synth.PARAMS)

    def make(stream_of):
        sites = calls.site_stream(stream_of, synth.genome(spark, d, 512), synth.dbsnp(spark, d), matrix, synth.PARAMS, 512, late="error")
        return posterior.consensus(posterior.called(sites, synth.PARAMS))

    return _streamed(spark, reads, far, make)


_LCG = "with recursive g(i, x, y) as (select 1, 48271::bigint, 16807::bigint union all select i + 1, (48271 * x) % 2147483647, (16807 * y) % 2147483647 from g where i < 6000)"


@query(_LCG + " select i::bigint as idx, x, y from g where i <= 2000")
def random_lcg(spark, d):
    """The two minimal standard generators from seed 1."""
    idx = F.col("idx")
    return spark.range(1, 2001).withColumnRenamed("id", "idx").select("idx", random.lcg(idx).alias("x"), random.lcg(idx, 16807).alias("y"))


@query(_LCG + " select i::bigint as idx, round(x / 2147483647.0, 12) as u, (10 * x) // 2147483647 as n from g where i <= 1000")
def random_uniform(spark, d):
    """Uniform draws: in (0, 1), and whole numbers 0 to 9."""
    x = random.lcg(F.col("idx"))
    return spark.range(1, 1001).withColumnRenamed("id", "idx").select("idx", F.round(random.uniform(x), 12).alias("u"), random.below(x, 10).alias("n"))


@query(_LCG + " select (a.i // 2 + 1)::bigint as idx, round(sqrt(-2 * ln(a.x / 2147483647.0)) * cos(2 * pi() * b.x / 2147483647.0), 9) as z from g a join g b on b.i = a.i + 1 where a.i % 2 = 1 and a.i < 2000")
def random_normal(spark, d):
    """Normal draws, each from two uniform ones."""
    return spark.range(1, 1001).withColumnRenamed("id", "idx").select("idx", F.round(random.normal(F.col("idx")), 9).alias("z"))


@query(_LCG + " select ((i - 1) // 23 * 5 + (i - 1) % 23 + 1)::bigint as idx, x from g where (i - 1) % 23 < 5 and (i - 1) // 23 * 5 + (i - 1) % 23 < 1000")
def random_discard_block(spark, d):
    """The first 5 of each 23 draws."""
    return spark.range(1, 1001).withColumnRenamed("id", "idx").select("idx", random.lcg(random.discarded(F.col("idx"), 23, 5)).alias("x"))


@query(_LCG + " select i::bigint as idx, xor(x, y << 3) as x from g where i <= 1000")
def random_xor_combine(spark, d):
    idx = F.col("idx")
    return spark.range(1, 1001).withColumnRenamed("id", "idx").select("idx", random.xor_combined(random.lcg(idx), random.lcg(idx, 16807), 0, 3).alias("x"))


def _lfsr_sql(z: str, k: int, q: int, s: int) -> str:
    low = f"{z} & {(1 << 32) - (1 << (32 - k))}"
    return f"xor((({low}) << {s}) & 4294967295, xor(({z} << {q}) & 4294967295, {z}) >> {k - s})"


@query(
    "with recursive g(i, a, b, c) as (select 0, 341::bigint, 341::bigint, 341::bigint union all select i + 1, "
    + ", ".join(_lfsr_sql(z, *random.TAUS88[j]) for j, z in enumerate("abc"))
    + " from g where i < 1000) select i::bigint as idx, xor(a, xor(b, c)) as x from g where i > 0"
)
def random_taus88(spark, d):
    return random.taus88(spark, 1000)
