"""From reads to observations and per-site counts.

One exchange by (chr, pos) serves the depth cap, both dependency ranks and the aggregates: every later window and grouping
has (chr, pos) among its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import read_code, ref_code
from ..params import CallParams

BLOCK = 4096


def normalise(reads: DataFrame) -> DataFrame:
    """0-based positions, and insertions and deletions taken out of seq and qual; read_len stays.

    mismatch over 200: so many N less 200 go in at indel_pos; 101 to 200: so many signs less 100 are taken out there."""
    mm, at = F.coalesce("mismatch", F.lit(0)), F.coalesce("indel_pos", F.lit(0))
    out = reads.withColumn("pos", F.col("pos") - 1)
    for c in ("seq", "qual"):
        left = F.substring(F.col(c), F.lit(1), at)
        wider = F.concat(left, F.repeat(F.lit("N"), mm - 200), F.substring(F.col(c), at + 1, F.length(c)))
        narrower = F.concat(left, F.substring(F.col(c), at + mm - 100 + 1, F.length(c)))
        out = out.withColumn(c, F.when(mm > 200, wider).when(mm > 100, narrower).otherwise(F.col(c)))
    return out


#: Contigs that are broadcast: names and lengths of so many are some MB.
FEW_CONTIGS = 50_000


def in_bounds(reads: DataFrame, contigs: DataFrame, strict: bool = True) -> DataFrame:
    """Reads that start at 0 or later and end before the contig's last place; ``strict``: an unknown contig is an error.

    Contigs are counted first: up to FEW_CONTIGS are broadcast, so that reads stay where they are (by contig they would be as
    many groups as there are chromosomes); more go by a shuffle."""
    lengths = contigs.select(F.col("chr").alias("__c"), F.col("length").alias("__length"))
    if lengths.limit(FEW_CONTIGS + 1).count() <= FEW_CONTIGS:
        lengths = F.broadcast(lengths)
    joined = reads.join(lengths, F.col("chr") == F.col("__c"), "left" if strict else "inner")
    inside = (F.col("pos") >= 0) & (F.col("pos") + F.col("read_len") < F.col("__length"))
    if strict:  # in one expression with the bounds, so that no filter comes before it
        inside = F.when(F.col("__length").isNull(), F.raise_error(F.concat(F.lit("unknown contig "), F.coalesce("chr", F.lit("null")))).cast("boolean")).otherwise(inside)
    return joined.filter(inside).drop("__c", "__length")


def with_ref_pieces(reads: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each genome block that a read lies in, with the reference letters under it (piece) and the read's first
    place there (first). Reads meet blocks by (chr, block), before they are exploded, so a block's text is copied once a
    read and not once a base; places without a block are left out."""
    end = F.col("pos") + F.col("read_len")
    parts = reads.withColumn("__at", F.explode(F.expr(f"sequence((pos) div {block}, (pos + read_len - 1) div {block})")))
    # each row becomes as many as it has bases, so that partitions must not be joined by their size before that
    parts = parts.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chr", "__at")
    g = blocks.select(F.col("chr").alias("__c"), F.col("block").alias("__b"), F.col("start").alias("__s"), F.col("seq").alias("__g"))
    joined = parts.join(g, (F.col("chr") == F.col("__c")) & (F.col("__at") == F.col("__b")))
    left, right = F.greatest(F.col("pos"), F.col("__s")), F.least(end, F.col("__s") + F.length("__g"))
    piece = F.substring(F.col("__g"), (left - F.col("__s") + 1).cast("int"), (right - left).cast("int"))
    return joined.withColumn("piece", piece).withColumn("first", (left - F.col("pos")).cast("int")).drop("__at", "__c", "__b", "__s", "__g").filter("piece <> ''")


def bases(reads: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """A row for each place a read covers: read_idx, chr, pos, start, coord, hit, strand (0 +, 1 -), cycle, base, q, eligible;
    of reads from with_ref_pieces() also ref_code.

    Places beyond a shortened string count in the depth only; so do N and qualities below q_min."""
    coord, pieces = F.col("coord"), "piece" in reads.columns
    places = F.sequence(F.col("first"), F.col("first") + F.length("piece") - 1) if pieces else F.sequence(F.lit(0), F.col("read_len") - 1)
    rows = reads.select("read_idx", "chr", F.col("pos").alias("start"), "hit", "read_len", F.when(F.col("strand") == "-", 1).otherwise(0).alias("strand"), "seq", "qual", *["piece", "first"] * pieces, F.explode(places).alias("coord"))
    letter, sign = F.substring(F.col("seq"), coord + 1, F.lit(1)), F.substring(F.col("qual"), coord + 1, F.lit(1))
    q = F.ascii(sign) - params.q_min
    ref = [ref_code(F.substring(F.col("piece"), coord - F.col("first") + 1, F.lit(1))).alias("ref_code")] if pieces else []
    return rows.select(
        "read_idx", "chr", (F.col("start") + coord).alias("pos"), "start", "coord", "hit", "strand", F.when(F.col("strand") == 0, coord).otherwise(F.col("read_len") - 1 - coord).alias("cycle"),
        read_code(letter).alias("base"), q.alias("q"), ((letter != "") & (F.upper(letter) != "N") & (sign != "") & (q >= 0)).alias("eligible"), *ref,
    )


def with_dependencies(rows: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Adds accepted (depth cap), unique (accepted and of one hit), t (occurrence among like base, strand and cycle), g (distinct
    strand and cycle of the base so far, less 1) and q_adj. t, g and q_adj are for unique rows."""
    site = ["chr", "pos"]
    arrived = W.partitionBy(*site).orderBy("start", "read_idx").rowsBetween(W.unboundedPreceding, -1)
    counted = F.when(F.col("eligible") & (F.col("hit") == 1), 1).otherwise(0)
    out = rows.repartition(*site).withColumn("accepted", F.col("eligible") & (F.coalesce(F.sum(counted).over(arrived), F.lit(0)) < params.depth_cap))
    out = out.withColumn("unique", F.col("accepted") & (F.col("hit") == 1))
    alike = W.partitionBy(*site, "unique", "base", "strand", "cycle").orderBy(F.desc("q"))
    out = out.withColumn("t", F.row_number().over(alike))
    by_base = W.partitionBy(*site, "unique", "base").orderBy(F.desc("q"), "cycle", "strand", "t").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("g", F.sum(F.when(F.col("t") == 1, 1).otherwise(0)).over(by_base) - 1)
    power = F.log10(F.col("q").cast("double")) + (F.col("t") - 1) * F.lit(params.log_pcr) + F.col("g") * F.lit(params.log_global)
    q_adj = F.when(F.col("q") <= 0, 1).otherwise(F.greatest(F.lit(1), F.floor(F.pow(F.lit(10.0), power) + 0.5).cast("int")))
    return out.withColumn("q_adj", q_adj)


def site_counts(extra: list | None = None) -> list:
    """Aggregates of a site: depth, repeat_time, dep_uni, and by base count_uni, q_sum, count_all."""
    base, u = F.col("base"), F.col("unique")
    out = [F.count(F.lit(1)).alias("depth"), F.sum("hit").alias("repeat_time"), F.count_if(u).alias("dep_uni")]
    for k in range(4):
        out += [F.count_if(u & (base == k)).alias(f"uni{k}"), F.coalesce(F.sum(F.when(u & (base == k), F.col("q"))), F.lit(0)).alias(f"qs{k}"), F.count_if(F.col("accepted") & (base == k)).alias(f"all{k}")]
    return out + (extra or [])


def pileup(observed: DataFrame) -> DataFrame:
    """Counts of each covered site."""
    return observed.groupBy("chr", "pos").agg(*site_counts())


def ref_sites(blocks: DataFrame) -> DataFrame:
    """Every place of the genome: chr, pos, ref_code."""
    rows = blocks.select("chr", "start", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("k"))
    return rows.select("chr", (F.col("start") + F.col("k")).alias("pos"), ref_code(F.substring(F.col("seq"), F.col("k") + 1, F.lit(1))).alias("ref_code"))


def known_sites(dbsnp: DataFrame) -> DataFrame:
    """One row for each (chr, 0-based pos): the first of the file's."""
    first = W.partitionBy("chr", "pos").orderBy("row_id")
    return dbsnp.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def site_bitmap(regions: DataFrame, read_length: int = 0, block: int = BLOCK) -> DataFrame:
    """(chr, block, words): a bit a place that a region (1-based start and end, both in; starts widened by the read length) covers, as
    words of 64 places by their number in the block. However many regions overlap, a block has one row of at most block / 64 words."""
    r = regions.select("chr", F.greatest(F.col("start") - 1 - read_length, F.lit(0)).alias("s"), (F.col("end") - 1).alias("e")).filter("s <= e")
    r = r.withColumn("word", F.explode(F.expr("sequence(s div 64, e div 64)")))
    low, high = F.greatest(F.col("s") - F.col("word") * 64, F.lit(0)), F.least(F.col("e") - F.col("word") * 64, F.lit(63))
    mask = F.expr("shiftleft(shiftrightunsigned(-1L, cast(63 - (high - low) as int)), cast(low as int))")
    words = r.withColumn("low", low).withColumn("high", high).groupBy("chr", "word").agg(F.bit_or(mask).alias("bits"))
    each = F.struct((F.col("word") % (block // 64)).cast("int").alias("k"), "bits")
    return words.groupBy("chr", F.floor(F.col("word") / (block // 64)).alias("block")).agg(F.map_from_entries(F.collect_list(each)).alias("words"))


def in_regions(sites: DataFrame, regions: DataFrame, read_length: int = 0, block: int = BLOCK) -> DataFrame:
    """Sites in one of the regions: an equi-join with the blocks' bitmaps, a row a block, then a look at the place's bit."""
    marks = site_bitmap(regions, read_length, block).select(F.col("chr").alias("__c"), F.col("block").alias("__b"), F.col("words").alias("__w"))
    joined = sites.join(marks, (F.col("chr") == F.col("__c")) & (F.floor(F.col("pos") / block) == F.col("__b")))
    word = F.coalesce(F.try_element_at("__w", F.floor(F.col("pos") % block / 64).cast("int")), F.lit(0).cast("long"))
    return joined.filter(F.getbit(word, (F.col("pos") % 64).cast("int")) == 1).drop("__c", "__b", "__w")


def check_order(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """Reads whose position is below that of the read before them in the file, within their contig: looked up within a contig's blocks
    of ``block`` reads; a block's first read is told the last read of the block before it."""
    rows = reads.withColumn("__k", F.floor(F.col("read_idx") / block))
    before = F.lag("pos").over(W.partitionBy("chr", "__k").orderBy("read_idx"))
    lasts = rows.groupBy("chr", "__k").agg(F.max_by("pos", "read_idx").alias("__last"))
    carry = lasts.select(F.col("chr").alias("__c"), F.col("__k").alias("__b"), F.lag("__last").over(W.partitionBy("chr").orderBy("__k")).alias("__carry"))
    joined = rows.withColumn("__before", before).join(carry, (F.col("chr") == F.col("__c")) & (F.col("__k") == F.col("__b")))
    return joined.filter(F.col("pos") < F.coalesce("__before", "__carry")).drop("__before", "__k", "__c", "__b", "__carry")
