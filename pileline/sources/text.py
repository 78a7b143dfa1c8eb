"""Text sources and sinks: FASTA, alignments, known SNPs, regions, calibration matrix, consensus; and Parquet consensus.

Files are read by Spark, in splits, from any store that Spark knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..files import staged
from ..functions.bases import shown
from ..operators.pileup import BLOCK


def read_fasta(spark: SparkSession, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, contigs) of a FASTA file. A contig's name ends at the first white space; text before the first header is
    no contig. Lines are joined by contig through their places in the file: each line knows its length, a running sum by
    contig gives its start, and lines are cut where blocks begin. No contig is held as one value."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    # ids grow along a file's splits. A line's header is the last one before it in its split, else the last one of the splits
    # before; so lines meet no contigs, and only rows of one split, or one row a split, are ever ordered together
    split, name = F.shiftright("n", 33).alias("split"), F.regexp_extract("value", r"^>\s*(\S*)", 1)
    rows = lines.select("file", "n", split, F.when(F.startswith("value", F.lit(">")), name).alias("head"), "value")
    own = F.last("head", ignorenulls=True).over(W.partitionBy("file", "split").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    tails = rows.groupBy("file", "split").agg(F.max(F.when(F.col("head").isNotNull(), F.struct("n", "head")))["head"].alias("tail"))
    before = F.last("tail", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    tails = tails.select(F.col("file").alias("__f"), F.col("split").alias("__s"), before.alias("before"))
    body = rows.withColumn("own", own).filter("head IS NULL").withColumn("seq", F.regexp_replace("value", r"\s", "")).filter("seq <> ''")
    placed = body.join(tails, (F.col("file") == F.col("__f")) & (F.col("split") == F.col("__s"))).withColumn("chr", F.coalesce("own", "before")).filter("chr IS NOT NULL")
    # places, too, are summed up by split first
    sums = placed.groupBy("chr", "split").agg(F.sum(F.length("seq")).alias("letters"))
    earlier = F.coalesce(F.sum("letters").over(W.partitionBy("chr").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("chr").alias("__c"), F.col("split").alias("__p"), earlier.alias("earlier"))
    inside = F.coalesce(F.sum(F.length("seq")).over(W.partitionBy("chr", "split").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inside", inside).join(sums, (F.col("chr") == F.col("__c")) & (F.col("split") == F.col("__p")))
    start = F.col("earlier") + F.col("inside")
    placed = placed.select("chr", start.alias("start"), "seq")
    parts = placed.select("chr", "start", "seq", F.explode(F.expr(f"sequence((start) div {block}, (start + length(seq) - 1) div {block})")).alias("block"))
    left = F.greatest(F.col("block") * block, F.col("start"))
    right = F.least((F.col("block") + 1) * block, F.col("start") + F.length("seq"))
    cut = parts.select("chr", "block", left.alias("at"), F.substring(F.col("seq"), (left - F.col("start") + 1).cast("int"), (right - left).cast("int")).alias("piece"))
    # a block has ``block`` letters, so its pieces are bounded
    joined = cut.groupBy("chr", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    blocks = joined.select("chr", "block", (F.col("block") * block).alias("start"), "seq")
    return blocks, placed.groupBy("chr").agg(F.max(F.col("start") + F.length("seq")).alias("length"))


def write_fasta(blocks: DataFrame, path: str) -> None:
    """One file for each contig: its header, then a line for each block."""
    head = blocks.select("chr", F.lit(-1).cast("long").alias("block"), F.concat(F.lit(">"), "chr").alias("value")).distinct()
    rows = head.unionAll(blocks.select("chr", "block", F.col("seq").alias("value"))).repartition("chr").sortWithinPartitions("chr", "block")
    rows.select(F.col("chr").alias("contig"), "value").write.mode("overwrite").partitionBy("contig").text(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Reads of whitespace-separated lines: id seq qual hit ab length strand chr pos mismatch [indel position]. Lines with
    fewer than ten fields, or with a field that should be a number and isn't, are left out."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("read_idx"), F.split(F.btrim("value"), r"\s+").alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    number = lambda k: F.expr(f"try_cast(get(f, {k}) as int)")
    rows = lines.filter(F.size("f") >= 10).select(
        "read_idx", at(0).alias("read_id"), at(1).alias("seq"), at(2).alias("qual"), number(3).alias("hit"), at(4).alias("ab"), number(5).alias("read_len"), at(6).alias("strand"), at(7).alias("chr"),
        F.expr("try_cast(get(f, 8) as bigint)").alias("pos"), number(9).alias("mismatch"), F.when(number(9) > 100, number(10)).alias("indel_pos"),
    )
    return rows.filter("hit IS NOT NULL AND read_len IS NOT NULL AND pos IS NOT NULL AND mismatch IS NOT NULL")


def write_alignments(reads: DataFrame, path: str) -> None:
    columns = ["read_id", "seq", "qual", "hit", "ab", "read_len", "strand", "chr", "pos", "mismatch", "indel_pos"]
    reads.sortWithinPartitions("read_idx").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def read_dbsnp(spark: SparkSession, path: str) -> DataFrame:
    """Known SNPs, positions made 0-based; row_id is the order of the file, whose first row of a position counts."""
    rows = spark.read.csv(path, sep="\t", schema=schema.DBSNP).withColumn("row_id", F.monotonically_increasing_id())
    freq = [F.col(c).alias(f"f{k}") for k, c in enumerate(("f_a", "f_c", "f_t", "f_g"))]
    return rows.filter("chr IS NOT NULL AND pos IS NOT NULL").select("chr", (F.col("pos") - 1).alias("pos"), "hapmap", "validated", "indel", *freq, "rsid", "row_id")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end; rows without all three are left out."""
    return spark.read.csv(path, sep="\t", schema=schema.REGIONS).na.drop()


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The calibration matrix from rows ``q cycle p0 .. p15``, p by true base * 4 + observed base."""
    rows = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("f")).filter(F.size("f") >= 18)
    long = rows.select(F.col("f")[0].cast("int").alias("q"), F.col("f")[1].cast("int").alias("cycle"), F.posexplode(F.slice("f", 3, 16)).alias("k", "p"))
    return long.select("q", "cycle", F.shiftright("k", 2).alias("t_base"), F.col("k").bitwiseAND(3).alias("o_base"), F.col("p").cast("double").alias("p"))


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Tab-separated, in scientific notation with 16 digits."""
    wide = matrix.groupBy("q", "cycle").agg(F.sort_array(F.collect_list(F.struct("t_base", "o_base", "p"))).alias("cells"))
    values = F.transform("cells", lambda c: F.format_string("%.16e", c["p"]))
    wide.orderBy("q", "cycle").select(F.concat_ws("\t", F.col("q").cast("string"), F.col("cycle").cast("string"), F.array_join(values, "\t")).alias("value")).write.mode("overwrite").text(path)


def six_digits(x: Column) -> Column:
    """A number with six significant digits and its decimal point, as text: 1.00000, 0.0123457, 255.000."""
    digits = F.when(x == 0, F.lit(5)).otherwise(F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x)) + 1e-12))).cast("int")
    out = F.format_string("%.12f", x)
    for n in range(12, -1, -1):
        out = F.when(digits == n, F.format_string(f"%.{n}f", x)).otherwise(out)
    return F.when((x != 0) & (F.abs(x) < 1e-4), F.format_string("%.5e", x)).otherwise(out)


#: Text of a site without a call after its contig and position (fixed value).
N_ROW = "N\tN\t0\tN\t0\t0\t0\tN\t0\t0\t0\t0\t1.000\t255.000\t0"


def consensus_lines(rows: DataFrame) -> DataFrame:
    """The 17 tab-separated columns of each row as ``value``."""
    columns = [F.col(c).cast("string") for c in rows.columns[2:14]]
    line = F.concat_ws("\t", *columns, six_digits(F.col("rank_p")), six_digits(F.col("copy_number")), F.col("is_dbsnp").cast("string"))
    return rows.select("chr", "pos", F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.when((F.col("ref") == "N") & (F.col("genotype") == "N"), F.lit(N_ROW)).otherwise(line)).alias("value"))


def write_consensus(rows: DataFrame, path: str) -> None:
    """Text in order of (chr, pos), by ranges."""
    # bounds of ranges come from a sample, for which all rows would be made once more
    consensus_lines(staged(rows).repartitionByRange("chr", "pos")).sortWithinPartitions("chr", "pos").select("value").write.mode("overwrite").text(path)


def read_consensus_text(spark: SparkSession, path: str) -> DataFrame:
    """Consensus text; a row of another shape is an error."""
    return spark.read.csv(path, sep="\t", schema=schema.CONSENSUS, mode="FAILFAST")


def write_consensus_table(rows: DataFrame, path: str, block: int = 262_144) -> None:
    """Compressed columns, in order of position, in folders by contig; row groups carry the positions' bounds."""
    staged(rows).withColumn("block", F.floor((F.col("pos") - 1) / block)).repartitionByRange("chr", "block").sortWithinPartitions("chr", "pos").write.mode("overwrite").partitionBy("chr").option("compression", "zstd").parquet(path)


def read_consensus(spark: SparkSession, path: str, chr: str | None = None, start: int | None = None, end: int | None = None, block: int = 262_144) -> DataFrame:
    """Rows of the table, or of a region (1-based, both ends in): contigs by folder, blocks and positions by row group."""
    rows = spark.read.schema(schema.CONSENSUS + ", block bigint").parquet(path)
    if chr is not None:
        rows = rows.filter(F.col("chr") == chr)
    if start is not None:
        rows = rows.filter((F.col("block") >= (start - 1) // block) & (F.col("pos") >= start))
    if end is not None:
        rows = rows.filter((F.col("block") <= (end - 1) // block) & (F.col("pos") <= end))
    names = [c.split()[0] for c in schema.CONSENSUS.split(", ")]
    return rows.select(*names)
