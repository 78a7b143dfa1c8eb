"""Columnar codecs: run lengths, dictionaries, two-bit bases, differences, sparse lists, window directory.

Words are built and read by shifts; rows are grouped by word, never collected. The codec of whole consensus rows works on
blocks of bounded size in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import schema
from ..files import staged
from .seq import ranked, reduce_by_key

#: Two-bit codes of the packed form, in another order than the base codes: A0 C1 G2 T3 (fixed value).
PACKED = "ACGT"


def rle_encode(df: DataFrame, idx: str, value: str) -> DataFrame:
    """(start, run_length, value) of each run."""
    return reduce_by_key(df, idx, F.col(value), F.count(F.lit(1)).alias("run_length")).select(F.col("first_idx").alias("start"), "run_length", F.col("key").alias("value"))


def rle_decode(runs: DataFrame, idx: str = "idx") -> DataFrame:
    return runs.select(F.explode(F.expr("sequence(start, start + run_length - 1)")).alias(idx), "value")


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """(value, code): the distinct values in order, from code 0. One row a distinct value, numbered by ranges."""
    return ranked(df.select(F.col(value).alias("value")).distinct(), "value").select("value", (F.col("rank") - 1).alias("code"))


def code_bits(entries: int) -> int:
    """Bits of a code: enough for so many entries, 1 at least."""
    return max(1, (entries - 1).bit_length())


def pack(df: DataFrame, idx: str, code: str, bits: int, word_bits: int = 32) -> DataFrame:
    """(word, n, packed): codes of ``bits`` bits, the first in the highest place, as many as fit in a word; the last word is
    aligned to the right."""
    each = word_bits // bits
    rows = df.select(F.floor(F.col(idx) / each).alias("word"), (F.col(idx) % each).alias("__k"), F.col(code).cast("long").alias("__c"))
    sizes = F.max("__k").over(W.partitionBy("word")) + 1
    shifted = rows.withColumn("__n", sizes).withColumn("__s", F.expr(f"shiftleft(__c, cast((__n - 1 - __k) * {bits} as int))"))
    return shifted.groupBy("word").agg(F.max("__n").alias("n"), F.sum("__s").alias("packed"))


def unpack(words: DataFrame, bits: int, idx: str = "idx", word_bits: int = 32) -> DataFrame:
    """(idx, code) of packed words."""
    each = word_bits // bits
    rows = words.select("word", "n", "packed", F.explode(F.expr("sequence(0L, cast(n as bigint) - 1)")).alias("__k"))
    return rows.select((F.col("word") * each + F.col("__k")).alias(idx), F.expr(f"shiftright(packed, cast((n - 1 - __k) * {bits} as int)) & {(1 << bits) - 1}").alias("code"))


def base2bit(letter: Column) -> Column:
    """Two-bit code of A, C, G, T; anything else is an error."""
    place = F.instr(F.lit(PACKED), F.upper(letter))
    return F.when((F.length(letter) == 1) & (place > 0), place - 1).otherwise(F.raise_error(F.concat(F.lit("no base: "), F.coalesce(letter, F.lit("null")))).cast("int"))


def bit2base(code: Column) -> Column:
    return F.substring(F.lit(PACKED), code.cast("int") + 1, F.lit(1))


def diff_encode(df: DataFrame, idx: str, column: str, against: str) -> DataFrame:
    """(idx, value) where the column isn't what it is told against."""
    return df.filter(~F.col(column).eqNullSafe(F.col(against))).select(idx, F.col(column).alias("value"))


def diff_decode(base: DataFrame, idx: str, against: str, changes: DataFrame, out: str) -> DataFrame:
    moved = changes.select(F.col(idx).alias("__i"), F.struct("value").alias("__v"))
    return base.join(moved, F.col(idx) == F.col("__i"), "left").withColumn(out, F.when(F.col("__v").isNotNull(), F.col("__v")["value"]).otherwise(F.col(against))).drop("__i", "__v")


def sparse(df: DataFrame, idx: list[str], column: str, usual) -> DataFrame:
    """The rows where a column isn't its usual value; each column is tested for itself."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(usual))).select(*idx, F.col(column).alias("value"))


def sparse_columns(df: DataFrame, keys: list[str], usual: dict[str, float]) -> DataFrame:
    """(col, keys, value) of every value that isn't the usual one of its column: one pass for all columns."""
    values = F.array(*[F.struct(F.lit(c).alias("col"), F.when(~F.col(c).eqNullSafe(F.lit(u)), F.col(c).cast("double")).alias("value")) for c, u in usual.items()])
    return df.select(*keys, F.explode(F.filter(values, lambda x: x["value"].isNotNull())).alias("x")).select("x.col", *keys, "x.value")


#: How each column of a consensus row is kept in a block: bases by two bits, runs, or exceptions to the usual value.
_BASES, _RUN_COLUMNS = ("ref", "base1", "base2"), ("quality", "avg_q1", "uni1", "all1", "depth", "copy_number")
_USUAL = {"avg_q2": 0, "uni2": 0, "all2": 0, "rank_p": 1.0, "is_dbsnp": 0}
_KINDS = dict(c.split() for c in schema.CONSENSUS.split(", "))
#: A site without a call (fixed values).
_NOTHING = {"ref": "N", "genotype": "N", "base1": "N", "base2": "N", "rank_p": 1.0, "copy_number": 255.0}


def _block_schema() -> str:
    lists = {"pos_v": "bigint", "pos_n": "int", "genotype_k": "int", "genotype_v": "string"}
    for c in _BASES:
        lists |= {f"{c}_w": "bigint", f"{c}_k": "int", f"{c}_n": "int", f"{c}_v": "string"}
    lists |= {f"{c}_v": _KINDS[c] for c in _RUN_COLUMNS} | {f"{c}_n": "int" for c in _RUN_COLUMNS}
    lists |= {f"{c}_{x}": _KINDS[c] if x == "v" else "int" for c in _USUAL for x in "kv"}
    codes = [f"{c}_r int, {c}_vc binary, {c}_nc binary" for c in _RUN_COLUMNS] + [f"{c}_vc binary" for c in _USUAL]
    return "chr string, block bigint, n int, all_n boolean, " + ", ".join(f"{c} array<{t}>" for c, t in lists.items()) + ", " + ", ".join(codes)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if values.size else np.zeros(0, np.int64)
    return values[heads], np.diff(np.append(heads, values.size))


def _coded(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The distinct values, and each value's number among them in code_bits() bits, one after the other."""
    entries, codes = np.unique(values, return_inverse=True)
    bits = code_bits(entries.size)
    return entries, np.packbits((codes.reshape(-1, 1) >> np.arange(bits - 1, -1, -1)) & 1).tobytes()


def _uncoded(entries: np.ndarray, packed: bytes, n: int) -> np.ndarray:
    bits = code_bits(entries.size)
    each = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits).reshape(n, bits)
    return entries[each @ (1 << np.arange(bits - 1, -1, -1))] if n else entries[:0]


def _encoded(rows: dict[str, np.ndarray]) -> dict:
    """One block: its rows' columns, in order of position. A block of sites without calls ends after its positions."""
    n = rows["pos"].size
    out: dict = {"n": n}
    out["pos_v"], out["pos_n"] = _runs(rows["pos"] - np.arange(n))  # runs of consecutive places
    out["all_n"] = all(bool(np.all(rows[c] == _NOTHING.get(c, 0))) for c in _KINDS if c not in ("chr", "pos"))
    if out["all_n"]:
        return out
    for c in _BASES:
        # two bits a base, 32 a word, the first lowest; what is no base is 0 there and listed by runs
        code = np.full(n, -1)
        for k, letter in enumerate(PACKED):
            code[rows[c] == letter] = k
        odd = np.flatnonzero(code < 0)
        padded = np.zeros(-(-n // 32) * 32, np.uint64)
        padded[:n] = np.maximum(code, 0)
        out[f"{c}_w"] = np.bitwise_or.reduce(padded.reshape(-1, 32) << (2 * np.arange(32, dtype=np.uint64)), axis=1).view(np.int64)
        letters = rows[c][odd]
        new = np.flatnonzero(np.concatenate(([True], (odd[1:] != odd[:-1] + 1) | (letters[1:] != letters[:-1])))) if odd.size else odd
        out[f"{c}_k"], out[f"{c}_n"], out[f"{c}_v"] = odd[new], np.diff(np.append(new, odd.size)), letters[new]
    for c in _RUN_COLUMNS:
        values, lengths = _runs(rows[c])
        out[f"{c}_r"] = values.size
        out[f"{c}_v"], out[f"{c}_vc"] = _coded(values)
        out[f"{c}_n"], out[f"{c}_nc"] = _coded(lengths)
    odd = np.flatnonzero(rows["genotype"] != rows["ref"])
    out["genotype_k"], out["genotype_v"] = odd, rows["genotype"][odd]
    for c, usual in _USUAL.items():
        odd = np.flatnonzero(rows[c] != usual)
        out[f"{c}_k"] = odd
        out[f"{c}_v"], out[f"{c}_vc"] = _coded(rows[c][odd])
    return out


def _decoded(x: dict) -> dict[str, np.ndarray]:
    n = x["n"]
    out = {"pos": np.repeat(np.asarray(x["pos_v"], np.int64), x["pos_n"]) + np.arange(n)}
    if x["all_n"]:
        return out | {c: np.full(n, _NOTHING.get(c, 0), object if isinstance(_NOTHING.get(c), str) else None) for c in _KINDS if c not in ("chr", "pos")}
    for c in _BASES:
        codes = (np.asarray(x[f"{c}_w"], np.int64).view(np.uint64)[:, None] >> (2 * np.arange(32, dtype=np.uint64))) & np.uint64(3)
        out[c] = np.array(list(PACKED), object)[codes.reshape(-1)[:n].astype(np.int64)]
        for k, length, letter in zip(x[f"{c}_k"], x[f"{c}_n"], x[f"{c}_v"], strict=True):
            out[c][k : k + length] = letter
    for c in _RUN_COLUMNS:
        runs = x[f"{c}_r"]
        out[c] = np.repeat(_uncoded(np.asarray(x[f"{c}_v"]), x[f"{c}_vc"], runs), _uncoded(np.asarray(x[f"{c}_n"], np.int64), x[f"{c}_nc"], runs))
    out["genotype"] = out["ref"].copy()
    out["genotype"][x["genotype_k"]] = x["genotype_v"]
    for c, usual in _USUAL.items():
        at = np.asarray(x[f"{c}_k"], np.int64)
        out[c] = np.full(n, usual)
        out[c][at] = _uncoded(np.asarray(x[f"{c}_v"], out[c].dtype), x[f"{c}_vc"], at.size)
    return out


def compress(rows: DataFrame, size: int = 4096) -> DataFrame:
    """Consensus rows (17 columns, none null) as one row for each (chr, block) of ``size`` places: positions as runs of
    consecutive ones, bases by two bits with runs of what is none, the genotype where it isn't the reference's letter,
    quality, counts and copy number by runs whose values and lengths are dictionary codes of as many bits as they need, all else
    where it isn't what it mostly is, in such codes, too; of a block without calls the positions only. Arrow batches; a block is bounded."""
    names = list(_KINDS)
    placed = rows.select(*names, F.floor((F.col("pos") - 1) / size).alias("block")).repartition("chr", "block").sortWithinPartitions("chr", "block", "pos")
    target = pa.schema(to_arrow_schema(_parse_datatype_string(_block_schema())))

    def run(batches):
        held, last = [], None

        def done():
            table = pa.Table.from_batches(held)
            block = _encoded({c: table.column(c).to_numpy() for c in names if c != "chr"})
            return pa.RecordBatch.from_pylist([{"chr": last[0], "block": last[1]} | {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in block.items()}], target)

        for batch in batches:
            if not batch.num_rows:
                continue
            chrs, blocks = batch.column("chr").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (chrs[1:] != chrs[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                own = (chrs[a], int(blocks[a]))
                if held and own != last:
                    yield done()
                    held = []
                last = own
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return placed.mapInArrow(run, _block_schema())


def decompress(blocks: DataFrame) -> DataFrame:
    """The rows of compress(), all 17 columns."""
    target = pa.schema(to_arrow_schema(_parse_datatype_string(schema.CONSENSUS)))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                columns = _decoded(x) | {"chr": [x["chr"]] * x["n"]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return blocks.mapInArrow(run, schema.CONSENSUS)


def write_blocks(rows: DataFrame, path: str, size: int = 4096) -> None:
    """compress() as a table in order of (chr, block): folders by contig, bounds of blocks in each row group, small row groups,
    so that a region needs few of them."""
    blocks = staged(compress(rows, size))  # bounds of ranges come from a sample, for which all would be made once more
    ordered = blocks.repartitionByRange("chr", "block").sortWithinPartitions("chr", "block")
    ordered.write.mode("overwrite").partitionBy("chr").option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(path)


def region_blocks(spark: SparkSession, path: str, chr: str, start: int, end: int, size: int = 4096) -> DataFrame:
    """The blocks of write_blocks() that hold a place of a region (1-based, both ends in): the contig's folder only, row groups by
    the bounds of their blocks, and no other block is decoded."""
    kinds = _block_schema().replace("chr string, ", "", 1) + ", chr string"
    rows = spark.read.schema(kinds).parquet(path)
    return rows.filter((F.col("chr") == chr) & (F.col("block") >= (start - 1) // size) & (F.col("block") <= (end - 1) // size))


def read_region(spark: SparkSession, path: str, chr: str, start: int, end: int, size: int = 4096) -> DataFrame:
    """The consensus rows of a region from compressed blocks."""
    names = [c.split()[0] for c in _block_schema().split(", ")]
    found = decompress(region_blocks(spark, path, chr, start, end, size).select(*names))
    return found.filter((F.col("pos") >= start) & (F.col("pos") <= end))


def window_directory(rows: DataFrame, size: int = 262_144) -> DataFrame:
    """(chr, block, first_pos, sites, all_n) of windows of ``size`` sites."""
    return rows.groupBy("chr", F.floor((F.col("pos") - 1) / size).alias("block")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("sites"), F.every(F.col("ref") == "N").alias("all_n"))


def differing(a: DataFrame, b: DataFrame, keys: list[str], exact: list[str], near: list[str], tolerance: float = 1e-5) -> DataFrame:
    """(column, n): how many rows of two tables differ by column; ``near`` columns by more than a relative tolerance."""
    joined = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in exact + near]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in exact + near]), keys, "full")
    same = {c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in exact} | {c: F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance * F.greatest(F.abs(f"a_{c}"), F.abs(f"b_{c}")), F.lit(False)) for c in near}
    counts = joined.agg(*[F.count_if(~x).alias(c) for c, x in same.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in same])).alias("x")).select("x.column", "x.n")
