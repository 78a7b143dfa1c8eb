"""Fuzzy line dedup by MinHash.

A line is a piece of a text between line feeds; blank lines are no part of this and always stay. Lines are compared
trimmed and in lower case. Equal ones meet by a 128-bit digest. For the rest, each line's signature is the minimum of 40
multiplicative hashes over its 7-character shingles (shorter lines: padded), cut into 10 bands of 4: two lines of
similarity 0.8 share a band with probability 0.995. Candidates are checked by the exact Jaccard likeness of their shingle
sets; a distributed union-find gives the components, and the first line (least document, then line number) of each stays.

No text is shuffled but the candidates' lines (and whole ones where dedup_lines() rewrites them); everything else moves
digests and numbers.

Defined results: a null text has no lines; null ids are one id, the least. Rows of one id are told apart, in no set order, so
that of lines that several of them share one stays; very long lines are hashed whole; an empty table gives an empty result.
Other columns are not read, and can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import linked_components, within
from .util import SPACES, Shelf, free, pieces, staged, text_of

SHINGLE = 7
BANDS, ROWS = 10, 4
SIMILARITY = 0.8
#: One-bit sketches of lines of similarity 0.8 differ in 4 of 40 places on average; in more than 12 about once in 50,000.
ALLOWED = 12
#: Bits of the table that tells which lines are wanted: 8 MB, at most 1,048,576 words from the cluster.
MARKS = 1 << 26
_A = np.uint32(0x9E3779B1)
#: Odd multipliers of the hash functions, from a rule.
_FACTORS = [np.uint32((0x85EBCA6B * (2 * k + 1) + 0xC2B2AE35 * 2 * k) & 0xFFFFFFFF | 1) for k in range(BANDS * ROWS)]
KEYS = [f"b{k}" for k in range(BANDS)]


def _minima(lines: list[str]) -> np.ndarray:
    """(BANDS * ROWS, lines): the least hash of each line's shingles by each hash function."""
    pad = "\0" * (SHINGLE - 1)
    codes = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = codes.size - SHINGLE + 1
    h = codes[:n].copy()
    for k in range(1, SHINGLE):
        h *= _A
        h += codes[k : n + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate(([0], np.cumsum(sizes + SHINGLE - 1)[:-1]))
    # a line of L signs has max(1, L - SHINGLE + 1) shingles; those that reach into the padding of a longer line don't count
    own = np.maximum(1, sizes - SHINGLE + 1)
    first = np.concatenate(([0], np.cumsum(own)[:-1]))
    h = h[np.repeat(starts - first, own) + np.arange(int(own.sum()))]
    scaled, out = np.empty_like(h), np.empty((BANDS * ROWS, len(lines)), np.uint32)
    for k, factor in enumerate(_FACTORS):
        np.multiply(h, factor, out=scaled)
        np.minimum.reduceat(scaled, first, out=out[k])
    return out


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bands, bits) of non-empty lines: int64 of (lines, BANDS), and the one-bit sketch as int64."""
    # runs that stay in a core's cache
    minima = np.concatenate([_minima(lines[a:b]) for a, b in _runs(list(map(len, lines)), 50_000)], axis=1).astype(np.uint64)
    bands = np.zeros((BANDS, len(lines)), np.uint64)
    for k in range(BANDS * ROWS):
        band = k // ROWS
        x = (bands[band] ^ minima[k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
        bands[band] = x ^ (x >> np.uint64(29))
    ones = (minima * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)
    bits = np.bitwise_or.reduce(ones << np.arange(BANDS * ROWS, dtype=np.uint64)[:, None], axis=0)
    return bands.T.view(np.int64), bits.view(np.int64)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_numbers(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all lines in turn as 64-bit numbers, which are distinct for distinct shingles but for chance
    (2 ** -64), and how many each line has."""
    pad = "\0" * (SHINGLE - 1)
    codes = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = codes.size - SHINGLE + 1
    h = codes[:n].copy()
    for k in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : n + k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate(([0], np.cumsum(sizes + SHINGLE - 1)[:-1]))
    own = np.maximum(1, sizes - SHINGLE + 1)
    first = np.concatenate(([0], np.cumsum(own)[:-1]))
    return h[np.repeat(starts - first, own) + np.arange(int(own.sum()))], own


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each non-empty line as ascending numbers of 52 bits, one line after the other, and their sizes."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start in range(0, len(lines), 1 << 12):
        some = lines[start : start + (1 << 12)]
        numbers, own = shingle_numbers(some)
        whole = np.sort((np.repeat(np.arange(len(some), dtype=np.uint64), own) << np.uint64(52)) | (numbers >> np.uint64(12)))
        whole = whole[np.concatenate(([True], whole[1:] != whole[:-1]))]
        values.append(whole & np.uint64((1 << 52) - 1))
        sizes.append(np.bincount((whole >> np.uint64(52)).astype(np.int64), minlength=len(some)))
    return np.concatenate(values), np.concatenate(sizes)


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of about ``most`` characters."""
    start, size = 0, 0
    for i, x in enumerate(sizes):
        if size and size + x > most:
            yield start, i
            start, size = i, 0
        size += x
    if sizes:
        yield start, len(sizes)


def _told_apart(df: DataFrame, id_col: str, copy: str) -> tuple[DataFrame, bool]:
    """``df`` with a column ``copy`` that tells rows of one id apart, and whether an id repeats. Rows of repeated ids are staged,
    so that the column stays what it is; all others have 0."""
    own = F.col(f"`{id_col}`")
    (name,) = free(df, "__again")
    again = staged(df.groupBy(own.alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(name))
    if again.isEmpty():
        return df.withColumn(copy, F.lit(0).cast("long")), False
    twice = own.eqNullSafe(F.col(name))
    copies = staged(df.join(again, twice, "left_semi").withColumn(copy, F.monotonically_increasing_id()))
    return df.join(again, twice, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(copies), True


def _documents(df: DataFrame, id_col: str, text_col: str, copy: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("__doc"), F.col(copy).alias("__copy"), text_of(text_col).alias("__text"))


def _lines(docs: DataFrame, signed: bool = False, only: Broadcast | None = None) -> DataFrame:
    """Of every line that is not blank: __doc, __copy, __no (from 0), digest hi and lo; signed: also b0 .. b9 and bits. ``only``:
    those of _marks(), with their normal form as ``line``."""
    names = [*KEYS, "bits"] if signed else ["line"] if only else []
    rows = docs.select("__doc", "__copy", "__text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start, texts in pieces(batch.column(2)):
                of, nos, lines = [], [], []
                for k, text in enumerate(texts):
                    for no, line in enumerate(text.lower().split("\n")):
                        if line := line.strip(SPACES):
                            of.append(start + k)
                            nos.append(no)
                            lines.append(line)
                if not lines:
                    continue
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), ">i8").astype(np.int64).reshape(-1, 2)
                take, number = np.array(of, np.int64), np.array(nos, np.int32)
                columns = []
                if only:
                    bit = (digests[:, 0] ^ (number.astype(np.int64) << 7)) & (MARKS - 1)
                    good = np.flatnonzero(only.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                    digests, take, number = digests[good], take[good], number[good]
                    columns = [pa.array([lines[k] for k in good.tolist()], pa.string())]
                if signed:
                    bands, bits = signatures(lines)
                    columns = [pa.array(np.ascontiguousarray(bands[:, k])) for k in range(BANDS)] + [pa.array(bits)]
                first = [batch.column(k).take(pa.array(take)) for k in (0, 1)] + [pa.array(number), *(pa.array(np.ascontiguousarray(digests[:, k])) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*first, *columns], names=["__doc", "__copy", "__no", "hi", "lo", *names])

    kind = rows.schema["__doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"__doc {kind}, __copy long, __no int, hi long, lo long" + "".join(f", {c} {'string' if c == 'line' else 'long'}" for c in names))


def _marks(wanted: DataFrame) -> Broadcast:
    """One bit for each of ``wanted`` (hi, __no), by digest and number, of a table of MARKS bits whatever their number; a line
    whose bit isn't set is none of them. It only spares moving lines that a join would leave out."""
    bit = F.col("hi").bitwiseXOR(F.shiftleft(F.col("__no").cast("long"), 7)).bitwiseAND(F.lit(MARKS - 1))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("ones")).toArrow()
    table = np.zeros(MARKS >> 6, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return wanted.sparkSession.sparkContext.broadcast(table)


class _Place:
    """Documents, rows and line numbers as one column that sorts as they do: a number where ids are whole numbers that do not
    repeat, which can be aggregated without a sort, else a struct."""

    def __init__(self, docs: DataFrame, repeated: bool):
        self.kind = docs.schema["__doc"].dataType
        self.width = F.lit(str(1 << 31)).cast("decimal(10,0)")
        self.number = not repeated and self.kind.typeName() in ("byte", "short", "integer", "long")

    def of(self) -> Column:
        if not self.number:
            return F.struct("__doc", "__copy", "__no")
        doc = F.coalesce(F.col("__doc").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
        return (doc * self.width + F.col("__no")).cast("decimal(38,0)")

    def doc(self, at: Column) -> Column:
        if not self.number:
            return at["__doc"]
        whole = ((at - self.no(at)) / self.width).cast("decimal(20,0)")
        return F.when(whole >= F.lit(str(-(1 << 63))).cast("decimal(20,0)"), whole.cast(self.kind))

    def no(self, at: Column) -> Column:
        return F.pmod(at, self.width).cast("int") if self.number else at["__no"]

    def copy(self, at: Column) -> Column:
        return F.lit(0).cast("long") if self.number else at["__copy"]


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, payload): the normal form of each line of ``wanted`` (id, hi, __doc, __copy, __no)."""
    wanted = staged(wanted)
    at = wanted.select("id", F.col("__doc").alias("d"), F.col("__copy").alias("c"), F.col("__no").alias("n"))
    lines = _lines(docs, only=_marks(wanted))
    return lines.join(at, F.col("__doc").eqNullSafe(F.col("d")) & (F.col("__copy") == F.col("c")) & (F.col("__no") == F.col("n"))).select("id", F.col("line").alias("payload"))


def _line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(column.to_pylist())


def _classes(docs: DataFrame, place: _Place, similarity: float) -> DataFrame:
    """Classes of more than one line: the digest (hi, lo) of every member with the class's first line (first_doc, first_copy,
    first_no) and the number of lines in it (class_lines)."""
    shelf = Shelf(docs.sparkSession)
    # columns that follow from the digest are the same in all rows of a group
    grouped = _lines(docs, signed=True).groupBy("hi", "lo").agg(F.min(place.of()).alias("at"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in [*KEYS, "bits"]])
    distinct = shelf.put(grouped.withColumn("id", F.monotonically_increasing_id()))

    def fetch(ids: DataFrame) -> DataFrame:
        at = F.col("at")
        return _line_texts(docs, distinct.join(ids, "id").select("id", "hi", place.doc(at).alias("__doc"), place.copy(at).alias("__copy"), place.no(at).alias("__no")))

    trees = linked_components(distinct.select("id", "bits", *KEYS), KEYS, within(ALLOWED), fetch, _line_sets, similarity)
    named = trees.select(F.col("node").alias("id"), "root").unionAll(trees.select(F.col("root").alias("id"), "root").distinct())
    # lines that are alone need no class
    members = distinct.select("id", "hi", "lo", "at", "n").join(named, "id", "left").filter("n > 1 OR root IS NOT NULL")
    members = shelf.put(members.select("hi", "lo", "at", "n", F.coalesce("root", "id").alias("root")))
    first = F.col("first")
    heads = members.groupBy("root").agg(F.min("at").alias("first"), F.sum("n").alias("class_lines"))
    # staged, so that a class of very many lines can be split in the join
    heads = shelf.put(heads.select("root", place.doc(first).alias("first_doc"), place.copy(first).alias("first_copy"), place.no(first).alias("first_no"), "class_lines"))
    out = staged(members.join(heads, "root").drop("root", "at", "n"))
    shelf.clear()
    return out


def _judged(docs: DataFrame, repeated: bool, similarity: float) -> DataFrame:
    """__doc, __copy, __no, first_doc, first_copy, first_no, class_lines (null: alone), kept."""
    joined = _lines(docs).join(_classes(docs, _Place(docs, repeated), similarity), ["hi", "lo"], "left").drop("hi", "lo")
    own = F.col("first_doc").eqNullSafe(F.col("__doc")) & (F.col("first_copy") == F.col("__copy")) & (F.col("first_no") == F.col("__no"))
    return joined.withColumn("kept", F.col("class_lines").isNull() | own)


def judged_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every line that is not blank: ``id_col``, line_no (from 0), class_doc and class_line (the first line of its class,
    itself if it is alone), class_lines (lines in the class), kept (whether it is that first line)."""
    (copy,) = free(df, "__copy")
    rows, repeated = _told_apart(df, id_col, copy)
    docs = _documents(rows, id_col, text_col, copy)
    alone = F.col("class_lines").isNull()
    return _judged(docs, repeated, similarity).select(
        F.col("__doc").alias(id_col), F.col("__no").alias("line_no"), F.when(alone, F.col("__doc")).otherwise(F.col("first_doc")).alias("class_doc"),
        F.when(alone, F.col("__no")).otherwise(F.col("first_no")).alias("class_line"), F.coalesce("class_lines", F.lit(1)).cast("long").alias("class_lines"), "kept",
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` with only the kept (and blank) lines in their texts; documents of which no line is left go, as do
    none that had no line to begin with. Rows of one id are told apart."""
    copy, d, c, drop, new = free(df, "__copy", "__d", "__c", "__drop", "__new")
    rows, repeated = _told_apart(df, id_col, copy)
    judged = _judged(_documents(rows, id_col, text_col, copy), repeated, similarity).filter(~F.col("kept"))
    dropped = staged(judged.groupBy(F.col("__doc").alias(d), F.col("__copy").alias(c)).agg(F.collect_set("__no").alias(drop)))
    # never broadcast: the table grows with the input, and its size in files says little of that in memory
    joined = rows.join(dropped.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col(d)) & (F.col(copy) == F.col(c)), "left")
    text = F.col(f"`{text_col}`").cast("string")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)  # by a hash set, in order
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n"))
    gone = F.col(drop).isNotNull() & (F.btrim(F.col(new), F.lit(SPACES)) == "")
    out = joined.withColumn(new, kept).filter(~F.coalesce(gone, F.lit(False)))
    return out.select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
