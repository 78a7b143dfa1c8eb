"""Pileup by tiles with a halo.

Reads, not bases, are dealt to tiles of the genome; a read across an edge goes to both tiles, and each takes its own places only.
Reference blocks and known sites go with them in the same exchange, the only one: what a tile needs is packed into one row of
columns and written once (``staged_tiles``). Calibration and calling both read that table; a row is never cut, so neither
needs an exchange by place. In a task each tile is piled up, capped, ranked and summed by numpy over arrays. Spark opens packed
rows into short ones on their way to Python, so that a batch holds some reads and not as many tiles as a task has.

Tiles whose reads have more than HOT_BASES bases, told from counts of all reads, are dealt to several rows by a hash of the read.
For calibration each row counts by itself. For calling, each row first takes out the bases that at least ``depth_cap`` of its own
eligible ones precede (so they precede in the whole tile, too): of those only depth and hits are kept, as sums. What is left
is at most the cap times the tile's places from each row and is put together in one task.

Letters and qualities are ASCII; of known sites at one place the first by ``row_id`` counts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import staged
from ..functions.bases import GENOTYPES
from ..params import CallParams
from .pileup import BLOCK

HOT_BASES = 2_000_000
#: Hot tiles up to which their list is broadcast; more go by a shuffle.
FEW_TILES = 50_000
#: Letters of the reference in a row on its way to Python.
PIECE = 256

_KNOWN = [("k_pos", "long"), ("k_hapmap", "int"), ("k_validated", "int"), ("k_indel", "int"), *((f"k_f{k}", "double") for k in range(4))]
_READS = [("r_pos", "long"), ("r_idx", "long"), ("r_hit", "int"), ("r_strand", "int"), ("r_len", "int"), ("r_seq", "string"), ("r_qual", "string")]
_HEAD = [("chr", "string"), ("tile", "long"), ("salts", "int"), ("start", "long"), ("ref", "string")]
_EXTRA = [("x_depth", "long"), ("x_hits", "long")]
_LISTS = [*_KNOWN, *_READS, *_EXTRA]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_PACKED = ", ".join([f"{c} {t}" for c, t in _HEAD] + [f"{c} array<{'bigint' if t == 'long' else t}>" for c, t in _LISTS])
_SCHEMA = pa.schema([(c, _ARROW[t]) for c, t in _HEAD] + [(c, pa.list_(_ARROW[t])) for c, t in _LISTS])


def _dealt(reads: DataFrame, block: int) -> DataFrame:
    end = F.col("pos") + F.col("read_len")
    cut = reads.withColumn("tile", F.explode(F.expr(f"sequence(pos div {block}, (pos + read_len - 1) div {block})")))
    inside = F.least(end, (F.col("tile") + 1) * block) - F.greatest(F.col("pos"), F.col("tile") * block)
    return cut.withColumn("inside", inside)


def hot_tiles(reads: DataFrame, block: int = BLOCK, hot: int = HOT_BASES) -> DataFrame:
    """(chr, tile, salts): tiles of more than ``hot`` bases, and the number of rows that they are dealt to."""
    sizes = _dealt(reads.select("chr", "pos", "read_len"), block).groupBy("chr", "tile").agg(F.sum("inside").alias("n"))
    return sizes.filter(F.col("n") > hot).select("chr", "tile", F.ceil(2 * F.col("n") / hot).cast("int").alias("salts"))


def covered_blocks(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """A block of unknown letters for each tile that a read touches, for what needs no reference."""
    touched = _dealt(reads.select("chr", "pos", "read_len"), block).select("chr", F.col("tile").alias("block")).distinct()
    return touched.select("chr", "block", (F.col("block") * block).alias("start"), F.lit("N" * block).alias("seq"))


def staged_tiles(reads: DataFrame, blocks: DataFrame, dbsnp: DataFrame | None = None, block: int = BLOCK, hot: int = HOT_BASES) -> DataFrame:
    """The packed tiles of reads (0-based positions, in bounds), of blocks of ``block`` places and of known sites (None: none), from a
    table in the shared folder; a row a tile that has a block, hot tiles some more. Reads where there is no block are left out."""
    many = staged(hot_tiles(reads, block, hot))
    none = many.isEmpty()
    if not none and many.limit(FEW_TILES + 1).count() <= FEW_TILES:
        many = F.broadcast(many)

    def salted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("salts", F.lit(1)) if none else rows.join(many, ["chr", "tile"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    no = lambda t: F.lit(None).cast(t)
    every = F.explode(F.expr("sequence(0, salts - 1)"))
    shape = lambda rows, salt, kind, pos, idx, a, b, n1, n2, n3, f: rows.select(
        "chr", "tile", "salts", salt.alias("salt"), F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), idx.cast("long").alias("idx"), a.alias("a"), b.alias("b"),
        n1.cast("int").alias("n1"), n2.cast("int").alias("n2"), n3.cast("int").alias("n3"), f.alias("f"))
    g = salted(blocks.withColumn("tile", F.col("block").cast("long")))
    r = salted(_dealt(reads, block).drop("inside"))
    rows = [
        shape(g, every, 0, F.col("start"), F.lit(0), F.col("seq"), no("string"), no("int"), no("int"), no("int"), no("array<double>")),
        shape(r, F.pmod(F.xxhash64("read_idx"), F.col("salts")).cast("int"), 2, F.col("pos"), F.col("read_idx"), F.col("seq"), F.col("qual"), F.col("hit"), F.when(F.col("strand") == "-", 1).otherwise(0), F.col("read_len"), no("array<double>")),
    ]
    if dbsnp is not None:
        freq = F.array(*[F.col(f"f{k}").cast("double") for k in range(4)])
        s = salted(dbsnp.withColumn("tile", F.expr(f"pos div {block}")))
        rows.append(shape(s, every, 1, F.col("pos"), F.col("row_id"), no("string"), no("string"), F.col("hapmap"), F.col("validated"), F.col("indel"), freq))
    whole = functools.reduce(DataFrame.unionAll, rows)
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = whole.repartition(parts, "chr", "tile", "salt").sortWithinPartitions("chr", "tile", "salt", "kind", "pos", "idx")
    return staged(whole.mapInArrow(_pack, _PACKED))


def _runs(batches, names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Of sorted batches: (key, table) of each run of equal ``names``."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for n in names:  # next to a null there is a cut in any case: the keys are compared below
            new |= pc.fill_null(pc.not_equal(batch.column(n).slice(1), batch.column(n).slice(0, batch.num_rows - 1)), True).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(batch.column(n)[a].as_py() for n in names)
            if held and own != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _pack(batches):
    for (chrom, tile, _), rows in _runs(batches, ("chr", "tile", "salt")):
        kind = rows.column("kind").to_numpy()
        a, b = int(np.searchsorted(kind, 1)), int(np.searchsorted(kind, 2))
        if not a:
            continue  # no reference here
        known, reads = rows.slice(a, b - a), rows.slice(b)
        places = known.column("pos").to_numpy()
        known = known.take(pa.array(np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if places.size else np.zeros(0, np.int64)))
        freq = [pa.array([None if f is None else f[k] for f in known.column("f").to_pylist()], pa.float64()) for k in range(4)]
        columns = [known.column("pos"), known.column("n1"), known.column("n2"), known.column("n3"), *freq]
        columns += [reads.column(c) for c in ("pos", "idx", "n1", "n2", "n3", "a", "b")] + [pa.array([], pa.int64())] * 2
        head = [[chrom], [tile], [rows.column("salts")[0].as_py()], [rows.column("pos")[0].as_py()], [rows.column("a")[0].as_py()]]
        yield _row(head, columns)


def _row(head: list[list], columns: list) -> pa.RecordBatch:
    arrays = [pa.array(v, t) for v, t in zip(head, _SCHEMA.types[: len(head)], strict=True)]
    for column, kind in zip(columns, _SCHEMA.types[len(head) :], strict=True):
        flat = _flat(column)
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type)))
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, one after the other, and where each begins and how many it has; a null has none."""
    texts = pa.concat_arrays([texts])  # offsets from 0
    if not len(texts):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64) if texts.offset == 0 else None
    if at is None:
        texts = pa.array(texts.to_pylist(), pa.string())
        at = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and at[-1] else np.zeros(1, np.uint8)
    return data, at[:-1], np.diff(at)


class Tile:
    """The arrays of one packed row: reference, known sites, and the bases of its reads in its own places, in order of (read start,
    read_idx) within a place."""

    def __init__(self, row: dict[str, pa.Array], start: int, ref: str, params: CallParams):
        self.start, self.size, self.params = start, len(ref), params
        self.ref_code = (np.frombuffer(ref.encode("ascii", "replace"), np.uint8) >> 1) & 7
        self.row = row
        pos, length = row["r_pos"].to_numpy().astype(np.int64), row["r_len"].to_numpy().astype(np.int64)
        first, last = np.maximum(start - pos, 0), np.minimum(start + self.size - pos, length)
        count = np.maximum(last - first, 0)
        read = np.repeat(np.arange(pos.size), count)
        coord = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        site = pos[read] + coord - start
        order = np.argsort(site, kind="stable")
        self.read, coord, self.site = read[order], coord[order], site[order]
        letter, sign = self._at(row["r_seq"], coord), self._at(row["r_qual"], coord)
        strand, hit = row["r_strand"].to_numpy(), row["r_hit"].to_numpy().astype(np.int64)
        self.base, self.q = ((letter >> 1) & 3).astype(np.int64), sign.astype(np.int64) - params.q_min
        self.strand = strand[self.read].astype(np.int64)
        self.cycle = np.where(self.strand == 0, coord, length[self.read] - 1 - coord)
        self.hit = hit[self.read]
        self.eligible = (letter != 0) & (letter & 0xDF != ord("N")) & (sign != 0) & (self.q >= 0)

    def _at(self, texts: pa.Array, coord: np.ndarray) -> np.ndarray:
        data, begin, size = _letters(texts)
        inside = coord < size[self.read] if coord.size else np.zeros(0, bool)
        return np.where(inside, data[np.where(inside, begin[self.read] + coord, 0)] if coord.size else 0, 0)

    def accepted(self) -> np.ndarray:
        """Eligible bases that fewer than ``depth_cap`` eligible ones of one hit precede at their place."""
        counted = (self.eligible & (self.hit == 1)).astype(np.int64)
        if not counted.size:
            return np.zeros(0, bool)
        before = np.cumsum(counted) - counted
        opens = np.concatenate(([True], self.site[1:] != self.site[:-1]))
        before -= before[opens][np.cumsum(opens) - 1]
        return self.eligible & (before < self.params.depth_cap)

    def known(self) -> np.ndarray:
        mask = np.zeros(self.size, bool)
        mask[self.row["k_pos"].to_numpy() - self.start] = True
        return mask

    def calibration_cells(self) -> np.ndarray:
        """Cells ((q * 256 + cycle) * 4 + reference) * 4 + base of the bases that calibration counts."""
        code = self.ref_code[self.site].astype(np.int64)
        use = self.eligible & (self.hit == 1) & (code < 4) & ~self.known()[self.site]
        return ((self.q[use] * 256 + self.cycle[use]) * 4 + code[use]) * 4 + self.base[use]

    def ranked(self, unique: np.ndarray) -> tuple[np.ndarray, ...]:
        """site, base, cycle, q, t, g, q_adj of unique bases."""
        site, base, strand, cycle, q = (x[unique] for x in (self.site, self.base, self.strand, self.cycle, self.q))
        alike = ((site * 4 + base) * 2 + strand) * 512 + cycle
        order = np.lexsort((-q, alike))
        t = np.zeros(site.size, np.int64)
        t[order] = _counter(alike[order])
        group = site * 4 + base
        order = np.lexsort((t, strand, cycle, -q, group))
        ordered = group[order]
        fresh = np.cumsum(t[order] == 1)
        opens = np.concatenate(([True], ordered[1:] != ordered[:-1])) if ordered.size else np.zeros(0, bool)
        g = np.zeros(site.size, np.int64)
        if ordered.size:
            g[order] = fresh - fresh[opens][np.cumsum(opens) - 1] + (t[order] == 1)[opens][np.cumsum(opens) - 1] - 1
        power = np.log10(np.maximum(q, 1).astype(np.float64)) + (t - 1) * self.params.log_pcr + g * self.params.log_global
        q_adj = np.where(q <= 0, 1, np.maximum(1, np.floor(np.power(10.0, power) + 0.5).astype(np.int64)))
        return site, base, cycle, q, t, g, q_adj


def _counter(keys: np.ndarray) -> np.ndarray:
    """1, 2, ... in each run of equal keys."""
    if not keys.size:
        return np.zeros(0, np.int64)
    opens = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.arange(keys.size)
    return at - at[opens][np.cumsum(opens) - 1] + 1


def _opened(tiles: DataFrame) -> DataFrame:
    """Packed rows as short ones, those of one packed row (``part``) next to each other: pieces of the reference (kind 0), known sites
    (1), reads (2), sums of left out reads (3)."""

    def each(kind: int, lists: list[tuple[str, str]], names: str) -> str:
        got = dict(zip(names.split(), (f"x.{c}" for c, _ in lists), strict=True))
        return f"transform(arrays_zip({', '.join(c for c, _ in lists)}), x -> {short(kind, got)})"

    def short(kind: int, got: dict[str, str]) -> str:
        return f"named_struct('kind', {kind}, " + ", ".join(f"'{c}', cast({got.get(c, 'null')} as {t})" for c, t in _SHORT) + ")"

    ref = f"transform(sequence(0, (length(ref) - 1) div {PIECE}), i -> {short(0, {'a': f'substring(ref, cast(i as int) * {PIECE} + 1, {PIECE})'})})"
    kinds = [ref, each(1, _KNOWN, "pos n1 n2 n3 f0 f1 f2 f3"), each(2, _READS, "pos idx n1 n2 n3 a b"), each(3, _EXTRA, "pos idx")]
    rows = tiles.select(F.monotonically_increasing_id().alias("part"), "chr", "tile", "salts", "start", F.expr(f"concat({', '.join(kinds)})").alias("x"))
    return rows.select("part", "chr", "tile", "salts", "start", F.inline("x"))


_SHORT = [("pos", "long"), ("idx", "long"), ("a", "string"), ("b", "string"), ("n1", "int"), ("n2", "int"), ("n3", "int"), *((f"f{k}", "double") for k in range(4))]


def _each_tile(batches, params: CallParams) -> Iterator[tuple[list, dict[str, pa.Array], Tile]]:
    """Of batches of _opened(): the head, the lists and the arrays of each packed row."""
    for _, rows in _runs(batches, ("part",)):
        cuts = np.searchsorted(rows.column("kind").to_numpy(), [0, 1, 2, 3, 4]).tolist()
        ref, known, reads, extra = (rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))
        text = "".join(ref.column("a").to_pylist())
        row = {}
        for lists, own, names in ((_KNOWN, known, "pos n1 n2 n3 f0 f1 f2 f3"), (_READS, reads, "pos idx n1 n2 n3 a b"), (_EXTRA, extra, "pos idx")):
            row |= {c: _flat(own.column(n)) for (c, _), n in zip(lists, names.split(), strict=True)}
        head = [ref.column(c)[0].as_py() for c in ("chr", "tile", "salts", "start")] + [text]
        yield head, row, Tile(row, head[3], text, params)


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat


def calibration_counts(tiles: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """(q, cycle, t_base, o_base, n) as calibrate.counts() gives them, from packed tiles: a table of cells a task, then their sums."""

    def run(batches):
        cells = np.zeros(64 * 256 * 16, np.int64)
        for _, _, tile in _each_tile(batches, params):
            cells += np.bincount(tile.calibration_cells(), minlength=cells.size)[: cells.size]
        at = np.flatnonzero(cells)
        columns = [at >> 12, at >> 4 & 255, at >> 2 & 3, at & 3]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(cells[at])], names=["q", "cycle", "t_base", "o_base", "n"])

    found = _opened(tiles).mapInArrow(run, "q int, cycle int, t_base int, o_base int, n long")
    return found.groupBy("q", "cycle", "t_base", "o_base").agg(F.sum("n").alias("n"))


def log_cube(lp: DataFrame) -> np.ndarray:
    """The log matrix (q, cycle, o_base, lp) as an array [64, 256, 4, 10]; it has at most so many cells, whatever the data."""
    table = lp.toArrow()
    cube = np.zeros((64, 256, 4, len(GENOTYPES)))
    q, cycle, base = (table.column(c).to_numpy() for c in ("q", "cycle", "o_base"))
    cube[q, cycle, base] = np.stack(table.column("lp").to_pylist()) if len(q) else 0.0
    return cube


def _slim(tiles: DataFrame, params: CallParams) -> DataFrame:
    """Rows of hot tiles, put together: one row a tile, with the reads that can count and sums of the rest."""

    def trim(batches):
        for head, row, tile in _each_tile(batches, params):
            kept = np.zeros(len(row["r_pos"]), bool)
            kept[tile.read[tile.accepted()]] = True
            out = ~kept[tile.read]
            depth = np.bincount(tile.site[out], minlength=tile.size)
            hits = np.bincount(tile.site[out], weights=tile.hit[out], minlength=tile.size).astype(np.int64)
            mask = pa.array(kept)
            columns = [row[c] for c, _ in _KNOWN] + [row[c].filter(mask) for c, _ in _READS] + [pa.array(depth), pa.array(hits)]
            yield _row([[x] for x in head], columns)

    def join(batches):
        for _, rows in _runs(batches, ("chr", "tile")):
            lists = {c: rows.column(c).combine_chunks() for c, _ in _LISTS}
            lists = {c: pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v for c, v in lists.items()}
            flat = {c: lists[c].flatten() for c, _ in _READS}
            order = pa.array(np.lexsort((flat["r_idx"].to_numpy(), flat["r_pos"].to_numpy())))
            sums = [pa.array(np.sum([lists[c][k].values.to_numpy() for k in range(rows.num_rows)], axis=0)) for c, _ in _EXTRA]
            yield _row([[rows.column(c)[0].as_py()] for c, _ in _HEAD], [lists[c][0].values for c, _ in _KNOWN] + [flat[c].take(order) for c, _ in _READS] + sums)

    return _opened(tiles).mapInArrow(trim, _PACKED).repartition("chr", "tile").sortWithinPartitions("chr", "tile").mapInArrow(join, _PACKED)


_NUMBERS = ["depth", "repeat_time", "dep_uni", *[f"{c}{k}" for k in range(4) for c in ("uni", "qs", "all")]]
_SITES = "chr string, pos long, ref_code int, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", lik array<double>, hapmap int, validated int, indel int, f0 double, f1 double, f2 double, f3 double, seen array<struct<base:int,q:int>>"


def site_rows(tiles: DataFrame, cube: np.ndarray, params: CallParams = CallParams()) -> DataFrame:
    """Every place of the tiles: reference code, counts, ``lik``, its known site (nulls where there is none), and with
    ``rank_sum`` what is seen of unique bases: what posterior.called() needs, without a join or an exchange. ``cube``: log_cube(), 5 MB."""
    box = tiles.sparkSession.sparkContext.broadcast(cube)
    return _by_tile(tiles, params, lambda tile, row, chrom: _sites(tile, row, chrom, box.value, params), _SITES)


def _by_tile(tiles: DataFrame, params: CallParams, make: Callable[[Tile, dict[str, pa.Array], str], pa.RecordBatch], kinds: str) -> DataFrame:
    """What ``make`` gives for each tile, hot ones put together first."""

    def run(batches):
        for head, row, tile in _each_tile(batches, params):
            yield make(tile, row, head[0])

    plain = _opened(tiles.filter("salts = 1")).mapInArrow(run, kinds)
    hot = tiles.filter("salts > 1")
    return plain if hot.isEmpty() else plain.unionAll(_opened(_slim(hot, params)).mapInArrow(run, kinds))


def site_counts(tiles: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Counts of each covered site, as pileup.pileup() gives them."""

    def make(tile, row, chrom):
        numbers = _counts(tile, row, tile.accepted())
        at = np.flatnonzero(numbers["depth"])
        return _batch(chrom, at + tile.start, {c: numbers[c][at] for c in _NUMBERS}, "")

    return _by_tile(tiles, params, make, "chr string, pos long, " + ", ".join(f"{c} long" for c in _NUMBERS))


_PLACE = "chr string, pos long, ref_code int, known boolean, hapmap int, validated int, indel int, f0 double, f1 double, f2 double, f3 double"


def reference_rows(tiles: DataFrame) -> DataFrame:
    """Every place of the tiles with its reference code and its known site (``known``: whether there is one)."""

    def make(tile, row, chrom):
        code = pa.array(tile.ref_code.astype(np.int32))
        known = _known(tile, row)
        arrays = [pa.array([chrom] * tile.size, pa.string()), pa.array(np.arange(tile.size) + tile.start), code, pa.array(tile.known()), *known]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _PLACE.split(", ")])

    return _by_tile(tiles, CallParams(), make, _PLACE)


def no_reads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "read_idx long, chr string, pos long, seq string, qual string, hit int, strand string, read_len int")


def _known(tile: Tile, row: dict[str, pa.Array]) -> list[pa.Array]:
    """The columns of the known site of each place."""
    place = row["k_pos"].to_numpy() - tile.start
    at = np.full(tile.size, -1)
    at[place] = np.arange(place.size)
    pick = pa.array(at, mask=at < 0)
    return [row[c].take(pick) for c, _ in _KNOWN[1:]]


_SUMS = [f"{f}_{c}" for c in ("t", "g", "q", "q_adj") for f in ("sum", "max")]


def base_sums(tiles: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """(chr, pos, base, n, sums and maxima of t, g, q and q_adj) of the unique bases of each site."""

    def make(tile, row, chrom):
        site, base, _, q, t, g, q_adj = tile.ranked(tile.accepted() & (tile.hit == 1))
        order = np.argsort(site * 4 + base, kind="stable")
        cell = (site * 4 + base)[order]
        opens = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if cell.size else np.zeros(0, np.int64)
        out = {"base": (cell[opens] & 3).astype(np.int32), "n": np.diff(np.append(opens, cell.size))}
        for c, x in (("t", t), ("g", g), ("q", q), ("q_adj", q_adj)):
            for f, fold in (("sum", np.add), ("max", np.maximum)):
                out[f"{f}_{c}"] = fold.reduceat(x[order], opens) if opens.size else opens
        return _batch(chrom, (cell[opens] >> 2) + tile.start, out, "base")

    return _by_tile(tiles, params, make, "chr string, pos long, base int, n long, " + ", ".join(f"{c} long" for c in _SUMS))


def quality_counts(tiles: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """(chr, pos, q, n, below) of the unique bases of each site: how many have a quality, and how many a lower one."""

    def make(tile, row, chrom):
        unique = tile.accepted() & (tile.hit == 1)
        cell, n = np.unique(tile.site[unique] * 256 + tile.q[unique], return_counts=True)
        site, before = cell >> 8, np.cumsum(n) - n
        opens = np.concatenate(([True], site[1:] != site[:-1])) if site.size else np.zeros(0, bool)
        below = before - before[opens][np.cumsum(opens) - 1] if site.size else before
        return _batch(chrom, site + tile.start, {"q": (cell & 255).astype(np.int32), "n": n, "below": below}, "q")

    return _by_tile(tiles, params, make, "chr string, pos long, q int, n long, below long")


def _batch(chrom: str, pos: np.ndarray, columns: dict[str, np.ndarray], narrow: str) -> pa.RecordBatch:
    """Rows of one contig; ``narrow`` names the column of 32 bits."""
    arrays = [pa.array(np.ascontiguousarray(x), pa.int32() if c == narrow else pa.int64()) for c, x in columns.items()]
    return pa.RecordBatch.from_arrays([pa.array([chrom] * len(pos), pa.string()), pa.array(pos, pa.int64()), *arrays], names=["chr", "pos", *columns])


def _counts(tile: Tile, row: dict[str, pa.Array], accepted: np.ndarray) -> dict[str, np.ndarray]:
    """_NUMBERS of each place of a tile."""
    n, unique = tile.size, accepted & (tile.hit == 1)
    depth = np.bincount(tile.site, minlength=n)
    hits = np.bincount(tile.site, weights=tile.hit, minlength=n).astype(np.int64)
    if len(row["x_depth"]):
        depth, hits = depth + row["x_depth"].to_numpy(), hits + row["x_hits"].to_numpy()
    cell = tile.site * 4 + tile.base
    uni, qs = np.bincount(cell[unique], minlength=4 * n), np.bincount(cell[unique], weights=tile.q[unique], minlength=4 * n).astype(np.int64)
    seen_all = np.bincount(cell[accepted], minlength=4 * n)
    numbers = {"depth": depth, "repeat_time": hits, "dep_uni": np.bincount(tile.site[unique], minlength=n)}
    for k in range(4):
        numbers |= {f"uni{k}": uni[k::4], f"qs{k}": qs[k::4], f"all{k}": seen_all[k::4]}
    return numbers


def _sites(tile: Tile, row: dict[str, pa.Array], chrom: str, cube: np.ndarray, params: CallParams) -> pa.RecordBatch:
    n, accepted = tile.size, tile.accepted()
    numbers = _counts(tile, row, accepted)
    site, base, cycle, q, _, _, q_adj = tile.ranked(accepted & (tile.hit == 1))
    inside = (q_adj < 64) & (cycle < 256)
    worth = np.where(inside[:, None], cube[np.minimum(q_adj, 63), np.minimum(cycle, 255), base], 0.0)
    sums = [np.bincount(site, weights=worth[:, k], minlength=n) for k in range(worth.shape[1])]
    lik = np.round(np.stack(sums, 1).astype(np.float64), 9)  # sums of nothing are whole numbers
    known = _known(tile, row)
    arrays = [pa.array([chrom] * n, pa.string()), pa.array(np.arange(n) + tile.start), pa.array(tile.ref_code.astype(np.int32)), *(pa.array(np.ascontiguousarray(numbers[c]), pa.int64()) for c in _NUMBERS)]
    arrays += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * lik.shape[1]), pa.array(lik.reshape(-1))), *known]
    if params.rank_sum:
        order = np.argsort(site, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(site, minlength=n)))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(base[order].astype(np.int32)), pa.array(q[order].astype(np.int32))], names=["base", "q"])
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pairs))
    else:
        arrays.append(pa.nulls(n, pa.list_(pa.struct([("base", pa.int32()), ("q", pa.int32())]))))
    names = ["chr", "pos", "ref_code", *_NUMBERS, "lik", "hapmap", "validated", "indel", "f0", "f1", "f2", "f3", "seen"]
    return pa.RecordBatch.from_arrays(arrays, names=names)
