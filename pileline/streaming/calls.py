"""Calls over a stream of reads, with a state a block of the genome.

Position is the event time: one second a place, beginning at the contig's ``offset`` (0 where none is given, for contigs that
come side by side; running sums of lengths where they come one after the other). Every block of the genome has a state from the
start, with its reference, its known sites and a timer at its end, so blocks that no read touches are emitted, too. A block keeps
its reads as packed columns, one piece a micro-batch; when they hold more than ``most`` bases, those that can no longer count
(``depth_cap`` eligible bases that stand before them are there already, and more only come before them) are turned into sums, so a
state is bounded by the cap and the block's size. When the watermark, which follows the greatest position seen less ``lateness``
places, has passed a block's end, its sites are emitted, its reads go and it is marked as closed. That mark is kept in the state
store, so it outlives a restart: a read that comes to a closed block is dropped or, with ``late="error"``, ends the query. What such a
read has in a block that is still open counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.bases import GENOTYPES
from ..operators import tiles
from ..operators.pileup import BLOCK
from ..params import CallParams
from .pileup import PROVIDER

_READS = [c for c, _ in tiles._READS]
_KNOWN = [c for c, _ in tiles._KNOWN]
_EXTRA = [c for c, _ in tiles._EXTRA]
_TYPES = {c: tiles._ARROW[t] for c, t in tiles._LISTS}


def _bytes(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _columns(data: bytes) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return {c: pa.concat_arrays(table.column(c).chunks) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type) for c in table.column_names}


#: A processor of more bytes would travel as a broadcast variable, which the driver's side of a stateful stream can't read.
MOST_BYTES = 900_000


def packed_matrix(matrix: DataFrame) -> bytes:
    """The calibration matrix (q, cycle, t_base, o_base, p) as compressed bytes; its size follows qualities and read length only."""
    rows = matrix.toArrow()
    keys = [rows.column(c).to_numpy() for c in ("q", "cycle", "t_base", "o_base")]
    shape = (int(keys[0].max()) + 1, int(keys[1].max()) + 1, 4, 4)
    p = np.zeros(shape)
    p[tuple(keys)] = rows.column("p").to_numpy()
    data = np.array(shape[:2], np.int64).tobytes() + p.tobytes()
    out = zlib.compress(data, 9)
    if len(out) > MOST_BYTES:
        raise ValueError("the calibration matrix is too large for a stateful stream")
    return out


def _cube(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    q, cycle = np.frombuffer(raw[:16], np.int64)
    p = np.frombuffer(raw[16:], np.float64).reshape(q, cycle, 4, 4)
    cube = np.zeros((64, 256, 4, len(GENOTYPES)))
    for k, g in enumerate(GENOTYPES):
        cube[:q, :cycle, :, k] = np.log10(0.5 * p[:, :, g >> 2] + 0.5 * p[:, :, g & 3])
    return cube


def _unpacked(batches):
    """Rows of sites from blocks: a block travels as one value, so that its columns keep their Arrow types."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield from pa.ipc.open_stream(data).read_all().to_batches()


class BlockCaller(StatefulProcessor):
    def __init__(self, params: CallParams, matrix: bytes, late: str, most: int):
        self.params, self.matrix, self.late, self.most = params, matrix, late, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.cube = handle, _cube(self.matrix)
        self.head = handle.getValueState("head", "start long, ref string, known binary, closed boolean")
        self.sums = handle.getValueState("sums", "bases long, extra binary")
        self.pieces = handle.getListState("pieces", "data binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        known = {c: pa.array(list(row[c]), _TYPES[c]) for c in _KNOWN}
        self.head.update((int(row["start"]), row["ref"], _bytes(known), False))
        self.handle.registerTimer((int(row["offset"]) + int(row["start"]) + len(row["ref"])) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.head.exists():  # else there is no reference here
            head = self.head.get()
            for pdf in rows:
                if head[3] and self.late == "error":
                    raise ValueError(f"late read {pdf['r_idx'].iloc[0]}: block {key[1]} of {key[0]} is closed")
                if not head[3] and len(pdf):
                    self._keep(head, {c: pa.array(pdf[c], _TYPES[c]) for c in _READS})
        return iter(())

    def _keep(self, head: tuple, piece: dict[str, pa.Array]) -> None:
        bases, extra = self.sums.get() if self.sums.exists() else (0, None)
        bases += int(np.sum(piece["r_len"].to_numpy()))
        self.pieces.appendValue((_bytes(piece),))
        if bases > self.most:
            row = self._row(head, extra)
            tile = tiles.Tile(row, head[0], head[1], self.params)
            kept = np.zeros(len(row["r_pos"]), bool)
            kept[tile.read[tile.accepted()]] = True
            out = ~kept[tile.read]
            added = [np.bincount(tile.site[out], minlength=tile.size), np.bincount(tile.site[out], weights=tile.hit[out], minlength=tile.size).astype(np.int64)]
            new = {c: pa.array(a + row[c].to_numpy() if len(row[c]) else a) for c, a in zip(_EXTRA, added, strict=True)}
            left = {c: row[c].filter(pa.array(kept)) for c in _READS}
            self.pieces.clear()
            self.pieces.appendValue((_bytes(left),))
            # what is left may be more than ``most`` by itself: the next look is after as many again
            bases, extra = 0, _bytes(new)
        self.sums.update((bases, extra))

    def _row(self, head: tuple, extra: bytes | None) -> dict[str, pa.Array]:
        pieces = [_columns(x[0]) for x in self.pieces.get()]
        reads = {c: pa.concat_arrays([p[c] for p in pieces]) if pieces else pa.array([], _TYPES[c]) for c in _READS}
        order = pa.array(np.lexsort((reads["r_idx"].to_numpy(), reads["r_pos"].to_numpy())))
        sums = _columns(extra) if extra is not None else {c: pa.array([], pa.int64()) for c in _EXTRA}
        return _columns(head[2]) | {c: v.take(order) for c, v in reads.items()} | sums

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get()
        row = self._row(head, self.sums.get()[1] if self.sums.exists() else None)
        self.pieces.clear()
        self.sums.clear()
        self.head.update((head[0], "", b"", True))
        batch = tiles._sites(tiles.Tile(row, head[0], head[1], self.params), row, key[0], self.cube, self.params)
        yield pd.DataFrame({"data": [_bytes(dict(zip(batch.schema.names, batch.columns, strict=True)))]})

    def close(self) -> None:
        pass


def site_stream(
    reads: DataFrame, blocks: DataFrame, dbsnp: DataFrame, matrix: DataFrame, params: CallParams = CallParams(), block: int = BLOCK, lateness: int = 1_000, late: str = "drop", most: int = tiles.HOT_BASES
) -> DataFrame:
    """The rows of tiles.site_rows(), for posterior.called(), of a stream of reads (0-based positions, in bounds), each block's when
    it is closed. ``blocks`` of ``block`` places and ``reads`` may have a column ``offset``; ``matrix`` is the calibration matrix."""
    if late not in ("drop", "error"):
        raise ValueError("late: drop or error")
    spark = reads.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    offset = F.col("offset") if "offset" in reads.columns else F.lit(0)
    heads = tiles.staged_tiles(tiles.no_reads(spark), blocks, dbsnp, block)
    begins = blocks.select("chr", F.col("block").cast("long").alias("tile"), (F.col("offset") if "offset" in blocks.columns else F.lit(0)).cast("long").alias("offset"))
    heads = heads.join(begins, ["chr", "tile"]).select("chr", "tile", "start", "ref", "offset", *_KNOWN)
    seen = reads.withColumn("at", F.timestamp_seconds(F.col("pos") + offset)).withWatermark("at", f"{lateness} seconds")
    dealt = tiles._dealt(seen, block)
    # without the event time: whether a read is late is told by its block's mark, not by the watermark alone
    rows = dealt.select(
        "chr", "tile", F.col("pos").alias("r_pos"), F.col("read_idx").alias("r_idx"), F.col("hit").alias("r_hit"), F.when(F.col("strand") == "-", 1).otherwise(0).alias("r_strand"),
        F.col("read_len").alias("r_len"), F.col("seq").alias("r_seq"), F.col("qual").alias("r_qual"),
    )
    caller = BlockCaller(params, packed_matrix(matrix), late, most)
    closed = rows.groupBy("chr", "tile").transformWithStateInPandas(caller, outputStructType="data binary", outputMode="Append", timeMode="EventTime", initialState=heads.groupBy("chr", "tile"))
    return closed.mapInArrow(_unpacked, tiles._SITES)
