"""Netpbm and BMP columns: decode to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

``decode()`` reads P1 to P6 (8 and 16 bits a sample) and uncompressed BMP of 1, 4, 8, 24 and 32 bits.
``tiles()`` is the operator on a DataFrame with a binary column; ``text_media()`` stores texts as images first.

Defined results: media that are null, empty, cut short or of an unknown kind give a row with ``error`` set and the other
columns null; an image with no pixel is an error too. Repeated rows give equal rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import each, staged, text_of

#: Width in pixels of the images made from texts: 64 RGB samples, 192 bytes a row.
ROW_PIXELS = 64
#: Rows of an image that are summed at once.
STRIP = 4096
PAD_TO = 192


class MediaError(ValueError):
    """The bytes are no image that is read here."""


def _fields(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    """The next ``count`` numbers of a Netpbm header; comments run from # to the end of the line."""
    out: list[int] = []
    while len(out) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            while at < len(data) and data[at] not in b"\r\n":
                at += 1
            continue
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at or at - start > 9:
            raise MediaError("bad Netpbm header")
        out.append(int(data[start:at]))
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, (height, width, 1 or 3); P1 and P4 give 1 for black as the format has it."""
    kind = data[1] - 48
    head, at = _fields(data, 2 if kind in (1, 4) else 3, 2)
    width, height, top = head[0], head[1], head[2] if len(head) == 3 else 1
    planes = 3 if kind in (3, 6) else 1
    if not width or not height or not 1 <= top <= 65535:
        raise MediaError("no pixel, or a bad largest value")
    count = width * height * planes
    wide = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    if kind == 1:
        body = b"".join(line.split(b"#")[0] for line in data[at:].splitlines())
        flat = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:count] - 48
    elif kind in (2, 3):
        words = b" ".join(line.split(b"#")[0] for line in data[at:].splitlines()).split()[:count]
        flat = np.array([int(w) for w in words], np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if packed.size < row * height:
            raise MediaError("cut short")
        flat = np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        if len(data) < at + 1 + count * wide.itemsize:
            raise MediaError("cut short")
        flat = np.frombuffer(data, wide, count, at + 1)
    if flat.size < count:
        raise MediaError("cut short")
    return flat.reshape(height, width, planes)


def encode_netpbm(image: np.ndarray) -> bytes:
    """uint8 of (height, width, 1 or 3) as P5 or P6."""
    height, width, planes = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if planes == 3 else 5, width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP as uint8 of (height, width, 3), red first; a fourth channel is left out."""
    if len(data) < 54:
        raise MediaError("cut short")
    start, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    down, height = height < 0, abs(height)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or packed == 3 and bits != 32:
        raise MediaError("a BMP of a kind that is not read")
    row = (width * bits + 31) // 32 * 4
    if len(data) < start + row * height:
        raise MediaError("cut short")
    rows = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    if bits >= 24:
        image = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        table = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        each = 8 // bits
        index = (rows[:, :, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8)[None, None, :]) & ((1 << bits) - 1)
        index = index.reshape(height, row * each)[:, :width]
        if index.max() >= len(table):
            raise MediaError("a colour that the table lacks")
        image = table[index]
    return np.ascontiguousarray(image if down else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """uint8 of (height, width, 3) as a BMP of 24 bits."""
    height, width, _ = image.shape
    row = (width * 24 + 31) // 32 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode(data: bytes | None) -> np.ndarray:
    if not data:
        raise MediaError("empty")
    try:
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return decode_netpbm(data)
    except (struct.error, ValueError, IndexError, OverflowError) as e:
        raise e if isinstance(e, MediaError) else MediaError("damaged") from e
    raise MediaError("unknown kind")


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area of each new pixel, from the integral image; float64 of (height, width, planes)."""

    def along(image: np.ndarray, n: int) -> np.ndarray:
        """Sums over n equal parts of axis 0, from the integral at their edges; worked off in strips, so that no table of the
        whole image is held. Sums of samples are whole numbers, so strips don't change them."""
        old = image.shape[0]
        at = np.arange(n + 1) * (old / n)
        low = np.minimum(at.astype(np.int64), old - 1)
        below, above = np.zeros((n + 1, *image.shape[1:])), np.zeros((n + 1, *image.shape[1:]))
        total = np.zeros(image.shape[1:])
        for start in range(0, old, STRIP):
            sums = np.cumsum(image[start : start + STRIP], axis=0, dtype=np.float64)
            sums = np.concatenate((total[None], total + sums))
            for wanted, out in ((low, below), (low + 1, above)):
                here = (wanted >= start) & (wanted < start + len(sums))
                out[here] = sums[wanted[here] - start]
            total = sums[-1]
        part = (at - low).reshape(-1, *[1] * (image.ndim - 1))
        return np.diff(below + part * (above - below), axis=0)

    tall, wide, _ = image.shape
    rows = along(image, height)
    return along(rows.swapaxes(0, 1), width).swapaxes(0, 1) * (height * width / (tall * wide))


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of three planes with the weights 299, 587, 114 (fixed values), or the only plane."""
    return image[:, :, 0] if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 grey cells is darker than its right neighbour; ties give 0."""
    cells = np.round(grey(resize(image, 8, 9)), 6)
    return int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image resized to side x side, rounded to uint8, as the bytes of an NPY file (version 1.0)."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(resize(image, side, side)), 0, 255).astype(np.uint8), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, id_col: str, media_col: str, side: int = 32) -> DataFrame:
    """``id_col``, height, width, planes, the ``tile`` (NPY bytes), ``dhash`` (16 hex digits) and ``error`` of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in each(batch.column(1)):
                try:
                    image = decode(data)
                    if image.dtype != np.uint8:
                        image = (image >> 8).astype(np.uint8)
                    rows.append((*image.shape, npy_tile(image, side), f"{difference_hash(image):016x}", None))
                except MediaError as e:
                    rows.append((None, None, None, None, None, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "height", "width", "planes", "tile", "dhash", "error"])

    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{media_col}`").cast("binary").alias("__media"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, height int, width int, planes int, tile binary, dhash string, error string")


def write_tiles(tiled: DataFrame, path: str) -> None:
    """The rows of tiles() or media_digests() as a table whose ``tile`` values are whole NPY files."""
    tiled.write.mode("overwrite").parquet(path)


def write_npy_files(tiled: DataFrame, uri: str, id_col: str = "doc_id") -> DataFrame:
    """Writes each ``tile`` as a file of its own below ``uri`` (a folder that all executors reach, by any scheme that Arrow knows) and
    gives ``id_col`` and ``file`` of every row that has one, from a staged table, so that the files are written once. Names follow the
    row's place and not its id, which may be null or repeated; a task that runs again writes the same names."""
    from pyspark import TaskContext

    def run(batches):
        system, base = fs.FileSystem.from_uri(uri)
        part, n = TaskContext.get().partitionId(), 0
        system.create_dir(base, recursive=True)
        for batch in batches:
            names = []
            for data in each(batch.column(1)):
                name = f"tile-{part:06}-{n:09}.npy" if data is not None else None
                if name:
                    with system.open_output_stream(f"{base}/{name}") as out:
                        out.write(data)
                names.append(name)
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], names=[id_col, "file"])

    rows = tiled.select(F.col(f"`{id_col}`").alias(id_col), "tile")
    return staged(rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, file string").filter("file IS NOT NULL"))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``media``: each whole text (null: empty) in UTF-8, padded with spaces to a positive
    multiple of 192 bytes, as a P6 image of 64 pixels a row, one byte a sample."""
    text = text_of(text_col)
    n = F.octet_length(text)
    padded = F.greatest(F.ceil(n / F.lit(PAD_TO)), F.lit(1)) * PAD_TO
    head = F.concat(F.lit(f"P6\n{ROW_PIXELS} "), (padded / PAD_TO).cast("long").cast("string"), F.lit("\n255\n"))
    payload = F.concat(text.cast("binary"), F.repeat(F.lit(" "), (padded - n).cast("int")).cast("binary"))
    return df.select(F.col(f"`{id_col}`").alias(id_col), n.cast("long").alias("n_bytes"), F.concat(head.cast("binary"), payload).alias("media"))


def media_digests(media: DataFrame, id_col: str = "doc_id", side: int = 16) -> DataFrame:
    """Reads the images of text_media() back and describes them: payload digests, the stored form's digests, the ``tile`` (the
    bytes of an NPY file) and ``feature`` (the difference hash and the first half of the tile's SHA-256). Null ids and
    repeated rows are described like any other."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in each(batch.column(2)):
                image = decode(data)
                payload = image.tobytes()
                tile = npy_tile(image, side)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(image):016x}-{hashlib.sha256(tile).hexdigest()[:32]}", tile))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    rows = media.select(id_col, "n_bytes", "media")
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
