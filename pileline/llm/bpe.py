"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a batch that the worker has not met before are merged together: an index maps each pair of
symbols to all positions where it occurs, active pairs are applied in ascending rank, and every merge updates the
lists of the pairs it makes. A pair's merge never yields a pair of lower rank in a vocabulary made by merging, so
this gives what merging word by word gives.

Defined results: a null text is encoded as the empty text (no ids); the text of a special token becomes its id; a
repeated row is encoded again; only the id and the text are read, so other columns can have any name. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import pieces, text_of

#: The split of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers; the oldest half goes when it is full. Bounds memory only, results don't depend on it.
REMEMBERED = 200_000
_SHIFT = 20
_MASK = (1 << _SHIFT) - 1


def byte_names() -> dict[int, str]:
    """Byte to the printable character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _read_in_full(told: dict) -> None:
    """An error if a tokenizer file asks for something that this encoder doesn't do; ids would be wrong in silence."""
    model, before = told["model"], told.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE":
        odd.append("type")
    if told.get("normalizer"):
        odd.append("normalizer")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        odd.append("pre_tokenizer")
    if (told.get("decoder") or {"type": "ByteLevel"}).get("type") != "ByteLevel":
        odd.append("decoder")
    odd += sorted({f"added_tokens.{k}" for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)})
    if odd:
        raise ValueError(f"the tokenizer file asks for what is not done here: {', '.join(odd)}")


class ByteBpe:
    """One vocabulary: encode() and decode() for a text, encode_words() for many words at once."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        _read_in_full(told)
        model = told["model"]
        vocab = model["vocab"]
        names = byte_names()
        values = {c: b for b, c in names.items()}
        self.byte_ids = [vocab[names[b]] for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] << _SHIFT | vocab[right], (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in told["added_tokens"] if t["content"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, k in [*vocab.items(), *self.special.items()]:
            self.bytes_of[k] = bytes(values[c] for c in name) if all(c in values for c in name) else name.encode()
        self.split = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str | int, bytes] = {}
        self.whole = {k: int(k).to_bytes(4, "little") for k in self.special.values()}
        # the merges as sorted pairs with their ranks and results, and by rank
        keys = np.array(list(self.merges), np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.by_rank = {rank: (pair, made) for pair, (rank, made) in self.merges.items()}
        self.byte_table = np.array(self.byte_ids, np.int32)
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _index(self, where: dict[int, list[np.ndarray]], active: list[int], left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
        """Adds the places ``at`` of the pairs (left, right) to the lists of those pairs that can be merged."""
        keys = left.astype(np.int64) << _SHIFT | right
        place = np.minimum(np.searchsorted(self.pairs, keys), self.pairs.size - 1)
        good = np.flatnonzero(self.pairs[place] == keys)
        if not good.size:
            return
        ranks = self.ranks[place[good]]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[good[order]]
        edges = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))).tolist()
        for a, b in zip(edges, [*edges[1:], ranks.size], strict=True):
            rank = int(ranks[a])
            if rank not in where:
                where[rank] = []
                heapq.heappush(active, rank)
            where[rank].append(at[a:b])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as the bytes of int32; the pair index runs over all of them together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        symbols = self.byte_table[np.frombuffer(b"".join(raw), np.uint8)]
        n = symbols.size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = sizes > 0
        after[ends[full] - 1] = -1
        before[(ends - sizes)[full]] = -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        inner = np.flatnonzero(after >= 0)
        self._index(where, active, symbols[inner], symbols[after[inner]], inner)
        while active:
            rank = heapq.heappop(active)
            pair, made = self.by_rank[rank]
            left, right = pair >> _SHIFT, pair & _MASK
            lists = where.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[symbols[at] == left]
            next_ = after[at]
            good = (next_ >= 0) & (symbols[next_] == right)
            at, next_ = at[good], next_[good]
            if left == right and at.size > 1:
                # of places that overlap, the first goes first
                taken, free = [], -1
                for i, j in zip(at.tolist(), next_.tolist(), strict=True):
                    if i != free:
                        taken.append(i)
                        free = j
                at = np.array(taken, np.int64)
                next_ = after[at]
            if not at.size:
                continue
            symbols[at], symbols[next_] = made, -1
            last = after[next_]
            after[at] = last
            on = last >= 0
            before[last[on]] = at[on]
            first = before[at]
            up = first >= 0
            self._index(where, active, np.concatenate((symbols[at[on]], symbols[first[up]])), np.concatenate((symbols[last[on]], symbols[at[up]])), np.concatenate((at[on], first[up])))
        kept = symbols >= 0
        counts = np.concatenate(([0], np.cumsum(kept)))
        flat = symbols[kept].astype("<i4").tobytes()
        stops = (4 * counts[ends]).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _segments(self, text: str) -> list[str]:
        return self.split_special.split(text) if self.split_special and text else [text]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, int32."""
        known = self.known
        split, special = self.split.findall, self.special
        docs = []
        for text in texts:
            segments = self._segments(text)
            # a special token is told from the words around it by its type
            docs.append(split(text) if len(segments) == 1 else [w for s in segments for w in ((special[s],) if s in special else split(s))])
        now = {w for words in docs for w in words}
        now.difference_update(self.whole)
        fresh = sorted(now.difference(known))
        if len(known) + len(fresh) > REMEMBERED:
            for w in list(known)[: len(known) // 2]:
                if w not in now:
                    del known[w]
        if fresh:
            known.update(zip(fresh, self.encode_words(fresh), strict=True))
        known.update(self.whole)
        return [np.frombuffer(b"".join([known[w] for w in words]), "<i4") for words in docs]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        flat = self.blob[np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()
        stops = np.concatenate(([0], ends))[np.cumsum([0, *map(len, lists)])].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def decode(self, ids) -> str:
        return self.decode_batch([np.asarray(ids, np.int64)])[0]


@lru_cache(maxsize=2)
def _loaded(digest: str, spec: str) -> ByteBpe:
    return ByteBpe(spec)


def _model(spec: str) -> ByteBpe:
    return _loaded(hashlib.sha256(spec.encode()).hexdigest(), spec)


def read_spec(path: str) -> str:
    """The tokenizer file; a few MB, read once on the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` array<int> of every row."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("__text"))

    def run(batches):
        bpe = _model(spec.value)
        for batch in batches:
            for start, texts in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), _lists(bpe.encode_batch(texts))], names=[id_col, "ids"])
        bpe.known.clear()

    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and their ``decoded`` text; null ids give the empty text."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        bpe = _model(spec.value)
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            at = at - at[0]
            texts = bpe.decode_batch([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and what they decode to, ``decoded``: encode() and decode() in one pass, so that an executor runs one
    Python worker a core and not two."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("__text"))

    def run(batches):
        bpe = _model(spec.value)
        for batch in batches:
            for start, texts in pieces(batch.column(1)):
                ids = bpe.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), _lists(ids), pa.array(bpe.decode_batch(ids), pa.string())], names=[id_col, "ids", "decoded"])
        bpe.known.clear()  # a worker outlives its tasks

    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, SHA-256 of the ids and of the decoded text, of every row."""
    done = round_trip(df, path, id_col, text_col)
    return done.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
