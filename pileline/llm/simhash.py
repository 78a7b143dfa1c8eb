"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, one set where more than half of the document's shingle hashes have it. Two fingerprints that
differ in at most ``tau`` bits, cut into m segments on a ring, have a segment from which every chain of l consecutive
segments differs in at most floor(l * tau / m) bits. The first chains allow no difference, so they are the key that
candidates share; the longer chains are checked on the candidates before the whole Hamming distance.

Equal fingerprints are one node from the start, so groups of exact copies cost nothing. Keys that at most
``CROWD`` fingerprints share are compared in sorted runs, and only a tree of the links found leaves the task. Keys that
more share (families of near copies) are never compared pair by pair: their fingerprints are expanded to all values
within tau // 2 bits (tau even; else (tau + 1) // 2), grouped by value, linked to the group's least and, for odd tau,
checked; see links().

Defined results: a text without words has the fingerprint 0 and is linked like any other; null counts as empty; repeated
rows each get a row; a null id is never a component's least one, unless it has no other; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import linked_components
from .components import components
from .util import Shelf, each, free, staged, text_of

BITS = 64
SEGMENTS = 16
#: Fingerprints that share a key are compared with each other up to so many; more go the way of shared neighbours, which is exact too.
CROWD = 128
SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; A-Z lower-cased; fewer words: one hash of all of them; none: empty."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it; as a signed number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` long of every row."""
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t, words)) for t in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


def budgets(tau: int, segments: int = SEGMENTS) -> list[int]:
    """Differences that a chain of l = 1, 2, ... segments may have."""
    return [length * tau // segments for length in range(1, segments + 1)]


def _rotated(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    left, right = bits.astype(np.uint64), ((BITS - bits) % BITS).astype(np.uint64)
    return (x << left) | np.where(bits == 0, np.uint64(0), x >> right)


def chain_holds(diff: np.ndarray, first: np.ndarray, tau: int, segments: int = SEGMENTS) -> np.ndarray:
    """Whether the chains that begin at segment ``first`` of the differing bits stay within their budgets."""
    width = BITS // segments
    turned = _rotated(diff, first * width)
    allowed = budgets(tau, segments)
    good = np.ones(diff.size, bool)
    for length in range(1, segments + 1):
        if length == segments or allowed[length] > allowed[length - 1]:  # sums only grow: the longest chain of each budget decides
            mask = np.uint64((1 << BITS) - (1 << (BITS - width * length)))
            good &= np.bitwise_count(turned & mask) <= allowed[length - 1]
    return good


def _trees(pairs) -> list[tuple[int, int]]:
    """Of pairs: each node with the root of its tree, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up if root(x) != x]


def _linked(keys: np.ndarray, fps: np.ndarray, tau: int, bits: int) -> list[tuple[int, int]]:
    """Links between rows of equal keys, which stand together, as trees."""
    found = []
    value, first = fps.view(np.uint64), (keys >> bits).astype(np.int64)
    at = np.arange(keys.size)
    for step in range(1, keys.size):
        at = at[at + step < keys.size]
        at = at[keys[at] == keys[at + step]]
        if not at.size:
            break
        diff = value[at] ^ value[at + step]
        good = at[chain_holds(diff, first[at], tau)]
        good = good[np.bitwise_count(value[good] ^ value[good + step]) <= tau]
        found.append(np.stack((fps[good], fps[good + step]), 1))
    pairs = np.concatenate(found).tolist() if found else []
    return _trees(pairs)


def _key_bits(tau: int) -> int:
    """Bits of the chain of segments that allows no difference."""
    if not 1 <= tau < SEGMENTS:
        raise ValueError(f"tau must be from 1 to {SEGMENTS - 1}")
    return min(56, sum(b == 0 for b in budgets(tau)) * (BITS // SEGMENTS))  # a key also holds the first segment's number


def chain_keys(fp: Column, tau: int) -> list[Column]:
    """The keys of a fingerprint: from each segment on, the chain that allows no difference. Any two fingerprints that differ in
    at most ``tau`` bits have one of them in common."""
    width, exact = BITS // SEGMENTS, _key_bits(tau)

    def key(k: int) -> Column:
        turned = fp if k == 0 else F.shiftleft(fp, k * width).bitwiseOR(F.shiftrightunsigned(fp, BITS - k * width))
        return (F.shiftrightunsigned(turned, BITS - exact) + F.lit(k << exact)).cast("long")

    return [key(k) for k in range(SEGMENTS)]


def links(distinct: DataFrame, tau: int, crowd: int = CROWD) -> DataFrame:
    """Of distinct fingerprints (fp): rows (u, v) that connect all those which differ in at most ``tau`` bits; v <= u in
    signed order. Not all pairs are given, but their connected components are those of all pairs."""
    exact, fp = _key_bits(tau), F.col("fp")
    keyed = distinct.select("fp", F.explode(F.array(*chain_keys(fp, tau))).alias("key"))
    crowded = staged(keyed.groupBy("key").count().filter(F.col("count") > crowd).select("key"))

    def compare(batches):
        keep_k, keep_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = ["u", "v"]

        def out(keys, fps):
            rows = _linked(keys, fps, tau, exact)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=names)

        for batch in batches:
            keys = np.concatenate((keep_k, batch.column(0).to_numpy()))
            fps = np.concatenate((keep_f, batch.column(1).to_numpy()))
            if not keys.size:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key's run may go on in the next batch; it has at most ``crowd`` rows
            yield out(keys[:whole], fps[:whole])
            keep_k, keep_f = keys[whole:], fps[whole:]
        yield out(keep_k, keep_f)

    quiet = keyed.join(crowded, "key", "left_anti").select("key", "fp")
    few = quiet.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")

    loud = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    reach = (tau + 1) // 2
    flips = [0] + [sum(1 << b for b in bits) for k in range(1, reach + 1) for bits in combinations(range(BITS), k)]
    signed = [f - (1 << BITS) if f >= 1 << (BITS - 1) else f for f in flips]
    near = loud.select("fp", F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in signed]), lambda f: f.bitwiseXOR(F.col("fp")))).alias("near"))
    if tau % 2:
        # two values within reach of one may differ in tau + 1 bits, so one end has to be nearer: pairs (nearer, farther) by value
        close = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("near"))) <= tau // 2)
        base = close.groupBy("near").agg(F.min("fp").alias("v"))
        many = near.join(base, "near").select(F.col("fp").alias("u"), "v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau)
    else:
        base = near.groupBy("near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        many = near.join(base, "near").select(F.col("fp").alias("u"), "v")
    return few.unionAll(many.filter("u <> v").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2) -> DataFrame:
    """``id_col``, ``fp``, ``component_id`` (least id that can be reached over links of at most ``tau`` bits, itself
    included), ``rows_alike`` (rows of its component), of every row."""
    marked = staged(fingerprints(df, id_col, text_col, words))
    distinct = staged(marked.groupBy("fp").agg(F.min(id_col).alias("__least"), F.count(F.lit(1)).alias("__rows")))
    trees = components(links(distinct.select("fp"), tau))
    rooted = distinct.join(trees, distinct["fp"] == trees["node"], "left").select("fp", "__least", "__rows", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("__least").alias("component_id"), F.sum("__rows").alias("rows_alike"))
    of = rooted.select("fp", "root").join(heads, "root").drop("root")
    return marked.join(of, "fp").select(id_col, "fp", "component_id", "rows_alike")


#: near_copies(): texts whose fingerprints differ in so many bits or fewer always meet.
TAU = 2
#: near_copies(): bits in which the SimHash fingerprints of candidates may differ. At a likeness of 0.8 they differ in 10 of 64
#: on average, in more than 26 about once in ten million pairs.
SKETCH_ALLOWED = 26
#: near_copies(): two sets of likeness 0.8 share a band with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS, ROWS = 20, 5
KEYS = [f"b{k}" for k in range(BANDS)]
#: Bytes of texts that are worked on at once.
RUN = 1_000_000
#: Odd multipliers of the hash functions, from a rule.
_FACTORS = [np.uint32((0x9E3779B1 * (2 * k + 1) + 0x85EBCA6A * k) & 0xFFFFFFFF | 1) for k in range(BANDS * ROWS)]
_LOW = np.uint64((1 << 52) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_digest(text: str) -> tuple[int, int]:
    """128 bits of the text's words."""
    whole = xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "replace").lower().split()))
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of word shingles of each text (at most 4,096) as ascending numbers of 52 bits, one text after the other, and
    their sizes. A-Z are lower-cased; fewer words make one shingle; none make an empty set."""
    tokens = [t.encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    digest = xxhash.xxh3_64_intdigest
    of = np.fromiter((digest(w) for some in tokens for w in some), np.uint64, int(sizes.sum()))
    owner, own = np.repeat(np.arange(sizes.size), sizes), np.maximum(sizes - words + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    first = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    h = np.zeros(first.size, np.uint64)
    for k in range(words):  # a text of fewer words has one shingle of what it has
        at = first + k
        inside = at < (starts + sizes)[owner[first]]
        h = np.where(inside, h * np.uint64(0x9E3779B97F4A7C15) + of[np.minimum(at, of.size - 1)], h)
    whole = np.sort((owner[first].astype(np.uint64) << np.uint64(52)) | (_mixed(h) >> np.uint64(12)))
    whole = whole[np.concatenate(([True], whole[1:] != whole[:-1]))]
    return whole & _LOW, np.bincount((whole >> np.uint64(52)).astype(np.int64), minlength=len(texts))


def band_keys(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(BANDS, sets): the keys of each set, 0 for an empty one."""
    out = np.zeros((BANDS, sizes.size), np.uint64)
    full = np.flatnonzero(sizes)
    if full.size:
        h, first = (_mixed(values) >> np.uint64(32)).astype(np.uint32), (np.cumsum(sizes) - sizes)[full]
        scaled, bands = np.empty_like(h), np.zeros((BANDS, full.size), np.uint64)
        for k, factor in enumerate(_FACTORS):
            np.multiply(h, factor, out=scaled)
            band = k // ROWS
            x = (bands[band] ^ np.minimum.reduceat(scaled, first)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
            bands[band] = x ^ (x >> np.uint64(29))
        out[:, full] = bands
    return out


def within_ring(tau: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whether at most ``tau`` bits are set in the difference of two fingerprints: first whether from some segment on all chains
    stay within their budgets, as from one they must, then the whole count."""

    def near(diff: np.ndarray) -> np.ndarray:
        good = np.zeros(diff.size, bool)
        for first in range(SEGMENTS):
            rest = np.flatnonzero(~good)
            good[rest[chain_holds(diff[rest], np.full(rest.size, first, np.int64), tau)]] = True
        return good & (np.bitwise_count(diff) <= tau)

    return near


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about RUN bytes and at most 4,096, each with its place."""
    start, size, sizes = 0, 0, pc.binary_length(column).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and (size + n > RUN or i - start == 1 << 12):
            yield start, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if sizes:
        yield start, column.slice(start).to_pylist()


def _whole_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, payload): the shingle sets of the texts of ``wanted`` (id, hi, lo, __least)."""
    rows = df.select(F.col(f"`{id_col}`").alias("__key"), text_of(text_col).alias("__text"))
    rows = rows.join(wanted.select("__least").distinct(), F.col("__key").eqNullSafe(F.col("__least")), "left_semi").select("__text")

    def run(batches):
        for batch in batches:
            for _, texts in _runs(batch.column(0)):
                digests = [text_digest(t) for t in texts]
                values, sizes = shingle_sets(texts, words)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), lists], names=["hi", "lo", "payload"])

    # a repeated id may have other texts, too; the digest tells
    found = rows.mapInArrow(run, "hi long, lo long, payload array<long>")
    return found.join(wanted.select("id", "hi", "lo"), ["hi", "lo"]).groupBy("id").agg(F.first("payload").alias("payload"))


def _payload_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tau: int = TAU) -> DataFrame:
    """``id_col`` and ``component_id`` of every row: classes of documents whose sets of word shingles have a likeness of
    ``similarity`` or more.

    Candidates meet by the pigeonring chains of their SimHash fingerprints, as in near_duplicates(): none whose fingerprints
    differ in at most ``tau`` bits is missed. At a likeness of 0.8 fingerprints differ in 10 of 64 bits, too many for chains
    that are selective, and those of the words differ as much where whole blocks are edited. So candidates meet by MinHash
    bands of their shingles as well, which depend on the likeness only, however a text was edited. Chains within a wide
    margin and the Hamming distance spare most the exact check that decides: the Jaccard likeness of all shingle hashes of
    both texts, as fingerprints of texts of one template can be as near at a likeness of 0.7. Equal texts meet by a digest of
    their words. How keys that many texts share are worked off is told in candidates.py.

    Texts without words are equal texts; null counts as empty; the null id is the greatest. Other columns aren't read."""
    rows = df.select(F.col(f"`{id_col}`").alias("__key"), text_of(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            for start, texts in _runs(batch.column(1)):
                digests = [text_digest(t) for t in texts]
                values, sizes = shingle_sets(texts, words)
                ends = np.cumsum(sizes)
                spread = _mixed(values)
                bits = [majority(spread[b - n : b]) if n else 0 for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                keys = band_keys(values, sizes).view(np.int64)
                columns = [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(bits, pa.int64()), *map(pa.array, keys)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns], names=["__key", "hi", "lo", "bits", *KEYS])

    shelf = Shelf(df.sparkSession)
    marked = staged(rows.mapInArrow(run, f"__key {rows.schema[0].dataType.simpleString()}, hi long, lo long, bits long" + "".join(f", {c} long" for c in KEYS)))
    slim = marked.groupBy("hi", "lo").agg(F.min("__key").alias("__least"), *[F.min(c).alias(c) for c in ("bits", *KEYS)])
    distinct = shelf.put(slim.withColumn("id", F.monotonically_increasing_id()))

    def fetch(ids: DataFrame) -> DataFrame:
        return _whole_sets(df, staged(distinct.join(ids, "id").select("id", "hi", "lo", "__least")), id_col, text_col, words)

    chains = [c.alias(f"c{k}") for k, c in enumerate(chain_keys(F.col("bits"), tau))]
    items = distinct.select("id", "bits", *chains, *KEYS)
    trees = linked_components(items, items.columns[2:], within_ring(SKETCH_ALLOWED), fetch, _payload_sets, similarity)
    rooted = distinct.select("id", "hi", "lo", "__least").join(trees, F.col("id") == F.col("node"), "left").select("hi", "lo", "__least", F.coalesce("root", "id").alias("root"))
    heads = shelf.put(rooted.groupBy("root").agg(F.min("__least").alias("component_id")))  # staged, so that a large class can be split in the join
    classes = staged(rooted.join(heads, "root").select("hi", "lo", "component_id"))
    shelf.clear()
    return marked.select("__key", "hi", "lo").join(classes, ["hi", "lo"]).select(F.col("__key").alias(id_col), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df``, all columns, of the documents that are the least ids of their classes. Rows of one id stay or go
    together."""
    (gone_id,) = free(df, "__gone")
    classes = near_copies(df, id_col, text_col, words, similarity)
    key = F.col(f"`{id_col}`")
    own = F.col("component_id").eqNullSafe(key)
    gone = staged(classes.groupBy(key.alias(gone_id)).agg(F.max(own).alias("own")).filter("NOT own").select(gone_id))
    return df.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)), "left_anti")
