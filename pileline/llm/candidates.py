"""Links between like items that share a key, without emitting all pairs of a large family.

Items have an id, 64 ``bits`` of a sketch (like items differ in few) and some keys; like items share a key. Two items are
linked when the Jaccard likeness of their sets reaches the limit, which is always decided on the whole sets.

* Groups of at most ``CROWD`` items are compared in sorted runs inside a task; pairs whose sketches are near go on and meet
  their sets.
* Larger groups are dealt into blocks, each with the group's hub (the item nearest to its majority bits). Inside a block
  all items are compared with the hub, then those that it does not explain with all others, by an index of set elements.
* What is then in the group's main component needs no more comparing with itself. All other items meet every block of the
  group, again in tiles of bounded size, so no pair that shares a key is left out and no task holds a group.

Which keys are so frequent that their rows must not meet in one task is told from a sample of items. It decides where rows
are compared, not whether: a group of any size that the sample misses is noticed in the stream and takes the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Forest, components, together
from .util import Shelf

CROWD = 128
#: A block of a large group holds about so many items, and about so many set elements.
BLOCK, BLOCK_ELEMENTS = 512, 1 << 20
#: One of so many items is looked at for frequent keys, and so many of those with one key make it frequent.
SAMPLE, FREQUENT = 64, 16
#: Set elements that are compared at once.
RUN = 400_000

Near = Callable[[np.ndarray], np.ndarray]
#: From a column of payloads: all set elements (numbers of 52 bits, distinct and ascending in each row) and how many each row has.
Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def within(allowed: int) -> Near:
    """Whether at most ``allowed`` bits are set in the difference of two sketches."""
    return lambda diff: np.bitwise_count(diff) <= allowed


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(starts - (ends - sizes), sizes)


def _close(keys: np.ndarray, ids: np.ndarray, bits: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of equal keys, which stand together, with near sketches."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits = bits.view(np.uint64)
    at = np.arange(keys.size)
    for step in range(1, keys.size):
        at = at[: np.searchsorted(at, keys.size - step)]
        at = at[keys[at] == keys[at + step]]
        if not at.size:
            break
        good = at[near(bits[at] ^ bits[at + step])]
        us.append(np.minimum(ids[good], ids[good + step]))
        vs.append(np.maximum(ids[good], ids[good + step]))
    return np.concatenate(us), np.concatenate(vs)


def grouped(keyed: DataFrame, near: Near, crowd: int = CROWD) -> DataFrame:
    """Of rows (key, id, bits), all long: (loud, a, b, c), where not loud a pair of near ids (a, b), a < b, of a key with at
    most ``crowd`` rows, and where loud a row (key, id, bits) of a key with more."""
    names = ["loud", "a", "b", "c"]

    def rows(loud: bool, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(columns[0].size, loud)), *map(pa.array, columns)], names=names)

    def settled(keys, ids, bits):
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        many = np.repeat(np.diff(edges) > crowd, np.diff(edges))
        if many.any():
            yield rows(True, keys[many], ids[many], bits[many])
            keys, ids, bits = keys[~many], ids[~many], bits[~many]
        u, v = _close(keys, ids, bits, near)
        if u.size:
            yield rows(False, u, v, np.zeros_like(u))

    def compare(batches: Iterator[pa.RecordBatch]):
        held, loud = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True)]
            if loud is not None and held[0].size:
                n = int(np.searchsorted(held[0], loud, "right"))
                if n:
                    yield rows(True, *[h[:n] for h in held])
                held = [h[n:] for h in held]
                loud = None if held[0].size else loud
            if not held[0].size:
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
            if whole:
                yield from settled(*[h[:whole] for h in held])
            held = [h[whole:] for h in held]
            if held[0].size > crowd:
                loud = held[0][-1]
                yield rows(True, *held)
                held = [h[:0] for h in held]
        if held[0].size:
            yield from settled(*held)

    return keyed.select("key", "id", "bits").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "loud boolean, a long, b long, c long")


def _size(column: pa.Array) -> np.ndarray:
    """A measure of each payload: list elements or bytes."""
    kind = column.type
    sizes = pc.list_value_length(column) if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pc.binary_length(column)
    return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _shared(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements rows left[k] and right[k] have in common."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, left.size, 1 << 12):
        a, b = left[at : at + (1 << 12)], right[at : at + (1 << 12)]
        numbered = lambda x: (np.repeat(np.arange(x.size, dtype=np.uint64), sizes[x]) << np.uint64(52)) | values[_spans(starts[x], sizes[x])]
        both = np.sort(np.concatenate((numbered(a), numbered(b))), kind="stable")  # two ascending runs: a merge
        twice = both[1:][both[1:] == both[:-1]]
        out.append(np.bincount((twice >> np.uint64(52)).astype(np.int64), minlength=a.size))
    return np.concatenate(out)


def verified(pairs: DataFrame, payloads: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """Links that connect what the like ones of ``pairs`` (u, v) connect. Each set of a first member is made once."""
    right = pairs.join(payloads.withColumnRenamed("id", "v"), "v").select("u", "v", "payload")
    own = payloads.join(pairs.select(F.col("u").alias("id")).distinct(), "id").select(F.col("id").alias("u"), F.lit(-1).cast("long").alias("v"), "payload")

    def judge(batches: Iterator[pa.RecordBatch]):
        forest = Forest()
        carried, mine = np.zeros(0, np.uint64), 0  # the set of the last first member, and its payload's size
        for batch in batches:
            us, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes, start, run = _size(batch.column(2)), 0, 0
            for stop in range(1, vs.size + 1):
                mine = sizes[stop - 1] if vs[stop - 1] < 0 else mine
                run += sizes[stop - 1] + (mine if vs[stop - 1] >= 0 else 0)
                if stop < vs.size and run < RUN:
                    continue
                found, counts = sets(batch.column(2).slice(start, stop - start))
                values, counts = np.concatenate((carried, found)), np.concatenate(([carried.size], counts))
                starts = np.cumsum(counts) - counts
                u, v = us[start:stop], vs[start:stop]
                owner = np.maximum.accumulate(np.where(v < 0, np.arange(1, v.size + 1), 0))
                of = np.flatnonzero(v >= 0)
                if of.size:
                    both = _shared(values, starts, counts, owner[of], of + 1)
                    all_ = counts[owner[of]] + counts[of + 1] - both
                    good = of[(both >= similarity * all_ - 1e-9) & (all_ > 0)]
                    yield from forest.add(u[good], v[good])
                last = int(owner[-1])
                carried = values[starts[last] : starts[last] + counts[last]].copy()
                start, run = stop, 0
        yield from forest.flush()

    return own.unionAll(right).repartition("u").sortWithinPartitions("u", "v").mapInArrow(judge, "u long, v long")


def _tile(sides: np.ndarray, roots: np.ndarray, values: np.ndarray, counts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that likenesses between the rows of one tile connect, as a forest. Side 0: rows that are compared with
    all of side 1 (and 2); side 2: the hub, a row of side 1 with which all others are compared first. Without a row of side 0
    those of side 1 that the hub does not explain are compared with all."""
    labels, group = np.unique(roots, return_inverse=True)
    up = np.arange(labels.size)
    links = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(a: int, others: np.ndarray) -> None:
        for b in np.unique(group[others]).tolist():
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((int(labels[max(x, y)]), int(labels[min(x, y)])))

    owner = np.repeat(np.arange(counts.size), counts)
    starts = np.cumsum(counts) - counts
    likes = lambda both, a: both >= similarity * (counts[a] + counts - both) - 1e-9
    firsts = np.flatnonzero(sides == 0)
    across = firsts.size > 0
    hubs = np.flatnonzero(sides == 2)
    if not across and hubs.size:
        hub = int(hubs[0])
        mine = values[starts[hub] : starts[hub] + counts[hub]]
        both = np.bincount(owner[np.isin(values, mine)], minlength=counts.size)
        join(int(group[hub]), np.flatnonzero(likes(both, hub) & (counts > 0)))
        main = top(int(group[hub]))
        firsts = np.array([k for k in range(counts.size) if top(int(group[k])) != main], np.int64)
    elif not across:
        firsts = np.arange(counts.size)
    if not firsts.size:
        return links
    # an index of the rows that are compared with; those of side 0 are not among them
    indexed = np.flatnonzero(sides[owner] > 0) if across else np.arange(values.size)
    order = indexed[np.argsort(values[indexed], kind="stable")]
    listed = values[order]
    for a in firsts.tolist():
        mine = values[starts[a] : starts[a] + counts[a]]
        lo, hi = np.searchsorted(listed, mine), np.searchsorted(listed, mine, "right")
        both = np.bincount(owner[order[_spans(lo, hi - lo)]], minlength=counts.size)
        join(int(group[a]), np.flatnonzero(likes(both, a) & (both > 0)))
    return links


def tile_links(rows: DataFrame, payloads: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """Links (u, v) between roots from rows (tile, side, id, root), see _tile(). A tile has about two blocks of rows at most."""

    def links(batches: Iterator[pa.RecordBatch]):
        forest = Forest()
        held: list[pa.RecordBatch] = []

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            column = table.column(3).chunk(0) if table.num_rows else None
            values, counts = sets(column)
            found = _tile(table.column(1).to_numpy(), table.column(2).to_numpy(), values, counts, similarity)
            if found:
                pairs = np.array(found, np.int64)
                yield from forest.add(pairs[:, 0], pairs[:, 1])

        for batch in batches:
            tiles = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), tiles.size]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                if held and held[0].column(0)[0].as_py() != tiles[a]:
                    yield from done()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()
        yield from forest.flush()

    full = rows.join(payloads, "id").select("tile", "side", "root", "payload")
    # a tile is few bytes and much work, so that partitions must not be joined by their size
    return full.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile").mapInArrow(links, "u long, v long")


def _hubs(loud: DataFrame) -> DataFrame:
    """(key, hub): of each group of (key, id, bits) the item that is nearest to its majority bits."""
    ones = loud.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("bits", b).bitwiseAND(1)).alias(f"s{b}") for b in range(64)])
    centre = None
    for b in range(64):
        bit = F.when(F.col(f"s{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        centre = bit if centre is None else centre.bitwiseOR(bit)
    far = F.bit_count(F.col("bits").bitwiseXOR(F.col("centre"))).cast("long")
    # distance and id in one sort key, so that the hub is a plain minimum
    near = F.min_by("id", far * F.lit(2.0**53) + F.abs(F.hash("id")).cast("double"))
    return loud.join(ones.select("key", centre.alias("centre")), "key").groupBy("key").agg(near.alias("hub"))


def _blocks(rows: Column, elements: Column, block: int) -> Column:
    return F.greatest(F.ceil(rows / block), F.ceil(elements / BLOCK_ELEMENTS), F.lit(1)).cast("int")


def linked_components(items: DataFrame, keys: list[str], near: Near, fetch: Callable[[DataFrame], DataFrame], sets: Sets, similarity: float, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Components (node, root), as components() has them, of the like pairs among ``items`` (id, not negative, bits, and the
    columns ``keys``, all long) that share a key. ``fetch`` takes a table (id) and gives (id, payload), which ``sets`` turns
    into sets. Items that are the like of nothing have no row."""
    shelf = Shelf(items.sparkSession)
    exploded = lambda df: df.select("id", "bits", F.explode(F.array(*keys)).alias("key"))
    seen = items.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    frequent = shelf.put(exploded(seen).groupBy("key").count().filter(F.col("count") >= FREQUENT).select("key"))
    keyed = exploded(items)
    some = not frequent.isEmpty()
    found = shelf.put(grouped(keyed.join(frequent, "key", "left_anti") if some else keyed, near, crowd))
    pairs = shelf.put(found.filter(~F.col("loud")).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    loud = found.filter("loud").select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("c").alias("bits"))
    if some:
        loud = loud.unionAll(keyed.join(frequent, "key", "left_semi").select("key", "id", "bits"))
    loud = shelf.put(loud)
    needed = pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")).unionAll(loud.select("id")).distinct()
    payloads = shelf.put(fetch(needed))
    links = shelf.put(verified(pairs, payloads, sets, similarity))
    shelf.drop(found, pairs)
    crowds = not loud.isEmpty()
    if crowds:
        measure = F.size("payload") if payloads.schema["payload"].dataType.typeName() == "array" else F.length("payload")
        weighed = loud.join(payloads.select("id", measure.alias("elements")), "id")
        groups = weighed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("elements").alias("e"))
        groups = shelf.put(groups.join(_hubs(loud), "key").select("key", "hub", _blocks(F.col("n"), F.col("e"), block).alias("blocks")))
        own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
        hub = F.col("id") == F.col("hub")
        dealt = loud.join(groups, "key").select("key", "id", hub.alias("is_hub"), F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("at"))
        inner = dealt.select(F.xxhash64("key", "at").alias("tile"), F.when(F.col("is_hub"), 2).otherwise(1).cast("long").alias("side"), "id", F.col("id").alias("root"))
        links = links.unionAll(shelf.put(tile_links(inner, payloads, sets, similarity)))
    trees = components(links)
    if crowds:
        wide = groups.filter("blocks > 1")
        if not wide.isEmpty():
            rooted = loud.join(wide, "key").join(trees, F.col("id") == F.col("node"), "left").select("key", "id", "hub", "blocks", F.coalesce("root", "id").alias("root"))
            rooted = shelf.put(rooted)
            main = rooted.filter(hub).select("key", F.col("root").alias("main")).distinct()
            sized = rooted.join(main, "key").join(payloads.select("id", measure.alias("elements")), "id")
            apart = F.col("root") != F.col("main")
            left = sized.groupBy("key").agg(F.count_if(apart).alias("n"), F.sum(F.when(apart, F.col("elements")).otherwise(0)).alias("e")).filter("n > 0")
            left = shelf.put(left.select("key", _blocks(F.col("n"), F.col("e"), block).alias("parts")).join(main, "key"))
            rows = rooted.join(left, "key")
            part = F.pmod(F.xxhash64("id", "key", F.lit("part")), F.col("parts")).cast("int")
            tile = F.xxhash64("key", "part", "at", F.lit("across")).alias("tile")
            odd = rows.filter(apart).withColumn("part", part).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(tile, F.lit(0).cast("long").alias("side"), "id", "root")
            every = rows.withColumn("at", own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(tile, F.lit(1).cast("long").alias("side"), "id", "root")
            more = shelf.put(tile_links(odd.unionAll(every), payloads, sets, similarity))
            if not more.isEmpty():
                trees = together(trees, components(more))
    out = shelf.keep(trees)
    shelf.clear()
    return out
