"""Operators on ordered sequences: rows with a whole-number ``idx`` that gives their place.

Prefix folds over the whole order never use a window over all rows. The sequence is cut into blocks of BLOCK places; each
block is folded by itself in a window of its own, the blocks' totals, one row each, are folded in order, and every row
adds what came before its block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..files import staged

BLOCK = 4096

#: Folds by name: aggregate, combination of two partial results, value of nothing.
FOLDS: dict[str, tuple[Callable, Callable, object]] = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
    "min": (F.min, lambda a, b: F.least(a, b), None),
}


def _blocked(df: DataFrame, idx: str) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(idx) / BLOCK))


def _carries(totals: DataFrame, parts: list) -> DataFrame:
    """(__b, __c0, ...): of each block (__block, __t0, ...) the folds of all blocks before it. Blocks are folded in groups of BLOCK, then
    the groups, so that a window covers BLOCK blocks, and the last one a row for BLOCK * BLOCK * BLOCK places."""
    grouped = totals.withColumn("__super", F.floor(F.col("__block") / BLOCK))
    inside = W.partitionBy("__super").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    tops = grouped.groupBy("__super").agg(*[fold(f"__t{k}").alias(f"__t{k}") for k, _, fold, _, _ in parts])
    far = W.orderBy("__super").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col("__super").alias("__s"), *[fold(f"__t{k}").over(far).alias(f"__f{k}") for k, _, fold, _, _ in parts])
    both = grouped.withColumns({f"__n{k}": fold(f"__t{k}").over(inside) for k, _, fold, _, _ in parts}).join(tops, F.col("__super") == F.col("__s"), "left")
    return both.select(F.col("__block").alias("__b"), *[_joined(F.col(f"__f{k}"), F.col(f"__n{k}"), combine).alias(f"__c{k}") for k, _, _, combine, _ in parts])


def _joined(a: Column, b: Column, combine: Callable) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))


def scan(df: DataFrame, idx: str, value: Column, out: str, op: str = "sum", exclusive: bool = False, init=None) -> DataFrame:
    """Adds the prefix fold of ``value`` in order of ``idx``, with or without the row's own. ``init`` is put before an
    exclusive scan."""
    return scans(df, idx, [(value, out, op)], exclusive, init)


def scans(df: DataFrame, idx: str, folds: list[tuple[Column, str, str]], exclusive: bool = False, init=None) -> DataFrame:
    """Several prefix folds (value, name, op) in one pass."""
    rows = _blocked(df.withColumns({f"__v{k}": value for k, (value, _, _) in enumerate(folds)}), idx)
    parts = [(k, name, *FOLDS[op]) for k, (_, name, op) in enumerate(folds)]
    inside = W.partitionBy("__block").orderBy(idx).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    carry = _carries(rows.groupBy("__block").agg(*[fold(f"__v{k}").alias(f"__t{k}") for k, _, fold, _, _ in parts]), parts)
    own = rows.withColumns({f"__o{k}": fold(f"__v{k}").over(inside) for k, _, fold, _, _ in parts})
    return _finished(own.join(carry, F.col("__block") == F.col("__b"), "left"), parts, init).drop("__block", "__b")


def _finished(joined: DataFrame, parts: list, init) -> DataFrame:
    for k, name, _, combine, empty in parts:
        both, start = _joined(F.col(f"__c{k}"), F.col(f"__o{k}"), combine), init if init is not None else empty
        joined = joined.withColumn(name, both if start is None else _joined(F.lit(start), both, combine))
    return joined.drop(*[f"__{x}{k}" for k, *_ in parts for x in "vco"])


def with_previous(df: DataFrame, idx: str, value: Column, out: str) -> DataFrame:
    """Adds the value of the row before (null for the first); a block's first row gets it from the last block before it."""
    rows = _blocked(df.withColumn("__v", F.struct(value.alias("v"))), idx)
    order = W.partitionBy("__block").orderBy(idx)
    lasts = rows.groupBy("__block").agg(F.max_by("__v", idx).alias("__last"))
    grouped = lasts.withColumn("__super", F.floor(F.col("__block") / BLOCK))
    ends = grouped.groupBy("__super").agg(F.max_by("__last", "__block").alias("__end")).select(F.col("__super").alias("__s"), F.lag("__end").over(W.orderBy("__super")).alias("__far"))
    near = grouped.withColumn("__near", F.lag("__last").over(W.partitionBy("__super").orderBy("__block")))
    carry = near.join(ends, F.col("__super") == F.col("__s")).select(F.col("__block").alias("__b"), F.coalesce("__near", "__far").alias("__carry"))
    joined = rows.withColumn("__lag", F.lag("__v").over(order)).join(carry, F.col("__block") == F.col("__b"), "left")
    return joined.withColumn(out, F.coalesce("__lag", "__carry")["v"]).drop("__v", "__block", "__lag", "__b", "__carry")


def with_heads(df: DataFrame, idx: str, key: Column, out: str = "head") -> DataFrame:
    """Adds whether the row begins a run of equal keys."""
    lagged = with_previous(df.withColumn("__k", key), idx, F.struct(F.col("__k").alias("k")), "__p")
    return lagged.withColumn(out, F.col("__p").isNull() | ~F.col("__p")["k"].eqNullSafe(F.col("__k"))).drop("__k", "__p")


def with_runs(df: DataFrame, idx: str, key: Column, out: str = "run") -> DataFrame:
    """Adds the number, from 1, of the run of equal consecutive keys that the row is in."""
    return scan(with_heads(df, idx, key, "__h"), idx, F.col("__h").cast("int"), out).drop("__h")


def scan_by_key(df: DataFrame, idx: str, key: Column, value: Column, out: str, op: str = "sum", exclusive: bool = False, init=None) -> DataFrame:
    """Prefix fold that begins anew with each run of equal consecutive keys; long runs are folded block by block."""
    return scans_by_key(df, idx, key, [(value, out, op)], exclusive, init)


def scans_by_key(df: DataFrame, idx: str, key: Column, folds: list[tuple[Column, str, str]], exclusive: bool = False, init=None) -> DataFrame:
    """Several prefix folds (value, name, op) over the runs of one key, which are found once."""
    rows = _blocked(with_runs(df, idx, key, "__run").withColumns({f"__v{k}": value for k, (value, _, _) in enumerate(folds)}), idx)
    inside = W.partitionBy("__run", "__block").orderBy(idx).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    before = W.partitionBy("__run").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    parts = [(k, name, *FOLDS[op]) for k, (_, name, op) in enumerate(folds)]
    totals = rows.groupBy("__run", "__block").agg(*[fold(f"__v{k}").alias(f"__t{k}") for k, _, fold, _, _ in parts])
    carry = totals.select(F.col("__run").alias("__r"), F.col("__block").alias("__b"), *[fold(f"__t{k}").over(before).alias(f"__c{k}") for k, _, fold, _, _ in parts])
    own = rows.withColumns({f"__o{k}": fold(f"__v{k}").over(inside) for k, _, fold, _, _ in parts})
    joined = own.join(carry, (F.col("__run") == F.col("__r")) & (F.col("__block") == F.col("__b")), "left")
    return _finished(joined, parts, init).drop("__run", "__block", "__r", "__b")


#: Rows that fold() takes together at each level.
FAN = 256
_CHUNK = 16


def _inner(values: Column, op: Callable, kind: str) -> Column:
    """The inclusive folds of an array of struct(v), as an array of the same; an array grows by _CHUNK at most, so none is copied often."""
    empty = F.array().cast(f"array<struct<v:{kind}>>")
    none = F.lit(None).cast(f"struct<v:{kind}>")
    join = lambda a, b: F.when(a.isNull(), b).otherwise(F.struct(op(a["v"], b["v"]).alias("v")))
    grow = lambda s, x: F.struct(F.concat(s["out"], F.array(join(s["last"], x))).alias("out"), join(s["last"], x).alias("last"))

    def folded(array: Column, first: Column) -> Column:
        return F.aggregate(array, F.struct(empty.alias("out"), first.alias("last")), grow)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))
    step = lambda s, chunk: F.struct(F.concat(s["all"], F.array(s["part"]["out"])).alias("all"), folded(chunk, s["part"]["last"]).alias("part"))
    start = F.struct(F.array().cast(f"array<array<struct<v:{kind}>>>").alias("all"), F.struct(empty.alias("out"), none.alias("last")).alias("part"))
    return F.aggregate(chunks, start, step, lambda s: F.flatten(F.concat(s["all"], F.array(s["part"]["out"]))))


def fold(df: DataFrame, idx: str, value: Column, out: str, op: Callable[[Column, Column], Column], exclusive: bool = False, init=None) -> DataFrame:
    """Adds the prefix fold of ``value`` by any associative ``op``, commutative or not: op(a, b) of two Columns of the value's type, a
    being what comes first. Values may be structs; the first exclusive one is ``init`` (a Column; null if not given), which is put
    before all others.

    A tree: FAN rows are folded inside one array, their totals again, until one array holds all, in as many levels as the
    greatest ``idx`` takes; then what comes before each group goes down the same way. No window and no task covers more than
    FAN rows of a group."""
    v, own, carry = "__fv", "__fo", "__fc"
    rows = df.withColumn(v, value)
    kind = rows.schema[v].dataType.simpleString()
    most = df.agg(F.max(idx)).first()[0]
    if most is None:
        return rows.withColumn(out, F.col(v)).drop(v)
    join = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(op(a["v"], b["v"]).alias("v")))
    names = [c for c in df.columns]
    level = rows.select(F.col(idx).alias("__at"), F.struct(F.col(v).alias("v")).alias("__x"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    levels = []
    while True:
        item = F.struct("__at", "__x", *(["__row"] if not levels else []))
        groups = level.withColumn("__g", F.floor(F.col("__at") / FAN)).groupBy("__g").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["__at"] < b["__at"], -1).when(a["__at"] > b["__at"], 1).otherwise(0)).alias("__all"))
        levels.append(staged(groups.withColumn("__sums", _inner(F.col("__all.__x"), op, kind))))
        most //= FAN
        if most < 1:
            break
        level = levels[-1].select(F.col("__g").alias("__at"), F.element_at("__sums", -1).alias("__x"))
    above = None
    for groups in reversed(levels):
        if above is not None:
            groups = groups.join(above, F.col("__g") == F.col("__of"), "left")
        before = F.col("__before") if above is not None else F.lit(None).cast(f"struct<v:{kind}>")
        flat = groups.select(before.alias("__before"), F.posexplode("__all").alias("__k", "__item"), "__sums")
        inner = F.get(F.col("__sums"), F.col("__k") - 1), F.get(F.col("__sums"), F.col("__k"))
        flat = flat.select("__item", *[join(F.col("__before"), x).alias(c) for x, c in zip(inner, (carry, own), strict=True)])
        above = flat.select(F.col("__item.__at").alias("__of"), F.col(carry).alias("__before"))
    found = F.col(carry if exclusive else own)
    if exclusive:
        first = F.lit(None).cast(f"struct<v:{kind}>") if init is None else F.struct(init.alias("v"))
        found = join(first, found)
    return flat.select("__item.__row.*", found["v"].alias(out))


def fold_by_key(df: DataFrame, idx: str, key: Column, value: Column, out: str, op: Callable[[Column, Column], Column], exclusive: bool = False, init: Column | None = None) -> DataFrame:
    """fold() that begins anew with each run of equal consecutive keys: one fold of (head, value), which is associative, too."""
    headed = with_heads(df, idx, key, "__fh")

    def both(a: Column, b: Column) -> Column:
        return F.struct((a["head"] | b["head"]).alias("head"), F.when(b["head"], b["x"]).otherwise(op(a["x"], b["x"])).alias("x"))

    pair = F.struct(F.col("__fh").alias("head"), value.alias("x"))
    folded = fold(headed, idx, pair, "__fp", both, exclusive)
    found = F.col("__fp")["x"]
    if exclusive:
        start = F.lit(None) if init is None else init
        found = F.when(F.col("__fh"), start).otherwise(found if init is None else op(init, found))
    return folded.withColumn(out, found).drop("__fh", "__fp")


def reduce_by_key(df: DataFrame, idx: str, key: Column, *aggregates: Column) -> DataFrame:
    """One row (run, key, first_idx, ...) for each run of equal consecutive keys."""
    rows = with_runs(df.withColumn("key", key), idx, F.col("key"))
    return rows.groupBy("run", "key").agg(F.min(idx).alias("first_idx"), *aggregates)


def adjacent_difference(df: DataFrame, idx: str, value: Column, out: str) -> DataFrame:
    """value less that of the row before; the first row's own value."""
    return with_previous(df.withColumn("__x", value), idx, F.col("__x"), "__q").withColumn(out, F.coalesce(F.col("__x") - F.col("__q"), F.col("__x"))).drop("__x", "__q")


def unique(df: DataFrame, idx: str, key: Column) -> DataFrame:
    """The first row of each run of equal consecutive keys."""
    return with_heads(df, idx, key, "__h").filter("__h").drop("__h")


def sorted_until(df: DataFrame, idx: str, value: Column) -> DataFrame:
    """One row: the place of the first value below the one before it (null: all are in order), and whether all are."""
    broken = with_previous(df.withColumn("__x", value), idx, F.col("__x"), "__q").filter("__x < __q")
    return broken.agg(F.min(idx).alias("until")).withColumn("is_sorted", F.col("until").isNull())


def gather(indexes: DataFrame, at: str, source: DataFrame, idx: str) -> DataFrame:
    """The rows of ``source`` at the places that ``indexes`` names, once for each time."""
    return indexes.join(source.withColumnRenamed(idx, "__i"), F.col(at) == F.col("__i")).drop("__i")


def scatter(target: DataFrame, idx: str, value: str, updates: DataFrame, at: str, new: str) -> DataFrame:
    """``target`` with the values that ``updates`` puts at places; places are named once at most."""
    moved = updates.select(F.col(at).alias("__i"), F.struct(F.col(new).alias("v")).alias("__n"))
    return target.join(moved, F.col(idx) == F.col("__i"), "left").withColumn(value, F.when(F.col("__n").isNotNull(), F.col("__n")["v"]).otherwise(F.col(value))).drop("__i", "__n")


def bounds(values: DataFrame, value: str, probes: DataFrame, probe: str) -> DataFrame:
    """Of each distinct probe: lower (values below it), upper (values not above it), found.

    Values and probes are counted by distinct value, merged and cut into ranges; each range is summed by itself and adds
    what the ranges before it hold, so no window covers all rows."""
    counted = values.groupBy(F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", F.lit(False))
    asked = probes.select(F.col(probe).alias("__x")).distinct().withColumn("__n", F.lit(0).cast("long")).withColumn("__p", F.lit(True))
    merged = counted.unionByName(asked).groupBy("__x").agg(F.sum("__n").alias("__n"), F.max("__p").alias("__p"))
    ranged = staged(merged.repartitionByRange(F.col("__x")).withColumn("__part", F.spark_partition_id()))
    before = ranged.groupBy("__part").agg(F.sum("__n").alias("__t")).select(F.col("__part").alias("__q"), F.coalesce(F.sum("__t").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__c"))
    upto = F.sum("__n").over(W.partitionBy("__part").orderBy("__x").rowsBetween(W.unboundedPreceding, 0))
    out = ranged.withColumn("__u", upto).join(before, F.col("__part") == F.col("__q")).filter("__p")
    upper = F.col("__c") + F.col("__u")
    return out.select(F.col("__x").alias(probe), (upper - F.col("__n")).alias("lower"), upper.alias("upper"), (F.col("__n") > 0).alias("found"))


def stable_partition(df: DataFrame, idx: str, truth: Column, out: str = "place") -> DataFrame:
    """Adds the row's place, from 0, when rows for which ``truth`` holds come first and order is kept otherwise."""
    held = df.withColumn("__t", F.coalesce(truth, F.lit(False)))
    counted = scans(held, idx, [(F.col("__t").cast("int"), "__yes", "sum"), ((~F.col("__t")).cast("int"), "__no", "sum")], exclusive=True)
    total = held.agg(F.count_if("__t").alias("__all"))
    return counted.crossJoin(F.broadcast(total)).withColumn(out, F.when(F.col("__t"), F.col("__yes")).otherwise(F.col("__all") + F.col("__no"))).drop("__t", "__yes", "__no", "__all")  # the total is one row


def partition_point(df: DataFrame, idx: str, truth: Column) -> DataFrame:
    """One row: the first place where ``truth`` fails (null: nowhere), and whether no row after it holds it."""
    return df.agg(F.min(F.when(~truth, F.col(idx))).alias("point"), F.max(F.when(truth, F.col(idx))).alias("__last")).select("point", F.coalesce(F.col("__last") < F.col("point"), F.lit(True)).alias("is_partitioned"))


def mismatch(a: DataFrame, b: DataFrame, idx: str, value: str) -> DataFrame:
    """One row: the first place where the sequences differ (null: nowhere), and whether they are equal."""
    left, right = a.select(idx, F.struct(F.col(value).alias("v")).alias("__a")), b.select(idx, F.struct(F.col(value).alias("v")).alias("__b"))
    return left.join(right, idx, "full").filter(~F.col("__a").eqNullSafe(F.col("__b"))).agg(F.min(idx).alias("first")).withColumn("equal", F.col("first").isNull())


def zipped(a: DataFrame, b: DataFrame, idx: str, left: str, right: str) -> DataFrame:
    """(idx, left, right): the values of two sequences at each place that both have."""
    return a.select(idx, F.col(left).alias("left")).join(b.select(idx, F.col(right).alias("right")), idx)


def inner_product(a: DataFrame, b: DataFrame, idx: str, left: str, right: str, init=0) -> DataFrame:
    """One row: init and the sum of the products, place by place, of two sequences; and how many places both have."""
    both = zipped(a, b, idx, left, right)
    return both.agg((F.coalesce(F.sum(F.col("left") * F.col("right")), F.lit(0)) + F.lit(init)).alias("s"), F.count(F.lit(1)).alias("n"))


def swap_ranges(a: DataFrame, b: DataFrame, idx: str, value: str, start: int, stop: int) -> tuple[DataFrame, DataFrame]:
    """Two sequences with their values from place ``start`` to before ``stop`` exchanged, where both have the place."""
    inside = (F.col(idx) >= start) & (F.col(idx) < stop)

    def taken(own: DataFrame, other: DataFrame) -> DataFrame:
        new = other.filter(inside).select(F.col(idx).alias("__i"), F.struct(F.col(value).alias("v")).alias("__n"))
        return own.join(new, F.col(idx) == F.col("__i"), "left").withColumn(value, F.when(F.col("__n").isNotNull(), F.col("__n")["v"]).otherwise(F.col(value))).drop("__i", "__n")

    return taken(a, b), taken(b, a)


def ranked(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Adds the row's place, from 1, in that order (null last): its number within a range of it, and the ranges' sizes before it.
    A key that many rows have is cut by the later columns of the order.

    The ranges' bounds come from a sample, which another run of the same plan draws anew; so the rows are staged with their
    range (upper bits) and number."""
    ascending = [F.col(c).asc_nulls_last() for c in order]
    rows = staged(df.repartitionByRange(*ascending).sortWithinPartitions(*ascending).withColumn("__at", F.monotonically_increasing_id()))
    part, number = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.coalesce(F.sum("count").over(W.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(part.alias("__q")).count().select("__q", before.alias("__before"))
    return rows.join(sizes, part == F.col("__q")).withColumn(out, F.col("__before") + number + 1).drop("__at", "__q", "__before")


def stable_sort_by_key(df: DataFrame, idx: str, key: str, out: str = "place") -> DataFrame:
    """Adds the row's place, from 1, when rows are sorted by ``key`` (null last) and those of equal keys keep their order."""
    return ranked(df, key, idx, out=out)


def merged(a: DataFrame, b: DataFrame, idx: str, key: str, out: str = "place") -> tuple[DataFrame, DataFrame]:
    """Two sequences, each in order of ``key`` with places ``idx`` from 0, with the place from 0 that each element has in the merged
    one; of equal keys those of ``a`` come first, in their order. Nothing is sorted again: a place is an element's own place and its
    rank in the other sequence, which bounds() finds by ranges of both. Null keys are not merged (null place)."""

    def placed(own: DataFrame, other: DataFrame, rank: str) -> DataFrame:
        asked, at, low = "__mk", "__mi", "__mr"
        found = bounds(other.filter(F.col(key).isNotNull()), key, own.filter(F.col(key).isNotNull()), key).select(F.col(key).alias(asked), F.col(rank).alias(low))
        joined = own.withColumn(at, F.col(idx)).join(found, F.col(key) == F.col(asked), "left")
        return joined.withColumn(out, F.col(at) + F.col(low)).drop(asked, at, low)

    return placed(a, b, "lower"), placed(b, a, "upper")


def segmented_places(df: DataFrame, segment: str, *order: str, out: str = "place") -> DataFrame:
    """Adds the row's place, from 1, in its segment when each segment is sorted by ``order`` (null last). Rows are dealt by ranges of
    (segment, order), so a long segment is cut into several ranges and none is held as a list; a segment's first rank is one row."""
    rows = ranked(df, segment, *order, out="__sr")
    firsts = rows.groupBy(F.col(segment).alias("__ss")).agg(F.min("__sr").alias("__sf"))
    return rows.join(firsts, F.col(segment).eqNullSafe(F.col("__ss"))).withColumn(out, F.col("__sr") - F.col("__sf") + 1).drop("__sr", "__ss", "__sf")


def for_each(df: DataFrame, action: Callable) -> None:
    """Runs ``action`` on every row where the row is, for its effects (accumulators, stores) only. A task that is run again
    repeats them."""

    def run(rows):
        for row in rows:
            action(row)

    df.foreachPartition(run)


def minmax_element(df: DataFrame, idx: str, value: str) -> DataFrame:
    """One row: places of the first least and the first greatest value."""
    v, i = F.col(value).alias("v"), F.col(idx)
    least, greatest = F.min(F.struct(v, i.alias("i"))), F.max(F.struct(v, (-i).alias("i")))
    return df.agg(least["i"].alias("min_idx"), (-greatest["i"]).alias("max_idx"))
