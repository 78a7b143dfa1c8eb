"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs (pieces between line feeds and sentence ends, trimmed, distinct) are hashed to 64-bit digests. A sketch has
CELLS cells in three parts; each digest goes to one cell of each part, which holds a count, the XOR of its digests and the
XOR of their checks. Subtracting the sketches of two versions leaves the digests that only one of them has; cells that
hold a single one are peeled until nothing is left. Where peeling gets stuck, the two versions are sketched larger: both
digest sets are divided by the next four bits of the digests into sixteen sketches of their own, and so on for those
that still fail. So every difference is recovered in the end, whatever its size, and no step is quadratic in a text's length.

The fingerprint is the smallest sketch, written as text.

Defined results: null counts as empty, which has no paragraph; two texts without paragraphs are alike (1.0); repeated
paragraphs of a text count once; rows with the same id stand in descending order of their texts; a table of one row has that
row as its own next document. Only the id and the text are read. Ids are numbers; any
other type is an error in comparisons with the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .util import SPACES, staged, text_of

PARTS = 3
#: Cells of a part: of the smallest sketch, which is the fingerprint, and of each of the sketches that a larger one is made of.
PART, SMALL_PART = 10, 5
CELLS = PART * PARTS
#: Rounds of peeling before a sketch counts as stuck.
ROUNDS = 10
#: Bits of the digest that divide a larger sketch, from the top, at each retry.
SPLIT_BITS = 4
MOST_RETRIES = 15


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs."""
    pieces = F.split(text, r"\n+|(?<=[.!?])[\x20\t\r\x0b\f]+")
    kept = F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(SPACES))), lambda p: p != "")
    return F.array_distinct(F.transform(kept, lambda p: F.xxhash64(p)))


def _place(digest: str, part: str, size: int) -> str:
    """Cell of a digest within a part."""
    return f"((shiftrightunsigned({digest}, 20 * {part}) & 1048575L) % {size}L)"


def sketch_sql(digests: str, size: int = PART) -> str:
    """The cells of an array of digests: struct(c: count, k: XOR of digests, h: XOR of checks)."""
    # checks and places are made once a digest, not once a cell
    places = ", ".join(f"'p{j}', cast({_place('d', str(j), size)} as int)" for j in range(PARTS))
    items = f"transform({digests}, d -> named_struct('k', d, 'h', xxhash64(d) & 4294967295L, {places}))"
    empty = "named_struct('c', 0, 'k', 0L, 'h', 0L)"
    add = "(s, x) -> named_struct('c', s.c + 1, 'k', s.k ^ x.k, 'h', s.h ^ x.h)"
    parts = (f"transform(sequence(0, {size - 1}), i -> aggregate(filter(t, x -> x.p{j} = i), {empty}, {add}))" for j in range(PARTS))
    return f"transform(array({items}), t -> concat({', '.join(parts)}))[0]"


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel_sql(cells: str, size: int = PART) -> str:
    """struct(cells: what is left, found: digests peeled so far, go: whether the last round found any); done if every cell
    left is empty."""
    places = ", ".join(_place("x.k", str(j), size) for j in range(PARTS))
    single = f"array_distinct(transform(filter(s.cells, x -> abs(x.c) = 1 AND x.h = (xxhash64(x.k) & 4294967295L)), x -> named_struct('c', x.c, 'k', x.k, 'h', x.h, 'at', array({places}))))"
    without = "(y, q) -> named_struct('c', y.c - q.c, 'k', y.k ^ q.k, 'h', y.h ^ q.h)"
    left = f"transform(s.cells, (x, i) -> aggregate(filter(p, q -> q.at[i div {size}] = i % {size}), x, {without}))"
    # array(..)[0] by a lambda names the peeled cells, so that they are found once a round
    step = f"transform(array({single}), p -> if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), named_struct('cells', {left}, 'found', concat(s.found, transform(p, q -> q.k)), 'go', true)))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', cast(array() as array<bigint>), 'go', true), (s, r) -> if(s.go, {step}, s))"


DONE = "forall({0}.cells, x -> x.c = 0 AND x.k = 0L AND x.h = 0L)"


def written(cells: Column) -> Column:
    """A sketch as text: count.digests.checks of each cell, in hexadecimal; empty cells are empty."""
    return F.array_join(F.transform(cells, lambda x: F.when(x["c"] == 0, F.lit("")).otherwise(F.concat_ws(".", F.hex(x["c"].cast("long")), F.hex(x["k"]), F.hex(x["h"])))), ",")


def differences(pairs: DataFrame, level: int = 0, count_only: bool = False) -> DataFrame:
    """Of (pair, a, b): a row (pair, found), or (pair, n) with their number, for each sketch of the pair, whose ``found`` are digests in one of a and b only;
    all of a pair's rows together have all of them, each once. a and b: arrays of distinct digests. ``level``: how often
    the rows have been divided already."""
    out, rows = [], pairs
    for level in range(level, MOST_RETRIES):
        tried = rows.withColumn("peeled", F.expr(peel_sql(subtract_sql(sketch_sql("a", SMALL_PART), sketch_sql("b", SMALL_PART)), SMALL_PART)))
        own = F.size("peeled.found").alias("n") if count_only else F.col("peeled.found").alias("found")
        marked = tried.select("pair", F.expr(DONE.format("peeled")).alias("done"), own, "a", "b")
        kept = marked.columns[2]
        tried = staged(marked.select("pair", "done", F.when(F.col("done"), F.col(kept)).alias(kept), *[F.when(~F.col("done"), F.col(c)).alias(c) for c in ("a", "b")]))
        out.append(tried.filter("done").select("pair", kept))
        stuck = tried.filter("NOT done").select("pair", "a", "b")
        if stuck.isEmpty():
            break
        rows = larger(stuck, level)
    else:
        raise RuntimeError("a sketch could not be peeled at any size")
    return out[0] if len(out) == 1 else out[0].unionAll(_union(out[1:]))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionAll(f)
    return whole


def larger(stuck: DataFrame, level: int) -> DataFrame:
    """(pair, a, b) of each of the sixteen parts that the next bits of the digests make of a row; empty parts are left out."""
    bits = f"shiftrightunsigned({{0}}, {64 - SPLIT_BITS * (level + 1)}) & {(1 << SPLIT_BITS) - 1}L"
    part = f"transform(sequence(0L, {(1 << SPLIT_BITS) - 1}L), g -> named_struct('a', filter(a, x -> ({bits.format('x')}) = g), 'b', filter(b, x -> ({bits.format('x')}) = g)))"
    return stuck.select("pair", F.explode(F.expr(part)).alias("part")).select("pair", "part.a", "part.b").filter("size(a) > 0 OR size(b) > 0")


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Jaccard likeness of two sets of sizes a and b that ``found`` digests tell apart; two empty sets are alike."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - found) / (a + b + found))


def _group(df: DataFrame, id_col: str) -> Column:
    """Number of the quantile group of an id, from the lowest ids up; null ids are in the lowest. The quantiles are those of
    all ids, four for each shuffle partition."""
    if not isinstance(df.schema[id_col].dataType, NumericType):
        raise TypeError(f"ids in {id_col} have to be numbers: the next document is found by their quantiles")
    groups = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(f"`{id_col}`").cast("double").alias("x")).filter("x is not null")
    cuts = sorted(set(ids.approxQuantile("x", [k / groups for k in range(1, groups)], 0.25 / groups)))
    if not cuts:
        return F.lit(0)
    # one literal, however many cuts there are: the text is folded to an array when the plan is made
    known = f"cast(split('{','.join(f'{float(c)!r}' for c in cuts)}', ',') as array<double>)"
    halve = f"""aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('l', 0, 'h', {len(cuts)}), (s, i) ->
        if(s.l >= s.h, s, if({known}[(s.l + s.h) div 2] < cast(`{id_col}` as double), named_struct('l', cast((s.l + s.h) div 2 + 1 as int), 'h', s.h), named_struct('l', s.l, 'h', cast((s.l + s.h) div 2 as int)))), s -> s.l)"""
    return F.coalesce(F.expr(halve), F.lit(0))


def edited_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document: id, n_chars, edited_sha256, both fingerprints, and the digests of its paragraphs (a), of its edited
    text's (b) and of the next document's (c), with the smallest sketches of the first and the last (sa, sc). The edited text has the last half of the signs (rounded down) replaced by as
    many first ones (or all) of the next document in descending order of ids; the first comes after the last.

    Ids are cut at their quantiles into groups, which are windows of their own. Each group is given a copy of the first row
    of the group after it, so that its last row finds its next without a window over all rows; texts are shuffled once."""
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), text_of(text_col).alias("__text"), _group(df, id_col).alias("__group"))
    top = F.struct(F.col("__id").isNotNull().alias("some"), F.col("__id").alias("id"), F.col("__text").alias("text"))
    # the first row of each group, found by partial aggregation; groups are few
    heads = rows.groupBy("__group").agg(F.max(top).alias("__top")).select("__group", F.col("__top.id").alias("__id"), F.col("__top.text").alias("__text"))
    # the copy goes to the next higher group, that of the highest ids to the lowest group
    up = W.orderBy(F.col("__group"))
    target = F.coalesce(F.lead("__group").over(up), F.min("__group").over(W.partitionBy()))
    ghosts = heads.withColumn("__to", target).select("__id", "__text", F.col("__to").alias("__group"), F.lit(True).alias("__ghost"))
    whole = rows.withColumn("__ghost", F.lit(False)).unionByName(ghosts)
    down = W.partitionBy("__group").orderBy(F.col("__ghost"), F.col("__id").desc_nulls_last(), F.col("__text").desc())
    # what is made of a row after the first window is handed to the row before it by a second one, which needs no exchange
    moved = whole.withColumn("__next", F.lead("__text").over(down)).withColumn("a", paragraphs(F.col("__text"))).withColumn("sa", F.expr(sketch_sql("a")))
    moved = moved.withColumn("c", F.lead("a").over(down)).withColumn("sc", F.lead("sa").over(down)).filter(~F.col("__ghost"))
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), n - half), F.substring(F.col("__next"), F.lit(1), half))
    made = moved.select("__id", n.cast("long").alias("n_chars"), edited.alias("__edited"), "a", "c", "sa", "sc")
    return made.select(F.col("__id").alias(id_col), "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "a", paragraphs(F.col("__edited")).alias("b"), "c", "sa", "sc")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row."""
    digests = df.select(F.col(f"`{id_col}`").alias(id_col), paragraphs(text_of(text_col)).alias("__d"))
    return digests.select(id_col, written(F.expr(sketch_sql("__d"))).alias("fingerprint"))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = edited_versions(df, id_col, text_col)
    # the smallest sketches are made once: they are the fingerprints, and what is subtracted first
    rows = rows.withColumn("sb", F.expr(sketch_sql("b")))
    rows = rows.withColumn("pb", F.expr(peel_sql(subtract_sql("sa", "sb")))).withColumn("pc", F.expr(peel_sql(subtract_sql("sa", "sc"))))
    done_b, done_c = F.expr(DONE.format("pb")), F.expr(DONE.format("pc"))
    first = staged(rows.select(
        F.monotonically_increasing_id().alias("pair"), id_col, "n_chars", "edited_sha256", written(F.col("sa")).alias("fingerprint"), written(F.col("sb")).alias("edited_fingerprint"),
        F.size("a").alias("na"), F.size("b").alias("nb"), F.size("c").alias("nc"), F.when(done_b, F.size("pb.found")).alias("db"), F.when(done_c, F.size("pc.found")).alias("dc"),
        F.when(~(done_b & done_c), F.col("a")).alias("a"), F.when(~done_b, F.col("b")).alias("b"), F.when(~done_c, F.col("c")).alias("c"),
    ))
    # pairs are 2 x row for the edited text and 2 x row + 1 for the next document
    tasks = first.filter("db IS NULL OR dc IS NULL").select("a", F.explode(F.filter(F.array(F.struct((F.col("pair") * 2).alias("pair"), "b"), F.struct((F.col("pair") * 2 + 1).alias("pair"), F.col("c").alias("b"))), lambda t: t["b"].isNotNull())).alias("t")).select("t.pair", "a", "t.b")
    more = differences(larger(tasks, 0), 1, count_only=True).groupBy((F.floor(F.col("pair") / 2)).alias("pair")).agg(
        F.sum(F.when(F.col("pair") % 2 == 0, F.col("n"))).alias("mb"), F.sum(F.when(F.col("pair") % 2 == 1, F.col("n"))).alias("mc")
    )
    out = first.join(more, "pair", "left")
    return out.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("na"), F.col("nb"), F.coalesce("db", "mb", F.lit(0))).alias("near_edited"), likeness(F.col("na"), F.col("nc"), F.coalesce("dc", "mc", F.lit(0))).alias("near_next"),
    )
