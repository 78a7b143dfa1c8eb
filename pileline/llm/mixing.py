"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / w``: u in (0, 1) from a hash of its id, w its quality weight. Within its source
the documents are taken in ascending key order until the words that the target leaves after whole epochs are used up.

Keys are mapped to [0, 1) by ``key / (1 + key)`` and cut into ``CELLS`` cells, of which none gets over 6 in 4096 of the rows
of any weight from 0.1 to 1. Sizes are summed by (source, cell) before anything is shuffled, the cells' sums are added up
within a source, and only the rows of one cell are ever sorted together; so a source that holds a third of all rows is
spread over thousands of groups.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; documents of size 0
take 0 words; equal rows (same id, same size) are ordered arbitrarily among themselves but their taken words agree as a
multiset between runs; an empty table gives an empty result; if all sizes are 0, all targets are 0. Other columns are not
read, and can have any name; mixed_documents() returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import SPACES, free, staged, text_of, unit_hash, word_count

CELLS = 4096
#: No source gives more than so many times its own words.
MOST_EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Signs that mark broken prose (fixed value); their share lowers a document's weight.
SIGNS = "!#$%&*|{}<>=_"


def quality_weight(text: Column) -> Column:
    """In [0.1, 1]: one less five times the share of SIGNS, 0.1 at least; 1 for an empty text."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, SIGNS, ""))) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * share)


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None = None) -> DataFrame:
    """The narrow rows that all else works on: __id, __source, __size, __key, __cell. ``weight`` over 0; default quality_weight()."""
    text = text_of(text_col)
    return (
        df.select(
            F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"), word_count(text).alias("__size"),
            unit_hash(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("__u"), (quality_weight(text) if weight is None else weight.cast("double")).alias("__w"),
        )
        .select("__id", "__source", "__size", (-F.log("__u") / F.col("__w")).alias("__key"))
        .withColumn("__cell", F.least(F.floor(F.col("__key") / (F.col("__key") + 1) * CELLS), F.lit(CELLS - 1)).cast("int"))
    )


def targets(sums: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Of rows (__source, source_size): adds ``target``. Sources in order of code points, null last, have the weights in
    turn; they share all words by weight, none above ``most`` times its own, the excess reshared by weight until none is.

    With sources in ascending order of limit / weight, the first ones stop at their limits and all others get one multiple
    of their weights: the least number of stopped ones for which that multiple is within the next one's limit.
    """
    everything = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ordered = W.orderBy("__ratio", F.col("__source").asc_nulls_last())
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    t = sums.withColumn("__weight", weight).withColumn("__limit", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("__ratio", F.col("__limit") / F.col("__weight")).withColumn("__all", F.sum("source_size").over(everything))
    t = t.withColumn("__wsum", F.sum("__weight").over(everything))
    t = t.withColumn("__full", F.coalesce(F.sum("__limit").over(before), F.lit(0.0))).withColumn("__wfull", F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    t = t.withColumn("__level", (F.col("__all") - F.col("__full")) / (F.col("__wsum") - F.col("__wfull")))
    t = t.withColumn("__fits", F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level")))
    t = t.withColumn("__level", F.min("__fits").over(everything)["__level"])
    target = F.when(F.col("__level").isNull(), F.col("__limit")).otherwise(F.least(F.col("__limit"), F.col("__level") * F.col("__weight")))
    return t.select("__source", "source_size", target.alias("target"))


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(sources, cells): of each source its size, target, epochs and rest; of each (source, cell) the words before it."""
    cells = rows.groupBy("__source", "__cell").agg(F.sum("__size").alias("__words"))
    sums = cells.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    size, target = F.col("source_size"), F.col("target")
    sources = targets(sums, weights, most).withColumn("__epochs", F.when(size > 0, F.least(F.floor(target / size), F.lit(most))).otherwise(0).cast("long"))
    sources = sources.withColumn("__rest", target - F.col("__epochs") * size)
    by_cell = W.partitionBy("__source").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    return sources, cells.withColumn("__before", F.coalesce(F.sum("__words").over(by_cell), F.lit(0))).drop("__words")


def mix(rows: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Of the rows of sized(): adds source_size, target, __copies (how often the row is taken) and ``taken`` words.

    The document that crosses the target is taken if that comes nearer to it than leaving it out."""
    sources, cells = plan(rows, weights, most)
    within = W.partitionBy("__source", "__cell").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, 0)
    # sources and cells are small next to the rows; whether they are broadcast is left to Spark, which knows their sizes
    known = cells.join(sources, cells["__source"].eqNullSafe(sources["__source"])).drop(sources["__source"]).withColumnRenamed("__source", "__s").withColumnRenamed("__cell", "__c")
    summed = rows.withColumn("__upto", F.sum("__size").over(within))
    joined = summed.join(known, summed["__source"].eqNullSafe(known["__s"]) & (summed["__cell"] == known["__c"]))
    upto, size, rest = F.col("__before") + F.col("__upto"), F.col("__size"), F.col("__rest")
    taken_once = (upto <= rest) | ((upto - size < rest) & (upto - rest < rest - (upto - size)))
    copies = F.col("__epochs") + F.when(taken_once & (F.col("__epochs") < most), 1).otherwise(0)
    return joined.withColumn("__copies", copies).withColumn("taken", F.col("__copies") * size).drop("__s", "__c")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """One row for each document: its id, size, source_size, target and taken words."""
    out = mix(sized(df, id_col, text_col, source_col, weight))
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "taken")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """The rows of ``df``, all its columns, as often as the mix takes them.

    Texts are not shuffled: of each source only the last (key, id, size) taken is found, and rows are compared with it. Where
    several rows are equal in these and the mix takes a part of them only, the table is staged with row numbers, and the first
    so many of them stay, told by counts a partition and a look into the one partition where the number is reached."""
    rows = staged(sized(df, id_col, text_col, source_col, weight))
    key = F.struct("__key", "__id", "__size")
    chosen = staged(mix(rows).select("__source", "__epochs", (F.col("__copies") > F.col("__epochs")).alias("__more"), key.alias("__at")))
    cuts = chosen.groupBy("__source").agg(F.max("__epochs").alias("__epochs"), F.max(F.when(F.col("__more"), F.col("__at"))).alias("__last"))
    own_key, s, epochs, last, n, copy, row, most = free(df, "__key", "__s", "__epochs", "__last", "__n", "__copy", "__row", "__most")
    cuts = staged(cuts.select(F.col("__source").alias(s), F.col("__epochs").alias(epochs), F.col("__last").alias(last)))
    ends = chosen.join(cuts, F.col("__source").eqNullSafe(F.col(s)) & (F.col("__at") == F.col(last)))
    split = staged(ends.groupBy(F.col(s)).agg(F.count_if("__more").alias("k"), F.count(F.lit(1)).alias("m")).filter("k < m").select(F.col(s).alias("__ts"), "k"))
    tied = not split.isEmpty()
    if tied:
        df = staged(df.withColumn(row, F.monotonically_increasing_id()))
    text = text_of(text_col)
    tagged = df.withColumn(own_key, -F.log(unit_hash(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))) / (quality_weight(text) if weight is None else weight.cast("double")))
    tagged = tagged.join(cuts, F.col(f"`{source_col}`").eqNullSafe(F.col(s)))
    own = F.struct(F.col(own_key).alias("__key"), F.col(f"`{id_col}`").alias("__id"), word_count(text).alias("__size"))
    taken = F.col(last).isNotNull() & (own <= F.col(last))
    if tied:
        limits = _kth(tagged.filter(own == F.col(last)).select(F.col(s).alias("__ts"), F.col(row).alias("__row")), split, most)
        tagged = tagged.join(limits, F.col(s).eqNullSafe(F.col("__ls")), "left")
        taken = taken & (F.col(most).isNull() | (own < F.col(last)) | (F.col(row) <= F.col(most)))
    repeated = tagged.withColumn(n, (F.col(epochs) + F.when(taken, 1).otherwise(0)).cast("int")).filter(F.col(n) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n))))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns if c != row])


def _kth(ties: DataFrame, wanted: DataFrame, out: str) -> DataFrame:
    """(__ls, ``out``): of each source of ``wanted`` (__ts, k) the row number of the k-th of its rows in ``ties`` (__ts, __row). Row
    numbers have their partition in the upper bits; only the partition that holds the k-th is put in order."""
    part = F.shiftright("__row", 33)
    ties = staged(ties.withColumn("__part", part))
    counts = ties.groupBy("__ts", "__part").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("__ts").orderBy("__part")))
    w = wanted.select(F.col("__ts").alias("__ws"), "k")
    at = counts.join(w, F.col("__ts").eqNullSafe(F.col("__ws"))).filter("k > upto - c AND k <= upto").select(F.col("__ts").alias("__ls"), F.col("__part").alias("__lp"), (F.col("k") - F.col("upto") + F.col("c")).alias("r"))
    inside = ties.join(at, F.col("__ts").eqNullSafe(F.col("__ls")) & (F.col("__part") == F.col("__lp"))).withColumn("i", F.row_number().over(W.partitionBy("__ls").orderBy("__row")))
    return staged(inside.filter("i = r").select("__ls", F.col("__row").alias(out)))


_SIZE = "(case when d.text is null then 0 else len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')) end)"


def sql(table: str = "documents") -> str:
    """DuckDB SQL for mixed() with the default weight and weights."""
    signs = SIGNS.replace("'", "''")
    return f"""
with sized as (
  select doc_id, source, cast({_SIZE} as bigint) as size,
    -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5) / 4503599627370496.0)
      / greatest(0.1, 1.0 - 5.0 * ((length(coalesce(d.text, '')) - length(translate(coalesce(d.text, ''), '{signs}', ''))) / greatest(length(coalesce(d.text, '')), 1)::double)) as key
  from {table} d),
sums as (select source, sum(size) as source_size from sized group by source),
w as (select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int]::double as weight from sums),
r as (select *, source_size * 3.0::double as lim, source_size * 3.0::double / weight as ratio from w),
p as (select *, sum(source_size) over () as total, sum(weight) over () as wsum,
    coalesce(sum(lim) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as full_,
    coalesce(sum(weight) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as wfull from r),
l as (select *, (total::double - full_) / (wsum - wfull) as level from p),
lv as (select arg_min(level, ratio) as lev from l where level <= ratio),
t as (select source, source_size, case when lev is null then lim else least(lim, lev * weight) end as target from l, lv),
e as (select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as epochs from t),
c as (select s.doc_id, s.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows unbounded preceding) as upto
  from sized s join e on s.source is not distinct from e.source)
select doc_id, size, source_size::bigint as source_size, target,
  (size * (epochs + case when epochs < 3 and (upto <= rest or (upto - size < rest and upto - rest < rest - (upto - size))) then 1 else 0 end))::bigint as taken
from c"""
