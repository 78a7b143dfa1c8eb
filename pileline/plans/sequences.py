"""Queries of the ordered-sequence operators and codecs over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import codec, seq
from .synth import table



def ev(spark: SparkSession, d: str) -> DataFrame:
    """(idx, v, k, x): the events in order of event_id; v whole, x the value, k the type."""
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), F.floor("value").cast("long").alias("v"), F.col("event_type").alias("k"), F.col("value").alias("x"))


_EV = "with e as (select event_id as idx, floor(value)::bigint as v, event_type as k, value as x from events)"
_RUN = _EV + ", h as (select *, case when k is distinct from lag(k) over (order by idx) or row_number() over (order by idx) = 1 then 1 else 0 end as head from e), r as (select *, sum(head) over (order by idx rows unbounded preceding)::bigint as run from h)"

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(_EV + " select idx, sum(v) over (order by idx rows unbounded preceding)::bigint as s from e")
def inclusive_scan(spark, d):
    return seq.scan(ev(spark, d), "idx", F.col("v"), "s").select("idx", "s")


@query(_EV + " select idx, 7 + coalesce(sum(v) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as s, coalesce(max(v) over (order by idx rows between unbounded preceding and 1 preceding), -1) as m from e")
def exclusive_scan(spark, d):
    rows = seq.scan(ev(spark, d), "idx", F.col("v"), "s", exclusive=True, init=7)
    return seq.scan(rows, "idx", F.col("v"), "m", "max", exclusive=True).select("idx", "s", F.coalesce("m", F.lit(-1)).alias("m"))


@query(_RUN + " select idx, sum(v) over (partition by run order by idx rows unbounded preceding)::bigint as s, min(v) over (partition by run order by idx rows unbounded preceding) as m from r")
def inclusive_scan_by_key(spark, d):
    return seq.scans_by_key(ev(spark, d), "idx", F.col("k"), [(F.col("v"), "s", "sum"), (F.col("v"), "m", "min")]).select("idx", "s", "m")


@query(_RUN + " select idx, 5 + coalesce(sum(v) over (partition by run order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as s from r")
def exclusive_scan_by_key(spark, d):
    return seq.scan_by_key(ev(spark, d), "idx", F.col("k"), F.col("v"), "s", exclusive=True, init=5).select("idx", "s")


@query(_EV + " select idx, sum(v * v % 1000) over (order by idx rows unbounded preceding)::bigint as s from e")
def transform_scan(spark, d):
    return seq.scan(ev(spark, d), "idx", F.col("v") * F.col("v") % 1000, "s").select("idx", "s")


def _affine(a, b):
    """x -> m x + c after another such map: no commutative operator."""
    return F.struct((a["m"] * b["m"]).alias("m"), (b["m"] * a["c"] + b["c"]).alias("c"))


def _later(a, b):
    return F.coalesce(b, a)


_MAPS = ", m as (select *, case when v % 3 = 0 then -1 else 1 end as s, v % 7 as c from {t})"
_SIGNS = "case when sum(case when s < 0 then 1 else 0 end) over ({w}) % 2 = 0 then 1 else -1 end"
_HELD = "case when v % 5 = 0 then v end"


def _maps_sql(source: str, part: str) -> str:
    """Signs are their own inverses, so the composed map has closed sums."""
    w, p = f"{part} order by idx rows unbounded preceding", f"{part} order by idx rows between unbounded preceding and 1 preceding"
    signs = f", g as (select *, ({_SIGNS.format(w=w)})::bigint as upto from m), t as (select *, sum(c * upto) over ({w}) * upto as total from g)"
    last = f"last_value({_HELD} ignore nulls) over ({{w}})"
    before = f"coalesce(lag(upto) over ({part} order by idx), 0) as m_before, coalesce((lag(total) over ({part} order by idx))::bigint, 0) as c_before"
    out = f"select idx, upto as m, total::bigint as c, {before}, coalesce({last.format(w=w)}, -1) as held, coalesce({last.format(w=p)}, -1) as held_before"
    return source + _MAPS.format(t="r" if part else "e") + signs + " " + out + " from t"


def _map_of():
    return F.struct(F.when(F.col("v") % 3 == 0, -1).otherwise(1).cast("long").alias("m"), (F.col("v") % 7).alias("c"))


def _folded(rows, scan):
    rows = scan(scan(rows, _map_of(), "own", _affine, False), _map_of(), "before", _affine, True)
    held = F.when(F.col("v") % 5 == 0, F.col("v"))
    rows = scan(scan(rows, held, "held", _later, False), held, "held_before", _later, True)
    known = [F.coalesce(F.col(c), F.lit(x).cast("long")).alias(n) for c, x, n in (("before.m", 0, "m_before"), ("before.c", 0, "c_before"), ("held", -1, "held"), ("held_before", -1, "held_before"))]
    return rows.select("idx", "own.m", "own.c", *known)


@query(_maps_sql(_EV, ""))
def fold_any(spark, d):
    """Scans of operators that FOLDS doesn't have: affine maps, and the last value that is not null."""
    return _folded(ev(spark, d), lambda rows, value, out, op, exclusive: seq.fold(rows, "idx", value, out, op, exclusive))


@query(_maps_sql(_RUN, "partition by run"))
def fold_any_by_key(spark, d):
    return _folded(ev(spark, d), lambda rows, value, out, op, exclusive: seq.fold_by_key(rows, "idx", F.col("k"), value, out, op, exclusive))


@query(_EV + " select idx, coalesce(v - lag(v) over (order by idx), v) as diff from e")
def adjacent_difference(spark, d):
    return seq.adjacent_difference(ev(spark, d), "idx", F.col("v"), "diff").select("idx", "diff")


@query(_EV + " select sum(v)::bigint as total, min(v) as least, max(v) as greatest, bit_xor(v) as bits, count(*) as n from e")
def reduce(spark, d):
    return ev(spark, d).agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.bit_xor("v").alias("bits"), F.count(F.lit(1)).alias("n"))


@query(_RUN + " select run, k as key, min(idx) as first_idx, sum(v)::bigint as total, max(v) as greatest from r group by run, k")
def reduce_by_key(spark, d):
    return seq.reduce_by_key(ev(spark, d), "idx", F.col("k"), F.sum("v").alias("total"), F.max("v").alias("greatest"))


@query("select o_orderstatus, sum(round(o_totalprice * 100)::bigint % 97)::bigint as s from orders group by o_orderstatus")
def transform_reduce(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long") % 97).alias("s"))


@query(_EV + " select count(*) filter (v % 3 = 0) as n, count(*) filter (k = 'click') as clicks from e")
def count_if(spark, d):
    return ev(spark, d).agg(F.count_if(F.col("v") % 3 == 0).alias("n"), F.count_if(F.col("k") == "click").alias("clicks"))


@query(_EV + " select (select idx from e order by v, idx limit 1) as min_idx, (select idx from e order by v desc, idx limit 1) as max_idx")
def minmax_element(spark, d):
    return seq.minmax_element(ev(spark, d), "idx", "v")


_CU = ", c as (select c_custkey as idx, round(c_acctbal)::bigint as w from customer)"


def cu(spark, d):
    """A second sequence: (idx, w) of the customers."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.round("c_acctbal").cast("long").alias("w"))


@query(_EV + _CU + " select 11 + sum(v * w)::bigint as s, count(*) as n from e join c using (idx)")
def inner_product(spark, d):
    return seq.inner_product(ev(spark, d), cu(spark, d), "idx", "v", "w", 11)


@query(_EV + _CU + ' select idx, v as "left", w as "right" from e join c using (idx)')
def zip_sequences(spark, d):
    return seq.zipped(ev(spark, d), cu(spark, d), "idx", "v", "w")


@query(_EV + " select count(*) as n, sum(v)::bigint as total from e")
def for_each(spark, d):
    """Counts and sums by accumulators."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def action(row):
        n.add(1)
        total.add(row.v)

    seq.for_each(ev(spark, d).select("v"), action)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


@query(_EV + " select k, bool_and(v >= 0) as all_of, bool_or(v > 150) as any_of, not bool_or(v > 190) as none_of from e group by k")
def all_any_none(spark, d):
    return ev(spark, d).groupBy("k").agg(F.every(F.col("v") >= 0).alias("all_of"), F.some(F.col("v") > 150).alias("any_of"), (~F.some(F.col("v") > 190)).alias("none_of"))


@query(_EV + " select row_number() over (order by v, idx) as rank, idx, v from e")
def sort(spark, d):
    return seq.ranked(ev(spark, d).select("idx", "v"), "v", "idx")


@query(_EV + " select row_number() over (order by k, idx) as place, k, idx, v from e")
def stable_sort_by_key(spark, d):
    return seq.stable_sort_by_key(ev(spark, d).select("k", "idx", "v"), "idx", "k")


@query("select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') as keys from orders group by o_custkey")
def segmented_sort(spark, d):
    """Many short arrays, each sorted by itself."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a")).select("o_custkey", F.array_join(F.col("a").cast("array<string>"), ",").alias("keys"))


@query(_EV + ", l as (select *, lag(v) over (order by idx) as p from e) select min(idx) filter (v < p) as until, min(idx) filter (v < p) is null as is_sorted from l")
def is_sorted_until(spark, d):
    return seq.sorted_until(ev(spark, d), "idx", F.col("v"))


@query(_EV + " select (select max(idx) from e) - idx as idx, v from e")
def reverse(spark, d):
    rows = ev(spark, d)
    last = rows.agg(F.max("idx").alias("last"))
    return rows.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("idx")).alias("idx"), "v")  # the last place is one row


@query(_EV + " select idx, v, (row_number() over (order by (v % 2 <> 0), idx) - 1)::bigint as place from e")
def partition(spark, d):
    return seq.stable_partition(ev(spark, d), "idx", F.col("v") % 2 == 0).select("idx", "v", "place")


@query(_EV + " select min(idx) filter (not idx < 321) as point, coalesce(max(idx) filter (idx < 321) < min(idx) filter (not idx < 321), true) as is_partitioned from e")
def partition_point(spark, d):
    return seq.partition_point(ev(spark, d), "idx", F.col("idx") < 321)


@query(_RUN + " select idx, k from r where head = 1")
def unique(spark, d):
    return seq.unique(ev(spark, d), "idx", F.col("k")).select("idx", "k")


@query(_RUN + " select idx, k, v from r where head = 1")
def unique_by_key(spark, d):
    return seq.unique(ev(spark, d), "idx", F.col("k")).select("idx", "k", "v")


@query(_EV + " select min(idx) filter (v > 180) as found, min(idx) filter (not v < 150) as found_not from e")
def find_if(spark, d):
    return ev(spark, d).agg(F.min(F.when(F.col("v") > 180, F.col("idx"))).alias("found"), F.min(F.when(~(F.col("v") < 150), F.col("idx"))).alias("found_not"))


def _bounds(spark, d):
    return seq.bounds(ev(spark, d), "v", table(spark, d, "part").select(F.floor("p_retailprice").cast("long").alias("probe")), "probe")


_BOUNDS = _EV + ", p as (select distinct floor(p_retailprice)::bigint as probe from part), c as (select v, count(*) as n from e group by v), b as (select probe, coalesce(sum(n) filter (v < probe), 0)::bigint as lower, coalesce(sum(n) filter (v <= probe), 0)::bigint as upper from p left join c on c.v <= p.probe group by probe)"


@query(_BOUNDS + " select probe, lower from b")
def lower_bound(spark, d):
    return _bounds(spark, d).select("probe", "lower")


@query(_BOUNDS + " select probe, upper from b")
def upper_bound(spark, d):
    return _bounds(spark, d).select("probe", "upper")


@query(_BOUNDS + " select probe, upper > lower as found from b")
def binary_search(spark, d):
    return _bounds(spark, d).select("probe", "found")


@query(_BOUNDS + " select * from b")
def equal_range(spark, d):
    return _bounds(spark, d).select("probe", "lower", "upper")


@query(_EV + " select min(idx) filter (idx >= 500 and v <> v // 2) as first, min(idx) filter (idx >= 500 and v <> v // 2) is null as equal from e")
def mismatch(spark, d):
    a = ev(spark, d)
    return seq.mismatch(a, a.withColumn("v", F.when(F.col("idx") >= 500, F.expr("(v) div 2")).otherwise(F.col("v"))), "idx", "v")


@query(_EV + " select name, bool_and(v = w) as equal from (select 'same' as name, v, v as w from e union all select 'one differs', v, case when idx = 700 then v + 1 else v end from e) group by name")
def equal(spark, d):
    a = ev(spark, d)
    others = {"same": a.select("*"), "one differs": a.withColumn("v", F.col("v") + (F.col("idx") == 700).cast("int"))}
    found = [seq.mismatch(a, b, "idx", "v").select(F.lit(name).alias("name"), "equal") for name, b in others.items()]
    return found[0].unionAll(found[1])


_N = "(select count(*) from events)"


@query(_EV + f" select m.idx, e.v from (select idx, (idx * 7 + 3) % {_N} as at from e) m join e on e.idx = m.at")
def gather(spark, d):
    rows = ev(spark, d)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    index = rows.select("idx").crossJoin(F.broadcast(n)).select(F.col("idx").alias("to"), ((F.col("idx") * 7 + 3) % F.col("n")).alias("at"))  # the count is one row
    return seq.gather(index, "at", rows.select("idx", "v"), "idx").select(F.col("to").alias("idx"), "v")


@query(_EV + f" select m.idx, e.v from (select idx, (idx * 7 + 3) % {_N} as at from e where k = 'click') m join e on e.idx = m.at")
def gather_if(spark, d):
    rows = ev(spark, d)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    index = rows.filter("k = 'click'").select("idx").crossJoin(F.broadcast(n)).select(F.col("idx").alias("to"), ((F.col("idx") * 7 + 3) % F.col("n")).alias("at"))
    return seq.gather(index, "at", rows.select("idx", "v"), "idx").select(F.col("to").alias("idx"), "v")


@query(_EV + " select e.idx, coalesce(u.v, e.v) as v from e left join (select idx * 2 as at, v from e) u on u.at = e.idx")
def scatter(spark, d):
    rows = ev(spark, d).select("idx", "v")
    return seq.scatter(rows, "idx", "v", rows.select((F.col("idx") * 2).alias("at"), F.col("v").alias("new")), "at", "new").select("idx", "v")


@query(_EV + " select e.idx, coalesce(u.v, e.v) as v from e left join (select idx * 2 as at, v from e where v % 2 = 0) u on u.at = e.idx")
def scatter_if(spark, d):
    rows = ev(spark, d).select("idx", "v")
    return seq.scatter(rows, "idx", "v", rows.filter("v % 2 = 0").select((F.col("idx") * 2).alias("at"), F.col("v").alias("new")), "at", "new").select("idx", "v")


@query(_EV + " select idx, v from e where v > 100")
def copy_if(spark, d):
    return ev(spark, d).filter("v > 100").select("idx", "v")


@query(_EV + " select e.idx, e.v from e join (select event_id from events where user_id % 2 = 0) s on s.event_id = e.idx")
def copy_if_stencil(spark, d):
    stencil = table(spark, d, "events").filter("user_id % 2 = 0").select(F.col("event_id").alias("idx"))
    return ev(spark, d).join(stencil, "idx", "left_semi").select("idx", "v")


@query(_EV + " select idx, v from e where not v > 100")
def remove_if(spark, d):
    return ev(spark, d).filter("NOT v > 100").select("idx", "v")


@query(_EV + " select idx, case when v > 100 then -1 else v end as v, case when k = 'click' then 'tap' else k end as k from e")
def replace_if(spark, d):
    return ev(spark, d).select("idx", F.when(F.col("v") > 100, F.lit(-1).cast("long")).otherwise(F.col("v")).alias("v"), F.when(F.col("k") == "click", "tap").otherwise(F.col("k")).alias("k"))


@query(_EV + " select idx, v * 2 + 1 as a, idx - v as b, greatest(idx, v) as c, least(idx, v) as d, v % 7 as m, -v as n, v // 3 as q from e")
def transform(spark, d):
    i, v = F.col("idx"), F.col("v")
    return ev(spark, d).select("idx", (v * 2 + 1).alias("a"), (i - v).alias("b"), F.greatest(i, v).alias("c"), F.least(i, v).alias("d"), (v % 7).alias("m"), (-v).alias("n"), F.expr("v div 3").alias("q"))


@query(_EV + " select idx, case when v % 2 = 0 then v // 2 else v end as v from e")
def transform_if(spark, d):
    return ev(spark, d).select("idx", F.when(F.col("v") % 2 == 0, F.expr("(v) div 2")).otherwise(F.col("v")).alias("v"))


@query("select unnest(range(10, 3010, 3))::bigint as value")
def sequence(spark, d):
    return spark.range(10, 3010, 3).withColumnRenamed("id", "value")


@query("select unnest(range(1000))::bigint as idx, 42 as v, 'x' as s")
def fill(spark, d):
    return spark.range(1000).select(F.col("id").alias("idx"), F.lit(42).alias("v"), F.lit("x").alias("s"))


@query("select i::bigint as idx, (i * i + 1)::bigint as v from (select unnest(range(1000)) as i)")
def generate(spark, d):
    return spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") * F.col("id") + 1).alias("v"))


@query(_EV + _CU + """, b as (select idx, case when idx between 20 and 79 then true else false end as inside, v, w from e join c using (idx))
    select 'events' as side, e.idx, case when b.inside then b.w else e.v end as v from e left join b using (idx)
    union all select 'customers', c.idx, case when b.inside then b.v else c.w end from c left join b using (idx)""")
def swap_ranges(spark, d):
    a, b = seq.swap_ranges(ev(spark, d).select("idx", "v"), cu(spark, d).withColumnRenamed("w", "v"), "idx", "v", 20, 80)
    return a.select(F.lit("events").alias("side"), "idx", "v").unionAll(b.select(F.lit("customers").alias("side"), "idx", "v"))


@query("select user_id from events where event_type = 'click' intersect all select user_id from events where event_type = 'view'")
def set_intersection(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").intersectAll(e.filter("event_type = 'view'").select("user_id"))


@query("select o_orderkey as key, 'o' as side from orders union all select c_custkey, 'c' from customer")
def merge(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit("o").alias("side")).unionAll(table(spark, d, "customer").select("c_custkey", F.lit("c"))).orderBy("key", "side")


@query("""with a as (select o_custkey as key, o_orderkey as id, row_number() over (order by o_custkey, o_orderkey) - 1 as idx from orders),
  b as (select c_custkey as key, c_custkey as id, row_number() over (order by c_custkey) - 1 as idx from customer),
  u as (select key, id, idx, 'o' as side, 0 as first from a union all select key, id, idx, 'c', 1 from b)
select side, key, id, row_number() over (order by key, first, idx) - 1 as place from u""")
def merge_places(spark, d):
    """Orders by customer, with ties, and customers: where each goes when both sequences are merged."""
    a = seq.ranked(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id")), "key", "id").withColumn("idx", F.col("rank") - 1)
    b = seq.ranked(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id")), "key").withColumn("idx", F.col("rank") - 1)
    left, right = seq.merged(a.drop("rank"), b.drop("rank"), "idx", "key")
    both = left.withColumn("side", F.lit("o")).unionByName(right.withColumn("side", F.lit("c")))
    return both.select("side", "key", "id", "place")


@query("""with l as (select case when l_orderkey % 3 = 0 then -1 else l_suppkey end as seg, l_partkey as v, l_orderkey as o, l_linenumber as n from lineitem)
select seg, o, n, row_number() over (partition by seg order by v, o, n) as place from l""")
def segmented_places(spark, d):
    """Segments of which one has a third of all rows."""
    seg = F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey")).alias("seg")
    rows = table(spark, d, "lineitem").select(seg, F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return seq.segmented_places(rows, "seg", "v", "o", "n").select("seg", "o", "n", "place")


@query(_EV + " select idx, idx & v as a, idx | v as o, xor(idx, v) as x, bit_count(idx)::int as n, (idx >> 2) & 1 as bit, idx << 3 as l from e")
def bit_functors(spark, d):
    i, v = F.col("idx"), F.col("v")
    return ev(spark, d).select("idx", i.bitwiseAND(v).alias("a"), i.bitwiseOR(v).alias("o"), i.bitwiseXOR(v).alias("x"), F.bit_count(i).alias("n"), F.shiftright(i, 2).bitwiseAND(1).alias("bit"), F.shiftleft(i, 3).alias("l"))


_RLE = _RUN + ", runs as (select run, k as value, min(idx) as start, count(*) as run_length from r group by run, k)"


@query(_RLE + " select start, run_length, value from runs")
def rle_encode(spark, d):
    return codec.rle_encode(ev(spark, d), "idx", "k")


@query(_EV + " select idx, k as value from e")
def rle_decode(spark, d):
    return codec.rle_decode(codec.rle_encode(ev(spark, d), "idx", "k"))


_DICT = _EV + ", dict as (select k as value, (row_number() over (order by k) - 1)::bigint as code from (select distinct k from e)), coded as (select idx, code from e join dict on e.k = dict.value)"


def _coded(spark, d):
    rows = ev(spark, d)
    words = codec.dictionary(rows, "k")
    return rows.join(words, F.col("k") == F.col("value")).select("idx", "code"), words


@query(_DICT + ", w as (select idx // 8 as word, idx % 8 as k, code, max(idx % 8) over (partition by idx // 8) + 1 as n from coded) select word, n, sum(code << ((n - 1 - k) * 4)::int)::bigint as packed from w group by word, n")
def dict_encode(spark, d):
    return codec.pack(_coded(spark, d)[0], "idx", "code", 4)


@query(_EV + " select idx, k as value from e")
def dict_decode(spark, d):
    rows, words = _coded(spark, d)
    return codec.unpack(codec.pack(rows, "idx", "code", 4), 4).join(words, "code").select("idx", "value")


@query(_DICT + " select value, code from dict")
def dict_build(spark, d):
    return _coded(spark, d)[1]


_RD = _RLE + ", ord as (select *, (row_number() over (order by start) - 1)::bigint as n from runs), dv as (select value, (row_number() over (order by value) - 1)::bigint as vc from (select distinct value from runs)), dl as (select run_length, (row_number() over (order by run_length) - 1)::bigint as lc from (select distinct run_length from runs))"


@query(_RD + " select start, vc, lc from ord join dv using (value) join dl using (run_length)")
def rle_dict_encode(spark, d):
    """Runs, with a dictionary for their values and one for their lengths."""
    runs = codec.rle_encode(ev(spark, d), "idx", "k")
    values, lengths = codec.dictionary(runs, "value").withColumnRenamed("code", "vc"), codec.dictionary(runs, "run_length").select(F.col("value").alias("run_length"), F.col("code").alias("lc"))
    return runs.join(values, "value").join(lengths, "run_length").select("start", "vc", "lc")


_BASES = "with b as (select event_id as idx, substr('ACGT', ((event_id * event_id + event_id // 3) % 4)::int + 1, 1) as base, ((event_id * event_id + event_id // 3) % 4)::bigint as code from events)"


def _bases(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), codec.bit2base(F.expr("(event_id * event_id + (event_id) div 3) % 4")).alias("base"))


@query(_BASES + ", w as (select idx // 16 as word, idx % 16 as k, code, max(idx % 16) over (partition by idx // 16) + 1 as n from b) select word, n, sum(code << ((n - 1 - k) * 2)::int)::bigint as packed from w group by word, n")
def pack2bit(spark, d):
    return codec.pack(_bases(spark, d).withColumn("code", codec.base2bit(F.col("base"))), "idx", "code", 2)


@query(_BASES + " select idx, base from b")
def unpack2bit(spark, d):
    words = codec.pack(_bases(spark, d).withColumn("code", codec.base2bit(F.col("base"))), "idx", "code", 2)
    return codec.unpack(words, 2).select("idx", codec.bit2base(F.col("code")).alias("base"))
