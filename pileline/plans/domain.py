"""Queries of the calling pipeline and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases as B
from ..operators import calibrate, pileup, posterior, tiles
from . import synth
from .synth import PARAMS

# ---- Spark ---------------------------------------------------------------------------------------------------------


def placed_reads(spark: SparkSession, d: str) -> DataFrame:
    return pileup.in_bounds(pileup.normalise(synth.reads(spark, d)), synth.contigs(spark, d))


def base_rows(spark: SparkSession, d: str) -> DataFrame:
    return pileup.bases(placed_reads(spark, d), PARAMS)


def packed_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.staged_tiles(placed_reads(spark, d), synth.genome(spark, d), synth.dbsnp(spark, d))


def piled(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of the reads alone, for the steps that look at no reference."""
    reads = placed_reads(spark, d)
    return tiles.staged_tiles(reads, tiles.covered_blocks(reads))


def reference(spark: SparkSession, d: str) -> DataFrame:
    """Every place with its known site: blocks and known sites meet by block, before the blocks are cut into places."""
    return tiles.reference_rows(tiles.staged_tiles(tiles.no_reads(spark), synth.genome(spark, d), synth.dbsnp(spark, d)))


def calibration_counts(spark: SparkSession, d: str) -> DataFrame:
    return tiles.calibration_counts(packed_tiles(spark, d), PARAMS)


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.log_matrix(calibrate.matrix(spark, calibration_counts(spark, d), PARAMS))


def sites(spark: SparkSession, d: str, params=PARAMS, matrix: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Counts and likelihoods of every place: both passes read the same staged tiles. ``matrix`` makes the calibration matrix
    out of the tiles."""
    packed = packed_tiles(spark, d)
    made = calibration_matrix(packed) if matrix is None else matrix(packed)
    return tiles.site_rows(packed, tiles.log_cube(calibrate.log_matrix(made)), params)


def calibration_matrix(packed: DataFrame) -> DataFrame:
    return calibrate.matrix(packed.sparkSession, tiles.calibration_counts(packed, PARAMS), PARAMS)


def calls(spark: SparkSession, d: str, matrix: Callable[[DataFrame], DataFrame] | None = None, **modes) -> DataFrame:
    params = replace(PARAMS, **modes)
    return posterior.called(sites(spark, d, params, matrix), params)


SITE = ["chr", "pos"]
COUNTS = [f"{c}{k}" for k in range(4) for c in ("uni", "qs", "all")]


def reads_synth(spark, d):
    return synth.reads(spark, d).select("read_idx", "chr", "pos", "seq", "qual", "hit", "strand", "read_len")


def reads_bounds_filter(spark, d):
    short = synth.contigs(spark, d).withColumn("length", F.col("length") - 110)
    kept = pileup.in_bounds(pileup.normalise(synth.reads(spark, d)), short)
    return kept.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


def read_explode_bases(spark, d):
    return base_rows(spark, d).select("read_idx", "chr", "pos", "coord", "cycle", "base", "q")


def site_pileup(spark, d):
    return tiles.site_counts(piled(spark, d), PARAMS).select(*SITE, "depth", "repeat_time", "dep_uni", *COUNTS)


def depth_cap(spark, d):
    rows = tiles.site_counts(piled(spark, d), replace(PARAMS, depth_cap=20))
    return rows.select(*SITE, F.expr("all0 + all1 + all2 + all3").alias("accepted"), F.col("dep_uni").alias("unique"), "depth")


def pcr_rank(spark, d):
    return tiles.base_sums(piled(spark, d), PARAMS).select(*SITE, "base", "sum_t", "max_t")


def global_dep(spark, d):
    return tiles.base_sums(piled(spark, d), PARAMS).select(*SITE, "base", "sum_g", "max_g")


def quality_adjust(spark, d):
    return tiles.base_sums(piled(spark, d), PARAMS).select(*SITE, "base", "sum_q", "sum_q_adj")


def best_bases(spark, d):
    return calls(spark, d).select(*SITE, "base1", "base2", "qual1", "qual2", "qual3")


def type_likelihood(spark, d):
    return sites(spark, d).filter("depth > 0").select(*SITE, *[F.round(F.col("lik")[k], 6).alias(f"lik{g}") for k, g in enumerate(B.GENOTYPES)])


def genotype_top2(spark, d):
    return calls(spark, d).select(*SITE, "type1", "type2", F.round("lp1", 6).alias("lp1"), F.round("lp2", 6).alias("lp2"))


def consensus_quality(spark, d):
    return calls(spark, d).select(*SITE, "quality")


def consensus_rows(spark, d):
    return posterior.consensus(calls(spark, d))


def consensus_refined(spark, d):
    rows = posterior.consensus(calls(spark, d, refine=True, rank_sum=True))
    return rows.withColumn("rank_p", F.round("rank_p", 6))


def n_mask(spark, d):
    return calls(spark, d).select(*SITE, "nflag").filter("nflag")


def monoploid_call(spark, d):
    return posterior.consensus(calls(spark, d, monoploid=True)).select(*SITE, "genotype", "quality")


def calib_counts(spark, d):
    return calibration_counts(spark, d)


def calib_rollups(spark, d):
    return calibrate.rollups(calibration_counts(spark, d)).na.fill(-1)  # -1: all


def calib_matrix(spark, d):
    return calibrate.matrix(spark, calibration_counts(spark, d), PARAMS).withColumn("p", F.round("p", 9))


def log_matrix(spark, d):
    return log_rows(spark, d).select("q", "cycle", "o_base", *[F.round(F.col("lp")[k], 9).alias(f"lp{g}") for k, g in enumerate(B.GENOTYPES)])


def prior_table(spark, d):
    return posterior.prior_table(spark, PARAMS)


def prior_transition(spark, d):
    return posterior.prior_table(spark, replace(PARAMS, transition_dominant=True))


def dbsnp_join(spark, d):
    return reference(spark, d).select(*SITE, "ref_code", F.col("hapmap").isNotNull().alias("known"), F.coalesce("validated", F.lit(-1)).alias("validated"))


def dbsnp_prior(spark, d):
    rows = reference(spark, d).filter("known").withColumn("prior", posterior.refined_prior(posterior.prior_column(PARAMS), PARAMS))
    return rows.select(*SITE, *[F.round(F.col("prior")[k], 9).alias(f"p{g}") for k, g in enumerate(B.GENOTYPES)])


def mid_rank(spark, d):
    rows = tiles.quality_counts(piled(spark, d), PARAMS)
    return rows.select(*SITE, "q", "n", (F.col("below") + (1 + F.col("n")) / 2.0).alias("mid"))


def rank_table(spark, d):
    return posterior.rank_table_frame(spark).withColumn("p", F.round("p", 9))


def rank_sum_test(spark, d):
    rows = calls(spark, d, rank_sum=True).filter("shiftright(type1, 2) <> type1 & 3")
    return rows.select(*SITE, "type1", F.round("rank_p", 6).alias("rank_p"))


def normal_tail(spark, d):
    z = (F.col("value") - 100) / 20.0
    return synth.table(spark, d, "events").select("event_id", F.round(B.normal_tail(z), 9).alias("p"))


def region_semi_join(spark, d):
    regions = synth.contigs(spark, d).select("chr", F.explode(F.expr("sequence(10L, length, 500L)")).alias("start")).withColumn("end", F.col("start") + 60)
    return pileup.in_regions(pileup.ref_sites(synth.genome(spark, d)), regions, 36).select(*SITE)


def snp_only(spark, d):
    return posterior.snps(posterior.consensus(calls(spark, d))).select(*SITE, "ref", "genotype", "quality")


def indel_normalise(spark, d):
    rows = synth.reads(spark, d).withColumn("indel_pos", (F.col("read_idx") % 30).cast("int")).withColumn("mismatch", F.when(F.col("read_idx") % 4 == 0, 203).when(F.col("read_idx") % 4 == 1, 102).otherwise(0))
    return pileup.normalise(rows).select("read_idx", "pos", "seq", "qual", "read_len")


def genome_blocks(spark, d):
    return synth.genome(spark, d)


def base_codes(spark, d):
    rows = pileup.ref_sites(synth.genome(spark, d)).groupBy("chr", "ref_code").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("chr", "ref_code", B.shown(F.col("ref_code")).alias("letter"), "n")


def word_encode_decode(spark, d):
    rows = base_rows(spark, d).select("read_idx", "coord", B.pack_word(F.col("base"), F.col("q"), F.col("cycle"), F.col("strand"), F.lit(1)).alias("word"))
    return rows.select("read_idx", "coord", "word", *[c.cast("long").alias(k) for k, c in B.unpack_word(F.col("word")).items()])


def order_check(spark, d):
    mixed = synth.reads(spark, d).withColumn("pos", F.when(F.col("read_idx") % 101 == 0, 1).otherwise(F.col("pos")))
    return pileup.check_order(mixed).select("read_idx", "chr", "pos")


def coverage_rollup(spark, d):
    return tiles.site_counts(piled(spark, d), PARAMS).groupBy("chr", F.expr("(pos) div 1000").alias("block")).agg(F.max("depth").alias("max_depth"), F.sum("depth").alias("sum_depth"), F.count(F.lit(1)).alias("sites"))


NAMES = """reads_synth reads_bounds_filter read_explode_bases site_pileup depth_cap pcr_rank global_dep quality_adjust best_bases type_likelihood genotype_top2 consensus_quality
consensus_rows consensus_refined n_mask monoploid_call calib_counts calib_rollups calib_matrix log_matrix prior_table prior_transition dbsnp_join dbsnp_prior mid_rank rank_table
rank_sum_test normal_tail region_semi_join snp_only indel_normalise genome_blocks base_codes word_encode_decode order_check coverage_rollup""".split()
QUERIES = {n: globals()[n] for n in NAMES}

# ---- SQL -----------------------------------------------------------------------------------------------------------

_REF = "(((pos * pos * 7 + pos * 13 + cast(chr as bigint) * 5) // 11) % 4)"
_G = B.GENOTYPES
_LIK = ", ".join(f"round(coalesce(sum(lp{g}), 0.0), 9) as lik{g}" for g in _G)
_UNI = ", ".join(f"count(*) filter (uniq and base = {k}) as uni{k}, coalesce(sum(q) filter (uniq and base = {k}), 0)::bigint as qs{k}, count(*) filter (accepted and base = {k}) as all{k}" for k in range(4))


def _prior_sql(g: int, extra: str = "") -> str:
    a, b = g >> 2, g & 3
    plain = "0.0625::double" if a == b else "0.002::double * 0.25 * 0.25"
    own = f"case when (case when ref_code = {a} then 1 else 0 end) + (case when ref_code = {b} then 1 else 0 end) = 2 then 1.0 when ref_code = {a} or ref_code = {b} then 0.001 " + ("else 0.0005" if a == b else "else 0.001::double * 0.0005") + " end"
    return f"(case when ref_code >= 4 then {plain} else ({own})::double{extra} end)"


def _refined_sql(g: int) -> str:
    a, b = g >> 2, g & 3
    het = "case when validated = 1 then 0.1 else 0.02 end"
    tagged = f"case when (ref_code & 3) = {a} then 1.0 when validated = 1 then 0.05 else 0.01 end" if a == b else het
    return f"(case when hapmap is not null and indel = 0 and f{a} > 0 and f{b} > 0 then (case when hapmap = 1 then {'1.0' if a == b else '0.2'}::double * f{a} * f{b} else ({tagged})::double end) else {_prior_sql(g)} end)"


def _ranked(c: str) -> str:
    return "list_sort([" + ", ".join(f"{{'v': {c}{k}::bigint, 'b': {k}}}" for k in range(4)) + "], 'DESC')"


def _top(prior, only=None) -> str:
    return "list_sort([" + ", ".join(f"{{'lp': lik{g} + log10({prior(g)}), 'g': {g}}}" for g in _G if only is None or g in only) + "], 'DESC')"


_POST = """{name} as (select *, top[1].lp as lp1, top[1].g as type1, top[2].lp as lp2, top[2].g as type2 from (select *, {top} as top from best))"""
_QUAL = """{name}q as (select *, greatest(0, least(99, case when (type1 >> 2) = (type1 & 3) then
      (case when qual1 > 0 and base1 <> (type1 & 3) then 0 else least(raw, qual1 - qual2) end)
    when base1 < 4 and base2 < 4 and [qs0, qs1, qs2, qs3][base1 + 1] > 0 and [qs0, qs1, qs2, qs3][base2 + 1] > 0 and least(base1, base2) = (type1 >> 2) and greatest(base1, base2) = (type1 & 3)
      then least(raw, qual2 - qual3) else 0 end))::int as quality
  from (select *, case when rank_p = 0 then 0 else trunc((lp1 - lp2) * 10 + log10(rank_p) * 10 + 1e-9)::bigint end as raw from {source}))"""
_MONO = [g for g in _G if g >> 2 == g & 3]

CTE = {
    "reads": "reads as (select event_id as read_idx, cast(event_id % 5 as varchar) as chr, event_id // 5 as start, case when event_id % 11 = 0 then 2 else 1 end as hit, (event_id % 3) % 2 as strand from events)",
    "bases": f"""ex as (select r.*, coord, start + coord as pos from reads r, (select unnest(range(0, 36)) as coord)),
bases as (select read_idx, chr, pos, start, coord, hit, strand, case when strand = 0 then coord else 35 - coord end as cycle, 10 + (read_idx * 3 + coord * 5) % 30 as q,
    case when (read_idx * 31 + coord * 17) % 23 = 0 then ({_REF} + 1 + read_idx % 3) % 4 when pos % 50 = 0 and read_idx % 2 = 0 then ({_REF} + 2) % 4 else {_REF} end as base from ex)""",
    "contigs": "contigs as (select chr, max(start) + 137 as length from reads group by chr)",
    "ref": f"places as (select chr, unnest(range(length)) as pos from contigs),\nref as (select chr, pos, (case when pos % 97 = 0 then 7 else {_REF} end)::int as ref_code from places)",
    "known": f"known as (select chr, pos, ((pos // 50) % 2)::int as hapmap, ((pos // 100) % 2)::int as validated, 0 as indel, {', '.join(f'case when {_REF} = {k} then 0.7 when ({_REF} + 2) % 4 = {k} then 0.3 else 0.0 end::double as f{k}' for k in range(4))} from places where pos % 50 = 0)",
    "acc": "acc as (select *, coalesce(sum(case when hit = 1 then 1 else 0 end) over (partition by chr, pos order by start, read_idx rows between unbounded preceding and 1 preceding), 0) < 255 as accepted, accepted and hit = 1 as uniq from bases)",
    "dep": """w2 as (select *, row_number() over (partition by chr, pos, base, strand, cycle order by q desc) as t from acc where uniq),
w3 as (select *, sum(case when t = 1 then 1 else 0 end) over (partition by chr, pos, base order by q desc, cycle, strand, t rows unbounded preceding) - 1 as g from w2),
dep as (select *, greatest(1, floor(pow(10.0::double, log10(q::double) + (t - 1) * log10(0.5::double) + g * log10(0.9::double)) + 0.5)::int) as q_adj from w3)""",
    "sites": f"sites as (select chr, pos, count(*) as depth, sum(hit)::bigint as repeat_time, count(*) filter (uniq) as dep_uni, {_UNI} from acc group by chr, pos)",
    "calib": "calib as (select q::int as q, cycle::int as cycle, ref_code as t_base, base::int as o_base, count(*) as n from bases join ref using (chr, pos) where hit = 1 and ref_code < 4 and pos % 50 <> 0 group by all)",
    "pm": """grid as (select q::int as q, cycle::int as cycle, t::int as t_base, o::int as o_base from (select unnest(range(41)) as q), (select unnest(range(36)) as cycle), (select unnest(range(4)) as t), (select unnest(range(4)) as o)),
cells as (select g.*, coalesce(c.n, 0) as n from grid g left join calib c using (q, cycle, t_base, o_base)),
sums as (select *, sum(n) over (partition by q, cycle, t_base) as n_qct, sum(n) over (partition by q, t_base, o_base) as n_qto, sum(n) over (partition by q, t_base) as n_qt, sum(n) over (partition by q) as n_q,
    sum(case when t_base <> o_base then n else 0 end) over (partition by q) as bad from cells),
parts as (select *, case when n > 10 then n when n_qto > 10 then n_qto when t_base = o_base then n_q - bad else bad end as part, case when n > 10 then n_qct when n_qto > 10 then n_qt else n_q end as whole from sums),
pm as (select q, cycle, t_base, o_base, case when whole = 0 or part = 0 or part = whole then (case when t_base = o_base then greatest(0.25::double, 1.0::double - pow(10.0::double, -(q / 10.0::double))) else least(0.25::double, pow(10.0::double, -(q / 10.0::double)) / 3.0::double) end) else part::double / whole::double end as p from parts)""",
    "lm": f"wide as (select q, cycle, o_base, {', '.join(f'max(p) filter (t_base = {t}) as p{t}' for t in range(4))} from pm group by q, cycle, o_base),\nlm as (select q, cycle, o_base, {', '.join(f'log10(0.5::double * p{g >> 2} + 0.5::double * p{g & 3}) as lp{g}' for g in _G)} from wide)",
    "lik": f"lik as (select d.chr, d.pos, {_LIK} from dep d join lm m on d.q_adj = m.q and d.cycle = m.cycle and d.base = m.o_base group by d.chr, d.pos)",
    "best": f"""filled as (select r.chr, r.pos, r.ref_code, {', '.join(f'coalesce({c}, 0) as {c}' for c in ['depth', 'repeat_time', 'dep_uni', *COUNTS])}, {', '.join(f'coalesce(lik{g}, 0.0) as lik{g}' for g in _G)},
    k.hapmap, k.validated, k.indel, k.f0, k.f1, k.f2, k.f3, (k.hapmap is not null)::int as is_dbsnp, r.ref_code >= 4 and coalesce(depth, 0) = 0 as nflag
  from ref r left join sites s using (chr, pos) left join lik l using (chr, pos) left join known k using (chr, pos)),
ranked as (select *, case when dep_uni > 0 then {_ranked('qs')} else {_ranked('all')} end as rk from filled),
best as (select *, case when rk[1].v = 0 then ref_code else rk[1].b end as base1, case when rk[1].v <> 0 and rk[2].v = 0 and rk[1].b <> ref_code then ref_code else rk[2].b end as base2,
    case when dep_uni > 0 then rk[1].v else -1 end as qual1, case when dep_uni > 0 then rk[2].v else -2 end as qual2, case when dep_uni > 0 then rk[3].v else -3 end as qual3 from ranked)""",
    "post": _POST.format(name="post0", top=_top(_prior_sql)) + ",\npost as (select *, 1.0::double as rank_p from post0)",
    "call": _QUAL.format(name="call", source="post"),
    "mono": _POST.format(name="mono0", top=_top(_prior_sql, _MONO)) + ",\nmono as (select *, 1.0::double as rank_p from mono0),\n" + _QUAL.format(name="mono", source="mono"),
    "table": """fact(i, f) as (select 0, 1.0::double union all select i + 1, f * (i + 1) from fact where i < 63),
rs(n, n1, t, c) as (select 0, 0, 0, 1::hugeint union all
  select n, n1, t, sum(c)::hugeint from (select n + 1 as n, n1, t, c from rs where n < 63 union all select n + 1, n1 + 1, t + n + 1, c from rs where n < 63) group by n, n1, t),
ps as (select n, n1, t, c::double / (a.f / (b.f * d.f)) as p from rs join fact a on a.i = n join fact b on b.i = n1 join fact d on d.i = n - n1 where n > 0),
cum as (select *, sum(p) over (partition by n, n1 order by t rows unbounded preceding) as l, coalesce(sum(p) over (partition by n, n1 order by t rows between unbounded preceding and 1 preceding), 0.0) as b from ps),
rt as (select n::int as n, n1::int as n1, t::int as t, greatest(0.0, least(l, 1.0 - b)) as p from cum)""",
}


def _tests(source: str) -> str:
    """Rank-sum tests of the calls in ``source``."""
    return f"""tested as (select chr, pos, type1, (type1 >> 2) as a, (type1 & 3) as b, [uni0, uni1, uni2, uni3][(type1 >> 2) + 1] as nb, [uni0, uni1, uni2, uni3][(type1 & 3) + 1] as na from {source} where (type1 >> 2) <> (type1 & 3)),
seen as (select d.chr, d.pos, d.base, d.q from dep d join tested t using (chr, pos) where d.base = t.a or d.base = t.b),
hist as (select chr, pos, q, count(*) as n from seen group by all),
mids as (select *, coalesce(sum(n) over (partition by chr, pos order by q rows between unbounded preceding and 1 preceding), 0) + (1 + n) / 2.0::double as r from hist),
sums_ as (select s.chr, s.pos, sum(r) filter (s.base = t.b) as ta, sum(r) filter (s.base = t.a) as tb from seen s join mids m using (chr, pos, q) join tested t using (chr, pos) group by s.chr, s.pos),
pick as (select t.*, ta, tb, na + nb as n, case when na <= nb then na else nb end as n1, case when na <= nb then ta else tb end as tt from tested t left join sums_ using (chr, pos)),
look as (select p.*, coalesce(x.p, 1.0) as p1, coalesce(y.p, 1.0) as p2 from pick p left join rt x on x.n = p.n and x.n1 = p.n1 and x.t = floor(p.tt)::int
    left join rt y on y.n = (p.n::int >> 1) and y.n1 = (p.n1::int | ((p.n::int & 1) << 5)) and y.t = floor(p.tt)::int + 1),
ranks as (select chr, pos, type1, case when na = 0 or nb = 0 then 0.0 else round(p1 + (tt - floor(tt)) * (p2 - p1), 9) end as rank_p from look)"""


def _with(need: list[str], final: str, recursive: bool = False) -> str:
    return "with " + ("recursive " if recursive else "") + ",\n".join(CTE.get(n, n) for n in need) + "\n" + final


_TO_SITES = ["reads", "bases", "contigs", "ref", "known", "acc"]
_TO_BEST = [*_TO_SITES, "dep", "sites", "calib", "pm", "lm", "lik", "best"]
_REFINE = [*_TO_BEST, _POST.format(name="ref0", top=_top(_refined_sql)), CTE["table"], _tests("ref0"), "ref1 as (select r.*, coalesce(k.rank_p, 1.0) as rank_p from ref0 r left join ranks k using (chr, pos))", _QUAL.format(name="refined", source="ref1")]


def _consensus_sql(source: str, rank: str = "rank_p") -> str:
    code = lambda b: f"substr('ACTGNNNN', {b} + 1, 1)"
    pick = lambda c, b: f"[{c}0, {c}1, {c}2, {c}3][{b} + 1]"

    def one(k: int, gone: str) -> str:
        b = f"base{k}"
        mean = f"(case when {pick('qs', b)} = 0 then 0 else {pick('qs', b)} // {pick('uni', b)} end)"
        zero = lambda x: f"(case when {gone} then 0 else {x} end)::bigint"
        return f"case when {gone} then 'N' else {code(b)} end as base{k}, {zero(mean)} as avg_q{k}, {zero(pick('uni', b))} as uni{k}, {zero(pick('all', b))} as all{k}"

    none = "(nflag or base1 >= 4)"
    return f"""select chr, pos + 1 as pos, case when {none} then 'N' else {code('ref_code')} end as ref, case when {none} then 'N' else substr('{B.IUPAC}', type1 + 1, 1) end as genotype,
  (case when {none} then 0 else quality end)::int as quality, {one(1, none)}, {one(2, f'({none} or base2 >= 4)')}, (case when {none} then 0 else depth end)::bigint as depth,
  case when {none} then 1.0 else {rank} end as rank_p, case when {none} or depth = 0 then 255.0 else round(repeat_time / depth, 9) end as copy_number, (case when {none} then 0 else is_dbsnp end)::int as is_dbsnp from {source}"""


_ACTG = lambda e: f"substr('ACTG', ({e})::int + 1, 1)"
_SEQ = "string_agg(substr('ACTG', base::int + 1, 1), '' order by coord)"
_QUALS = "string_agg(chr_(q), '' order by coord)".replace("chr_(q)", "chr((q + 64)::int)")
_LINES = f"lines as (select b.read_idx, b.chr, b.start + 1 as pos, {_SEQ} as seq, {_QUALS} as qual, b.hit, case when b.strand = 0 then '+' else '-' end as strand, 36 as read_len from bases b group by all)"
_TAIL = "(0.39894228 * exp(-z * (z / 2.0)) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.31938153) * t)"

SQL = {
    "reads_synth": _with(["reads", "bases", _LINES], "select * from lines").replace("chr((q", "chr((q"),
    "reads_bounds_filter": _with(["reads", "contigs"], "select chr, count(*) as n, max(start) as last from reads join contigs using (chr) where start + 36 < length - 110 group by chr"),
    "read_explode_bases": _with(["reads", "bases"], "select read_idx, chr, pos, coord::int as coord, cycle::int as cycle, base::int as base, q::int as q from bases"),
    "site_pileup": _with(["reads", "bases", "acc", "sites"], "select * from sites"),
    "depth_cap": _with(["reads", "bases", CTE["acc"].replace("< 255", "< 20")], "select chr, pos, count(*) filter (accepted) as accepted, count(*) filter (uniq) as unique, count(*) as depth from acc group by chr, pos"),
    "pcr_rank": _with(["reads", "bases", "acc", "dep"], "select chr, pos, base::int as base, sum(t)::bigint as sum_t, max(t)::bigint as max_t from dep group by all"),
    "global_dep": _with(["reads", "bases", "acc", "dep"], "select chr, pos, base::int as base, sum(g)::bigint as sum_g, max(g)::bigint as max_g from dep group by all"),
    "quality_adjust": _with(["reads", "bases", "acc", "dep"], "select chr, pos, base::int as base, sum(q)::bigint as sum_q, sum(q_adj)::bigint as sum_q_adj from dep group by all"),
    "best_bases": _with(_TO_BEST, "select chr, pos, base1::int as base1, base2::int as base2, qual1::bigint as qual1, qual2::bigint as qual2, qual3::bigint as qual3 from best"),
    "type_likelihood": _with(_TO_BEST[:-1], f"select chr, pos, {', '.join(f'round(coalesce(lik{g}, 0.0), 6) as lik{g}' for g in _G)} from sites left join lik using (chr, pos)"),
    "genotype_top2": _with([*_TO_BEST, "post"], "select chr, pos, type1, type2, round(lp1, 6) as lp1, round(lp2, 6) as lp2 from post"),
    "consensus_quality": _with([*_TO_BEST, "post", "call"], "select chr, pos, quality from callq"),
    "consensus_rows": _with([*_TO_BEST, "post", "call"], _consensus_sql("callq")),
    "consensus_refined": _with(_REFINE, _consensus_sql("refinedq", "round(rank_p, 6)"), True),
    "n_mask": _with(_TO_BEST, "select chr, pos, nflag from best where nflag"),
    "monoploid_call": _with([*_TO_BEST, "mono"], f"select chr, pos, genotype, quality from ({_consensus_sql('monoq')})"),
    "calib_counts": _with(["reads", "bases", "contigs", "ref", "calib"], "select * from calib"),
    "calib_rollups": _with(["reads", "bases", "contigs", "ref", "calib"], "select q, coalesce(cycle, -1) as cycle, coalesce(t_base, -1) as t_base, coalesce(o_base, -1) as o_base, sum(n)::bigint as n, sum(case when tt <> oo then n else 0 end)::bigint as mismatch from (select *, t_base as tt, o_base as oo from calib) group by grouping sets ((q, cycle, t_base), (q, t_base, o_base), (q, t_base), (q))"),
    "calib_matrix": _with(["reads", "bases", "contigs", "ref", "calib", "pm"], "select q, cycle, t_base, o_base, round(p, 9) as p from pm"),
    "log_matrix": _with(["reads", "bases", "contigs", "ref", "calib", "pm", "lm"], f"select q, cycle, o_base, {', '.join(f'round(lp{g}, 9) as lp{g}' for g in _G)} from lm"),
    "prior_table": "select ref_code, genotype, case genotype " + " ".join(f"when {g} then {_prior_sql(g)}" for g in _G) + f" end as p from (select unnest(range(8))::int as ref_code), (select unnest({_G})::int as genotype)",
    "prior_transition": "select ref_code, genotype, case genotype " + " ".join(f"when {g} then {_prior_sql(g, f' * case when xor({g >> 2}, ref_code) = 3 or xor({g & 3}, ref_code) = 3 then 4 else 1 end')}" for g in _G) + f" end as p from (select unnest(range(8))::int as ref_code), (select unnest({_G})::int as genotype)",
    "dbsnp_join": _with(["reads", "contigs", "ref", "known"], "select chr, pos, ref_code, hapmap is not null as known, coalesce(validated, -1) as validated from ref left join known using (chr, pos)"),
    "dbsnp_prior": _with(["reads", "contigs", "ref", "known"], f"select chr, pos, {', '.join(f'round({_refined_sql(g)}, 9) as p{g}' for g in _G)} from ref join known using (chr, pos)"),
    "mid_rank": _with(["reads", "bases", "acc", "h as (select chr, pos, q, count(*) as n from acc where uniq group by all)"], "select chr, pos, q::int as q, n, coalesce(sum(n) over (partition by chr, pos order by q rows between unbounded preceding and 1 preceding), 0) + (1 + n) / 2.0::double as mid from h"),
    "rank_table": _with(["table"], "select n, n1, t, round(p, 9) as p from rt", True),
    "rank_sum_test": _with([*_TO_BEST, "post", CTE["table"], _tests("post0")], "select chr, pos, type1, round(rank_p, 6) as rank_p from ranks", True),
    "normal_tail": f"with a as (select event_id, (value - 100) / 20.0::double as z from events), b as (select *, 1.0::double / (1.0 + abs(z) * 0.2316419) as t from a), c as (select *, case when z < 0 then {_TAIL} else 1.0 - {_TAIL} end as n from b) select event_id, round(case when abs(z) > 6 then 0.0 when n > 0.5 then 1.0 - n else n end, 9) as p from c",
    "region_semi_join": _with(["reads", "contigs", "ref", "regions as (select chr, unnest(range(10, length + 1, 500)) as s from contigs)"], "select chr, pos from ref r where exists (select 1 from regions g where g.chr = r.chr and r.pos >= greatest(g.s - 37, 0) and r.pos <= g.s + 59)"),
    "snp_only": _with([*_TO_BEST, "post", "call"], f"select chr, pos, ref, genotype, quality from ({_consensus_sql('callq')}) where genotype <> ref and ref <> 'N'"),
    "indel_normalise": _with(["reads", "bases", _LINES, "k as (select *, (read_idx % 30)::int as cut from lines)"], "select read_idx, pos - 1 as pos, case when read_idx % 4 = 0 then substr(seq, 1, cut) || 'NNN' || substr(seq, cut + 1) when read_idx % 4 = 1 then substr(seq, 1, cut) || substr(seq, cut + 3) else seq end as seq, case when read_idx % 4 = 0 then substr(qual, 1, cut) || 'NNN' || substr(qual, cut + 1) when read_idx % 4 = 1 then substr(qual, 1, cut) || substr(qual, cut + 3) else qual end as qual, read_len from k"),
    "genome_blocks": _with(["reads", "contigs", "ref"], "select chr, pos // 4096 as block, (pos // 4096) * 4096 as start, string_agg(substr('ACTGNNNN', ref_code + 1, 1), '' order by pos) as seq from ref group by all"),
    "base_codes": _with(["reads", "contigs", "ref"], "select chr, ref_code, substr('ACTGNNNN', ref_code + 1, 1) as letter, count(*) as n from ref group by all"),
    "word_encode_decode": _with(["reads", "bases"], "select read_idx, coord::int as coord, (base << 23) | ((64 - q) << 17) | (cycle << 9) | (strand << 8) | 1 as word, base, q, cycle, strand, 1::bigint as occurrences from bases"),
    "order_check": _with(["reads", "m as (select read_idx, chr, case when read_idx % 101 = 0 then 1 else start + 1 end as pos from reads)", "l as (select *, lag(pos) over (partition by chr order by read_idx) as before from m)"], "select read_idx, chr, pos from l where pos < before"),
    "coverage_rollup": _with(["reads", "bases", "acc", "sites"], "select chr, pos // 1000 as block, max(depth) as max_depth, sum(depth)::bigint as sum_depth, count(*) as sites from sites group by all"),
}
