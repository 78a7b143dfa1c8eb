"""Type likelihoods, priors, posteriors, rank-sum tests, consensus qualities and consensus rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import GENOTYPES, iupac, normal_tail, shown
from ..params import CallParams
from .pileup import site_counts

#: Sums of logarithms depend on their order; they are rounded to so many places before they are compared.
PLACES = 9
#: Added before a quality is cut to a whole number, which exact differences of logarithms may just miss.
NUDGE = 1e-9


def likelihoods(observed: DataFrame, lp: DataFrame, with_qualities: bool = False) -> DataFrame:
    """Of each covered site: the pileup's counts and ``lik``, the sums of lp over its unique observations.

    The log matrix has at most 64 qualities x 256 cycles x 4 bases, so it can always be broadcast."""
    m = F.broadcast(lp.select(F.col("q").alias("q_adj"), "cycle", F.col("o_base").alias("base"), "lp"))
    joined = observed.join(m, ["q_adj", "cycle", "base"], "left")
    sums = [F.round(F.coalesce(F.sum(F.when(F.col("unique"), F.col("lp")[k])), F.lit(0.0)), PLACES).alias(f"lik{k}") for k in range(10)]
    # a site has at most depth_cap unique observations, so the list is bounded
    extra = [F.collect_list(F.when(F.col("unique"), F.struct("base", "q"))).alias("seen")] if with_qualities else []
    out = joined.groupBy("chr", "pos").agg(*site_counts(sums + extra))
    return out.withColumn("lik", F.array(*[F.col(f"lik{k}") for k in range(10)])).drop(*[f"lik{k}" for k in range(10)])


def prior_rows(params: CallParams = CallParams()) -> list[tuple[int, int, float]]:
    """(ref_code, genotype, p) for the eight reference codes and ten genotypes."""
    out = []
    for ref in range(8):
        for g in GENOTYPES:
            a, b = g >> 2, g & 3
            if ref >= 4:
                p = (1 if a == b else 2 * params.het_novel) * 0.25 * 0.25
            else:
                own = (a == ref) + (b == ref)
                p = 1.0 if own == 2 else params.het_novel if own else params.althom_novel if a == b else params.het_novel * params.althom_novel
                if params.transition_dominant and 3 in (a ^ ref, b ^ ref):
                    p *= 4
            out.append((ref, g, float(p)))
    return out


def prior_table(spark: SparkSession, params: CallParams = CallParams()) -> DataFrame:
    return spark.createDataFrame(prior_rows(params), "ref_code int, genotype int, p double")


def prior_column(params: CallParams = CallParams()) -> Column:
    """The ten priors of a row's ref_code: eighty constants, no join."""
    table = prior_rows(params)
    flat = F.array(*[F.lit(p) for _, _, p in table])
    return F.slice(flat, F.col("ref_code") * len(GENOTYPES) + 1, F.lit(len(GENOTYPES)))


def refined_prior(prior: Column, params: CallParams) -> Column:
    """Priors of known sites by their entry (f0 .. f3, hapmap, validated, indel); others and indels keep theirs. One expression
    for all genotypes: ten spelled out would outgrow a compiled method."""
    validated = F.col("validated") == 1
    het, hom = F.when(validated, params.het_val).otherwise(params.het_unval), F.when(validated, params.althom_val).otherwise(params.althom_unval)
    freq, own = F.array(*[F.col(f"f{k}") for k in range(4)]), F.col("ref_code").bitwiseAND(3)

    def refined(g: Column, k: Column) -> Column:
        a, b = F.shiftright(g, 2), g.bitwiseAND(3)
        fa, fb = F.get(freq, a), F.get(freq, b)
        tagged = F.when(a != b, het).when(own == a, F.lit(1.0)).otherwise(hom)
        known = F.when(F.col("hapmap") == 1, F.when(a == b, F.lit(1.0)).otherwise(F.lit(2 * params.het_val)) * fa * fb).otherwise(tagged)
        return F.when((fa > 0) & (fb > 0), known).otherwise(F.get(prior, k))

    changed = F.transform(F.array(*[F.lit(g) for g in GENOTYPES]), refined)
    return F.when(F.col("hapmap").isNotNull() & (F.col("indel") == 0), changed).otherwise(prior)


def with_best_bases(rows: DataFrame) -> DataFrame:
    """Adds base1, base2, qual1 to qual3 to sites with counts qs0 .. all3, dep_uni and ref_code; of equal sums the later
    base comes first."""
    some = F.col("dep_uni") > 0
    by = [F.struct(F.when(some, F.col(f"qs{k}")).otherwise(F.col(f"all{k}")).cast("long").alias("v"), F.lit(k).alias("b")) for k in range(4)]
    ranked = rows.withColumn("__r", F.sort_array(F.array(*by), asc=False))
    first, second = F.col("__r")[0], F.col("__r")[1]
    base1 = F.when(first["v"] == 0, F.col("ref_code")).otherwise(first["b"])
    base2 = F.when((first["v"] != 0) & (second["v"] == 0) & (first["b"] != F.col("ref_code")), F.col("ref_code")).otherwise(second["b"])
    quals = {f"qual{k + 1}": F.when(some, F.col("__r")[k]["v"]).otherwise(F.lit(-1 - k).cast("long")) for k in range(3)}
    return ranked.withColumns({"base1": base1.cast("int"), "base2": base2.cast("int")} | quals).drop("__r")


def with_top_genotypes(rows: DataFrame, monoploid: bool = False) -> DataFrame:
    """Adds type1, lp1, type2, lp2 to rows with lik and prior: the genotypes of greatest log posterior; of equals the later
    one first."""
    log_prior = lambda p: F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf")))
    codes = F.array(*[F.lit(g) for g in GENOTYPES])
    pairs = F.transform(F.arrays_zip("lik", "prior", codes.alias("g")), lambda x: F.struct((x["lik"] + log_prior(x["prior"])).alias("lp"), x["g"].alias("g")))
    if monoploid:
        pairs = F.filter(pairs, lambda x: F.shiftright(x["g"], 2) == x["g"].bitwiseAND(3))
    ranked = rows.withColumn("__r", F.sort_array(pairs, asc=False))
    return ranked.withColumns({f"{c}{k + 1}": F.col("__r")[k][f] for k in range(2) for c, f in (("lp", "lp"), ("type", "g"))}).drop("__r")


def rank_table_frame(spark: SparkSession) -> DataFrame:
    """(n, n1, t, p): two-sided rank-sum probabilities of groups n1 of n up to 63; 679,120 rows, whatever the data."""
    counts = np.zeros((64, 2048), np.uint64)  # the largest is below C(63, 31), which fits
    counts[0, 0] = 1
    factorial = [1.0]
    for i in range(1, 64):
        factorial.append(factorial[-1] * i)
    parts = []
    for n in range(1, 64):
        new = counts.copy()
        new[1 : n + 1, n:] += counts[:n, : 2048 - n]
        counts = new
        for n1 in range(n + 1):
            t = np.arange(n1 * (n1 + 1) // 2, n1 * (2 * n - n1 + 1) // 2 + 1)
            each = counts[n1, t].astype(np.float64) / (factorial[n] / (factorial[n1] * factorial[n - n1]))
            left = np.cumsum(each)
            p = np.maximum(0.0, np.minimum(left, 1.0 - np.concatenate(([0.0], left[:-1]))))
            parts.append((np.full(t.size, n, np.int32), np.full(t.size, n1, np.int32), t.astype(np.int32), p))
    return spark.createDataFrame(pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], names=["n", "n1", "t", "p"]))


@lru_cache(maxsize=4)
def _lookup(spark: SparkSession, exact: bool) -> DataFrame:
    """rank_table_frame() with the place that the interpolation goes on to, as one row: (x, y, z, p1, p2), built once a session.

    That place is addressed with a shift of one bit less; ``exact`` takes the next place instead."""
    table = rank_table_frame(spark).toArrow()
    n, n1, t, p = (table.column(c).to_numpy() for c in ("n", "n1", "t", "p"))
    grid = np.full((64, 64, 2049), np.nan)
    grid[n, n1, t] = p
    n2, m2 = (n, n1) if exact else (n >> 1, n1 | (n & 1) << 5)
    return spark.createDataFrame(pa.table([pa.array(c) for c in (n, n1, t, p)] + [pa.array(grid[n2, m2, t + 1], from_pandas=True)], names=["__x", "__y", "__z", "__p1", "__p2"]))


def _allele_ranks(own: Column, a: Column) -> Column:
    """struct(ta, tb): sums of the mid-ranks, by q, of the bases ``a`` and of the others among ``own``: one pass in order of q."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("before", "na", "nb", "ta", "tb")], F.lit(-1).alias("q"))

    def flushed(s: Column) -> tuple[Column, Column, Column]:
        middle = s["before"] + (s["na"] + s["nb"] + 1) / 2
        return s["before"] + s["na"] + s["nb"], s["ta"] + s["na"] * middle, s["tb"] + s["nb"] * middle

    def step(s: Column, x: Column) -> Column:
        before, ta, tb = flushed(s)
        one, other = F.when(x["base"] == a, 1.0).otherwise(0.0), F.when(x["base"] == a, 0.0).otherwise(1.0)
        tied = x["q"] == s["q"]
        pick = lambda yes, no: F.when(tied, yes).otherwise(no)
        return F.struct(
            pick(s["before"], before).alias("before"), pick(s["na"] + one, one).alias("na"), pick(s["nb"] + other, other).alias("nb"),
            pick(s["ta"], ta).alias("ta"), pick(s["tb"], tb).alias("tb"), x["q"].cast("int").alias("q"),
        )

    return F.aggregate(F.array_sort(F.transform(own, lambda x: F.struct(x["q"].alias("q"), x["base"].alias("base")))), zero, step, lambda s: F.struct(flushed(s)[1].alias("ta"), flushed(s)[2].alias("tb")))


def rank_sums(calls: DataFrame, table: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Adds rank_p to calls with type1, uni0 .. uni3 and seen: 1 for homozygous calls, 0 where an allele has no unique
    observation, else the rank-sum test of the two alleles' qualities, by the table for fewer than 64 of them."""
    a, b = F.shiftright("type1", 2), F.col("type1").bitwiseAND(3)
    uni = F.array(*[F.col(f"uni{k}") for k in range(4)])
    own = F.filter("seen", lambda s: (s["base"] == a) | (s["base"] == b))
    testable = (a != b) & (F.get(uni, a) > 0) & (F.get(uni, b) > 0)
    rows = calls.withColumn("__a", a).withColumn("__b", b).withColumn("__test", testable).withColumn("__na", F.get(uni, b).cast("int")).withColumn("__nb", F.get(uni, a).cast("int"))
    # "a" counts the second allele here, as the test does
    rows = rows.withColumn("__sums", F.when(F.col("__test"), _allele_ranks(own, F.col("__b"))))
    rows = rows.withColumn("__ta", F.col("__sums.ta")).withColumn("__tb", F.col("__sums.tb")).drop("__sums")
    small = F.col("__na") <= F.col("__nb")
    rows = rows.withColumn("__n", F.col("__na") + F.col("__nb")).withColumn("__n1", F.when(small, F.col("__na")).otherwise(F.col("__nb")))
    rows = rows.withColumn("__tt", F.when(small, F.col("__ta")).otherwise(F.col("__tb"))).withColumn("__t", F.floor("__tt").cast("int"))
    use = F.col("__test") & (F.col("__n") < 64)
    # the table's size is fixed at 679,120 rows of 28 bytes
    found = F.broadcast(table if table is not None else _lookup(calls.sparkSession, exact))
    rows = rows.join(found, use & (F.col("__n") == F.col("__x")) & (F.col("__n1") == F.col("__y")) & (F.col("__t") == F.col("__z")), "left")
    p1, p2 = F.coalesce("__p1", F.lit(1.0)), F.coalesce("__p2", F.lit(1.0))
    by_table = p1 + (F.col("__tt") - F.col("__t")) * (p2 - p1)
    # columns of their own: spelled into each other they would outgrow a compiled method
    rows = rows.withColumn("__deviate", normal_deviate(F.col("__na"), F.col("__nb"), F.col("__ta"), F.col("__tb"))).withColumn("__normal", normal_tail(F.col("__deviate")))
    by_normal = F.col("__normal")
    p = F.when(F.col("__a") == F.col("__b"), 1.0).when(~F.col("__test"), 0.0).when(F.col("__n") < 64, by_table).otherwise(by_normal)
    return rows.withColumn("rank_p", F.round(p, PLACES)).drop(*[c for c in rows.columns if c.startswith("__")])


def normal_deviate(n1: Column, n2: Column, t1: Column, t2: Column) -> Column:
    """The larger of the two groups' normal deviates; the means are whole numbers, cut off."""
    n = n1 + n2 + 1
    scale = F.sqrt(n1 * n2 * n / 12.0)
    u1, u2 = (t1 - F.floor(n1 * n / 2)) / scale, (t2 - F.floor(n2 * n / 2)) / scale
    far = F.array_max(F.array(F.struct(F.abs(u1).alias("far"), F.lit(0).alias("first"), u1.alias("u")), F.struct(F.abs(u2).alias("far"), F.lit(1).alias("first"), u2.alias("u"))))
    return far["u"]


def consensus_quality() -> Column:
    """Quality 0 to 99 of rows with lp1, lp2, type1, base1, base2, qual1 .. qual3, qs0 .. qs3 and rank_p."""
    raw = F.when(F.col("rank_p") == 0, F.lit(0).cast("long")).otherwise(((F.col("lp1") - F.col("lp2")) * 10 + F.log10("rank_p") * 10 + NUDGE).cast("long"))
    q_sums = F.array(*[F.col(f"qs{k}") for k in range(4)])
    a, b = F.shiftright("type1", 2), F.col("type1").bitwiseAND(3)
    hom = F.when((F.col("qual1") > 0) & (F.col("base1") != b), F.lit(0)).otherwise(F.least(raw, F.col("qual1") - F.col("qual2")))
    low, high = F.least("base1", "base2"), F.greatest("base1", "base2")
    agrees = (F.coalesce(F.get(q_sums, F.col("base1")), F.lit(0)) > 0) & (F.coalesce(F.get(q_sums, F.col("base2")), F.lit(0)) > 0) & (low == a) & (high == b)
    het = F.when(agrees, F.least(raw, F.col("qual2") - F.col("qual3"))).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(99), F.when(a == b, hom).otherwise(het))).cast("int")


def call(sites: DataFrame, covered: DataFrame, known: DataFrame | None, params: CallParams = CallParams(), table: DataFrame | None = None) -> DataFrame:
    """Of every reference site: what consensus() needs. ``sites``: chr, pos, ref_code; ``covered``: likelihoods(); ``known``: known_sites()."""
    rows = sites.join(covered, ["chr", "pos"], "left")
    numbers = ["depth", "repeat_time", "dep_uni", *[f"{c}{k}" for k in range(4) for c in ("uni", "qs", "all")]]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers} | {"lik": F.coalesce("lik", F.array(*[F.lit(0.0)] * 10))})
    if known is not None:
        rows = rows.join(known.select("chr", "pos", "hapmap", "validated", "indel", "f0", "f1", "f2", "f3"), ["chr", "pos"], "left")
    return called(rows, params, table)


def called(rows: DataFrame, params: CallParams = CallParams(), table: DataFrame | None = None) -> DataFrame:
    """What consensus() needs, of rows with chr, pos, ref_code, counts and lik of every site and, if known sites are used, hapmap,
    validated, indel and f0 to f3, null where a site is none."""
    known = "hapmap" in rows.columns
    rows = rows.withColumn("is_dbsnp", F.col("hapmap").isNotNull().cast("int") if known else F.lit(0))
    rows = rows.withColumn("nflag", (F.col("ref_code") >= 4) & (F.col("depth") == 0)).withColumn("prior", prior_column(params))
    if known and params.refine:
        rows = rows.withColumn("prior", refined_prior(F.col("prior"), params))
    rows = with_top_genotypes(with_best_bases(rows), params.monoploid).drop("lik", "prior")
    if params.rank_sum:
        rows = rank_sums(rows, table, params.exact_rank)
    else:
        rows = rows.withColumn("rank_p", F.lit(1.0))
    return rows.withColumn("quality", consensus_quality())


def consensus(calls: DataFrame) -> DataFrame:
    """The 17 columns of each site; sites without a call get the literal N row."""
    arrays = {c: F.array(*[F.col(f"{c}{k}") for k in range(4)]) for c in ("uni", "qs", "all")}
    none = F.col("nflag") | (F.col("base1") >= 4)

    def of(base: Column, gone: Column) -> dict[str, Column]:
        uni, qs = F.get(arrays["uni"], base), F.get(arrays["qs"], base)
        mean = F.when(qs == 0, F.lit(0)).otherwise(F.floor(qs / uni))
        zero = lambda c: F.when(gone, F.lit(0)).otherwise(c).cast("long")
        return {"base": F.when(gone, "N").otherwise(shown(base)), "avg_q": zero(mean), "uni": zero(uni), "all": zero(F.get(arrays["all"], base))}

    one, two = of(F.col("base1"), none), of(F.col("base2"), none | (F.col("base2") >= 4))
    unless = lambda value, c: F.when(none, value).otherwise(c)
    return calls.select(
        "chr", (F.col("pos") + 1).alias("pos"), unless(F.lit("N"), shown(F.col("ref_code"))).alias("ref"), unless(F.lit("N"), iupac(F.col("type1"))).alias("genotype"), unless(F.lit(0), F.col("quality")).cast("int").alias("quality"),
        *[v.alias(f"{k}1") for k, v in one.items()], *[v.alias(f"{k}2") for k, v in two.items()],
        unless(F.lit(0), F.col("depth")).cast("long").alias("depth"), unless(F.lit(1.0), F.col("rank_p")).alias("rank_p"),
        unless(F.lit(255.0), F.when(F.col("depth") == 0, 255.0).otherwise(F.round(F.col("repeat_time") / F.col("depth"), PLACES))).alias("copy_number"), unless(F.lit(0), F.col("is_dbsnp")).cast("int").alias("is_dbsnp"),
    )


def snps(rows: DataFrame) -> DataFrame:
    """Consensus rows whose genotype isn't the reference's letter."""
    return rows.filter((F.col("genotype") != F.col("ref")) & (F.col("ref") != "N"))
