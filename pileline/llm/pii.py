"""Personal data by candidate gradient boosting, in SQL expressions only.

Four exact patterns with their tests (octets, Luhn, numbers of digits) give the base spans. Wide patterns beside them propose
many more spans that overlap each other and the base: numbers in other groups, addresses with brackets or words for signs. Boosted
trees decide on those. They learn from all proposals of all documents: a proposal that passes the exact pattern and test of its kind
is a positive, any other a negative, and the features leave out what the tests look at (the plus of a phone number, Luhn sums,
octets), so what is learned is the format and the context in which true ones stand. Features are small whole numbers; rows are
counted by feature vector, which is all that fitting needs, so the trees are fitted on a table whose size is bounded by the features'
values and not by the documents. A tree becomes one SQL expression. The scores of each kind are calibrated by the counts
(the share of positives at a score or above, made monotone), and the threshold of a kind is the least score whose share is
PRECISION or more; a kind without one adds nothing.

Of what passes, spans that overlap a base span go (base spans stay, always), and of a run of spans each of which overlaps one
before it the one of the best score stays, then the longer, the earlier and the kind listed first.

Defined results: null texts are empty; repeated rows, equal and null ids each get a row; positions count code points; an empty table
gives no rows; columns other than the two named are not read. A match is found by splitting a text at its matches, and its
place by a running sum over the pieces, in a window over one text's matches, so that long texts take no quadratic time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import staged, text_of

KINDS = ("email", "ip", "card", "phone")
# Repeats are possessive and begin at the beginning of a run, or where the last match ended: what is found is the same, but long runs take no quadratic time and no deep stack.
#: The exact patterns.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wide patterns. Their lengths are bounded.
WIDE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20?@\x20?|\x20at\x20)[A-Z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\.|\x20dot\x20)[A-Z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|,|-)\x20?[0-9]{1,4}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4,6}+(?:[\x20._/-]{0,2}+[0-9]{2,6}+){2,5}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}+(?:[\x20().-]{1,3}+[0-9]{2,5}+){1,5}+(?![0-9])",
}
#: Words that speak for a kind in the CUE letters before a span.
CUES = {
    "email": "mail|contact|write|reach|courriel|correo|kontakt",
    "ip": "ip|addr|host|server|login|client|from",
    "card": "card|visa|master|amex|credit|debit|pay|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|dial|sms|whatsapp",
}
#: Words and signs that speak against any.
AGAINST = "token|secret|hash|sha|uuid|isbn|order|invoice|version|="
CUE, NEAR = 24, 1
#: Precision that a score needs, by the counts of all proposals, and the fewest positives that a kind's trees are fitted on.
PRECISION, LEAST = 0.95, 20
ROUNDS, DEPTH, RATE, PENALTY = 30, 2, 0.3, 1.0
#: Features and the number of values of each, from 0.
FEATURES = {"digits": 22, "groups": 8, "first": 8, "last": 8, "signs": 8, "lside": 5, "rside": 5, "cue": 2, "against": 2, "head": 6}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: str) -> str:
    """SQL that tells whether at most 19 digits pass Luhn's test."""
    d = f"int(substring({digits}, length({digits}) - i, 1))"
    twice = f"(2 * {d} - IF({d} > 4, 9, 0))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + IF(i % 2 = 1, {twice}, {d})) % 10 = 0"


def passes(kind: str, m: str, digits: str) -> str:
    """SQL for the test of a kind on a match of its exact pattern."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND int('0' || right(p, 3)) <= 255)"
    if kind == "card":
        return f"length({digits}) BETWEEN 14 AND 19 AND CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn(digits)} ELSE false END"
    return f"length({digits}) BETWEEN 10 AND 15"


def _pieces(text: Column, pattern: str, worth: Column) -> Column:
    """The matches of a pattern in order: (gap before, match, letters before, letters after); null where there are none."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(gaps, found, F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))),
        lambda x: F.struct(F.length(x["0"]).alias("gap"), x["1"].alias("m"), F.right(x["0"], F.lit(CUE)).alias("before"), F.left(x["2"], F.lit(NEAR)).alias("after")),
    )  # the last gap has no match
    return F.when(worth, F.filter(rows, lambda x: x["m"].isNotNull()))


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, a list of matches a pattern), without texts: one row a document, from a staged table, so that row numbers stay."""
    text = F.col("__text")
    digit, sign = F.expr(r"__text RLIKE '[0-9]'"), F.expr(r"__text RLIKE '(?i)@|[ (\\[{]at[ )\\]}]'")
    lists = [_pieces(text, EXACT[k], F.contains(text, F.lit("@")) if k == "email" else digit).alias(f"exact_{k}") for k in KINDS]
    lists += [_pieces(text, WIDE[k], sign if k == "email" else digit).alias(f"wide_{k}") for k in KINDS]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("__text"))
    return staged(rows.select(F.monotonically_increasing_id().alias("row"), "id", *lists))


def _spans(found: DataFrame, sort: str) -> DataFrame:
    """(row, kind number, lo, hi, m, before, after, digits) of the matches ``exact`` or ``wide``, by row."""
    lists = reduce(DataFrame.unionAll, [found.filter(F.col(f"{sort}_{k}").isNotNull()).select("row", F.lit(n).alias("kind"), F.posexplode(f"{sort}_{k}").alias("place", "at")) for n, k in enumerate(KINDS)])
    flat = lists.select("row", "kind", "place", "at.*").repartition("row")
    end = F.sum(F.col("gap") + F.length("m")).over(W.partitionBy("row", "kind").orderBy("place")).cast("long")
    flat = flat.select("row", "kind", end.alias("hi"), "m", "before", "after")
    return flat.select("row", "kind", (F.col("hi") - F.length("m")).alias("lo"), "hi", "m", "before", "after", _digits(F.col("m")).alias("digits"))


def _by_kind(sql) -> Column:
    return F.expr("CASE " + " ".join(f"WHEN kind = {n} THEN {sql(k)}" for n, k in enumerate(KINDS)) + " END")


def base_spans(found: DataFrame) -> DataFrame:
    """(row, kind, lo, hi) of the base spans."""
    return _spans(found, "exact").filter(_by_kind(lambda k: passes(k, "m", "digits"))).select("row", "kind", "lo", "hi")


def featured(spans: DataFrame) -> DataFrame:
    """Spans with their features and whether they pass the exact pattern and test of their kind (``good``)."""

    def klass(c: str) -> Column:
        return F.expr(f"CASE WHEN {c} = '' THEN 0 WHEN {c} RLIKE '^\\\\s$' THEN 1 WHEN {c} RLIKE '^[0-9]$' THEN 2 WHEN {c} RLIKE '^\\\\p{{L}}$' THEN 3 ELSE 4 END")

    def most(name: str, value: Column) -> Column:
        return F.least(value, F.lit(FEATURES[name] - 1)).cast("int").alias(name)

    core = F.regexp_replace("m", r"^(?:\+|00)", "")  # a phone number's plus is not to be seen
    groups = F.filter(F.split(core, "[^0-9]+"), lambda g: g != "")
    labels = F.split(F.regexp_replace(F.lower("m"), r"\x20?[\[({]?\x20?dot\x20?[\])}]?\x20?", "."), "[.]")
    mail = F.col("kind") == 0
    group = lambda k: F.length(F.coalesce(F.get(groups, k), F.lit("")))
    signs = (F.contains(core, F.lit("(")).cast("int") * 4 + F.contains(core, F.lit(" ")).cast("int") * 2 + F.contains(core, F.lit("-")).cast("int"))
    tail = F.get(labels, F.size(labels) - 1)
    lower = F.lower("before")
    return spans.select(
        "row", "kind", "lo", "hi",
        _by_kind(lambda k: f"m RLIKE '^(?:{EXACT[k].replace(chr(92), chr(92) * 2)})$' AND {passes(k, 'm', 'digits')}").alias("good"),
        most("digits", F.length(_digits(core))),
        most("groups", F.when(mail, F.size(labels)).otherwise(F.size(groups))),
        most("first", F.when(mail, F.length(F.get(labels, F.lit(0)))/4).otherwise(group(F.lit(0)))),
        most("last", F.when(mail, F.length(tail)).otherwise(group(F.size(groups) - 1))),
        most("signs", F.when(mail, F.when(tail.rlike("^[a-z]+$"), 0).otherwise(1)).when(F.col("kind") == 1, 0).otherwise(signs)),
        klass("right(before, 1)").alias("lside"),
        klass("after").alias("rside"),
        _by_kind(lambda k: f"lower(before) RLIKE '{CUES[k]}'").cast("int").alias("cue"),
        lower.rlike(AGAINST).cast("int").alias("against"),
        F.when(mail, F.when(F.col("m").rlike("[0-9]"), 1).otherwise(0)).when(F.col("kind") == 2, F.expr("CASE WHEN digits RLIKE '^4' THEN 1 WHEN digits RLIKE '^(5|2)' THEN 2 WHEN digits RLIKE '^3' THEN 3 WHEN digits RLIKE '^0' THEN 4 ELSE 5 END")).otherwise(0).alias("head"),
    )


def learn(spans: DataFrame) -> dict[int, tuple[list, float]]:
    """Of featured spans: a kind's number to its trees (nested (feature, cut, left, right) or a leaf) and its threshold. Spans are
    counted by feature vector on the cluster; what comes to the driver is at most one row a vector."""
    names = list(FEATURES)
    told = spans.groupBy("kind", *names).agg(F.sum(F.col("good").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for kind in range(len(KINDS)):
        cells = sorted((tuple(r[f] for f in names), r["pos"] or 0, r["n"]) for r in told if r["kind"] == kind)
        pos, n = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if pos >= LEAST:
            trees = _boosted(cells, math.log((pos + 0.5) / (n - pos + 0.5)))
            if (cut := _threshold(cells, [_value(trees, c[0]) for c in cells])) is not None:
                out[kind] = (trees, cut)
    return out


def _value(trees: list, x: tuple) -> float:
    total = 0.0
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        total += t
    return total


def _boosted(cells: list[tuple[tuple, int, int]], prior: float) -> list:
    """Trees by Newton steps on the logistic loss of counted cells; the first is a leaf, the log odds of all."""
    trees, scores = [prior], [prior] * len(cells)
    for _ in range(ROUNDS):
        shares = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [p - n * s for (_, p, n), s in zip(cells, shares, strict=True)]
        bends = [n * s * (1 - s) for (_, _, n), s in zip(cells, shares, strict=True)]
        tree = _grown(cells, grads, bends, list(range(len(cells))), DEPTH)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        scores = [s + _value([tree], c[0]) for s, c in zip(scores, cells, strict=True)]
    return trees


def _grown(cells: list, grads: list[float], bends: list[float], some: list[int], depth: int):
    g, h = sum(grads[i] for i in some), sum(bends[i] for i in some)
    best = (1e-6, None)
    for f, (_, values) in enumerate(FEATURES.items()) if depth else ():
        gs, hs = [0.0] * values, [0.0] * values
        for i in some:
            gs[cells[i][0][f]] += grads[i]
            hs[cells[i][0][f]] += bends[i]
        left_g = left_h = 0.0
        for cut in range(values - 1):
            left_g, left_h = left_g + gs[cut], left_h + hs[cut]
            gain = left_g**2 / (left_h + PENALTY) + (g - left_g) ** 2 / (h - left_h + PENALTY) - g**2 / (h + PENALTY)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut))
    if best[1] is None:
        return RATE * g / (h + PENALTY)
    f, cut = best[1]
    parts = [[i for i in some if (cells[i][0][f] <= cut) == side] for side in (True, False)]
    return (f, cut, *(_grown(cells, grads, bends, part, depth - 1) for part in parts))


def _threshold(cells: list, scores: list[float]) -> float | None:
    """The least score from which on every share of positives, made monotone by pooling neighbours, is PRECISION or more."""
    pools: list[list[float]] = []  # least score, positives, rows
    for score, (_, pos, n) in sorted(zip(scores, cells, strict=True), key=lambda x: x[0]):
        pools.append([score, pos, n])
        while len(pools) > 1 and (pools[-2][0] == score or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            _, p, m = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + p, pools[-1][2] + m]
    return next((score for score, p, m in pools if p >= PRECISION * m), None)


def _sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"double({tree!r})"
    return f"CASE WHEN `{list(FEATURES)[tree[0]]}` <= {tree[1]} THEN {_sql(tree[2])} ELSE {_sql(tree[3])} END"


def score(trees: list) -> str:
    """The trees' sum as SQL over the features."""
    return " + ".join(_sql(t) for t in trees)


def added(spans: DataFrame, base: DataFrame, models: dict[int, tuple[list, float]]) -> DataFrame:
    """(row, kind, lo, hi) of the proposals that pass their kind's threshold, overlap no base span and are the best of their run."""
    if not models:
        return base.limit(0)
    value = F.expr("CASE " + " ".join(f"WHEN kind = {k} THEN {score(trees)}" for k, (trees, _) in models.items()) + " END")
    cut = F.expr("CASE " + " ".join(f"WHEN kind = {k} THEN double({cut!r})" for k, (_, cut) in models.items()) + " END")
    passed = spans.filter("NOT good").withColumn("score", value).filter(F.col("score") >= cut - 1e-9)
    rows = passed.select("row", "kind", "lo", "hi", "score").unionAll(base.select("row", "kind", "lo", "hi", F.lit(None).cast("double")))
    # base spans first at a place: any base span that begins before a proposal ends and ends after it begins is seen from one side
    order = W.partitionBy("row").orderBy("lo", F.col("score").isNotNull(), "hi", "kind")
    own = F.col("score").isNull()
    before = F.max(F.when(own, F.col("hi"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    back = W.partitionBy("row").orderBy(F.col("lo").desc(), F.col("score").isNotNull().desc(), F.col("hi").desc(), F.col("kind").desc())  # a frame to the end of a group would take quadratic time
    after = F.min(F.when(own, F.col("lo"))).over(back.rowsBetween(W.unboundedPreceding, -1))
    free = rows.withColumn("before", before).withColumn("after", after).filter("score IS NOT NULL AND NOT coalesce(before > lo, false) AND NOT coalesce(after < hi, false)").drop("before", "after")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = free.withColumn("new", F.when(reach > F.col("lo"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rank = F.row_number().over(W.partitionBy("row", "run").orderBy(F.col("score").desc(), (F.col("hi") - F.col("lo")).desc(), "lo", "kind"))
    return runs.withColumn("rank", rank).filter("rank = 1").select("row", "kind", "lo", "hi")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``id_col``, ``base`` and ``all``, lists of (start, kind number, end, kind) in order. The trees are fitted on
    the proposals of the same rows."""
    found = _found(df, id_col, text_col)
    base = staged(base_spans(found))
    proposed = staged(featured(_spans(found, "wide")))
    more = added(proposed, base, learn(proposed))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    rows = base.withColumn("own", F.lit(True)).unionAll(more.withColumn("own", F.lit(False)))
    rows = rows.select("row", "own", F.struct(F.col("lo").alias("start"), "kind", F.col("hi").alias("end"), name.alias("name")).alias("at"))
    lists = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("own"), F.col("at")))).alias("base"), F.array_sort(F.collect_list("at")).alias("all"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,name:string>>")
    return found.select("row", "id").join(lists, "row", "left").select(F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("all", none).alias("all"))


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["name"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of rows of spans(): ``id_col``, n_email to n_phone, base_sha256 and spans."""
    counts = [F.expr(f"size(filter(base, s -> s.name = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("all").alias("spans"))


def redacted(df: DataFrame, text_col: str = "text", base_col: str = "all") -> DataFrame:
    """``df`` (texts with their spans) with each span of the text replaced by its kind in brackets, spans that overlap as one."""
    at, text = F.col(f"`{base_col}`"), text_of(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.when(s["start"] < a["to"], F.struct(a["out"].alias("out"), F.greatest(a["to"], s["end"]).alias("to"))).otherwise(
        F.struct(F.concat(a["out"], F.substring(text, (a["to"] + 1).cast("int"), (s["start"] - a["to"]).cast("int")), F.lit("["), s["name"], F.lit("]")).alias("out"), s["end"].alias("to"))
    )
    return df.withColumn(text_col, F.aggregate(at, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["to"] + 1).cast("int"), F.length(text)))))
