"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the most frequent form.

Candidates come from a rare-first prefix filter of positional bigrams. All bigrams are put into one order, rare ones first, and each
word keeps its three rarest with their positions. One edit touches at most two bigrams of a word, so two near words keep a common
bigram that the edit leaves alone, at positions that differ by at most one. As the edit is then either right or left of that bigram,
all letters up to it, or all from it on, are equal, too, and stand in the key: that is the position limit, as strict as it can be
without losing a pair. Words that share a key are compared in the join, which lets only verified pairs out. Keys of over CROWD
words are not compared pair by pair: their words meet by what is left when one letter on the edit's side is taken out, so each
row of those joins is a near pair (their number is bounded by the alphabet and not by the key's words); these are verified, too.

Defined results: a null text has no words, a null id counts as an empty text; repeated rows count each time; words are compared by
code points whatever their length; an empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import each, free, staged, text_of

#: Letters of a word: a to z and U+00C0 to U+00FF, so there are at most 90 * 90 bigrams.
LETTERS = 26 + 64
#: The three rarest bigrams: one more than an edit can touch.
RAREST = 3
#: Words of a key up to which they are compared with each other.
CROWD = 48
SLIP = 97
#: Spark's edit distance takes time by the square of the length; words of more letters than this are compared from their first difference on.
LENGTHY = 100


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id text, run) of every maximal run of letters of every text, A-Z lower-cased."""
    lower = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.split(lower, "[^a-z\\u00C0-\\u00FF]+")).alias("run"))
    return rows.filter("run <> ''")


def slipped(found: DataFrame) -> DataFrame:
    """(word): the runs, of which one in 97 loses a letter, told by the crc32 of ``id:run``."""
    h = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    return h.select(F.expr(f"CASE WHEN h % {SLIP} = 0 THEN concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)) ELSE run END").alias("word"))


def vocabulary(words: DataFrame, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n long) of words that are long and frequent enough."""
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def _ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the order by frequency over all words, then by code points."""
    letters = words.select(F.split("word", "").alias("s")).filter("size(s) > 1")  # an array's elements are found at once, a text's letters by a walk
    grams = letters.select(F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> s[i - 1] || s[i])")).alias("gram"))
    counted = grams.groupBy("gram").count().orderBy("count", "gram").limit(LETTERS**2 + 1).collect()
    if len(counted) > LETTERS**2:
        raise ValueError("words may have the letters a to z and U+00C0 to U+00FF only")
    return {row["gram"]: k for k, row in enumerate(counted)}


def rarest(word: str, ranks: dict[str, int]) -> list[int]:
    """The positions of the three rarest bigrams of a word."""
    return heapq.nsmallest(RAREST, range(len(word) - 1), key=lambda p: (ranks[word[p : p + 2]], p))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _keyed(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(key, id, word, after, before): an edit is at letter ``after`` or later, or before letter ``before``."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, word in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                for p in rarest(word, ranks):
                    rows.append((_hash("<" + word[: p + 2]), i, word, p + 2, None))
                    rows.append((_hash(">" + word[p:]), i, word, None, p))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "word", "after", "before"])

    return words.select("id", "word").mapInArrow(run, "key long, id long, word string, after int, before int")


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def forms(word: str, after: int | None, before: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Letters taken out, and hashes of what is left; -1 for the whole word. A hash is a sum over letters, so taking one out
    costs no pass over the word."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = codes.size
    factors = np.full(n, _STEP, np.uint64)
    factors[:1] = 1
    powers = np.cumprod(factors, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)))
    out = np.unique(np.concatenate((np.arange(n if after is None else after, n), np.arange(0 if before is None else before))))
    left = sums[out] + (sums[n] - sums[out + 1]) * np.uint64(_BACK)
    return np.concatenate(([-1], out)), np.concatenate((sums[n:], left)).view(np.int64)


def _crowded(words: DataFrame, keyed: DataFrame, loud: DataFrame) -> DataFrame:
    """(a, b) of near words among those of crowded keys."""
    limits = keyed.join(loud, "key", "left_semi").groupBy("id", "word").agg(F.min("after").alias("after"), F.max("before").alias("before"))

    def run(batches):
        def packed():
            ids = np.repeat([h[0] for h in held], [h[1].size for h in held])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([h[1] for h in held])), pa.array(np.concatenate([h[2] for h in held]))], names=["id", "gone", "form"])

        held, size = [], 0
        for batch in batches:
            ids, befores, afters = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for i, word, after, before in zip(ids, each(batch.column(1)), afters, befores, strict=True):
                held.append((i, *forms(word, after, before)))
                size += held[-1][1].size
                if size > 50_000:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    # a word gives several rows, so partitions must not be joined by their size before that
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = staged(limits.repartition(parts, "id").mapInArrow(run, "id long, gone long, form long"))
    a, b = taken.alias("a"), taken.alias("b")
    replaced = a.join(b, F.expr("a.form = b.form AND a.gone = b.gone AND a.gone >= 0 AND a.id < b.id"))
    inserted = a.filter("gone < 0").alias("a").join(b.filter("gone >= 0").alias("b"), F.expr("a.form = b.form AND a.id <> b.id"))
    pairs = replaced.select("a.id", F.expr("b.id AS other")).unionAll(inserted.select(F.expr("least(a.id, b.id)"), F.expr("greatest(a.id, b.id)"))).distinct()
    named = pairs.join(words.select("id", F.col("word").alias("wa")), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("wb")), "other")
    return named.filter(_one_edit("wa", "wb")).select(F.col("id").alias("a"), F.col("other").alias("b"))


def _one_edit(a: str, b: str) -> str:
    """SQL that tells whether two different words of any length differ by one edit, in time that grows with their length only."""
    first = f"array_position(zip_with(split({a}, ''), split({b}, ''), (x, y) -> NOT x <=> y), true)"
    rest = f"length({a}) = length({b}) AND substring({a}, k + 1) = substring({b}, k + 1) OR length({a}) > length({b}) AND substring({a}, k + 1) = substring({b}, k) OR length({a}) < length({b}) AND substring({a}, k) = substring({b}, k + 1)"
    return f"abs(length({a}) - length({b})) < 2 AND exists(array(int({first})), k -> {rest})"


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, once each: the ids of all pairs of ``words`` (id long, word; both unique) that differ by one edit."""
    keyed = staged(_keyed(words, _ranks(words)))
    loud = staged(keyed.groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
    quiet = staged(keyed.join(loud, "key", "left_anti").select("key", "id", "word", F.length("word").alias("size")))

    def compared(some: DataFrame, near: str) -> DataFrame:
        a, b = some.alias("a"), some.alias("b")
        return a.join(b.hint("merge"), F.expr(f"a.key = b.key AND a.id < b.id AND abs(a.size - b.size) < 2 AND {near}")).select(F.expr("a.id AS a"), F.expr("b.id AS b"))

    few = compared(quiet.filter(F.col("size") <= LENGTHY), "levenshtein(a.word, b.word, 1) = 1")
    few = few.unionAll(compared(quiet.filter(F.col("size") >= LENGTHY), f"greatest(a.size, b.size) > {LENGTHY} AND {_one_edit('a.word', 'b.word')}"))
    return few.unionAll(_crowded(words, keyed, loud)).distinct()


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the forms that follow. Counts double at each step at least, so that steps
    grow with the logarithm of the greatest count, and rounds with that one's logarithm."""
    at = staged(formed.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("far"))
        joined = staged(at.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return at


def variants(counted: DataFrame) -> DataFrame:
    """Of (word, n), unique: word, form, root string; n, n_near, form_n long. A form is the near word of largest n, the least by
    code points of several, if its n is twice the word's or more; a root follows forms to the last."""
    words = staged(counted.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    pairs = staged(near_pairs(words))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("best"))
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    told = words.join(near, "id", "left").withColumn("formed", -F.col("best.less") >= 2 * F.col("n"))
    shown = staged(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("formed"), F.col("best.word")).alias("form"), F.when(F.col("formed"), -F.col("best.less")).alias("form_n")))
    roots = _roots(shown.filter("form IS NOT NULL"))
    return shown.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def respelt(df: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``respelt`` (``respelt_`` and so on where that is taken): the words of each text, A-Z lower-cased, in
    order, with roots in the place of variants (``found`` as variants() gives it)."""
    key, place, run, root, out = free(df, "__row", "__place", "__run", "__root", "respelt")
    lower = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = staged(df.withColumn(key, F.monotonically_increasing_id()))
    each_run = rows.select(key, F.posexplode(F.split(lower, "[^a-z\\u00C0-\\u00FF]+")).alias(place, run)).filter(F.col(run) != "")
    moved = found.filter("form IS NOT NULL").select(F.col("word").alias("__w"), F.col("root").alias(root))
    named = each_run.join(moved, F.col(run) == F.col("__w"), "left").select(key, F.struct(place, F.coalesce(root, run).alias("w")).alias("at"))
    lines = named.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["w"]), " ").alias(out))  # a list is one text's words
    return rows.join(lines, key, "left").drop(key).withColumn(out, F.coalesce(out, F.lit("")))
