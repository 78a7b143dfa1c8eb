"""URL filter: rules by host suffix and path prefix, then naive Bayes over segmented host and path words.

A host's labels are cut at dots, hyphens, underscores and digits; each piece, which may be several words written together,
is split by a Viterbi search for the words of greatest total log probability under a unigram model. A multinomial naive
Bayes model scores the words of host and path.

The unigram model counts the words of all pages' texts and url paths, together with the seed words of both classes. It stays
a table: a piece's substrings are looked up in it by a join, so no vocabulary is cut or sent to the driver.

The classes are learned from all pages, as they have no labels: a page is of the block class if a rule blocks it or if no rule
fits and a word of it is in the fixed seed list of advertising, gambling, drug-shop, adult and spam words; all others are of
the allow class. The seed words of either class get SEED_WEIGHT more counts in it, every word gets one.

Defined results: a null url, or one without ``://``, has an empty host and path; a host without words is judged by the
prior, the classes' shares of all pages; the last label (the top-level domain) and ``www`` count as words like any other; an empty table gives an
empty result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import staged

#: Words of hosts that are blocked (fixed seed list).
BLOCK_WORDS = (
    "ad ads advert adverts banner banners track tracker tracking click clicks popup casino casinos poker slots jackpot roulette bet bets betting gamble gambling lottery win winner winners "
    "prize prizes bonus free cheap discount deal deals pill pills pharma pharmacy viagra cialis drug drugs adult porn porno sex sexy xxx nude escort cams spam farm seo loan loans credit payday "
    "crack warez torrent keygen hack phish scam malware virus fake replica"
).split()
#: Ordinary words of hosts and paths (fixed seed list).
ALLOW_WORDS = "www blog news example com net org de fr es en en html index page article wiki docs help about mail shop forum home m static images data science school city book library health travel food music sport".split()
#: Pseudo-counts of a seed word in the unigram model and in its class.
SEED_COUNT = 1_000
SEED_WEIGHT = 10
#: Keys of at least one row in so many are hot; there can't be more of them than this.
SHARES = 4_096

_PIECE = re.compile(r"[^\W\d_]+")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract of the url filter has them."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    ok = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


@dataclass(frozen=True)
class Rule:
    """``host/path`` with the verdict block or allow; fits the host and its subdomains where the path starts with /path."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        domain, _, start = self.text.partition("/")
        return ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))


def by_rules(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        out = F.when(rule.fits(host, path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Model:
    """Tables: ``counts`` (word, n) for segmenting, of ``total`` words of ``lengths`` letters (from many to few); ``odds`` (token,
    odds), the log odds block : allow; ``unseen``, those of a token that no page has; ``prior``, those of a page."""

    counts: DataFrame
    total: int
    lengths: list[int]
    odds: DataFrame | None = None
    unseen: float = 0.0
    prior: float = 0.0


def segment(piece: str, words: dict[str, float], unknown: float, lengths: list[int] | int) -> list[str]:
    """The words of greatest total log probability; of equals the one whose last word is longest. Letters that fit no word are
    words of one letter at ``unknown`` each. ``lengths`` are those of words, from many letters to few, with 1, or
    the greatest."""
    lengths = range(lengths, 0, -1) if isinstance(lengths, int) else lengths
    n = len(piece)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for size in lengths:
            if (start := end - size) < 0:
                continue
            word = words.get(piece[start:end], unknown if size == 1 else None)
            if word is not None and best[start] + word > best[end]:
                best[end], back[end] = best[start] + word, start
    out = []
    while n:
        out.append(piece[back[n] : n])
        n = back[n]
    return out[::-1]


def word_counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(word, n): how often each word stands in the pages' texts and url paths, over all pages."""
    _, path = split_url(F.col(f"`{url_col}`"))
    text = F.regexp_replace(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(F.concat_ws(" ", text, path)), r"[^\p{L}]+")).alias("word"))
    return words.filter(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def seeds(pages: DataFrame) -> DataFrame:
    """(word, b, a): whether a word is a seed of the block class, and of the allow class."""
    rows = [(w, int(w in BLOCK_WORDS), int(w in ALLOW_WORDS)) for w in sorted({*BLOCK_WORDS, *ALLOW_WORDS})]
    return pages.sparkSession.createDataFrame(rows, "word string, b long, a long")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with host and path, and ``key``: their pieces in order, with spaces between."""
    names = rows.columns
    h, p = names.index("host"), names.index("path")

    def run(batches):
        for batch in batches:
            keys = [" ".join(_PIECE.findall(f"{host} {path}".lower())) for host, path in zip(batch.column(h).to_pylist(), batch.column(p).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*names, "key"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", key string")


def segmented(keys: DataFrame, model: Model) -> DataFrame:
    """(key, words) of distinct keys (key)."""
    lengths, total = model.lengths, model.total
    # every letter is a word of the model; those that the corpus lacks are less likely than any word, and still worse the more there are
    unknown = math.log(0.01 / total)
    pieces = staged(keys.select(F.explode(F.split("key", " ")).alias("piece")).filter("piece <> ''").distinct())

    def parts(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(subs, pa.string())], names=["piece", "word"])

        of, subs, size = [], [], 0
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                for length in lengths:  # only so long can a word be, so a long piece doesn't give all its substrings
                    if length <= len(piece):
                        some = {piece[start : start + length] for start in range(len(piece) - length + 1)}
                        of += [piece] * len(some)
                        subs += some
                        size += len(some) * (len(piece) + length)
                    if size > 1_000_000:
                        yield out()
                        of, subs, size = [], [], 0
        yield out()

    def split(batches):
        for batch in batches:
            out = []
            for piece, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(segment(piece, {k["word"]: math.log(k["n"] / total) for k in known or ()}, unknown, lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["piece", "words"])

    known = pieces.mapInArrow(parts, "piece string, word string").join(model.counts, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    cuts = pieces.join(known, "piece", "left").select("piece", "known").mapInArrow(split, "piece string, words array<string>")
    at = keys.select("key", F.posexplode(F.split("key", " ")).alias("at", "piece"))
    found = at.join(cuts, "piece", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return found.select("key", F.flatten(F.transform("all", lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("words"))


def _tokens(words: Column) -> Column:
    """What naive Bayes counts: the words and each two neighbours, so that a domain and the folder after it can speak together."""
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return F.concat(words, pairs)


def _met(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` joined with the one row of ``told`` that their key has. Keys of at least one in SHARES of all rows, of which there
    are SHARES at most, are broadcast, so that their rows stay where they are; the others go by a shuffle."""
    rows = staged(rows)
    counts = rows.groupBy("key").count()
    floor = max(1, -(-rows.count() // SHARES))
    hot = staged(counts.filter(F.col("count") >= floor).orderBy(F.desc("count"), "key").limit(SHARES).select("key"))
    few = F.broadcast(told.join(F.broadcast(hot), "key", "left_semi"))
    return rows.join(F.broadcast(hot), "key", "left_anti").join(told, "key").unionByName(rows.join(few, "key"))


def learn(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: list[Rule] | None = None) -> Model:
    """The model of all pages; only sums come to the driver."""
    extra = seeds(pages)
    both = word_counts(pages, url_col, html_col).unionAll(extra.select("word", F.lit(SEED_COUNT).cast("long").alias("n")))
    counts = staged(both.groupBy("word").agg(F.sum("n").alias("n")))
    sizes = counts.groupBy(F.length("word").alias("size")).agg(F.sum("n").alias("n")).collect()  # a row a length
    model = Model(counts, sum(r["n"] for r in sizes), sorted({1, *(r["size"] for r in sizes)}, reverse=True))
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("rule", by_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)["verdict"])
    pages_of = staged(_keyed(ruled).groupBy("key", "rule").agg(F.count(F.lit(1)).alias("pages")))
    words_of = segmented(pages_of.select("key").distinct(), model)
    seeded = F.arrays_overlap("words", F.array(*[F.lit(w) for w in BLOCK_WORDS]))
    blocked = F.coalesce(F.col("rule") == "block", seeded)
    classed = staged(pages_of.join(words_of, "key").select(F.when(blocked, F.col("pages")).otherwise(0).alias("b"), F.when(blocked, 0).otherwise(F.col("pages")).alias("a"), "words"))
    judged = classed.select("b", "a", F.explode(_tokens(F.col("words"))).alias("word"))
    weights = extra.select("word", (F.col("b") * SEED_WEIGHT).alias("b"), (F.col("a") * SEED_WEIGHT).alias("a"))
    classes = staged(judged.select("word", "b", "a").unionAll(weights).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    b, a, kinds = classes.agg(F.sum("b"), F.sum("a"), F.count(F.lit(1))).first()
    # multinomial likelihoods with one more count for every word, and for one that no page has
    blocked_pages, allowed_pages = classed.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    model.prior = math.log(blocked_pages + 1) - math.log(allowed_pages + 1)  # the classes' shares of all pages
    model.unseen = math.log(a + kinds + 1) - math.log(b + kinds + 1)
    model.odds = classes.select("word", (F.log(F.col("b") + 1) - F.log(F.col("a") + 1) + F.lit(model.unseen)).alias("odds"))
    return model


def judge(pages: DataFrame, rules: list[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule (null if none fits), verdict, score (the method's, also where a rule decides), words."""
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = _keyed(pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path")))
    words_of = staged(segmented(rows.select("key").distinct(), model))
    each = words_of.select("key", F.explode(_tokens(F.col("words"))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    odds = each.join(model.odds, "word", "left").groupBy("key").agg(F.sum(F.col("n") * F.coalesce("odds", F.lit(model.unseen))).alias("odds"))
    # a sum's last places depend on its order
    all_odds = F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(model.prior), 9)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), all_odds))))
    scored = _met(rows, staged(words_of.join(odds, "key", "left").select("key", "words", score.alias("score"))))
    ruled = scored.withColumn("__rule", by_rules(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return ruled.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score", "words")


#: The rules of the url filter's contract.
RULES = [Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block")]
