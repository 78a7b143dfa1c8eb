import random
import re
import zlib
from collections import Counter

from pileline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def counts(rows):
    out = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counted):
    near = {w: [v for v in counted if one_edit(w, v)] for w in counted}
    form = {}
    for w in counted:
        best = min(near[w], key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best is not None and counted[best] >= 2 * counted[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counted[w], len(near[w]), counted.get(form[w])) for w in counted}


def told(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abeéñt") for _ in range(r.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "straße", "ÉCOLE", "École"]
    words = []
    for w in base:
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(len(w))
            v = r.choice([w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abxé") + w[k:], w[:k] + r.choice("abzÿ") + w[k + 1 :]])
            words += [v] * r.choice([1, 3, 3, 4, 8, 20])
    r.shuffle(words)
    rows = [(r.choice([i, i, 7, None]), r.choice([" ", "-", "1", ". "]).join(words[i : i + 9]).upper() if i % 5 == 0 else " ".join(words[i : i + 9]), "x", 1) for i in range(0, len(words), 9)]
    return [*rows, (5, None, "x", 1), (6, "", "x", 1), rows[0], rows[0]]


def variants(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return told(spelling.variants(spelling.vocabulary(spelling.slipped(spelling.runs(df)))))


def test_variants_equal_all_pairs(spark):
    rows = sample(1)
    wanted = brute(counts(rows))
    assert variants(spark, rows) == wanted
    assert sum(w[1] is not None for w in wanted) > 20 and any(w[1] != w[2] for w in wanted if w[1])


def test_crowded_keys_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CROWD", 2)
    rows = sample(2)
    assert variants(spark, rows) == brute(counts(rows))


def test_forms_tell_one_letter_out():
    r = random.Random(7)
    for _ in range(300):
        w = "".join(r.choice("abé") for _ in range(r.randrange(5, 12)))
        out, hashes = spelling.forms(w, 3, 2)
        assert out.tolist() == [-1, 0, 1, *range(3, len(w))]
        whole = {}
        for k, h in zip(out.tolist(), hashes.tolist()):
            left = w if k < 0 else w[:k] + w[k + 1 :]
            assert not left or spelling.forms(left, None, None)[1][0] == h
            assert whole.setdefault(left, h) == h


def test_near_words_share_a_rare_bigram_key():
    r = random.Random(9)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(5, 9))) for _ in range(400)]
    freq = Counter(w[p : p + 2] for w in set(words) for p in range(len(w) - 1))
    ranks = {g: k for k, g in enumerate(sorted(freq, key=lambda g: (freq[g], g)))}
    keys = {w: {x for p in spelling.rarest(w, ranks) for x in (("<", w[: p + 2]), (">", w[p:]))} for w in words}
    near = [(a, b) for a in keys for b in keys if a < b and one_edit(a, b)]
    assert len(near) > 300 and all(keys[a] & keys[b] for a, b in near)


def test_very_long_words_empty_tables_and_respelling(spark):
    long = "xyz" * 10_000
    rows = [(1, " ".join([long] * 4), "x", 1), (2, " ".join([long[:7_000] + "q" + long[7_000:]] * 9), "x", 1), (3, "Hellos hello, hello", "x", 1)]
    rows += [(4, "hello hello hello hello hello helo helo helo", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = spelling.variants(spelling.vocabulary(spelling.runs(df).select("run").withColumnRenamed("run", "word"), 4))
    shown = {(w[:6], (f or "")[:6], n, k, m) for w, f, _, n, k, m in told(found)}
    assert shown == {("xyzxyz", "xyzxyz", 4, 1, 9), ("xyzxyz", "", 9, 1, None), ("hello", "", 7, 1, None), ("helo", "hello", 3, 1, 7)}
    again = {r["doc_id"]: r["respelt"] for r in spelling.respelt(df, found).collect()}
    assert again[3] == "hellos hello hello" and again[4] == " ".join(["hello"] * 8)
    assert variants(spark, []) == set()
