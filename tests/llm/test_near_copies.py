import random

import numpy as np
from pileline.llm import candidates, simhash
from pyspark.sql import functions as F


def shingle_set(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def classes(docs, similarity=0.8):
    """Least id of each document's class, pair by pair."""
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def planted():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    docs = [[r.choice(words) for _ in range(r.randrange(60, 500))] for _ in range(120)]
    out = [" ".join(d) for d in docs]
    for d in docs[:60]:
        for _ in range(r.randrange(1, 4)):
            w = list(d)
            for _ in range(r.randrange(0, 1 + len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += [None, "", " \n", "one", "ONE", "two words"]
    return list(enumerate(out))


def test_planted_copies_are_found_and_others_left(spark):
    docs = planted()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int")
    got = {x.doc_id: x.component_id for x in simhash.near_copies(df.select("doc_id", "text")).collect()}
    want = classes(docs)
    assert set(got) == set(want)
    right = sum(got[d] == want[d] for d in want)
    assert right >= 0.98 * len(want), right
    alone = {d for d in want if sum(w == want[d] for w in want.values()) == 1}
    # the estimate is exact up to 256 shingles and has a standard error of 0.025 above, so a class at the limit may differ
    assert sum(got[d] != d for d in alone) <= 2
    kept = {x.doc_id for x in simhash.keep_one(df).collect()}
    assert kept == {d for d in got if got[d] == d}


def test_families_of_documents_are_linked_past_the_hub(spark):
    # 300 texts of one template, pairs of them alike (0.87), across pairs not (0.71)
    r = random.Random(15)
    own = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    template, docs = own(170), []
    for _ in range(150):
        mine = own(20)
        docs += [" ".join(template + mine + own(12)), " ".join(template + mine + own(12))]
    docs = list(enumerate(docs))
    want = {d: d - d % 2 for d, _ in docs}
    assert classes(docs) == want
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want)
    assert all(got[d] == d for d in want if d % 2 == 0)


def test_words_between_documents_of_a_mix_keep_their_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y")], "doc_id long, text string, source string")
    assert [x.doc_id for x in simhash.keep_one(df.withColumn("extra", F.lit(1))).collect()] == [1, 1]
    assert simhash.keep_one(df.limit(0)).count() == 0


def blocks():
    """Pairs (2k, 2k + 1) with an appended, a dropped or a replaced block, of likeness 0.80 to 0.90."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    out = []
    for k in range(150):
        base = some(r.randrange(150, 1200))
        n = len(base) - 4
        if k % 3 == 0:
            other = base + some(int(n * r.uniform(0.12, 0.24)))
        elif k % 3 == 1:
            other = base[int(n * r.uniform(0.11, 0.19)) :]
        else:
            m = int(n * r.uniform(0.06, 0.10))
            at = r.randrange(n - m)
            other = base[:at] + some(m) + base[at + m :]
        out += [" ".join(base), " ".join(other)]
    return list(enumerate(out))


def test_edits_in_blocks_are_found(spark):
    docs = blocks()
    want = classes(docs)
    assert sum(want[d] != d for d in want) >= 140
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_long_texts_at_the_limit_are_judged_by_all_their_shingles(spark):
    r = random.Random(13)
    docs = []
    for k in range(20):
        base = [f"w{r.getrandbits(40)}" for _ in range(3004)]
        # 3,000 shingles; 3,730 / 3,770 in the longer text: likeness 0.804 and 0.796
        docs += [" ".join(base), " ".join(base + [f"w{r.getrandbits(40)}" for _ in range(730 if k % 2 else 770)])]
    docs = list(enumerate(docs))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d - 1 if d % 4 == 3 else d for d, _ in docs}


def test_common_shingles_do_not_hide_near_copies(spark):
    r = random.Random(14)
    common = " ".join(f"c{k}" for k in range(60))
    own = [" ".join(f"w{r.getrandbits(40)}" for _ in range(60)) for _ in range(200)]
    docs = list(enumerate([f"{common} {x}" for x in own] + [f"{common} {x} end" for x in own[:20]]))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d - 200 if d >= 200 else d for d, _ in docs}


def test_candidates_may_differ_in_the_sign_bit(spark):
    keyed = spark.createDataFrame([(1, 10, -(2**63)), (1, 11, 1), (1, 12, -1)], "key long, id long, bits long")
    got = candidates.grouped(keyed, candidates.within(2)).collect()
    assert {(x.loud, x.a, x.b) for x in got} == {(False, 10, 11)}
    got = candidates.grouped(keyed, simhash.within_ring(2), crowd=2).collect()
    assert {(x.loud, x.a, x.b, x.c) for x in got} == {(True, 1, 10, -(2**63)), (True, 1, 11, 1), (True, 1, 12, -1)}


def test_the_ring_lets_all_near_fingerprints_through():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 20000, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (20000, 26), dtype=np.uint64), axis=1)
    assert simhash.within_ring(26)(flips).all()
    b = r.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (simhash.within_ring(26)(a ^ b) == (np.bitwise_count(a ^ b) <= 26)).all()


def test_null_ids_names_and_bands(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, text, 1, 2), (5, text.upper(), 3, 4), (6, None, 5, 6), (7, "", 7, 8)], "doc_id long, text string, __gone long, id long")
    assert sorted((x.doc_id, x["__gone"], x["id"]) for x in simhash.keep_one(df).collect()) == [(5, 3, 4), (6, 5, 6)]
    # 4,000 pairs of 360 shared shingles and 45 of its own each: likeness 0.8
    r = random.Random(16)
    left, right = [], []
    for _ in range(4000):
        base = [f"{r.getrandbits(30):x}" for _ in range(364)]
        left.append(" ".join(base + [f"{r.getrandbits(30):x}" for _ in range(45)]))
        right.append(" ".join(base + [f"{r.getrandbits(30):x}" for _ in range(45)]))
    keys = [simhash.band_keys(*simhash.shingle_sets(x, 5)) for x in (left, right)]
    assert (keys[0] == keys[1]).any(axis=0).mean() >= 0.998


def test_chains_of_the_fingerprints_alone_find_all_within_two_bits(spark, monkeypatch):
    # no two texts share a band
    monkeypatch.setattr(simhash, "band_keys", lambda values, sizes: np.random.default_rng().integers(1, 2**62, (20, sizes.size)).astype(np.uint64))
    r = random.Random(21)
    bits = lambda t: simhash.majority(simhash._mixed(simhash.shingle_sets([t], 5)[0])) & (2**64 - 1)
    docs = []
    while len(docs) < 80:
        base = [f"w{r.getrandbits(40)}" for _ in range(60)]
        other = " ".join(base + [f"w{r.getrandbits(40)}" for _ in range(2)])
        if 0 < (bits(" ".join(base)) ^ bits(other)).bit_count() <= 2:
            docs += [" ".join(base), other]
    docs = list(enumerate(docs))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in docs}
