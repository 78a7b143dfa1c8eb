import random

import numpy as np
import pytest
import xxhash
from pileline.llm import simhash


def brute_fp(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, tau):
    ids = sorted(items)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (items[a] ^ items[b]).bit_count() <= tau:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprint_and_components_against_brute_force(spark):
    r = random.Random(3)
    base = " ".join(r.choice("ab cd ef gh ij kl Mn op qr".split()) for _ in range(300))
    texts = [None, "", " \t\n", "one", "One TWO", "one two three", "É é ça va bien", base, base, base + " x"]
    for _ in range(60):
        w = base.split()
        w[r.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {x.doc_id: x for x in simhash.near_duplicates(df).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: got[i].fp & (2**64 - 1) for i in fps} == fps
    assert {i: got[i].component_id for i in fps} == brute_components(fps, 2)


@pytest.mark.parametrize("crowd,tau", [(128, 2), (3, 2), (3, 1), (3, 3), (128, 3)])
def test_links_connect_what_brute_force_connects(spark, crowd, tau):
    r = random.Random(crowd * 10 + tau)
    values = set()
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    signed = {v: int(np.uint64(v).astype(np.int64)) for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = simhash.links(df, tau, crowd).collect()
    back = {s: v for v, s in signed.items()}
    up = {v: v for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in links:
        a, b = back[x.u], back[x.v]
        up[root(a)] = root(b)
    want = brute_components(dict.fromkeys(values) | {v: v for v in values}, tau)
    groups = {}
    for v in values:
        groups.setdefault(root(v), set()).add(v)
    wanted = {}
    for v in values:
        wanted.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
