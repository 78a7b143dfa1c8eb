import random

import numpy as np
from pileline.llm import candidates, lines, simhash

SPACES = " \t\n\x0b\x0c\r"


def brute(docs, similarity=0.8):
    items = [(d, n, raw.strip(SPACES).lower()) for d, t in docs for n, raw in enumerate((t or "").split("\n")) if raw.strip(SPACES)]
    sets = [lines.shingles(x[2]) for x in items]
    up = list(range(len(items)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if lines.jaccard(sets[a], sets[b]) >= similarity:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    first = {}
    for k, x in enumerate(items):
        r = root(k)
        first[r] = min(first.get(r, x[:2]), x[:2])
    return {x[:2]: first[root(k)] for k, x in enumerate(items)}


def sample():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(12, 60))) for _ in range(25)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(base).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(words)
            own.append(" ".join(w))
        docs.append((d, "\n".join(own)))
    return docs + [(60, None), (61, ""), (62, "a\n\n a \nA\nbb"), (63, "a"), (64, "\n \n"), (65, "ünï " * 3000)]


def test_classes_against_brute_force(spark):
    docs = sample()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, kept string")
    got = {(x.doc_id, x.line_no): (x.class_doc, x.class_line) for x in lines.judged_lines(df).collect()}
    want = brute(docs)
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)  # banding finds 0.995 of the pairs at the limit, more above it


def test_dedup_keeps_first_lines_and_blank_ones(spark):
    df = spark.createDataFrame([(1, "x one two three\n\ny", "s"), (2, "X one two three", "s"), (3, "X one two three\nnew", "s"), (4, "", "s"), (5, None, None)], "doc_id long, text string, __doc string")
    got = {x.doc_id: x.text for x in lines.dedup_lines(df).collect()}
    assert got == {1: "x one two three\n\ny", 3: "new", 4: "", 5: None}


def test_empty_table(spark):
    assert lines.judged_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def likeness(left, right):
    """Jaccard likeness of the shingle sets of left[k] and right[k]."""
    (a, na), (b, nb) = lines.shingle_sets(left), lines.shingle_sets(right)
    values, sizes = np.concatenate((a, b)), np.concatenate((na, nb))
    at = np.arange(len(left))
    both = candidates._shared(values, np.cumsum(sizes) - sizes, sizes, at, at + len(left))
    return both / (na + nb - both)


def test_likeness_is_that_of_the_shingle_sets():
    r = random.Random(2)
    for n in (1, 2, 500, 5000):
        many = ["".join(r.choice("abc ü") for _ in range(r.randrange(1, 40))) for _ in range(2 * n)]
        many[-1] = many[0]
        left, right = many[:n], [x + many[k % 3] if k % 2 else x for k, x in enumerate(many[n:])]
        want = [lines.jaccard(lines.shingles(a), lines.shingles(b)) for a, b in zip(left, right, strict=True)]
        assert likeness(left, right).tolist() == want


def linked(spark, items, sets, **options):
    """(node, root) of items (id, bits, key) with their sets."""
    payloads = spark.createDataFrame(list(sets.items()), "id long, payload array<long>")
    df = spark.createDataFrame(items, "id long, bits long, k long")
    got = candidates.linked_components(df, ["k"], candidates.within(12), lambda ids: payloads.join(ids, "id"), simhash._payload_sets, 0.8, **options)
    return {(x.node, x.root) for x in got.collect()}


def test_members_of_a_crowded_key_are_linked_past_the_hub(spark):
    # 200 items share one key: pairs (2k, 2k + 1) are alike, every other two and the hub are not
    items, sets = [(k, 0, 7) for k in range(200)], {k: [0, 1, *range(100 * (k // 2 + 1), 100 * (k // 2 + 1) + 20)] for k in range(200)}
    for options in ({"block": 16}, {"crowd": 500}):
        assert linked(spark, items, sets, **options) == {(2 * k + 1, 2 * k) for k in range(100)}
    # so many rows that the sample of keys sees them
    items, sets = [(k, 0, 7) for k in range(3000)], {k: [0, 1, *range(100 * (k // 2 + 1), 100 * (k // 2 + 1) + 20)] for k in range(3000)}
    assert linked(spark, items, sets) == {(2 * k + 1, 2 * k) for k in range(1500)}


def test_a_crowded_family_is_one_component_and_strangers_stay_out(spark):
    base = list(range(100, 200))
    sets = {k: sorted([*base, 1000 + k]) for k in range(300)} | {k: [0, 1, k * 10000] for k in range(300, 340)}
    items = [(k, 0, 7) for k in sets]
    for options in ({"block": 32}, {}):
        assert linked(spark, items, sets, **options) == {(k, 0) for k in range(1, 300)}


def test_a_family_of_lines_of_one_template(spark):
    # 400 lines, pairs of them alike (0.90), across pairs not (0.79 at most): they share many band keys
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, rows = text(150), []
    for _ in range(200):
        own = text(14)
        rows += [template + own + text(9), template + own + text(9)]
    sets = [lines.shingles(x) for x in rows]
    assert min(lines.jaccard(sets[2 * k], sets[2 * k + 1]) for k in range(200)) >= 0.8
    assert max(lines.jaccard(sets[a], sets[b]) for a in range(400) for b in range(a) if a // 2 != b // 2) < 0.8
    for n in (60, 400):  # below and above the size of a crowded key
        df = spark.createDataFrame(list(enumerate(rows[:n])), "doc_id long, text string")
        got = {x.doc_id: x.class_doc for x in lines.judged_lines(df).collect()}
        assert sum(got[2 * k + 1] == 2 * k for k in range(n // 2)) >= 0.98 * n / 2
        assert all(got[2 * k] == 2 * k for k in range(n // 2))


def test_null_and_repeated_ids_and_clashing_names(spark):
    # in a class with a null id, that is the first; of lines that rows of one id share, one stays
    df = spark.createDataFrame([(None, "a b c\nd"), (None, "a b c"), (1, "a b c"), (1, "a b c\nzz"), (1, "a b c\nzz")], "doc_id long, text string")
    kept = [(x.doc_id, x.line_no) for x in lines.judged_lines(df).collect() if x.kept]
    assert sorted(kept, key=str) in ([(1, 1), (None, 0), (None, 1)], [(1, 1), (None, 1), (None, 0)])
    left = sorted((str(x.doc_id), x.text) for x in lines.dedup_lines(df).collect())
    assert left in ([("1", "zz"), ("None", "a b c\nd")], [("1", "zz"), ("None", "a b c"), ("None", "d")])
    one = lines.judged_lines(spark.createDataFrame([(None, "a b c\nd"), (-3, "A b c"), (2, "a b c")], "doc_id long, text string"))
    assert sorted((x.doc_id or 0, x.class_doc, x.class_line, x.kept) for x in one.collect()) == [(-3, None, 0, False), (0, None, 0, True), (0, None, 1, True), (2, None, 0, False)]
    names = "__doc __copy __no __d __c __drop __new __again __text hi lo id at".split()
    odd = spark.createDataFrame([("b", "x y z", *names), ("a", "X y z\nw", *names), ("a", "w", *names)], ", ".join(f"{c} string" for c in ["key", "text", *names]))
    out = lines.dedup_lines(odd, "key").collect()
    assert all(list(x)[2:] == names for x in out) and sorted(x.text for x in out) in (["X y z", "w"], ["X y z\nw"])


def test_bands_and_sketch_find_pairs_at_the_limit():
    # 20,000 pairs of lines with 40 shingles in common and five of its own in each: likeness 0.8
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    left, right = [], []
    for _ in range(20_000):
        base = text(46)
        left.append(base + "A" + text(4))
        right.append(base + "B" + text(4))
    assert set(likeness(left, right)) == {0.8}
    (a, x), (b, y) = lines.signatures(left), lines.signatures(right)
    assert (a == b).any(axis=1).mean() >= 0.993
    share = (a == b).any(axis=1) & (np.bitwise_count(x ^ y) <= lines.ALLOWED)
    assert share.mean() >= 0.993
