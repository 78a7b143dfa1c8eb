import hashlib
import random
import re

from pileline.llm import pii

SCHEMA = "doc_id long, text string, lo string, row string"
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def shown(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def answers(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return pii.digests(pii.spans(df)).collect()


def check(rows, found):
    wanted = sorted((str(r[0]), *[sum(s[3] == k for s in base(r[1])) for k in pii.KINDS], hashlib.sha256(shown(base(r[1])).encode()).hexdigest()) for r in rows)
    assert sorted((str(f["doc_id"]), f["n_email"], f["n_ip"], f["n_card"], f["n_phone"], f["base_sha256"]) for f in found) == wanted


def texts(seed, n):
    r = random.Random(seed)
    atoms = ["a.b@c.de", "é@x.y", "x@y.z_w@q.r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.000255.1.9", "4539 1488-0343 6467", "4539148803436467", "1234 5678", "+1 (203) 555-0101",
             "+49-89.1234567 ", "+1+2 3456789012", "@", ".", "..", " ", "  ", "-", "+", "12", "9", "ß", "𝄞", "\n", "(", ")", "at", "x" * 30]
    return ["".join(r.choice(atoms) for _ in range(r.randrange(0, 30))) for _ in range(n)]


def test_base_spans_equal_plain_loops(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts(1, 400))] + [(7, None, "x", "y"), (None, "mail a@b.cd", "x", "y"), (None, "mail a@b.cd", "x", "y"), (9, "", "x", "y")]
    found = answers(spark, rows)
    check(rows, found)
    assert sum(f["n_email"] for f in found) > 50 and sum(f["n_card"] for f in found) > 20 and sum(f["n_phone"] for f in found) > 20


def test_very_long_texts_and_empty_tables(spark):
    rows = [(1, "7" * 9_000, "x", "y"), (2, "a." * 4_000, "x", "y"), (3, "1.2.3.4 " * 900, "x", "y"), (4, "+(" * 4_000 + "+1", "x", "y"), (5, "1" + " 2" * 4_000, "x", "y")]
    check(rows, answers(spark, rows))
    # so long that the plain loops above would take hours
    rows = [(1, "7" * 300_000, "x", "y"), (2, "a." * 150_000, "x", "y"), (3, "1.2.3.4 " * 20_000, "x", "y"), (4, "+(" * 100_000 + "+1", "x", "y"), (5, "1" + " 2" * 100_000, "x", "y")]
    found = {f["doc_id"]: f for f in answers(spark, rows)}
    assert [(f["n_email"], f["n_ip"], f["n_card"], f["n_phone"]) for _, f in sorted(found.items())] == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 20_000, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert found[3]["spans"] == ",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(20_000))
    assert answers(spark, []) == []


def people(n):
    """Documents with true addresses and numbers, decoys and near misses; the places that a reader would take out besides base."""
    r = random.Random(11)
    rows, near = [], {}
    for i in range(n):
        name, host = r.choice(["ann.lee", "bo_77", "c.diaz"]), r.choice(["mail1.example.com", "corp.example.org"])
        phone = f"1 ({r.randrange(200, 999)}) 555-{r.randrange(10_000):04}"
        said = r.choice(["call me at +" + phone, "write to " + name + "@" + host, f"server {r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.7", f"order {r.randrange(10**9)}", f"version {r.randrange(9)}.{r.randrange(9)}", f"in {r.randrange(1900, 2020)} - {r.randrange(10, 99)}", f"met at noon. Then {i} went", "nothing"])
        text = f"Row text, {said}, and so on."
        if i % 400 == 0:
            text = f"Please call me at {phone}, and so on."
            near[i] = (text.index(phone), text.index(phone) + len(phone))
        rows.append((i, text, "x", "y"))
    return rows, near


def test_boosted_trees_find_near_misses_and_leave_clean_texts_alone(spark):
    rows, near = people(2000)
    found = {f["doc_id"]: f for f in answers(spark, rows)}
    check(rows, found.values())
    more = {i: f["spans"] for i, f in found.items() if f["spans"] != shown(base(rows[i][1]))}
    assert more == {i: f"phone:{a}:{b}" for i, (a, b) in near.items()}


def test_kept_spans_overlap_no_base_and_no_other(spark):
    base = spark.createDataFrame([(1, 0, 10, 20), (1, 2, 50, 60)], "row long, kind int, lo long, hi long")
    names = list(pii.FEATURES)
    rows = [(1, 3, 5, 11, False), (1, 3, 18, 25, False), (1, 3, 5, 9, False), (1, 3, 30, 40, False), (1, 2, 35, 48, False), (1, 3, 61, 70, False), (1, 3, 49, 65, False), (1, 3, 52, 55, False), (2, 3, 12, 18, False), (2, 3, 20, 30, True)]
    spans = spark.createDataFrame([(*r, *([1] * len(names))) for r in rows], "row long, kind int, lo long, hi long, good boolean, " + ", ".join(f"`{n}` int" for n in names))
    kept = pii.added(spans, base, {3: ([0.5], 0.0), 2: ([0.25], 0.0)}).collect()
    assert sorted((r["row"], r["kind"], r["lo"], r["hi"]) for r in kept) == [(1, 3, 5, 9), (1, 3, 30, 40), (1, 3, 61, 70), (2, 3, 12, 18)]


def test_trees_in_sql_equal_trees_in_python(spark):
    r = random.Random(5)
    cells = sorted({tuple(r.randrange(v) for v in pii.FEATURES.values()): 0 for _ in range(300)})
    cells = [(c, n := r.randrange(1, 9), n + (c[0] > 9) * r.randrange(9)) for c in cells]
    trees = pii._boosted(cells, 0.1)
    df = spark.createDataFrame([c[0] for c in cells], ", ".join(f"`{n}` int" for n in pii.FEATURES))
    got = df.selectExpr("*", f"{pii.score(trees)} AS s").collect()
    assert len(trees) > 5 and all(abs(g["s"] - pii._value(trees, tuple(g)[:-1])) < 1e-9 for g in got)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, call +1 (203) 555-0101!"), (2, None), (3, "none")], "doc_id long, text string")
    both = df.join(pii.spans(df), "doc_id")
    assert {r["doc_id"]: r["text"] for r in pii.redacted(both).collect()} == {1: "é [email], call [phone]!", 2: "", 3: "none"}
