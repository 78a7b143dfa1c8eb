import hashlib
import random
import re

import pytest
from pileline.llm import iblt
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def paragraphs(t):
    return {x for x in (p.strip(SPACES) for p in re.split(r"\n+|(?<=[.!?])[ \t\r\x0b\f]+", t)) if x}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_against_sets(spark):
    r = random.Random(2)
    lines = [" ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(6)) + "." for _ in range(400)]
    docs = [(3 * k, "\n".join(r.choice(lines) for _ in range(r.choice([1, 2, 5, 30, 80])))) for k in range(120)]
    docs += [(1, None), (4, ""), (7, "no end"), (10, "\n".join(f"line {k}" for k in range(900))), (13, "ü. \U0001f600! x? y"), (16, "a"), (17, "a")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fingerprint string")
    got = {x.doc_id: x for x in iblt.compared(df).collect()}
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    assert len(got) == len(docs)
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(x.near_edited - jaccard(paragraphs(t), paragraphs(edited))) < 1e-9 and abs(x.near_next - jaccard(paragraphs(t), paragraphs(after))) < 1e-9
    assert got[16].fingerprint == got[17].fingerprint and got[1].fingerprint == got[4].fingerprint
    same = {x.doc_id: x.fingerprint for x in iblt.fingerprints(df).collect()}
    assert same == {d: x.fingerprint for d, x in got.items()}


def test_all_differences_are_recovered_at_any_size(spark):
    r = random.Random(3)
    pairs, want = [], {}
    for k, n in enumerate((0, 1, 5, 40, 700)):
        both, one, two = ({r.getrandbits(64) - 2**63 for _ in range(n)} for _ in range(3))
        pairs.append((k, sorted(both | one), sorted(both | two)))
        want[k] = sorted((both | one) ^ (both | two))
    found = iblt.differences(spark.createDataFrame(pairs, "pair long, a array<long>, b array<long>"))
    got = {x.pair: sorted(x.all) for x in found.groupBy("pair").agg(F.flatten(F.collect_list("found")).alias("all")).collect()}
    assert got == want


def test_small_tables(spark):
    one = spark.createDataFrame([(5, "x. y.")], "doc_id long, text string")
    x = iblt.compared(one).first()
    assert x.near_next == 1.0 and x.n_chars == 5
    assert iblt.compared(one.limit(0)).count() == 0


def test_ids_that_are_no_numbers_are_an_error(spark):
    with pytest.raises(TypeError, match="numbers"):
        iblt.compared(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_many_cuts_are_one_literal_and_change_nothing(spark):
    docs = spark.range(3000).selectExpr("id * 7 - 900 AS doc_id", "concat('line ', id % 11, '. more ', id % 5) AS text")
    few = iblt.compared(docs.limit(3000)).groupBy().agg(F.bit_xor(F.xxhash64("doc_id", "edited_sha256", "near_next"))).first()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        cut = docs.select(iblt._group(docs, "doc_id").alias("g"))
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and cut.distinct().count() > 1000
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert iblt.compared(docs).groupBy().agg(F.bit_xor(F.xxhash64("doc_id", "edited_sha256", "near_next"))).first() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
