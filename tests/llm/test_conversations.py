import hashlib
import random
import re
import zlib

from pileline.llm import conversations as cv

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, id string"
NONE = hashlib.sha256(b"").hexdigest()


def broken(rows):
    """The contract's damage, by plain loops: {conv_id: rows (turn, role, text) in order}."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        turns = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        turns += [(turn, role, text)] * (2 if kind == 3 else 1)
    for turns in out.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    return out


def brute(turns):
    """All counts and the cheapest, then least audit by a table of (cost, audit, repaired) a state, forward."""
    nums = [t for t, _, _ in turns if t is not None]
    gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step.get((q, role[0]))
                    new = (cost + 3, audit + "I", (*lines, role + ":"))
                    if to and (to not in best or new < best[to]):
                        best[to] = new
        return best

    for (_, role, text), fault in zip(turns, faults):
        best, after = inserts(best), {}
        for q, (cost, audit, lines) in best.items():
            moves = [(4, "D", q, ())]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                moves += [(more, "K", step.get((q, role[:1])), (role + ":" + text,))]
                moves += [(3 + more, "R", step.get((q, r[0])), (r + ":" + text,)) for r in ("user", "assistant")]
            for c, e, to, line in moves:
                new = (cost + c, audit + e, lines + line)
                if to is not None and (to not in after or new < after[to]):
                    after[to] = new
        best = after
    best = inserts(best)
    cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
    count = faults.count
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def answers(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = cv.report(cv.damaged(df), copies="copies").collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in found}


def sample(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"])
            text = r.choice(["Yes.", "No!", "so", "  \n", "", None, f"é {t}?", "words . ", f"line {r.randrange(5)}."])
            rows.append((r.choice([c, c, c, c, None]) if c % 7 == 0 else c, r.choice([t, t, t, None, t + 2]), role, text, "x"))
    return rows


def test_all_small_sequences_are_solved_at_least_cost():
    r = random.Random(3)
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", "d"), ("assistant", "e"), ("tool", "f."), ("user", " "), ("system", "g")]
    for _ in range(3000):
        turns = [(i, role, text + str(i) + "." if text[-1] == "." else text + (str(i) if text.strip() else "")) for i, (role, text) in enumerate(r.choices(kinds, k=r.randrange(0, 7)))]
        signs = "".join(cv.symbol(role, text, False) for _, role, text in turns)
        audit = cv.solved(signs)
        lines = [f"{x['role']}:{x['text']}" for x in cv.edited([t[1:] for t in turns], audit)]
        assert (cv.cost_of(signs, audit), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()) == brute(turns)[5:]


def test_distances_fold_over_blocks():
    r = random.Random(4)
    for _ in range(200):
        signs = "".join(r.choices("xsuaoSUAO", k=r.randrange(1, 30)))
        cut = r.randrange(0, len(signs) + 1)
        goal = cv.END
        for part in (signs[cut:], signs[:cut]):
            m = cv.matrix(part)
            goal = tuple(min(m[4 * q + k] + goal[k] for k in range(4)) for q in range(4))
        assert list(goal) == cv.distances(signs, cv.END)[:4]


def test_report_equals_plain_loops(spark):
    rows = sample(1, 60, 14)
    found, wanted = answers(spark, rows), {k: brute(v) for k, v in broken(rows).items()}
    assert found == wanted


def test_long_conversations_in_blocks_give_the_same(spark, monkeypatch):
    rows = sample(2, 12, 10) + [(5, 1, "user", "Same.", "x")] * 40 + [(5, t % 9, random.Random(t).choice(["user", "assistant"]), f"t {t % 23}.", "x") for t in range(300)]
    rows += [(77, t, "user", "gone.", "x") for t in range(4000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0]
    whole = answers(spark, rows)
    monkeypatch.setattr(cv, "LONG", 30)
    monkeypatch.setattr(cv, "BLOCK", 7)
    monkeypatch.setattr(cv, "BUCKETS", 5)  # short conversations share the bucket of a long one, and one without rows, too
    assert answers(spark, rows) == whole == {k: brute(v) for k, v in broken(rows).items()}
    assert whole[77] == (0, 0, 0, 0, 0, 0, "", NONE)


def test_repaired_turns_and_odd_tables(spark):
    rows = [(1, 0, "assistant", "Hi.", "x"), (1, 1, "user", "What", "y"), (2, None, None, None, "z"), (3, 5, "user", "a." * 3_000_000, "v")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r["conv_id"], r["place"], r["role"], r["text"][:5]) for r in cv.repaired(df).collect())
    assert [(c, role, text) for c, _, role, text in found] == [(1, "user", ""), (1, "assistant", "Hi."), (3, "user", "a.a.a"), (3, "assistant", "")]
    assert cv.report(df.limit(0)).collect() == []
    assert cv.report(cv.damaged(df.limit(0)), copies="copies").columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
