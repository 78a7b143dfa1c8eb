"""Conversation structure repair by shortest paths.

The turns of a conversation are the layers of a graph; a node is a layer and a state of the grammar ``(s?(ua)+)?`` of role
initials (start, after system, after user, after assistant). Arcs are edits with small whole costs: Keep 0, Rerole to user or
assistant 3, Delete 4, Insert an empty user or assistant turn 3; a truncated turn that isn't deleted costs 3 more; blank and
duplicate turns can only be deleted. Dial's bucket queue gives each node's distance to the end, and a walk along tight arcs
that takes the edit of the least initial first gives the audit.

Conversations are dealt by id, one pass each. Long ones (over LONG rows or LONG_BYTES, told from counts of all rows) are cut into
blocks instead: rows are placed by range of (id, turn, role, text), so that several tasks share one conversation. A block's
four-by-four matrix of distances is folded from the conversation's end, which gives each block the distances at its exit; its
walks from all four states are then known, and a fold from the beginning picks one. What a single task reads of a long
conversation is one small row a block. Only the digest of a repaired text is taken in order by one task, as SHA-256 allows
nothing else; it holds one block at a time.

Defined results: a null role or text is one space; a null turn comes first and counts for no gap; a null id is a conversation
of its own; rows of one turn stand by role, then text (both by code point), so repeated rows are neighbours. An initial is the
role's first character; other initials than s, u and a are in no sentence of the grammar. An empty table gives no rows.
Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import SPACES, each, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: A conversation of more rows or bytes than these is cut into blocks of at most BLOCK rows or BLOCK_BYTES.
LONG, LONG_BYTES, BLOCK, BLOCK_BYTES = 4_096, 32_000_000, 2_048, 8_000_000
#: Long conversations are told by a hash of the id of so many values, a table of fixed size; short ones that share one go the long way, to the same result.
BUCKETS = 1 << 18
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
START = 0
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The turn that Rerole and Insert make in a state, and the state after it.
MADE, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Cost of ending in a state, and the inserts that it takes.
END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}
_SOLID = re.compile(r"[^\x20\x09-\x0D]")


def symbol(role: str, text: str, seen: bool) -> str:
    """One letter for what edits a turn allows: x has to go; else its initial, or o for another; a capital for a truncated one."""
    if seen or not _SOLID.search(text):
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter if text.rstrip(SPACES)[-1] in ".!?" else letter.upper()


def _arcs(sign: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of a turn, by initial."""
    out = [("D", DELETE, state)]
    if sign != "x":
        more = TRUNCATED if sign.isupper() else 0
        if sign.lower() in NEXT[state]:
            out.append(("K", KEEP + more, NEXT[state][sign.lower()]))
        out.append(("R", REROLE + more, AFTER[state]))
    return out


_FORTH = {c: [_arcs(c, q) for q in range(4)] for c in "xsuaoSUAO"}
_BACK = {c: [[(q, cost) for q in range(4) for _, cost, to in arcs[q] if to == p] for p in range(4)] for c, arcs in _FORTH.items()}
_INSERTED = [[q for q in range(4) if AFTER[q] == p] for p in range(4)]


def distances(signs: str, goal: tuple[int, ...]) -> list[int]:
    """Cost from node 4 * turn + state to the exit after the last turn, where state q costs ``goal[q]``, by Dial's bucket queue:
    costs are small, so nodes wait in a ring of buckets, one a cost, and no heap is needed."""
    n = len(signs)
    dist = [FAR] * (4 * n + 4)
    known = [g for g in goal if g < FAR]
    base = min(known)
    span = max(REROLE + TRUNCATED, DELETE, INSERT, max(known) - base) + 1
    ring: list[list[int]] = [[] for _ in range(span)]
    for q, g in enumerate(goal):
        if g < FAR:
            dist[4 * n + q] = g
            ring[(g - base) % span].append(4 * n + q)
    waiting, at = len(known), 0
    while waiting:
        bucket = ring[at % span]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            d = at + base
            if dist[node] != d:
                continue  # it was reached at less cost
            i, p = divmod(node, 4)
            before = [(4 * i + q, d + INSERT) for q in _INSERTED[p]] if i < n else []
            if i:
                before += [(4 * i - 4 + q, d + cost) for q, cost in _BACK[signs[i - 1]][p]]
            for prior, cost in before:
                if cost < dist[prior]:
                    dist[prior] = cost
                    ring[(cost - base) % span].append(prior)
                    waiting += 1
        at += 1
    return dist


def walk(signs: str, dist: list[int], state: int) -> tuple[str, int]:
    """The least audit along tight arcs from ``state`` at the first turn to the exit, and the state there."""
    i, n, out = 0, len(signs), []
    while i < n:
        here = dist[4 * i + state]
        arcs = _FORTH[signs[i]][state]
        choices = [(arcs[0][0], arcs[0][1], 1, arcs[0][2]), ("I", INSERT, 0, AFTER[state]), *((k, c, 1, to) for k, c, to in arcs[1:])]
        for initial, cost, step, to in choices:
            if dist[4 * (i + step) + to] + cost == here:
                out.append(initial)
                i, state = i + step, to
                break
        else:
            raise RuntimeError("no tight arc")
    return "".join(out), state


@lru_cache(maxsize=65_536)
def solved(signs: str) -> str:
    """The audit of a whole conversation."""
    audit, state = walk(signs, distances(signs, END), START)
    return audit + TAIL[state]


def matrix(signs: str) -> list[int]:
    """Distances of a block from each state at its beginning to each state at its exit, row by row."""
    columns = [distances(signs, tuple(0 if q == k else FAR for q in range(4))) for k in range(4)]
    return [columns[k][q] for q in range(4) for k in range(4)]


def cost_of(signs: str, audit: str) -> int:
    costs, turns = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}, iter(signs)
    out = 0
    for edit in audit:
        out += costs[edit]
        if edit != "I" and next(turns).isupper() and edit != "D":
            out += TRUNCATED
    return out


def edited(turns: list[tuple[str, str]], audit: str, state: int = START) -> list[dict]:
    """The turns (role, text) after the edits of an audit that begins in ``state``."""
    rest, out = iter(turns), []
    for edit in audit:
        role, text = (MADE[state], "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            role, state = MADE[state], AFTER[state]
        out.append({"role": role, "text": text})
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: One row a conversation or a block of one; ``turns`` are its different ones that aren't null, of ``low`` to ``high``.
_PIECE = "piece long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _facts(rows: list[tuple], seen: list[bool]) -> dict:
    """What is counted of rows (turn, role, text) that stand in order, and their symbols."""
    marks = [symbol(role, text, old) for (_, role, text), old in zip(rows, seen, strict=True)]
    blank = sum(m == "x" and not _SOLID.search(t) for m, (_, _, t) in zip(marks, rows, strict=True))
    initials = [role[:1] for _, role, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    return {
        "signs": "".join(marks), "blank": blank, "duplicate": marks.count("x") - blank, "truncated": sum(m.isupper() for m in marks), "turns": len(turns),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "low": min(turns, default=None), "high": max(turns, default=None),
    }


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _grouped(batches, names: tuple[str, ...]) -> Iterator[tuple[object, list[tuple]]]:
    """Of sorted batches whose first column is a key: (key, rows of the other columns), one key after the other."""
    key, rows, first = None, [], True
    for batch in batches:
        columns = [each(c) if pa.types.is_string(c.type) else iter(c.to_pylist()) for c in (batch.column(n) for n in names)]
        for k, *row in zip(*columns, strict=True):
            if not first and not _same(k, key):
                yield key, rows
                rows = []
            key, first = k, False
            rows.append(tuple(row))
    if not first:
        yield key, rows


class _Out:
    """Rows that leave a task in batches of about two megabytes of text."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 200
        if self.size > 2_000_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0


def _piece_schema(id_type: pa.DataType) -> pa.Schema:
    whole = [("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _TURNS)]
    return pa.schema([("id", id_type), ("piece", pa.int64()), *whole])


def _short(rows: DataFrame) -> DataFrame:
    """Pieces of conversations that fit into memory, one each, from (id, turn, role, text, copies)."""

    def run(batches):
        out = None
        for key, turns in _grouped(batches, ("id", "turn", "role", "text", "copies")):
            out = out or _Out(schema)
            kept = [row[:3] for row in turns for _ in range(row[3])]
            known: set[tuple[str, str]] = set()
            seen = []
            for _, role, text in kept:
                seen.append((role, text) in known)
                known.add((role, text))
            facts = _facts(kept, seen)
            signs = facts.pop("signs")
            audit = solved(signs) if len(signs) <= 64 else solved.__wrapped__(signs)
            repaired = edited([r[1:] for r in kept], audit)
            yield from out.put({"id": key, "piece": 0, **facts, "cost": cost_of(signs, audit), "audit": audit, "repaired": repaired}, sum(len(r[2]) for r in kept))
        if out:
            yield from out.flush()

    schema = _piece_schema(_arrow(rows, "id"))
    dealt = rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_PIECE}")


def _arrow(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def _blocked(rows: DataFrame) -> DataFrame:
    """(id, turn, role, text, block, k, hi, lo): rows in order; blocks of a conversation ascend in order, k counts a block's rows."""

    def run(batches):
        shelf, key, k, size, first = TaskContext.get().partitionId() << 32, None, 0, 0, True
        for batch in batches:
            blocks, places, marks = [], [], []
            for i, role, text in zip(batch.column(0).to_pylist(), each(batch.column(2)), each(batch.column(3)), strict=True):
                if first or not _same(i, key) or k + 1 == BLOCK or size > BLOCK_BYTES:
                    shelf, k, size = shelf + 1, -1, 0
                key, first, k, size = i, False, k + 1, size + len(text)
                blocks.append(shelf)
                places.append(k)
                marks.append(xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")))
            halves = [pa.array([int.from_bytes(m[a : a + 8], "big", signed=True) for m in marks], pa.int64()) for a in (0, 8)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), *halves], names=[*batch.schema.names, "block", "k", "hi", "lo"])

    # a whole group of equal rows can be cut by the salt; which of them is where doesn't matter
    salted = rows.select("id", "turn", "role", "text", F.monotonically_increasing_id().alias("salt"))
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = salted.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order).drop("salt")
    return staged(placed.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, turn long, role string, text string, block long, k int, hi long, lo long"))


def _long(rows: DataFrame) -> DataFrame:
    """Pieces of conversations of any length, one a block, from (id, turn, role, text)."""
    id_type, id_arrow = rows.schema["id"].dataType.simpleString(), _arrow(rows, "id")
    placed = _blocked(rows)
    slim = placed.select("id", "hi", "lo", F.struct("block", "k").alias("at"))
    firsts = staged(slim.groupBy("id", "hi", "lo").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    f = firsts.select(F.col("id").alias("fid"), F.col("hi").alias("fhi"), F.col("lo").alias("flo"), "first")
    later = slim.join(f, F.col("id").eqNullSafe(F.col("fid")) & (F.col("hi") == F.col("fhi")) & (F.col("lo") == F.col("flo"))).filter("at > first")
    repeats = staged(later.groupBy(F.col("at.block").alias("block")).agg(F.collect_list("at.k").alias("repeats")))  # at most BLOCK

    fact_schema = pa.schema([("block", pa.int64()), ("id", id_arrow), ("signs", pa.string()), *((c, pa.int64()) for c in (*_COUNTS, "turns", "low", "high")), ("head", pa.string()), ("last", pa.string()), ("matrix", pa.list_(pa.int64()))])

    def look(batches):
        out = _Out(fact_schema)
        for block, turns in _grouped(batches, ("block", "id", "turn", "role", "text", "k", "repeats")):
            again = set(turns[0][5] or ())
            facts = _facts([t[1:4] for t in turns], [t[4] in again for t in turns])
            facts |= {"head": turns[0][2][:1], "last": turns[-1][2][:1], "matrix": matrix(facts["signs"])}
            yield from out.put({"block": block, "id": turns[0][0], **facts}, len(turns))
        yield from out.flush()

    marked = placed.join(repeats, "block", "left").withColumn("repeats", F.when(F.col("k") == 0, F.col("repeats")))
    seen = marked.repartition("block").sortWithinPartitions("block", "k")
    counts = "".join(f"{c} long, " for c in (*_COUNTS, "turns", "low", "high"))
    blocks = staged(seen.mapInArrow(look, f"block long, id {id_type}, signs string, {counts}head string, last string, matrix array<long>"))

    def goals(batches):
        for key, some in _streamed(batches):
            goal = END
            for block, m in some:
                yield {"block": block, "goal": list(goal)}
                goal = tuple(min(m[4 * q + k] + goal[k] for k in range(4)) for q in range(4))

    goal_schema = pa.schema([("block", pa.int64()), ("goal", pa.list_(pa.int64()))])
    backward = blocks.select("id", "block", "matrix").repartition("id").sortWithinPartitions("id", F.col("block").desc())
    wanted = backward.mapInArrow(lambda batches: _rows_out(goals(batches), goal_schema), "block long, goal array<long>")

    def walks(batches):
        for batch in batches:
            exits, audits = [], []
            for signs, goal in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                dist = distances(signs, tuple(goal))
                found = [walk(signs, dist, q) if dist[q] < FAR else ("", 0) for q in range(4)]
                exits.append([s for _, s in found])
                audits.append([a for a, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exits, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=["block", "exits", "audits"])

    walked = staged(blocks.select("block", "signs").join(wanted, "block").mapInArrow(walks, "block long, exits array<long>, audits array<string>"))

    def entries(batches):
        for key, some in _streamed(batches):
            state, before, last_turn, held = START, None, None, None
            for block, exits, head, last, low, high in some:
                if held:
                    yield held
                held = {"block": block, "entry": state, "bad": int(before is not None and before + head not in LEGAL), "shared": int(low is not None and low == last_turn), "tail": ""}
                state, before, last_turn = exits[state], last, high if high is not None else last_turn
            held["tail"] = TAIL[state]
            yield held

    entry_schema = pa.schema([("block", pa.int64()), ("entry", pa.int64()), ("bad", pa.int64()), ("shared", pa.int64()), ("tail", pa.string())])
    forward = blocks.select("id", "block", "head", "last", "low", "high").join(walked.select("block", "exits"), "block").select("id", "block", "exits", "head", "last", "low", "high")
    begun = forward.repartition("id").sortWithinPartitions("id", "block").mapInArrow(lambda batches: _rows_out(entries(batches), entry_schema), "block long, entry long, bad long, shared long, tail string")
    chosen = begun.join(walked, "block").select("block", "entry", "bad", "shared", F.concat(F.expr("audits[int(entry)]"), F.col("tail")).alias("audit"))
    told = staged(blocks.drop("matrix", "id", "head", "last").join(chosen, "block"))

    schema = _piece_schema(id_arrow)
    extra = ("signs", "turns", "low", "high", *_COUNTS, "entry", "bad", "shared", "audit")

    def mend(batches):
        out = _Out(schema)
        for block, turns in _grouped(batches, ("block", "id", "role", "text", "whole")):
            t = turns[0][3]
            new = {c: t[c] for c in ("low", "high", *_COUNTS, "audit")} | {"turns": t["turns"] - t["shared"], "illegal": t["illegal"] + t["bad"], "cost": cost_of(t["signs"], t["audit"])}
            yield from out.put({"id": turns[0][0], "piece": block, **new, "repaired": edited([r[1:3] for r in turns], t["audit"], t["entry"])}, sum(len(r[2]) for r in turns))
        yield from out.flush()

    # what is told of a block goes with its first row only
    both = placed.join(told.select("block", F.struct(*extra).alias("whole")), "block").withColumn("whole", F.when(F.col("k") == 0, F.col("whole")))
    return both.repartition("block").sortWithinPartitions("block", "k").mapInArrow(mend, f"id {id_type}, {_PIECE}")


def _streamed(batches) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Of sorted batches whose first column is a key: (key, an iterator of the other columns), of which nothing is held."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, some in groupby(rows, key=lambda row: (row[0] is None, "" if row[0] is None else repr(row[0]))):
        yield key, (row[1:] for row in some)


def _rows_out(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = _Out(schema)
    for row in rows:
        yield from out.put(row, 0)
    yield from out.flush()


def _parts(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of short conversations, one each, and of long ones, or None where no conversation is long."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    n = F.lit(1) if copies is None else F.col(f"`{copies}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), n.cast("int").alias("copies"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    sizes = rows.groupBy("id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    loud = staged(sizes.filter((F.col("n") > LONG) | (F.col("bytes") > LONG_BYTES)).select(bucket.alias("bucket")).distinct())
    if loud.isEmpty():
        return _short(rows), None
    marked = rows.withColumn("bucket", bucket)
    few = marked.join(F.broadcast(loud), "bucket", "left_anti").drop("bucket")
    many = marked.join(F.broadcast(loud), "bucket", "left_semi").withColumn("each", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return _short(few), _long(many)


def repaired(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col``, place, role, text of the turns of all repaired conversations, in order of place. Conversations that lose all
    turns have no row."""
    short, long = _parts(df, id_col, turn_col, role_col, text_col, None)
    pieces = short if long is None else short.unionAll(long)
    line = pieces.select("id", "piece", F.posexplode("repaired").alias("k", "line"))
    return line.select(F.col("id").alias(id_col), F.struct("piece", "k").alias("place"), "line.role", "line.text")


def report(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: str | None = None) -> DataFrame:
    """Of each conversation: ``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of
    ``role:text`` of its repaired turns, joined by newlines). ``copies`` is a column that says how often a row is taken, 0 too;
    a conversation of which nothing is taken has zeros, an empty audit and the digest of the empty text."""
    short, long = _parts(df, id_col, turn_col, role_col, text_col, copies)
    schema = pa.schema([("id", _arrow(short, "id")), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        out = _Out(schema)
        for row in _reports(batches):
            yield from out.put(row, len(row["audit"]))
        yield from out.flush()

    told = f"id {short.schema['id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    all_of = short.mapInArrow(run, told)
    if long is not None:
        all_of = all_of.unionAll(long.repartition("id").sortWithinPartitions("id", "piece").mapInArrow(run, told))
        if copies is not None:  # conversations of loud buckets of which nothing is taken
            ids = df.select(F.col(f"`{id_col}`").alias("whose")).distinct()
            all_of = ids.join(all_of, F.col("whose").eqNullSafe(F.col("id")), "left").select(
                F.col("whose").alias("id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
            )
    return all_of.withColumnRenamed("id", id_col)


def _reports(batches) -> Iterator[dict]:
    """One row a conversation from its pieces, which follow one another."""
    names, held, first = ("id", "piece", "low", "high", "turns", *_COUNTS, "cost", "audit", "repaired"), None, True

    def done() -> dict:
        low, high = held["low"], held["high"]
        return {"id": held["id"], "gaps": 0 if low is None else high - low + 1 - held["turns"], **{c: held[c] for c in (*_COUNTS, "cost")}, "audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}

    for batch in batches:
        for at in range(batch.num_rows):
            p = {c: batch.column(c)[at].as_py() for c in names}
            if not first and not (_same(p["id"], held["id"]) and p["piece"]):
                yield done()
                first = True
            if first:
                held = {"id": p["id"], "low": None, "high": None, "turns": 0, **dict.fromkeys((*_COUNTS, "cost"), 0), "audit": [], "hash": hashlib.sha256(), "any": False}
                first = False
            for c, least in (("low", min), ("high", max)):
                if p[c] is not None:
                    held[c] = p[c] if held[c] is None else least(held[c], p[c])
            for c in ("turns", *_COUNTS, "cost"):
                held[c] += p[c]
            held["audit"].append(p["audit"])
            for line in p["repaired"]:
                held["hash"].update((("\n" if held["any"] else "") + line["role"] + ":" + line["text"]).encode("utf-8", "surrogatepass"))
                held["any"] = True
    if not first:
        yield done()


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with damage by crc32 of ``id:turn``, modulo 20, and how often each is taken (``copies``): 0 drops it, 1 empties
    the text, 2 takes ``[.!?]`` out, 3 repeats it, 4 sets the role user. A null is one space, also in ``id:turn``."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{turn_col}`").alias(turn_col), space(role_col).alias(role_col), space(text_col).alias(text_col), kind.alias("__kind"))
    text = F.when(F.col("__kind").isin(0, 1), "").when(F.col("__kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    copies = F.when(F.col("__kind") == 0, 0).when(F.col("__kind") == 3, 2).otherwise(1)
    return rows.select(id_col, turn_col, F.when(F.col("__kind") == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col), copies.alias("copies"))
