"""Toxicity by a weighted grammar of finite-state transducers.

At the bottom are weighted transducers over letters, one each for insults, threats, targets, negations and verbs of saying; their
union reads the words of a clause, and the arc that ends a word gives its class and carries its weight. Three transducers over
classes are composed with it, one after the other: negation turns an insult or threat that follows within NEGATION_REACH words into
a negated one, reported speech turns one after a verb of saying into a reported one, and the target transducer marks those
that have a target within TARGET_REACH words, on either side: the composition is a bimachine, of which one part reads forwards and
the other backwards over what that gives. What is left are matches with a kind; each adds its word's weight to its
kind's total in the clause, clauses add up, and a logistic model over the kinds' totals gives the score. So a word counts
by what its clause does with it.

Fixed word lists seed the lexicon; more insults, whole words and word beginnings, are learned from a bounded sample of
labelled rows, as are the weights of words and kinds.

Defined results: null and empty texts get the score of a text without matches; whole texts are read; only the id and the
text are read of a document; without labels the seeds and fixed weights are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import each, text_of

#: Fixed word lists of the grammar.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting fool dumb imbecile jerk bastard idiota imbécil estúpido tonto basura idiote imbécile stupide ordure dummkopf trottel abschaum dumm".split()
THREATS = "kill hurt destroy burn shoot stab beat crush matar destruir tuer détruire töten zerstören vernichten".split()
TARGETS = "you your yours he she they them these those his her their people du dich euch ihr sie tu te toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says say called calls quoted claimed claims told wrote reported sagte sagt schrieb behauptet dit disait écrit dijo dice escribió".split()

NEGATION_REACH = 3
TARGET_REACH = 5
#: Matches of a clause by what happens to the word.
KINDS = ["insult", "insult+target", "insult+negated", "insult+reported", "threat", "threat+target", "threat+negated", "threat+reported"]
#: Bound on the labelled rows that the lexicon and the weights are learned from.
MOST_ROWS = 20_000
#: Lengths of word beginnings that are tried.
STEMS = (4, 5, 6)
#: Learned entries: in so many toxic rows at least, so much evidence (twice the log likelihood ratio) and share of toxic rows.
LEAST_ROWS, LEAST_EVIDENCE, LEAST_SHARE = 4, 14.0, 0.75
#: No entry counts for more; the number of entries is bounded by the sample they are learned from.
MOST_WEIGHT = 8.0

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]+")
CLASSES = "itynr"  # insult, threat, target (y: you), negation, reported speech; o: other


class Transducer:
    """A deterministic transducer over one-letter symbols: (state, symbol) gives (state, output); what is not in the table
    keeps the symbol and goes to the state's default."""

    def __init__(self, moves: dict[tuple[int, str], tuple[int, str]], default: dict[int, int]):
        self.moves, self.default = moves, default

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol)) or (self.default.get(state, 0), symbol)

    def run(self, symbols: str) -> str:
        state, out = 0, []
        for s in symbols:
            state, s = self.step(state, s)
            out.append(s)
        return "".join(out)


def compose(*machines: Transducer) -> Transducer:
    """One transducer that does what the given ones do in turn; built over the states that can be reached."""
    numbers, queue = {tuple(0 for _ in machines): 0}, [tuple(0 for _ in machines)]
    moves: dict[tuple[int, str], tuple[int, str]] = {}
    alphabet = ALPHABET
    while queue:
        states = queue.pop()
        for symbol in alphabet:
            out, after = symbol, []
            for machine, state in zip(machines, states, strict=True):
                state, out = machine.step(state, out)
                after.append(state)
            after = tuple(after)
            if after not in numbers:
                numbers[after] = len(numbers)
                queue.append(after)
            moves[numbers[states], symbol] = (numbers[after], out)
    return Transducer(moves, {})


#: Symbols: the classes, o for other words; j and u: negated insult and threat; k and v: reported; I and T: with a target.
ALPHABET = "itynroIT"


def negation() -> Transducer:
    """State: words left in which an insult or threat counts as negated."""
    moves = {}
    for left in range(NEGATION_REACH + 1):
        moves[left, "n"] = (NEGATION_REACH, "n")
        if left:
            moves[left, "i"], moves[left, "t"] = (left - 1, "j"), (left - 1, "u")
    return Transducer(moves, {k: max(0, k - 1) for k in range(NEGATION_REACH + 1)})


def reported() -> Transducer:
    """After a verb of saying, up to the clause's end, insults and threats are reported."""
    return Transducer({(0, "r"): (1, "r"), (1, "r"): (1, "r"), (1, "i"): (1, "k"), (1, "t"): (1, "v")}, {0: 0, 1: 1})


def targeted() -> Transducer:
    """State: words left in which an insult or threat has a target."""
    moves = {}
    for left in range(TARGET_REACH + 1):
        moves[left, "y"] = (TARGET_REACH, "y")
        if left:
            moves[left, "i"], moves[left, "t"] = (left - 1, "I"), (left - 1, "T")
    return Transducer(moves, {k: max(0, k - 1) for k in range(TARGET_REACH + 1)})


class Letters:
    """A weighted transducer over letters. ``arcs`` of a state: letter to state; ``ends`` of a state: END to (class, weight) of the arc
    that a word's end takes, MORE to that of the arc which any further letters take. The first end that a state is given stays; of
    several that fit a word, the whole word's counts before those of beginnings, and of these the shortest."""

    END, MORE = "#", "*"

    def __init__(self, sign: str = "", weights: dict[str, float] | None = None, beginnings: dict[str, float] | None = None):
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[dict[str, tuple[str, float]]] = [{}]
        for kind, entries in ((self.END, weights or {}), (self.MORE, beginnings or {})):
            for text, weight in entries.items():
                self._end(self._state(text), kind, (sign, weight))

    def _state(self, text: str) -> int:
        state = 0
        for letter in text:
            if letter not in self.arcs[state]:
                self.arcs[state][letter] = len(self.arcs)
                self.arcs.append({})
                self.ends.append({})
            state = self.arcs[state][letter]
        return state

    def _end(self, state: int, kind: str, output: tuple[str, float]) -> None:
        self.ends[state].setdefault(kind, output)

    def union(self, other: Letters) -> Letters:
        """This transducer with the paths of another, which give way to its own."""
        waiting = [(0, 0)]
        while waiting:
            own, far = waiting.pop()
            for kind, output in other.ends[far].items():
                self._end(own, kind, output)
            for letter, to in other.arcs[far].items():
                if letter not in self.arcs[own]:
                    self.arcs[own][letter] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append({})
                waiting.append((self.arcs[own][letter], to))
        return self

    def read(self, word: str) -> tuple[str, float]:
        """(class, weight) of a word; (o, 0) where no path takes it."""
        state, begun = 0, None
        for letter in word:
            if begun is None:
                begun = self.ends[state].get(self.MORE)
            if (to := self.arcs[state].get(letter)) is None:
                return begun or ("o", 0.0)
            state = to
        return self.ends[state].get(self.END) or begun or ("o", 0.0)


class Bimachine:
    """A transducer read forwards, composed with one read backwards over what it gives."""

    def __init__(self, forwards: Transducer, backwards: Transducer):
        self.forwards, self.backwards = forwards, backwards

    def run(self, symbols: str) -> str:
        return self.backwards.run(self.forwards.run(symbols)[::-1])[::-1]


#: Read forwards: negation, then reported speech, then targets before the word.
FORWARDS = compose(negation(), reported(), targeted())
#: Read backwards over what that gives: targets after the word.
BACKWARDS = targeted()
CLAUSE = Bimachine(FORWARDS, BACKWARDS)
KIND_OF = {"i": 0, "I": 1, "j": 2, "k": 3, "t": 4, "T": 5, "u": 6, "v": 7}


@dataclass
class Lexicon:
    """Classes of words; weights of insults and threats by word or by beginning."""

    classes: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def look_up(self, word: str) -> tuple[str, float]:
        if (c := self.classes.get(word)) is not None and c not in "it":
            return c, 0.0
        if word in self.weights:
            return c or "i", self.weights[word]
        for n in STEMS:
            if (w := self.stems.get(word[:n])) is not None and len(word) > n:
                return "i", w
        return "o", 0.0

    def machine(self) -> Letters:
        """The union of the transducers of function words, threats and insults; it gives what look_up() gives."""
        out = Letters()
        for sign in "ynr":
            out.union(Letters(sign, dict.fromkeys((w for w, c in self.classes.items() if c == sign), 0.0)))
        threats = {w: x for w, x in self.weights.items() if self.classes.get(w) == "t"}
        return out.union(Letters("t", threats)).union(Letters("i", {w: x for w, x in self.weights.items() if w not in threats}, self.stems))

    def reader(self):
        """machine() with a memory of the words that it read, of bounded size."""
        if "_reader" not in self.__dict__:
            self._reader = lru_cache(maxsize=200_000)(self.machine().read)
        return self._reader

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_reader"}

    def strikes(self, words: set[str]) -> bool:
        """Whether one of the words is an insult or a threat."""
        return not self.weights.keys().isdisjoint(words) or bool(self.stems) and any(not self.stems.keys().isdisjoint({w[:n] for w in words if len(w) > n}) for n in STEMS)


def seed_lexicon(weight: float = 2.0) -> Lexicon:
    lists = ((TARGETS, "y"), (NEGATIONS, "n"), (REPORTS, "r"), (THREATS, "t"), (INSULTS, "i"))
    return Lexicon({w: c for words, c in lists for w in words}, dict.fromkeys([*INSULTS, *THREATS], weight), {})


def totals(lexicon: Lexicon, text: str) -> list[float]:
    """The weight of the matches of each kind, summed over the clauses."""
    out = [0.0] * len(KINDS)
    low = text.lower()
    if not lexicon.strikes(set(WORD.findall(low))):
        return out
    read = lexicon.reader()
    for clause in CLAUSE_END.split(low):
        found = [read(w) for w in WORD.findall(clause)]
        symbols = "".join(c for c, _ in found)
        if "i" in symbols or "t" in symbols:
            for symbol, (_, weight) in zip(CLAUSE.run(symbols), found, strict=True):
                if symbol in KIND_OF:
                    out[KIND_OF[symbol]] += weight
    return out


@dataclass
class Model:
    lexicon: Lexicon
    kinds: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(rows) @ self.kinds + self.bias, -30, 30)))


def default_model() -> Model:
    """Without labels: seeds only; negated and reported matches count a quarter."""
    return Model(seed_lexicon(), np.array([3.0, 4.0, 0.75, 0.75, 3.0, 4.0, 0.75, 0.75]), -2.5)


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _count_terms(rows: DataFrame, only=None) -> DataFrame:
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in each(batch.column(0)):
                found = _terms(text)
                counts.update(found if only is None else found & only.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Twice the log likelihood ratio of a of ``toxic`` and b of ``clean`` rows against one rate for both."""
    total, k = 0.0, a + b
    rate = k / (toxic + clean)
    for x, n in ((a, toxic), (b, clean)):
        for y, m, p in ((x, n, rate), (n - x, n, 1 - rate)):
            if y and m:
                total += y * math.log(y / m / p)
    return 2 * total


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Seeds and learned entries of a bounded sample (text, label). What comes to the driver are terms of LEAST_ROWS toxic rows at least."""
    lexicon = seed_lexicon()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = counts.get(1.0, 0), counts.get(0.0, 0)
    if not toxic or not clean:
        return lexicon
    often = {r.term: r.n for r in _count_terms(rows.filter("label = 1")).filter(F.col("n") >= LEAST_ROWS).collect()}
    also = {r.term: r.n for r in _count_terms(rows.filter("label = 0"), rows.sparkSession.sparkContext.broadcast(frozenset(often))).collect()}
    found = []
    for term, a in often.items():
        b = also.get(term, 0)
        if a >= LEAST_SHARE * (a + b) and (e := _evidence(a, b, toxic, clean)) >= LEAST_EVIDENCE:
            found.append((e, term, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))))
    found.sort(key=lambda x: (-x[0], x[1]))
    for _, term, weight in found:
        weight = min(weight, MOST_WEIGHT)
        if term.endswith("*"):
            lexicon.stems[term[:-1]] = weight
        elif lexicon.classes.get(term, "i") in "it":
            lexicon.weights[term] = weight
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, rows of both labels of one weight in all; kinds never count against a text."""
    x = np.column_stack((np.log1p(x), np.ones(len(x))))
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def learn(rows: DataFrame) -> Model:
    """The model of a bounded sample (text, label)."""
    lexicon = learn_lexicon(rows)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([totals(shared.value, t) for t in each(batch.column(0))], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.select("text", "label").mapInArrow(run, "x array<double>, y double").toArrow()
    x, y = np.array(got.column(0).to_pylist()).reshape(-1, len(KINDS)), got.column(1).to_numpy()
    if not len(y) or y.min() == y.max():
        return default_model()
    return Model(lexicon, *_fit(x, y))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``matches`` (weights by KINDS) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([totals(shared.value.lexicon, t) for t in each(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x)), pa.array(list(x), pa.list_(pa.float64()))], names=[id_col, "score", "matches"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double, matches array<double>")


def keep_clean(df: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of a score below ``threshold``, all columns; texts are scored where they are, nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([totals(shared.value.lexicon, t or "") for t in each(batch.column(at))])
                yield batch.filter(pa.array(shared.value.score(x) < threshold))

    return df.mapInArrow(run, df.schema)
