"""Quality scores by attention over passages (multiple-instance learning).

A document is a bag of passages of PASSAGE words. Each passage is encoded from counts of character classes, word shapes
and repetition, and of hashed words; gated attention, ``softmax(w . (tanh(V e) * sigmoid(U e)))``, weighs the encodings e,
and a logistic unit scores their weighted sum. Encoder, attention and scorer are learned together from document labels,
on a bounded sample, with Adam over hand-written gradients.

Defined results: null and empty texts are one passage without words, scored like any other; every passage of a text of any
length counts; only the id and the text are read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import each, text_of

PASSAGE = 64
BUCKETS = 32
HIDDEN, GATE = 24, 12
#: Bounds on what is learned from: rows, and encodings of a row. A training row of more passages gives the means of runs of
#: neighbouring ones, so that all of its text counts; scores always look at each passage by itself.
MOST_ROWS, MOST_PASSAGES = 6_000, 2_000
#: Passages of all training rows together that come to the driver (100 MB, and 200 MB while it fits); a row has its share of them.
MOST_ALL = 1_000_000

#: Character classes: lower, upper, other letter, digit, full stop, comma, !?, space, line feed, the signs, other punctuation, the rest.
_KINDS = 12
SIGNS = "#$%&*|@<>{}=_~^"


def _kind(code: int) -> int:
    c = chr(code)
    if c == "\n":
        return 8
    if c in " \t\r\x0b\x0c":
        return 7
    if c in ".,!?":
        return {".": 4, ",": 5}.get(c, 6)
    if c in SIGNS:
        return 9
    category = unicodedata.category(c)
    return {"Ll": 0, "Lu": 1}.get(category, {"L": 2, "N": 3, "P": 10, "S": 10}.get(category[0], 11))


_TABLE: np.ndarray | None = None


def _classes(codes: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([_kind(c) for c in range(0x3000)], np.uint8)
    return np.where(codes < 0x3000, _TABLE[np.minimum(codes, 0x2FFF)], 2)


WIDTH = _KINDS + 6 + BUCKETS


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(x, counts): a row for each passage of all texts in turn; the number of passages of each text, 1 at least."""
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.cumsum(sizes)
    kinds = _classes(codes)
    space = (kinds == 7) | (kinds == 8)
    starts = ~space
    starts[1:] &= space[:-1]
    at = np.flatnonzero(starts)
    doc = np.searchsorted(stops, at, side="right")
    words = np.bincount(doc, minlength=len(texts))
    counts = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    nth = np.arange(at.size) - np.concatenate(([0], np.cumsum(words)[:-1]))[doc]
    passage = base[doc] + nth // PASSAGE
    total = int(counts.sum())
    x = np.zeros((total, WIDTH), np.float32)
    # signs before a text's first word belong to its first passage; the blank after each text belongs to none, so that a
    # text's features don't depend on its neighbours
    owner = np.repeat(np.arange(len(texts)), sizes)
    word = np.cumsum(starts) - 1
    of_char = base[owner]
    if at.size:
        of_char = np.where((word >= 0) & (doc[np.maximum(word, 0)] == owner), passage[np.maximum(word, 0)], of_char)
    own = np.ones(codes.size, bool)
    own[stops - 1] = False
    by_kind = np.bincount((of_char * _KINDS + kinds)[own], minlength=total * _KINDS).reshape(total, _KINDS)
    x[:, :_KINDS] = np.sqrt(by_kind / np.maximum(1, by_kind.sum(1))[:, None])
    if not at.size:
        return x, counts
    place = np.arange(codes.size) - at[np.maximum(word, 0)]
    mixed = codes * (np.uint32(2654435761) * (2 * np.minimum(place, 63).astype(np.uint32) + 1))
    mixed[space] = 0
    hashed = np.add.reduceat(mixed[at[0] :], at - at[0], dtype=np.uint32)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(2246822519)
    n = np.bincount(passage, minlength=total)
    some = np.maximum(1, n)
    length = np.add.reduceat((~space).astype(np.int64), at)
    again = np.zeros(at.size, bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
    unique = np.unique(passage.astype(np.uint64) << np.uint64(32) | hashed.astype(np.uint64)) >> np.uint64(32)
    x[:, _KINDS] = np.log1p(n) / 4
    x[:, _KINDS + 1] = np.bincount(passage, length, minlength=total) / some / 8
    x[:, _KINDS + 2] = np.bincount(unique.astype(np.int64), minlength=total) / some
    x[:, _KINDS + 3] = np.bincount(passage, again, minlength=total) / some
    x[:, _KINDS + 4] = np.sqrt(np.bincount(passage, length > 16, minlength=total) / some)
    x[:, _KINDS + 5] = np.sqrt(np.bincount(passage, length <= 3, minlength=total) / some)
    bag = np.bincount(passage * BUCKETS + (hashed >> np.uint32(16)).astype(np.int64) % BUCKETS, minlength=total * BUCKETS).reshape(total, BUCKETS)
    x[:, _KINDS + 6 :] = np.sqrt(bag / some[:, None])
    return x, counts


@dataclass
class Model:
    """Weights by name, and the features' means and scales."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        x = (x - self.mean) / self.scale
        e = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, s = np.tanh(e @ w["look"]), 1 / (1 + np.exp(-(e @ w["gate"])))
        a = (t * s) @ w["attend"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(e * a[:, None], first)
        y = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_bias"], -30, 30)))
        return {"x": x, "e": e, "t": t, "s": s, "a": a, "z": z, "y": y, "first": first}

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.forward(*features(texts))["y"].astype(np.float64) if texts else np.zeros(0)


def gradients(model: Model, f: dict[str, np.ndarray], counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    w, out = model.weights, {}
    d = (f["y"] - y) / len(y)
    out["score"], out["score_bias"] = f["z"].T @ d, np.array([d.sum()])
    dz = np.repeat(d[:, None] * w["score"][None, :], counts, axis=0)
    de = dz * f["a"][:, None]
    da = (dz * f["e"]).sum(1)
    da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), counts))
    g = f["t"] * f["s"]
    out["attend"] = g.T @ da
    dg = da[:, None] * w["attend"][None, :]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    out["look"], out["gate"] = f["e"].T @ dt, f["e"].T @ ds
    de += dt @ w["look"].T + ds @ w["gate"].T
    dh = de * (1 - f["e"] ** 2)
    out["encode"], out["encode_bias"] = f["x"].T @ dh, dh.sum(0)
    return out


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"encode": small(WIDTH, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32), "look": small(HIDDEN, GATE), "gate": small(HIDDEN, GATE), "attend": small(GATE), "score": small(HIDDEN), "score_bias": np.zeros(1, np.float32)}
    scale = x.std(0)
    model = Model(w, x.mean(0), np.where(scale > 1e-6, scale, 1).astype(np.float32))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            index = np.concatenate([np.arange(first[r], first[r] + counts[r]) for r in rows])
            g = gradients(model, model.forward(x[index], counts[rows]), counts[rows], y[rows])
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - pace * (m[k] / (np.sqrt(v[k]) + 1e-8) + decay * w[k])).astype(np.float32)
    return model


def merged(x: np.ndarray, most: int = MOST_PASSAGES) -> np.ndarray:
    """At most ``most`` rows: the means of runs of neighbouring rows, whose lengths differ by one at most."""
    if len(x) <= most:
        return x
    cuts = np.arange(most + 1) * len(x) // most
    return np.add.reduceat(x, cuts[:-1]) / np.diff(cuts)[:, None].astype(x.dtype)


def learn(rows: DataFrame) -> Model:
    """The model of a bounded sample (text, label); encodings of its passages come to the driver, MOST_ALL at most: a row of more
    passages than its share gives the means of neighbouring ones."""
    most = max(1, min(MOST_PASSAGES, MOST_ALL // max(1, rows.count())))

    def run(batches):
        for batch in batches:
            xs, ys = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                xs.append(merged(features([text])[0], most).astype(np.float16).tobytes())
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.float64())], names=["x", "y"])

    got = rows.select("text", "label").mapInArrow(run, "x binary, y double").toArrow()
    parts = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))  # one order, however the rows came
    if not parts:
        parts = [(features([""])[0].astype(np.float16).tobytes(), 1.0)]
    xs = [np.frombuffer(p, np.float16).reshape(-1, WIDTH) for p, _ in parts]
    return fit(np.concatenate(xs).astype(np.float32), np.array([len(x) for x in xs]), np.array([y for _, y in parts], np.float32))


def _runs(texts, most: int = 500_000):
    run, size = [], 0
    for t in texts:
        if size and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: better) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(r) for r in _runs(each(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")
