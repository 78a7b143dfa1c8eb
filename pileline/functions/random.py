"""Random numbers by place: each row's draw follows from its number alone, so it is the same however rows are divided."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modulus of the minimal standard generators (fixed value).
MODULUS = 2147483647
#: Of each of the three shift registers of taus88 (fixed values): its bits k, and the shifts q and s.
TAUS88 = ((31, 13, 12), (29, 2, 4), (28, 3, 17))
_WORD = (1 << 32) - 1


def lcg(place: Column, factor: int = 48271) -> Column:
    """The draw at a place, from 1, of the generator x -> factor * x modulo MODULUS from seed 1: the factor's power by halving."""
    start = F.struct(F.lit(1).cast("long").alias("r"), F.lit(factor).cast("long").alias("b"))

    def step(s: Column, k: Column) -> Column:
        odd = F.call_function("shiftright", place, k.cast("int")).bitwiseAND(1) == 1
        return F.struct(F.when(odd, s["r"] * s["b"] % MODULUS).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % MODULUS).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, step, lambda s: s["r"])


def discarded(place: Column, block: int, used: int) -> Column:
    """The place, in a sequence, of the draw at ``place`` when only the first ``used`` of each ``block`` draws count."""
    return F.floor((place - 1) / used) * block + (place - 1) % used + 1


def xor_combined(x: Column, y: Column, left: int, right: int) -> Column:
    return F.shiftleft(x, left).bitwiseXOR(F.shiftleft(y, right))


def uniform(x: Column) -> Column:
    """In (0, 1), from a draw of lcg()."""
    return x / F.lit(float(MODULUS))


def below(x: Column, n: int) -> Column:
    """A whole number from 0 to n - 1, from a draw of lcg()."""
    return F.floor(x * n / MODULUS).cast("long")


def normal(place: Column) -> Column:
    """Normal by Box and Muller, from the draws at places 2 * place - 1 and 2 * place."""
    return F.sqrt(-2 * F.log(uniform(lcg(2 * place - 1)))) * F.cos(2 * math.pi * uniform(lcg(2 * place)))


def _shifted(z: int, k: int, q: int, s: int) -> int:
    return ((z & (_WORD + 1 - (1 << (32 - k)))) << s & _WORD) ^ (((z << q & _WORD) ^ z) >> (k - s))


def _jumped(z: int, steps: int, register: tuple[int, int, int]) -> int:
    """The register after so many steps, which are linear in its bits: by squaring of what one step does to each bit."""
    moved = [_shifted(1 << b, *register) for b in range(32)]

    def apply(x: int) -> int:
        out = 0
        for b in range(32):
            if x >> b & 1:
                out ^= moved[b]
        return out

    while steps:
        if steps & 1:
            z = apply(z)
        moved = [apply(x) for x in moved]
        steps >>= 1
    return z


def taus88(spark: SparkSession, n: int, seed: int = 341) -> DataFrame:
    """(idx, x): the first n draws, from 1, of the combination of three shift registers; each batch of rows jumps to its start."""

    def run(batches):
        for batch in batches:
            places = batch.column(0).to_numpy()
            out = np.zeros(places.size, np.int64)
            for register in TAUS88:
                z, at = seed, 0
                for k, place in enumerate(places.tolist()):
                    z = _shifted(z, *register) if place == at + 1 else _jumped(seed, place, register)
                    at = place
                    out[k] ^= z
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["idx", "x"])

    return spark.range(1, n + 1).withColumnRenamed("id", "idx").mapInArrow(run, "idx long, x long")
