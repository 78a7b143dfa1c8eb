"""Base and genotype codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters in order of their codes 0 to 3; display letters of codes 0 to 7; genotypes a1 << 2 | a2 with a1 <= a2;
#: their letters by genotype (N where there is none).
LETTERS = "ACTG"
SHOWN = "ACTGNNNN"
GENOTYPES = [0, 1, 2, 3, 5, 6, 7, 10, 11, 15]
IUPAC = "AMWRNCYSNNTKNNNGN"


def ref_code(letter: Column) -> Column:
    """Reference code 0 to 7 of a letter; bit 2 marks N."""
    return F.shiftright(F.ascii(letter), 1).bitwiseAND(7)


def read_code(letter: Column) -> Column:
    """Read code 0 to 3 of a letter."""
    return F.shiftright(F.ascii(letter), 1).bitwiseAND(3)


def shown(code: Column) -> Column:
    return F.substring(F.lit(SHOWN), code + 1, F.lit(1))


def iupac(genotype: Column) -> Column:
    return F.substring(F.lit(IUPAC), genotype + 1, F.lit(1))


def pack_word(base: Column, q: Column, cycle: Column, strand: Column, occurrences: Column) -> Column:
    """An observation as one number: base at bit 23, 64 - q at 17, cycle at 9, strand at 8, occurrences at 0. 64 - q has six bits
    there; the seventh, which quality 0 only needs, is at 25, above the base. Qualities other than 0 to 64 have no word (null)."""
    less = (64 - q).cast("long")
    high, low = F.shiftleft(F.shiftright(less, 6), 25), F.shiftleft(less.bitwiseAND(63), 17)
    word = F.shiftleft(base.cast("long"), 23).bitwiseOR(low).bitwiseOR(high).bitwiseOR(F.shiftleft(cycle.cast("long"), 9)).bitwiseOR(F.shiftleft(strand.cast("long"), 8)).bitwiseOR(occurrences.cast("long"))
    return F.when(q.between(0, 64), word)


def unpack_word(word: Column) -> dict[str, Column]:
    part = lambda at, bits: F.shiftright(word, at).bitwiseAND((1 << bits) - 1)
    return {"base": part(23, 2), "q": 64 - (part(17, 6) + 64 * part(25, 1)), "cycle": part(9, 8), "strand": part(8, 1), "occurrences": part(0, 8)}


def normal_tail(z: Column) -> Column:
    """Tail of the normal distribution by a polynomial (fixed coefficients); 0 beyond 6; folded to 0.5 at most."""
    coefficients = [0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(z) * F.lit(0.2316419))
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + F.lit(c)) * t
    upper = F.lit(0.39894228) * F.exp(-z * (z / 2.0)) * poly
    n = F.when(z < 0, upper).otherwise(F.lit(1.0) - upper)
    return F.when(F.abs(z) > 6, F.lit(0.0)).otherwise(F.when(n > 0.5, F.lit(1.0) - n).otherwise(n))
