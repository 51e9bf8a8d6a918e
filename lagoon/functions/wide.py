"""Exact numbers of 18 places in 128 bits, where a decimal column ends at 38 digits.

A number is a struct of two limbs in base 10**18: `hi`, which has the sign, and `lo`
from 0 on. Sums add the limbs by themselves and carry once; what 128 bits don't hold
is null. (O175)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagoon.functions.numeric import MODES, ONE, WIDE, in_range, steps_away

BASE = 10**18
#: Greatest and least number, and their limbs.
MOST, LEAST = 2**127 - 1, -(2**127)
(_MOST_HI, _MOST_LO), (_LEAST_HI, _LEAST_LO) = divmod(MOST, BASE), divmod(LEAST, BASE)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _big(x) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast(WIDE)


def _made(hi: Column, lo: Column) -> Column:
    """Limbs of any size as a number, or null."""
    rest = F.pmod(lo, _big(BASE))
    top = hi + ((lo - rest) / _big(BASE)).cast(WIDE)
    fits = ((top < _big(_MOST_HI)) | ((top == _big(_MOST_HI)) & (rest <= _big(_MOST_LO)))) & ((top > _big(_LEAST_HI)) | ((top == _big(_LEAST_HI)) & (rest >= _big(_LEAST_LO))))
    return F.when(fits, F.struct(top.cast("decimal(21,0)").alias("hi"), rest.cast("long").alias("lo")))


def _limbs(x: Column) -> tuple[Column, Column]:
    return x["hi"].cast(WIDE), x["lo"].cast(WIDE)


def from_fixed(raw: Column | str) -> Column:
    """A raw value of 9 places."""
    return _made(_big(0), _c(raw).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(18,0)"))


def product(a: Column | str, b: Column | str) -> Column:
    """Of two raw values of 9 places, without rounding."""
    return _made(_big(0), (_c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)")).cast(WIDE))


def add(a: Column | str, b: Column | str, sign: int = 1) -> Column:
    """Sum, or difference with sign -1; null beyond 128 bits."""
    (ah, al), (bh, bl) = _limbs(_c(a)), _limbs(_c(b))
    return _made(ah + sign * bh, al + sign * bl)


def total(x: Column | str) -> Column:
    """An aggregate: the sum of all numbers; null if there is none or 128 bits don't hold it. Rows that are null don't count."""
    hi, lo = _limbs(_c(x))
    return _made(F.sum(hi), F.sum(lo))


def _size(x: Column) -> tuple[Column, Column, Column]:
    """Limbs without a sign, and whether the number is below 0."""
    hi, lo = _limbs(x)
    negative, part = hi < 0, lo > 0
    return F.when(negative, -hi - part.cast("int")).otherwise(hi).cast(WIDE), F.when(negative & part, _big(BASE) - lo).otherwise(lo).cast(WIDE), negative


def _divided(a: Column, b: Column) -> tuple[Column, Column]:
    rest = a % b
    return ((a - rest) / b).cast(WIDE), rest


def to_fixed(x: Column | str, mode: str) -> Column:
    """The raw value of 9 places, rounded once; null beyond 64 bits."""
    if mode not in MODES:
        raise ValueError(f"no rounding mode {mode!r}")
    hi, lo, negative = _size(_c(x))
    below, rest = _divided(lo, _big(ONE))
    q = hi * F.lit(ONE).cast("decimal(10,0)") + below
    size = q.cast(WIDE) + F.when(steps_away(mode, rest, _big(ONE), negative, q % 2 == 1), 1).otherwise(0)
    return in_range(F.when(negative, -size).otherwise(size).cast(WIDE))


def div_int(x: Column | str, n: Column | str, mode: str) -> Column:
    """Divided by a whole number, rounded once at 18 places; null where that is 0."""
    if mode not in MODES:
        raise ValueError(f"no rounding mode {mode!r}")
    hi, lo, negative = _size(_c(x))
    by = _c(n).cast("decimal(19,0)").cast(WIDE)
    d = F.abs(F.when(by != 0, by))
    negative = negative != (by < 0)
    top, carried = _divided(hi, d)
    low, rest = _divided((carried.cast("decimal(19,0)") * F.lit(BASE).cast("decimal(19,0)")).cast(WIDE) + lo, d)
    low = low + F.when(steps_away(mode, rest, d, negative, low % 2 == 1), 1).otherwise(0)
    sign = F.when(negative, -1).otherwise(1)
    return _made((sign * top).cast(WIDE), (sign * low).cast(WIDE))


def text(x: Column | str) -> Column:
    """The shortest exact decimal."""
    hi, lo, negative = _size(_c(x))
    part = F.rtrim(F.lpad(lo.cast("string"), 18, "0"), F.lit("0"))
    return F.concat(F.when(negative, "-").otherwise(""), hi.cast("string"), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))


def raw_text(x: Column | str) -> Column:
    """The number as a count of its last places, which may have 39 digits."""
    hi, lo, negative = _size(_c(x))
    digits = F.when(hi > 0, F.concat(hi.cast("string"), F.lpad(lo.cast("string"), 18, "0"))).otherwise(lo.cast("string"))
    return F.concat(F.when(negative, "-").otherwise(""), digits)
