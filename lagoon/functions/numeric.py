"""Integer, histogram and fixed-point expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw units of one whole in the nine-decimal fixed-point type, and the range of its 64-bit raw value.
ONE = 1_000_000_000
RAW_MIN, RAW_MAX = -(2**63), 2**63 - 1
WIDE = "decimal(38,0)"
MODES = ("HALF_EVEN", "HALF_UP", "HALF_DOWN", "DOWN", "UP", "FLOOR", "CEILING")


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def bit_length(x: Column | str) -> Column:
    """Significant bits of an integer of 0 or more; 0 of 0. (O064, O068)"""
    return F.when(_c(x) == 0, 0).otherwise(F.length(F.bin(_c(x)))).cast("int")


def log2_bucket(x: Column | str) -> Column:
    """floor(log2 x), and 0 for 0, from the bits and so without rounding. (O064)"""
    return F.greatest(bit_length(x) - 1, F.lit(0))


def hdr_bucket(x: Column | str, bits: int) -> Column:
    """Log-linear bucket of an integer of 0 or more: 2**bits linear buckets, then as many for each doubling. (O068)"""
    v, s = _c(x).cast("long"), 1 << bits
    major = bit_length(v) - bits
    return F.when(v < s, v).otherwise(major.cast("long") * s + F.call_function("shiftright", v, F.greatest(major - 1, F.lit(0))) % s)


def hdr_lower(bucket: Column | str, bits: int) -> Column:
    """Least value of a bucket. (O069)"""
    i, s = _c(bucket).cast("long"), 1 << bits
    major = F.floor(i / s).cast("int")
    return F.when(i < s, i).otherwise(F.call_function("shiftleft", i % s + s, F.greatest(major - 1, F.lit(0))))


def ordered_bucket(x: Column | str, bits: int = 6) -> Column:
    """A coarse bucket of any integer that keeps its order."""
    v = F.greatest(_c(x).cast("long"), F.lit(-RAW_MAX))  # the least integer has no opposite
    below = F.when(v < 0, 1).otherwise(0)
    return (1 - 2 * below) * hdr_bucket(F.abs(v), bits) - below


def steps_away(mode: str, rest: Column, b: Column, negative: Column, odd: Column) -> Column:
    """Whether a truncated quotient, with what is left of a divisor, goes a step away from zero. (O172)"""
    return {
        "DOWN": F.lit(False),
        "UP": rest > 0,
        "FLOOR": negative & (rest > 0),
        "CEILING": ~negative & (rest > 0),
        "HALF_UP": 2 * rest >= b,
        "HALF_DOWN": 2 * rest > b,
        "HALF_EVEN": (2 * rest > b) | ((2 * rest == b) & odd),
    }[mode]


def div_round(n: Column | str, d: Column | str | int, mode: str) -> Column:
    """n / d as a whole number under a rounding mode; null where d is 0. One rule for all modes: truncate, then step away from zero or not. (O172)"""
    if mode not in MODES:
        raise ValueError(f"no rounding mode {mode!r}")
    n, d = _c(n).cast(WIDE), _c(d).cast(WIDE)
    d = F.when(d != 0, d)
    a, b = F.abs(n), F.abs(d)
    q = _quotient(a, b)
    rest = a - q * b
    negative = (n < 0) != (d < 0)
    away = steps_away(mode, rest, b, negative, q % 2 == 1)
    size = q + F.when(away, 1).otherwise(0)
    return F.when(negative, -size).otherwise(size).cast(WIDE)


def _quotient(a: Column, b: Column) -> Column:
    """Whole quotient of two decimals of 0 or more: the remainder is exact, and so is what is left to divide."""
    return ((a - a % b) / b).cast(WIDE)


def in_range(x: Column) -> Column:
    """The raw value, or null beyond 64 bits. (O169, O171)"""
    return F.when((x >= F.lit(RAW_MIN).cast(WIDE)) & (x <= F.lit(RAW_MAX).cast(WIDE)), x.cast("long"))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, _c(b))


def _cut(n: Column, d: int) -> Column:
    """n / d of decimals without its fraction; null beyond 64 bits."""
    q = _quotient(F.abs(n), F.lit(d).cast(WIDE))
    return in_range(F.when(n < 0, -q).otherwise(q))


def mul_parts(a: Column | str, b: Column | str) -> Column:
    """Product of two raw fixed-point values, in long numbers unless these can't hold it, before `rounded`: whole raw units (q, null beyond 64 bits), what is left (rest) of a raw unit (by), and the sign (negative). (O171)"""
    a, b = _c(a), _c(b)
    high, low = (lambda x: _div(x, ONE)), (lambda x: x % ONE)
    ends = low(a) * low(b)
    q = high(a) * high(b) * ONE + high(a) * low(b) + low(a) * high(b) + _div(ends, ONE)  # all of one sign
    fits = F.abs(a.cast("double") * b.cast("double")) < 9e27
    wide = lambda x: x.cast("decimal(19,0)")
    return F.struct(
        F.when(fits, q).otherwise(_cut((wide(a) * wide(b)).cast(WIDE), ONE)).alias("q"), F.abs(ends % ONE).alias("rest"),
        F.lit(ONE).cast("long").alias("by"), ((a < 0) != (b < 0)).alias("negative"),
    )


def div_parts(a: Column | str, b: Column | str) -> Column:
    """Quotient of two raw fixed-point values, as `mul_parts` has it; of what is left, only whether it's nothing (0), less than half a raw unit (1), half of one (2) or more (3). Null where b is 0. (O171)"""
    a, b = _c(a), _c(b)
    x, y = a.cast("double"), F.abs(b.cast("double"))
    fits = (y > 0) & (y < 9e13) & (F.abs(x) < y * 9e9)
    five = a % b * 100_000  # nine more digits, five and four of them
    four = five % b * 10_000
    q = _div(a, b) * ONE + _div(five, b) * 10_000 + _div(four, b)
    n, d = F.abs(a.cast(WIDE)) * F.lit(ONE).cast("decimal(10,0)"), F.when(b != 0, F.abs(b.cast(WIDE)))
    n = n.cast(WIDE)
    wide, negative = _quotient(n, d), (a < 0) != (b < 0)
    kind = lambda rest, of: F.when(rest == 0, 0).when(2 * rest < of, 1).when(2 * rest == of, 2).otherwise(3)
    return F.struct(
        F.when(fits, q).otherwise(in_range(F.when(negative, -wide).otherwise(wide))).alias("q"),
        F.when(fits, kind(F.abs(four % b), F.abs(b))).otherwise(kind(n % d, d)).cast("long").alias("rest"), F.lit(4).cast("long").alias("by"), negative.alias("negative"),
    )


def rounded(parts: Column | str, mode: str) -> Column:
    """The raw value of `mul_parts` or `div_parts` under a rounding mode, null beyond 64 bits. (O171, O172)"""
    p = _c(parts)
    away = steps_away(mode, p["rest"], p["by"], p["negative"], p["q"] % 2 != 0)
    return F.when(away, F.try_add(p["q"], F.when(p["negative"], F.lit(-1)).otherwise(F.lit(1)).cast("long"))).otherwise(p["q"])


def fx_mul(a: Column | str, b: Column | str, mode: str) -> Column:
    """Product of two raw fixed-point values. (O171)"""
    return rounded(mul_parts(_c(a).cast("long"), _c(b).cast("long")), mode)


def fx_div(a: Column | str, b: Column | str, mode: str) -> Column:
    """Quotient of two raw fixed-point values. (O171)"""
    return rounded(div_parts(_c(a).cast("long"), _c(b).cast("long")), mode)


def fx_round(a: Column | str, decimals: int, mode: str) -> Column:
    """Rounded to so many decimals. (O173)"""
    step = 10 ** (9 - decimals)
    return in_range(div_round(a, step, mode) * step)


def to_tick(a: Column | str, tick: Column | str | int, mode: str) -> Column:
    """The nearest multiple of a tick. (O174)"""
    return in_range(div_round(a, tick, mode) * _c(tick).cast("decimal(19,0)"))


def checked_add(a: Column | str, b: Column | str) -> Column:
    return F.try_add(_c(a), _c(b))  # (O169)


def saturating_add(a: Column | str, b: Column | str) -> Column:
    """(O170)"""
    return F.coalesce(F.try_add(_c(a), _c(b)), F.when(_c(a) > 0, F.lit(RAW_MAX)).otherwise(F.lit(RAW_MIN)))


def parts(raw: Column | str) -> tuple[Column, Column, Column]:
    """Whole part and decimals without a sign, and the sign. (O168)"""
    a = F.abs(_c(raw)).cast(WIDE)
    whole = _quotient(a, F.lit(ONE).cast(WIDE))
    return whole.cast("long"), (a - whole * ONE).cast("long"), F.signum(_c(raw)).cast("int")


def to_scaled(raw: Column | str, decimals: int, mode: str) -> Column:
    """A raw value as a whole number at so many decimals; null beyond 64 bits. (O167)"""
    if decimals >= 9:
        return in_range(_c(raw).cast("decimal(19,0)") * F.lit(10 ** (decimals - 9)).cast("decimal(18,0)"))
    return in_range(div_round(raw, 10 ** (9 - decimals), mode))


def money_add(a: Column | str, a_currency: Column | str, b: Column | str, b_currency: Column | str, sign: int = 1) -> Column:
    """Sum (or difference, with sign -1) of two amounts; null where the currencies differ or 64 bits don't hold it. (O176)"""
    return F.when(_c(a_currency) == _c(b_currency), F.try_add(_c(a), _c(b)) if sign > 0 else F.try_subtract(_c(a), _c(b)))


#: Decimals of the minor unit where it isn't 2. (O178)
NO_MINOR_UNIT = ("JPY", "KRW", "VND", "CLP", "ISK")
THREE_DECIMALS = ("BHD", "KWD", "OMR", "TND", "JOD")


def minor_decimals(currency: Column | str) -> Column:
    c = _c(currency)
    return F.when(c.isin(*NO_MINOR_UNIT), 0).when(c.isin(*THREE_DECIMALS), 3).otherwise(2)


def currency_code(s: Column | str) -> Column:
    """Three letters, in upper case, else null. (O178)"""
    return F.when(_c(s).rlike("^[A-Za-z]{3}$"), F.upper(_c(s)))


def settle(raw: Column | str, currency: Column | str, mode: str) -> Column:
    """A raw amount rounded to its currency's minor unit. Give an amount that is itself computed as a column of its own: the rule names it many times. (O177)"""
    d = minor_decimals(currency)
    step = F.when(d == 0, 10**9).when(d == 3, 10**6).otherwise(10**7).cast(WIDE)
    return in_range(div_round(raw, step, mode) * step)


DECIMAL_TEXT = r"^[+-]?([0-9]+(\.[0-9]{0,9})?|\.[0-9]{1,9})$"


def parse_fixed(s: Column | str) -> Column:
    """Raw value of a decimal text: a sign, digits, at most nine decimals, no exponent, no spaces; else null. (O179)"""
    text = F.when(_c(s).rlike(DECIMAL_TEXT), _c(s))
    body = F.regexp_replace(text, "^[+-]", "")
    whole = F.substring_index(body, ".", 1)
    part = F.when(body.contains("."), F.substring_index(body, ".", -1)).otherwise(F.lit(""))
    digits = F.concat(whole, F.rpad(part, 9, "0"))
    size = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 19, digits.try_cast(WIDE))
    return in_range(F.when(text.startswith("-"), -size).otherwise(size))


def format_fixed(raw: Column | str) -> Column:
    """Shortest decimal text of a raw value. (O180)"""
    r = _c(raw).cast(WIDE)
    a = F.abs(r)
    part = F.regexp_replace(F.lpad((a % ONE).cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.when(r < 0, "-").otherwise(""), _quotient(a, F.lit(ONE).cast(WIDE)).cast("string"), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def format_places(raw: Column | str, places: int) -> Column:
    """Decimal text with so many places, the rest cut off. (O180)"""
    r = _c(raw).cast(WIDE)
    a = F.abs(r)
    part = F.substring(F.lpad((a % ONE).cast("string"), 9, "0"), 1, places)
    tail = F.concat(F.lit("."), part) if places else F.lit("")
    return F.concat(F.when(r < 0, "-").otherwise(""), _quotient(a, F.lit(ONE).cast(WIDE)).cast("string"), tail)
