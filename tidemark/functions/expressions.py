"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import datetime as dt
import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The age bands and their labels.
AGE_BANDS = ("range 1: <= 30", "range 2: 31 - 50", "range 3: 51 - 70", "range 4: > 70")

# Average length of a year in days, and the share of the window to be observed.
DAYS_PER_YEAR = 365.25
MIN_COVERAGE = 0.95

# Constants of the integer mixer below. Products stay under 2**62, so that the
# same numbers come out of Spark, numpy and plain SQL.
PRIME = 2147483647
_STEPS = (48271, 69621, 16807, 1103515245, 1664525)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- randomness


def hash32(seed: int, *ids: str | Column) -> Column:
    """Uniform integer in [0, 2**32) that depends only on the seed and the ids."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash32_sql(seed: int, *ids: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in ids)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 8) AS BIGINT)"


def mix(key: Column, replicate: Column, seed: int) -> Column:
    """Integer in [0, 2**31) drawn for one (key, replicate) pair."""
    a, b, c, d, e = _STEPS
    x = (key * F.lit(a) + replicate.cast("bigint") * F.lit(b) + F.lit(seed * c + 1)) % PRIME
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(d)) % PRIME
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(e)) % PRIME
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix_sql(key: str, replicate: str, seed: int) -> str:
    """The same draw as plain SQL text; the intermediate steps are repeated inline."""
    a, b, c, d, e = _STEPS
    x = f"(({key} * {a} + CAST({replicate} AS BIGINT) * {b} + {seed * c + 1}) % {PRIME})"
    x = f"((xor({x}, {x} >> 15) * {d}) % {PRIME})"
    x = f"((xor({x}, {x} >> 13) * {e}) % {PRIME})"
    return f"xor({x}, {x} >> 16)"


def mix_numpy(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """The same draw for every (key, replicate) pair, as a keys x replicates matrix; keys may be such a matrix already."""
    a, b, c, d, e = _STEPS
    keys = keys.astype(np.int64)
    x = ((keys if keys.ndim == 2 else keys[:, None]) * a + replicates.astype(np.int64)[None, :] * b + seed * c + 1) % PRIME
    x = ((x ^ (x >> 15)) * d) % PRIME
    x = ((x ^ (x >> 13)) * e) % PRIME
    return x ^ (x >> 16)


# Keys of 62 bits are two limbs of 31. The lower limb makes the first half of a draw, and that and the
# upper limb make the second, so two keys share their draws only if they are equal. No step needs
# more than 63 bits, so Spark, numpy and plain SQL give the same ones.
_LIMB = 31
_LOW = (1 << _LIMB) - 1


def key62(seed: int, *ids: str | Column) -> Column:
    """Integer in [0, 2**62) that depends only on the seed and the ids; keys of 1e8 ids collide once in a thousand times."""
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in ids]))
    high, low = (F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(_LOW)) for at in (1, 9))
    return F.shiftleft(high, _LIMB) + low


def key62_sql(seed: int, *ids: str) -> str:
    digits = f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in ids)}))"
    high, low = (f"(CAST('0x' || substr({digits}, {at}, 8) AS BIGINT) & {_LOW})" for at in (1, 9))
    return f"({high} * {1 << _LIMB} + {low})"


def draw62(key: Column, replicate: Column, seed: int) -> tuple[Column, Column]:
    """Both halves, in [0, 2**31) each, of what is drawn for one (key, replicate) pair."""
    first = mix(key.bitwiseAND(F.lit(_LOW)), replicate, seed)
    return first, mix(F.shiftright(key, _LIMB) + first, replicate, seed + 1)


def draw62_sql(source: str, key: str, replicate: str, seed: int) -> str:
    """The rows of a table with both halves as columns ``draw_1`` and ``draw_2``."""
    first = f"SELECT *, {mix_sql(f'({key} & {_LOW})', replicate, seed)} AS draw_1 FROM {source}"
    return f"(SELECT *, {mix_sql(f'(({key} >> {_LIMB}) + draw_1)', replicate, seed + 1)} AS draw_2 FROM ({first}))"


def draw62_numpy(keys: np.ndarray, replicates: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.astype(np.int64)
    first = mix_numpy(keys & _LOW, replicates, seed)
    return first, mix_numpy((keys >> _LIMB)[:, None] + first, replicates, seed + 1)


def below(first, second, size):
    """The 62 drawn bits scaled to [0, size), for a size under 2**31: no number is more than size / 2**62 likelier than another.

    Works on numbers and numpy arrays; ``below_sql`` is the same as text.
    """
    return (first * size + ((second * size) >> _LIMB)) >> _LIMB


def below_sql(size: str) -> str:
    return f"((draw_1 * {size} + ((draw_2 * {size}) >> {_LIMB})) >> {_LIMB})"


def coin(second):
    """A fair bit of the second half."""
    return (second >> 9) & 1


# ------------------------------------------------------------------ calendar


def month_ceil(date: Column) -> Column:
    """First month start on or after the date."""
    return F.add_months(F.trunc(F.date_sub(date, 1), "MM"), 1)


def month_starts(lo: Column, hi: Column, first: dt.date, last: dt.date) -> Column:
    """Array of the month starts in [lo, hi] that lie in [first, last]; null if there are none."""
    start = F.greatest(month_ceil(lo), F.lit(first))
    stop = F.least(F.trunc(hi, "MM"), F.lit(last))
    return F.when(start <= stop, F.sequence(start, stop, F.expr("interval 1 month")))


def age_band(event_date: str | Column, year_of_birth: str | Column) -> Column:
    age = F.year(col(event_date)) - col(year_of_birth)
    return (
        F.when(age <= 30, AGE_BANDS[0])
        .when(age <= 50, AGE_BANDS[1])
        .when(age <= 70, AGE_BANDS[2])
        .otherwise(AGE_BANDS[3])
    )


# ------------------------------------------------------------------- numbers


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as doubles that is null where the denominator is zero."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal width in [low, high]; the last bin is closed, outside is null."""
    width = (float(high) - float(low)) / bins
    index = F.floor((value - F.lit(float(low))) / F.lit(width)).cast("int")
    inside = (value >= F.lit(float(low))) & (value <= F.lit(float(high)))
    return F.when(inside, F.least(index, F.lit(bins - 1)))


def label_months(event_date: Column, months: int, closed: bool = False) -> Column:
    """Month starts d whose outcome window (d, d + months] holds the event; closed: [d, d + months]."""
    stop = F.trunc(event_date if closed else F.date_sub(event_date, 1), "MM")
    return F.sequence(F.add_months(month_ceil(event_date), -months), stop, F.expr("interval 1 month"))


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """True where the text contains one of the phrases, ignoring case; wildcards are taken literally."""
    if not phrases:
        return F.lit(False)
    lowered = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [lowered.contains(p.lower()) for p in phrases])


# ------------------------------------------------------------------- tails


def _scaled_erfc(z: float) -> float:
    """exp(z * z) * erfc(z)."""
    if z < 6:
        return math.exp(z * z) * math.erfc(z)
    rest = 0.0
    for k in range(60, 0, -1):
        rest = k / 2 / (z + rest)
    return 1 / (z + rest) / math.sqrt(math.pi)


@functools.cache
def _tail_polynomial(degree: int = 24) -> tuple[float, ...]:
    """ln(scaled erfc(z) / t) as a polynomial in 2 t - 1, for t = 2 / (2 + z): 13 digits for every z from 0 up."""

    def exact(y: np.ndarray) -> np.ndarray:
        t = (y + 1) / 2
        return np.array([math.log(_scaled_erfc(2 / x - 2) / x) for x in t])

    return tuple(np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(exact, degree)))


def chi2_p_sql(x: str) -> str:
    """SQL text of the upper tail of chi-squared with one degree of freedom, erfc(sqrt(x / 2)); null for null."""
    t = f"(2.0E0 / (2.0E0 + sqrt(({x}) / 2.0E0)))"
    y = f"(2.0E0 * {t} - 1.0E0)"
    terms = _tail_polynomial()
    acc = f"{terms[-1]:.17E}"
    for c in reversed(terms[:-1]):
        acc = f"({acc}) * {y} + ({c:.17E})"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(1.0E0, {t} * exp({acc} - ({x}) / 2.0E0)) END)"
