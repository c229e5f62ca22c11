"""Tail probabilities of the normal, t, F and chi-square distributions.

Continued-fraction forms of the incomplete beta and gamma functions: plain
functions for the tasks that solve models, column expressions for result frames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _lentz(a_b, steps: int = 500) -> float:
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...))."""
    _, b0 = a_b(0)
    f = b0 if b0 else _TINY
    c, d = f, 0.0
    for i in range(1, steps):
        a, b = a_b(i)
        d = b + a * d
        d = 1.0 / (d if d else _TINY)
        c = b + a / c
        c = c if c else _TINY
        delta = c * d
        f *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def term(i):
        if i == 0:
            return 0.0, 1.0
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    # term(1) carries the leading coefficient of the fraction under 1/(1 + ...)
    return front / a / _lentz(term)


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        total = term = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total

    def frac(i):
        return (0.0, x + 1.0 - a) if i == 0 else (-i * (i - a), x + 2.0 * i + 1.0 - a)

    return front / _lentz(frac)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2.0, x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """Quantile for p > 0.5, by bisection on the two-sided tail."""
    target = 2.0 * (1.0 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > target:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_two_sided(mid, df) > target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


# ------------------------------------------------------------ as columns
#
# The same functions as expressions.  Fractions and series have a length that is
# known beforehand and are summed from their far end, which needs one number at a
# time: a fold over a sequence.


def _column(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _fold(steps: Column, start: Column, step) -> Column:
    """``step(value, k)`` for k = steps, ..., 1."""
    return F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), start, lambda acc, k: step(acc, k.cast("double")))


def erfc(x: Column) -> Column:
    """Complementary error function of numbers not below zero."""
    x2 = x * x
    series = x * _fold(F.lit(80), F.lit(1.0), lambda acc, k: 1 + 2 * x2 / (2 * k + 1) * acc)
    fraction = _fold(F.lit(120), x, lambda acc, k: x + k / 2 / acc)
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x2) * series
    return F.when(x.isNull(), F.lit(None)).when(x < 2, near).otherwise(F.exp(-x2) / math.sqrt(math.pi) / fraction)


def _stirling_rest(z: Column) -> Column:
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)


_LIFT = 16  # where the asymptotic series is exact to rounding


def log_gamma(z: Column) -> Column:
    far, product = z + _LIFT, z
    for i in range(1, _LIFT):
        product = product * (z + i)
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + _stirling_rest(far) - F.log(product)


def log_beta(a: Column, b: Column) -> Column:
    """By differences in the larger argument, which keep their digits however large it is."""
    a, b = F.greatest(a, b), F.least(a, b)
    far = a + _LIFT
    grown = (far - 0.5) * F.log1p(b / far) + b * F.log(far + b) - b + _stirling_rest(far + b) - _stirling_rest(far)
    for i in range(_LIFT):
        grown = grown - F.log1p(b / (a + i))
    return log_gamma(b) - grown


def _beta_fraction(a: Column, b: Column, x: Column, front: Column) -> Column:
    def step(acc, k):
        m = F.floor(k / 2)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + F.when(k % 2 == 1, odd).otherwise(even) / acc

    steps = (300 + 8 * F.sqrt(a + b)).cast("int")
    return F.exp(front) / a / _fold(steps, F.lit(1.0), step)


def beta_tail(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function; ``rest`` is 1 - x, given apart so that it keeps its digits."""
    front = a * F.log(x) + b * F.log(rest) - log_beta(a, b)
    low, high = _beta_fraction(a, b, x, front), 1 - _beta_fraction(b, a, rest, front)
    known = F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0))
    return F.when((a + b + x).isNull(), F.lit(None)).otherwise(known.when(x <= (a + 1) / (a + b + 2), low).otherwise(high))


def normal_p(z: Column | str) -> Column:
    """Two-sided normal p."""
    return erfc(F.abs(_column(z)) / math.sqrt(2))


def t_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided Student p; the normal tail where df is missing."""
    t, df = _column(t), _column(df).cast("double")
    all_ = df + t * t
    return F.when(df.isNull() | F.isnan(df), normal_p(t)).otherwise(beta_tail(df / 2, F.lit(0.5), df / all_, t * t / all_))


def f_p(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """Upper tail of the F distribution."""
    f, df1, df2 = _column(f), _column(df1).cast("double"), _column(df2).cast("double")
    all_ = df2 + df1 * f
    return F.when(f <= 0, F.lit(1.0)).otherwise(beta_tail(df2 / 2, df1 / 2, df2 / all_, df1 * f / all_))


def chi2_p(x: Column | str, df: Column | str) -> Column:
    """Upper tail of the chi-square distribution."""
    a, x = _column(df).cast("double") / 2, _column(x) / 2
    front = a * F.log(x) - x - log_gamma(a)
    series = 1 - F.exp(front) / a * _fold(F.lit(200), F.lit(1.0), lambda acc, k: 1 + x / (a + k) * acc)
    fraction = _fold(F.lit(300), x + 601 - a, lambda acc, k: x + 2 * k - 1 - a - k * (k - a) / acc)
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, series).otherwise(F.exp(front) / fraction)
