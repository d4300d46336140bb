"""Dirichlet-multinomial (Polya) kernels as column expressions.

lgamma(a + c) - lgamma(a) and digamma(a + c) - digamma(a) are worked out in a fixed number of steps whatever the count, whole or not: by the
asymptotic series of their difference, which is exact to 1e-13 from `SHIFT` up, and below that by the recurrence. For whole counts they are
the rising factorial sum_{i<c} ln(a + i) and sum_{i<c} 1 / (a + i). By convention here, lgamma(0) is 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
# The asymptotic series of lgamma and digamma, as factors of odd and of even powers of 1 / x.
_LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)


def _series(x: Column, factors: tuple[float, ...], odd: bool) -> Column:
    y = F.lit(1.0) / (x * x)
    total = F.lit(factors[-1])
    for f in reversed(factors[:-1]):
        total = F.lit(f) + total * y
    return total / x if odd else total * y


def _number(a) -> Column:
    return F.lit(float(a)) if isinstance(a, float | int) else a.cast("double")


def rising(a, c) -> Column:
    """lgamma(a + c) - lgamma(a) for c >= 0 and a > 0; 0 for null and negative c."""
    n = F.coalesce(c, F.lit(0)).cast("double")

    def far(x: Column) -> Column:  # x is SHIFT or more
        return n * F.log(x + n) + (x - 0.5) * F.log1p(n / x) - n + _series(x + n, _LGAMMA_SERIES, True) - _series(x, _LGAMMA_SERIES, True)

    def near(x: Column) -> Column:
        return far(x + SHIFT) + F.log(reduce(lambda p, q: p * q, [(x + i) / (x + n + i) for i in range(SHIFT)]))

    if isinstance(a, float | int):
        many = far(_number(a)) if a >= SHIFT else near(_number(a))
        return F.when(n <= 0, 0.0).when(n == 1, math.log(a)).otherwise(many)
    x = _number(a)
    return F.when(n <= 0, 0.0).when(n == 1, F.log(x)).when(x >= SHIFT, far(x)).otherwise(near(x))


def digamma_rise(a, c) -> Column:
    """digamma(a + c) - digamma(a) for c >= 0 and a > 0; 0 for null and negative c."""
    n, x = F.coalesce(c, F.lit(0)).cast("double"), _number(a)

    def far(y: Column) -> Column:
        half = F.lit(0.5) / y - F.lit(0.5) / (y + n)
        return F.log1p(n / y) + half + _series(y + n, _DIGAMMA_SERIES, False) - _series(y, _DIGAMMA_SERIES, False)

    near = far(x + SHIFT) + reduce(lambda p, q: p + q, [F.lit(1.0) / (x + i) - F.lit(1.0) / (x + n + i) for i in range(SHIFT)])
    return F.when(n <= 0, 0.0).when(x >= SHIFT, far(x)).otherwise(near)


def log_gamma(x) -> Column:
    """lgamma of any x > 0; 0 for 0, by convention, and null for null and below."""
    x = _number(x)
    y = x + SHIFT
    far = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + _series(y, _LGAMMA_SERIES, True)
    return F.when(x > 0, far - F.log(reduce(lambda p, q: p * q, [x + i for i in range(SHIFT)]))).when(x == 0, 0.0)


def digamma(x) -> Column:
    """digamma of any x > 0, else null."""
    x = _number(x)
    y = x + SHIFT
    far = F.log(y) - F.lit(0.5) / y + _series(y, _DIGAMMA_SERIES, False)
    return F.when(x > 0, far - reduce(lambda p, q: p + q, [F.lit(1.0) / (x + i) for i in range(SHIFT)]))


def lgamma_whole(c) -> Column:
    """lgamma of a whole number, ln (c - 1)!; 0 for 0, by convention."""
    return rising(1.0, F.coalesce(c, F.lit(0)) - 1)


def type_prior(counts: list, priors: list) -> Column:
    """Log prior of how many segments are of each type, in any order: the Dirichlet-multinomial times the ways to order them
    by their last one; a count of 0 adds nothing to the latter, and priors may be 0 if their count is too or by lgamma(0) = 0."""
    total = reduce(lambda a, b: a + b, counts)
    out = lgamma_whole(total)
    prior_total = float(sum(priors))
    out = out - _rise(prior_total, total)
    for c, p in zip(counts, priors, strict=True):
        out = out - F.when(c > 0, lgamma_whole(c)).otherwise(0.0) + _rise(float(p), c)
    return out


def _rise(a: float, c) -> Column:
    """lgamma(a + c) - lgamma(a) with lgamma(0) = 0."""
    return rising(a, c) if a > 0 else lgamma_whole(c)


def anneal_temperature(iteration, n, burn_in: float = 0.25, cooling: float = 0.25, hottest: float = 5.0) -> Column:
    """Falls from `hottest` to 1 during burn-in, stays, and falls towards 0 while cooling; `n` iterations, a number or a column."""
    it, n = F.col(iteration) if isinstance(iteration, str) else iteration, _number(n)
    burn, cool = n * burn_in, n - n * cooling
    return F.when(it < burn, 1 + (hottest - 1) * (1 - it / burn)).when(it <= cool, 1.0).otherwise((n - it + 1) / (n - cool))
