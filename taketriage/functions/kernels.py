"""Numeric kernels: Beta tail, sigmoid, hash sampling, agreement, seeds."""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from ..plans.session import importable

# fixed values
FLOOR, CONFIDENCE, PRIOR = 0.25, 0.90, (1, 1)
AUDIT_RATE = 0.15


def doom_probability(kills: Column, passes: Column, floor: float = FLOOR, prior: tuple[int, int] = PRIOR) -> Column:
    """P(usable yield < floor) after these mechanical kills and passes.

    With a whole-number prior the Beta tail is a binomial sum: with n = a+b-1,
    P = sum over j < a of C(n, j) x^j (1-x)^(n-j) at x = 1 - floor.  Terms are
    made one from the other in logarithms, so any count is stable.
    """
    a, b = (kills + prior[0]).cast("int"), (passes + prior[1]).cast("int")
    n, x = (a + b - 1).cast("double"), 1.0 - floor
    lx, ly = math.log(x), math.log(floor)

    def step(acc: Column, j: Column) -> Column:
        term = acc["log"] + F.log(n - j + 1) - F.log(j.cast("double")) + lx - ly
        return F.struct(term.alias("log"), (acc["sum"] + F.exp(term)).alias("sum"))

    first = n * ly
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    # j runs over 1 .. a-1; a is 1 at least, and then the sequence is empty
    js = F.when(a > 1, F.sequence(F.lit(1), a - 1)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(js, start, step)["sum"])


def _log_beta_tail(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _log_beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # even and odd coefficients, evaluated from the far end
    f = 1.0
    for m in range(400, 0, -1):
        k = m // 2
        d = k * (b - k) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m))
        f = 1.0 + d / f
    return front / f


def doom_probability_any_prior(kills: Column, passes: Column, floor: float = FLOOR, prior: tuple[float, float] = (0.5, 0.5)) -> Column:
    """As :func:`doom_probability`, for priors that aren't whole numbers."""
    importable(SparkSession.active())

    @F.pandas_udf("double")
    def tail(k: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([1.0 - _log_beta_tail(prior[0] + a, prior[1] + b, 1.0 - floor) for a, b in zip(k, p, strict=True)])

    return tail(kills.cast("double"), passes.cast("double"))


def sigmoid(z: Column) -> Column:
    return F.when(z < -60, 0.0).when(z > 60, 1.0).otherwise(1.0 / (1.0 + F.exp(-z)))


def audit_pick(take_id: Column, rate: float = AUDIT_RATE) -> Column:
    share = F.conv(F.substring(F.sha2(take_id, 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return F.coalesce((take_id != "") & F.lit(rate > 0) & (share < rate), F.lit(False))


def kappa(gold: Column, predicted: Column) -> Column:
    """Cohen's kappa of two kill/pass labels, as an aggregate."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    po, g, p = share(gold == predicted), share(gold == "kill"), share(predicted == "kill")
    pe = g * p + (1 - g) * (1 - p)
    return F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def seed_signature(seeds: Column) -> Column:
    """Canonical text of a seed map; null when none is recorded."""
    return F.when(F.size(seeds) > 0, F.to_json(F.array_sort(F.map_entries(seeds))))


def mutated_seeds(seeds: Column, take_id: Column, attempt: Column) -> Column:
    """Every seed replaced by another 32-bit one, told by take and attempt."""
    base = F.when(F.size(seeds) > 0, seeds).otherwise(F.create_map(F.lit("seed"), F.lit(-1).cast("long")))

    def fresh(k: Column, v: Column) -> Column:
        h = F.pmod(F.xxhash64(k, v, take_id, attempt), F.lit(1 << 32))
        return F.when(h == v, F.pmod(h + 1, F.lit(1 << 32))).otherwise(h)

    return F.transform_values(base, fresh)


def _scaled(x: Column, digits: int) -> tuple[Column, Column]:
    """The whole number nearest ``x`` times a power of ten, halves to even, of
    the exact binary value; and the power.  For |x| times it below 2**52.

    A product's rounding error is found by splitting its factors in halves, and
    tells on which side of a half the exact product lies.
    """
    scale = float(10**digits)

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    (a, b), (c, d) = halves(x), halves(F.lit(scale))
    product = x * scale
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product).cast("double")
    past = (product - whole) - 0.5
    even = whole % 2 == 0
    up = (past > 0) | ((past == 0) & ((error > 0) | ((error == 0) & ~even)))
    return F.when(up, whole + 1).otherwise(whole), F.lit(scale)


def exact_round(x: Column, digits: int) -> Column:
    """``x`` to so many decimals, rounded from its exact binary value, halves to even."""
    whole, scale = _scaled(x.cast("double"), digits)
    return whole / scale


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many decimals, as C's ``%.<digits>f`` has it."""
    whole, scale = _scaled(F.abs(x.cast("double")), digits)
    number = whole.cast("long")
    point = F.lit(10**digits)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(number / scale).cast("string"), F.lit("."), F.lpad((number % point).cast("string"), digits, "0"))


def exact_sum(x: Column) -> Column:
    """The sum of doubles, rounded once, as an aggregate that is the same in any
    order of rows; 0.0 of none.

    Each value is cut at 2**-20 in two whole numbers, whose sums are exact; what
    lies below 2**-72 is left out.  Values of 2**31 and more, or not finite, are
    added plainly.
    """
    near = F.abs(x) < 2.0**31
    y = F.when(near, x) * 2.0**20
    high = y.cast("long")
    low = ((y - high) * 2.0**52).cast("long")
    whole = lambda c: F.sum(c.cast("decimal(16,0)"))
    exact = (whole(high) * F.lit(Decimal(2**52)) + whole(low)).cast("double") / 2.0**72
    return F.coalesce(exact, F.lit(0.0)) + F.coalesce(F.sum(F.when(~near, x)), F.lit(0.0))
