"""Tail probabilities as column expressions: nothing leaves the JVM.

The regularised incomplete beta function is a continued fraction (modified Lentz), run as
an aggregate over a bounded sequence of rounds; log-gamma is Stirling's series behind a
shift of the argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the fraction: it settles in about the root of the larger parameter.
ROUNDS = 400
EPS = 3e-12
TINY = 1e-300
SHIFT = 8


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0."""
    product = z
    for i in range(1, SHIFT):
        product = product * (z + i)
    w = z + SHIFT
    u = 1 / (w * w)
    # coefficients of Stirling's series (fixed values): B_2k / (2k (2k - 1))
    series = ((((-691 / 360360 * u + 1 / 1188) * u - 1 / 1680) * u + 1 / 1260) * u - 1 / 360) * u + 1 / 12
    return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + series / w - F.ln(product)


def _fraction(s: Column) -> Column:
    """The beta integral of s (x, a, b) by its fraction, where that settles fast."""
    x, a, b = s["x"], s["a"], s["b"]
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda f, c, d, on: F.struct(f.alias("f"), c.alias("c"), d.alias("d"), on.alias("on"))

    def step(now: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(i == 0, F.lit(1.0)).when(i % 2 == 0, even).otherwise(odd)
        d = 1 / safe(1 + term * now["d"])
        c = safe(1 + term / now["c"])
        return F.when(now["on"], state(now["f"] * c * d, c, d, F.abs(1 - c * d) >= EPS)).otherwise(now)

    start = state(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(True))
    f = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)["f"]
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)) / a
    return front * (f - 1)


def regularized_beta(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for a, b > 0; null where one of them is null."""
    x, a, b = (v.cast("double") for v in (x, a, b))
    far = x > (a + 1) / (a + b + 2)
    turned = F.struct(F.when(far, 1 - x).otherwise(x).alias("x"), F.when(far, b).otherwise(a).alias("a"), F.when(far, a).otherwise(b).alias("b"), far.alias("far"))
    inner = F.transform(F.array(turned), lambda s: F.when(s["far"], 1 - _fraction(s)).otherwise(_fraction(s)))[0]
    whole = F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner))
    known = x.isNotNull() & a.isNotNull() & b.isNotNull()
    return F.when(known & (x <= 0), 0.0).when(known & (x >= 1), 1.0).when(known, whole)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    t, df = t.cast("double"), df.cast("double")
    return regularized_beta(df / (df + t * t), df / 2, F.when(t.isNotNull(), 0.5))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of F."""
    f, d1, d2 = (v.cast("double") for v in (f, d1, d2))
    return F.when(f <= 0, 1.0).when(f.isNotNull(), regularized_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2))
