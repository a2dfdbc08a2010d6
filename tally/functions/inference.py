"""Expressions for interval estimates."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# From this many degrees of freedom the expansion in 1/v is exact to the last digits; below it, the quantile is solved for.
EXPANSION_FROM = 1000
FRACTION_TERMS = 80
NEWTON_STEPS = 40


def z_quantile(confidence: float) -> float:
    """Two-sided normal quantile."""
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def t_terms(confidence: float) -> tuple[float, ...]:
    """Cornish-Fisher coefficients of 1, 1/v, ... 1/v^4 for Student's t."""
    z = z_quantile(confidence)
    return (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def half_gamma_ratio(z: Column) -> Column:
    """Log of gamma(z + 1/2) / gamma(z): a series far out, carried back a dozen steps, so that nothing cancels."""
    far = z + 12
    series = F.log(far) / 2
    for power, over in ((1, -8.0), (3, 192.0), (5, -640.0), (7, 14336 / 17), (9, -18432 / 31)):
        series = series + 1 / (over * F.pow(far, F.lit(float(power))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(11)), series, lambda t, k: t + F.log((z + k) / (z + k + 0.5)))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front."""

    def safe(value: Column) -> Column:
        return F.when(F.abs(value) < 1e-300, F.lit(1e-300)).otherwise(value)

    def term(s: Column, by: Column) -> Column:
        d, c = 1 / safe(1 + by * s["d"]), safe(1 + by / s["c"])
        return _let(F.struct(d.alias("d"), c.alias("c")), lambda n: F.struct(n["c"], n["d"], (s["h"] * n["c"] * n["d"]).alias("h")))

    def pair(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let(term(s, even), lambda n: term(n, odd))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(FRACTION_TERMS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, pair, lambda s: s["h"])


def t_inside(t: Column, v: Column, scale: Column) -> Column:
    """Chance that Student's t with ``v`` degrees of freedom lies between -t and t; ``scale`` is ``1 / beta(1/2, v/2)``."""
    y = t * t / (v + t * t)
    # The fraction converges fast on one side of its mean; beyond it, the other tail is worked out.
    low = y < 1.5 / (v / 2 + 2.5)
    sides = F.when(low, F.struct(F.lit(0.5).alias("a"), (v / 2).alias("b"), y.alias("x"))).otherwise(
        F.struct((v / 2).alias("a"), F.lit(0.5).alias("b"), (1 - y).alias("x"))
    )
    front = F.sqrt(y) * F.exp(-v / 2 * F.log1p(t * t / v)) * scale
    tail = _let(sides, lambda s: front / s["a"] * _fraction(s["a"], s["b"], s["x"]))
    return F.when(low, tail).otherwise(1 - tail)


def t_solved(v: Column, confidence: float) -> Column:
    """Newton steps from the normal quantile. The chance is concave beyond 0 and the start lies below the root, so the
    steps rise to it and cannot pass it: the bracket is the start on one side and the tangent's root on the other."""

    def solved(known: Column) -> Column:
        v, scale = known["v"], known["scale"]

        def step(s: Column, _: Column) -> Column:
            t = s["t"]
            density = scale / F.sqrt(v) * F.exp(-(v + 1) / 2 * F.log1p(t * t / v))
            move = (F.lit(confidence) - t_inside(t, v, scale)) / (2 * density)
            return F.when(s["done"], s).otherwise(
                _let(move, lambda m: F.struct((t + m).alias("t"), (F.abs(m) <= 1e-15 * t).alias("done")))
            )

        start = F.struct(F.lit(z_quantile(confidence)).alias("t"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step, lambda s: s["t"])

    scale = F.exp(half_gamma_ratio(v / 2)) / math.sqrt(math.pi)
    return _let(F.struct(v.cast("double").alias("v"), scale.alias("scale")), solved)


def t_quantile(v: Column, confidence: float) -> Column:
    """Two-sided Student quantile for ``v`` degrees of freedom, fractions included; null below or at 0."""
    far = F.lit(0.0)
    for term in reversed(t_terms(confidence)):
        far = term + far / v
    return F.when(v >= EXPANSION_FROM, far).when(v > 0, t_solved(v, confidence))


@functools.lru_cache(maxsize=64)
def _known_quantile(gateway, name: str, confidence: float) -> Column:
    return t_quantile(F.col(name), confidence)


def t_quantile_of(name: str, confidence: float) -> Column:
    """:func:`t_quantile` of a column by name; put together once for each JVM, as the expression is long."""
    return _known_quantile(SparkContext._gateway, name, confidence)


def welch_df(var_a: Column, n_a: Column, var_b: Column, n_b: Column) -> Column:
    """Welch-Satterthwaite degrees of freedom."""
    a, b = var_a / n_a, var_b / n_b
    return (a + b) * (a + b) / (a * a / (n_a - 1) + b * b / (n_b - 1))
