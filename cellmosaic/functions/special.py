"""Special functions (Spark SQL has no log-gamma) and guarded arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 8


def lgamma(x: str) -> str:
    """log Gamma(x) for x > 0 as SQL text, NULL otherwise.

    ``x`` is SQL text. The argument is moved up by eight with the recurrence, where
    five terms of the asymptotic series reach double precision. There is no branch,
    so the generated code computes shared parts once; the logarithm of x itself is
    NULL for x <= 0. Text is parsed in one step, which is far cheaper than building
    the same tree from column objects.
    """
    x = f"({x})"
    y = f"({x} + {_SHIFT}D)"
    inv2 = f"(1D / ({y} * {y}))"
    series = f"(1D/12 - {inv2} * (1D/360 - {inv2} * (1D/1260 - {inv2} * (1D/1680 - {inv2} * (1D/1188))))) / {y}"
    rising = " * ".join(f"({x} + {i}D)" for i in range(1, _SHIFT))
    return (
        f"(({y} - 0.5D) * ln({y}) - {y} + {_HALF_LOG_2PI!r}D + {series} - ln({x}) - ln({rising}))"
    )


def lbeta(a: str, b: str) -> str:
    return f"({lgamma(a)} + {lgamma(b)} - {lgamma(f'({a}) + ({b})')})"


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is not positive."""
    return F.when(den > 0, num / den)


def log2(x: Column) -> Column:
    """log2 for x > 0, NULL otherwise."""
    return F.when(x > 0, F.log2(x))


def logsumexp(values: Column) -> Column:
    """log of the summed exponentials of an array column, shifted by its maximum."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return top + F.log(total)


def softmax(values: Column) -> Column:
    norm = logsumexp(values)
    return F.transform(values, lambda v: F.exp(v - norm))


def entropy(probs: Column) -> Column:
    """-sum p log p of an array column, probabilities clipped at 1e-30."""
    return F.aggregate(
        probs, F.lit(0.0), lambda acc, p: acc - p * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-30)))
    )
