"""One-dimensional maximum likelihood for many keys at once.

Each round evaluates a grid for every key in one distributed aggregate and then
narrows each key's interval around its best point; a parabola through the last
three points ends the search. Grids are even in log scale. Bounds and results are tables
with one row per key, whatever the number of keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import likelihood
from cellmosaic.session import durable

Round = Callable[[DataFrame | None], DataFrame]
Bounds = tuple[float, float] | dict[str, tuple[float, float]]


def best_point(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best grid point per key (the first on ties) with its neighbours: ``(.., best,
    step, left, ll, right)``; a neighbour outside the grid is NULL."""
    packed = F.array_sort(F.collect_list(F.struct("i", "at", "ll"))).alias("_g")
    top = scores.groupBy(*keys).agg(
        packed, F.max_by("i", F.struct(F.col("ll"), -F.col("i"))).alias("_i")
    )

    def at(shift: int) -> Column:
        return F.get("_g", F.col("_i") + shift)

    return top.select(
        *keys, at(0)["at"].alias("best"), (F.get("_g", F.lit(1))["at"] - F.get("_g", F.lit(0))["at"]).alias("step"),
        at(-1)["ll"].alias("left"), at(0)["ll"].alias("ll"), at(1)["ll"].alias("right"),
    )


def vertex(best: Column, step: Column, left: Column, mid: Column, right: Column) -> Column:
    """Maximum of the parabola through three even points; the middle one if it is flat."""
    bend = left - 2 * mid + right
    moved = best + step * (left - right) / (2 * bend)
    return F.when(bend < 0, moved).otherwise(best)


def first_points(bounds: tuple[float, float], points: int) -> list[float]:
    """The points of the first round on the log scale; the same for all keys, so no join is needed."""
    lo, hi = math.log(bounds[0]), math.log(bounds[1])
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def _limits(bounds: Bounds) -> tuple[Column, Column]:
    """Ends of the search on the log scale; bounds by the value of the key column ``what`` are told apart."""
    if isinstance(bounds, tuple):
        return F.lit(math.log(bounds[0])), F.lit(math.log(bounds[1]))
    of = [F.create_map(*[F.lit(v) for name, ends in bounds.items() for v in (name, math.log(ends[i]))]) for i in (0, 1)]
    return of[0][F.col("what")], of[1][F.col("what")]


def row_round(
    rows: DataFrame, keys: Sequence[str], bounds: Bounds, points: int, attach: Callable[[DataFrame, DataFrame], DataFrame],
) -> Round:
    """Rounds over rows of :data:`likelihood.PARTS`, which are neither repeated nor moved.

    A task sums its rows for all points of their key; ``attach`` joins rows with one row per key.
    """

    def scores(ends: DataFrame | None) -> DataFrame:
        lo, hi = _limits(bounds)
        if ends is None:
            placed = rows.withColumns({"_lo": lo, "_hi": hi})
        else:
            placed = attach(rows, ends.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))
        kept = placed.select(*keys, *likelihood.PARTS, "_lo", "_hi")
        kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
        schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "_lo", "_hi"]) + ", _sums array<double>"
        parts = kept.mapInArrow(likelihood.grid_sums(keys, points), schema)
        total = F.expr("array(" + ", ".join(f"sum(_sums[{i}])" for i in range(points)) + ")")
        wide = parts.groupBy(*keys).agg(total.alias("_sums"), F.any_value("_lo").alias("_lo"), F.any_value("_hi").alias("_hi"))
        at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / F.lit(points - 1.0)
        return wide.select(*keys, "_lo", "_hi", F.posexplode("_sums").alias("i", "ll")).select(*keys, "i", at.alias("at"), "ll")

    return scores


def maximise(scores: Round, keys: Sequence[str], bounds: Bounds, rounds: int) -> DataFrame:
    """Best parameter per key: ``(.., value, ll)``; a key without data gives no row.

    The rounds' small tables are written, so a round is evaluated once.
    """
    keys = list(keys)
    lo, hi = _limits(bounds)
    found = durable(best_point(scores(None), keys))
    for _ in range(rounds - 1):
        best, step = F.col("best"), F.col("step")
        ends = found.select(*keys, F.greatest(lo, best - step).alias("lo"), F.least(hi, best + step).alias("hi"))
        found = durable(best_point(scores(ends), keys))
    peak = vertex(*[F.col(c) for c in ("best", "step", "left", "ll", "right")])
    return found.select(*keys, F.exp(F.greatest(lo, F.least(hi, peak))).alias("value"), "ll")
