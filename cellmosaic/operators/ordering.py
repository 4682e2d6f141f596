"""Exact global order over many tasks: running totals, ranks, quantiles.

A plain window without partition keys puts all rows in one task. Here rows first
fall into value buckets whose bounds come from approximate quantiles. Totals per
bucket give the offset of each bucket, and a window inside the bucket does the
rest. A value that many rows share is a bucket's last one; its rows are cut once more, by
ranges of the column that breaks their tie. The result is exact whatever the quality of
the bounds: they only decide how even the tasks are. They are written out, because the
offsets and the windows must cut at the same values, and approximate quantiles depend on
the order in which parts arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cellmosaic.session import durable

BUCKETS = 64


def _same_group(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join with one row per group; NULL keys form groups of their own."""
    side = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    return df.join(side, same).drop(*[f"_g_{c}" for c in by])


def _with_bucket(
    df: DataFrame, by: Sequence[str], value: str, buckets: int, tie: str | None = None
) -> DataFrame:
    """Add ``_bucket`` and, inside the value that ends a bucket, ``_part`` by ranges of ``tie``."""
    probs = [i / buckets for i in range(1, buckets)]
    cut = F.percentile_approx(value, probs, 20 * buckets).alias("_cuts")
    cuts = durable((df.groupBy(*by) if by else df.groupBy(F.lit(1).alias("_all"))).agg(cut))
    index = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value)))
    if by:
        joined = _same_group(df, cuts, by)
    else:
        # a single row, so a broadcast of fixed size
        joined = df.withColumn("_all", F.lit(1)).join(F.broadcast(cuts), ["_all"]).drop("_all")
    # a value that fills several quantiles is the largest of its bucket
    shared = F.size(F.filter("_cuts", lambda c: c == F.col(value))) > 1
    tagged = joined.withColumns({
        "_bucket": F.when(F.col(value).isNull(), -1).otherwise(index), "_shared": F.coalesce(shared, F.lit(False)),
    }).drop("_cuts")
    if tie is None:
        return tagged.withColumn("_part", F.lit(0)).drop("_shared")
    common = tagged.filter("_shared").groupBy(*by, "_bucket").agg(F.percentile_approx(tie, probs, 20 * buckets).alias("_ties"))
    side = durable(common.withColumnsRenamed({c: f"_g_{c}" for c in [*by, "_bucket"]}))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*by, "_bucket"]]
    parted = tagged.join(side, same, "left")
    part = F.when(F.col("_shared"), 1 + F.size(F.filter("_ties", lambda c: c < F.col(tie)))).otherwise(0)
    return parted.withColumn("_part", part).drop("_ties", "_shared", *[f"_g_{c}" for c in [*by, "_bucket"]])


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    prefix: Sequence[str] = (),
    ties: Sequence[str] = (),
    buckets: int = BUCKETS,
    stored: bool = False,
) -> DataFrame:
    """Add inclusive running sums in the order ``prefix``, ``value``, ``ties``.

    ``sums`` maps new column -> summed column. ``prefix`` are columns with few
    values, ``value`` is numeric, and all order columns together must be unique
    within ``by``. The input is read three times, so it is written out first unless
    it is ``stored`` already.
    """
    by, prefix, ties = list(by), list(prefix), list(ties)
    df = df if stored else durable(df)
    numeric = bool(ties) and isinstance(df.schema[ties[0]].dataType, NumericType)
    tagged = _with_bucket(df, by, value, buckets, ties[0] if numeric and not prefix else None)
    group = [*by, *prefix, "_bucket", "_part"]
    totals = tagged.groupBy(*group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(
        *prefix, "_bucket", "_part"
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in group],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*group).orderBy(value, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = tagged
    for name, column in sums.items():
        local = local.withColumn(f"_l_{name}", F.sum(column).over(inside))
    joined = local.join(offsets, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in group])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
    )


def row_numbers(
    df: DataFrame,
    value: str,
    name: str = "row_no",
    by: Sequence[str] = (),
    prefix: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Row number from 1 in the order ``prefix``, ``value``, ``ties``."""
    return running_totals(
        df.withColumn("_one", F.lit(1)), value, {name: "_one"}, by, prefix, ties
    ).drop("_one")


def average_ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: its rank, ties averaged, and its count ``_n``."""
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(distinct, value, {"_upto": "_n"}, by)
    return ranked.select(
        *by, value, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name)
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles per group, NULL values left out.

    Equal values are counted before the shuffle. Only the two order statistics next
    to each quantile reach the last aggregate.
    """
    by = list(by)
    counted = durable(
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counted, value, {"_upto": "_n"}, by, stored=True)
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    ranked = _same_group(ranked, sizes, by) if by else ranked.join(F.broadcast(sizes))
    aggregates = []
    for name, prob in probs.items():
        at = (F.col("_size") - 1) * F.lit(prob)
        low, high = F.floor(at), F.ceil(at)
        first = F.col("_upto") - F.col("_n")

        def holds(i: Column, first: Column = first) -> Column:
            return (first <= i) & (F.col("_upto") > i)

        lo_value = F.max(F.when(holds(low), F.col(value)))
        hi_value = F.max(F.when(holds(high), F.col(value)))
        part = F.max(at - low)
        aggregates.append((lo_value + (hi_value - lo_value) * part).alias(name))
    return (ranked.groupBy(*by) if by else ranked).agg(*aggregates)
