"""Joins of a large fact table with a table that is unique on the join key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.session import durable

BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 250_000
ROW_OVERHEAD = 64  # bytes of a row in a broadcast hash table besides its values
SALTS = 8


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan; None where it cannot be read."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session has no JVM handle
        return None


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit


def few_bytes(df: DataFrame, rows: int = BROADCAST_ROWS, limit: int = BROADCAST_BYTES) -> bool:
    """Size check of a stored table, whose files are smaller than its rows in memory.

    The widths of all values are summed as text, strings and arrays at full length.
    """
    if df.limit(rows + 1).count() > rows:
        return False
    width = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + ROW_OVERHEAD)
    return (df.agg(width).first()[0] or 0) <= limit


def join_dim(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    bound: DataFrame | None = None,
    salts: int = SALTS,
    stored: bool = False,
) -> DataFrame:
    """Join ``fact`` with ``dim`` (at most one row per key).

    ``dim`` is broadcast only when its size is proven. ``bound`` may name the source
    table that ``dim`` was derived from without adding rows: its estimate is that of
    a scan, while the estimate of a join result is loose. Without it ``dim`` is written
    out and its rows and their widths are summed, unless its estimate is small. ``stored``
    says that ``bound``, or ``dim`` without it, is a written table: its estimate is the
    size of its files, which repeated values make many times smaller than its rows, so
    only the widths count. Beyond the limit the key is
    salted: a hot key is spread over ``salts`` tasks by a hash of ``salt_by``
    (columns of ``fact``), and each row of ``dim`` is repeated once per salt. Keys of a
    stored ``dim`` that are few enough alone are broadcast first, so that only rows of
    ``fact`` that have a match are shuffled.
    """
    on = list(on)
    source = bound if bound is not None else dim
    small = few_bytes(source) if stored else is_small(source)
    if not small and bound is None and not stored:
        dim = durable(dim)
        small = few_bytes(dim)
    if small:
        return fact.join(F.broadcast(dim), on, how)
    if stored and bound is None and how == "inner" and few_bytes(dim.select(*on)):
        fact = fact.join(F.broadcast(dim.select(*on)), on, "left_semi")
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def unique_or_fail(df: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """``df`` with one row per key; a repeated key fails the query when it runs."""
    values = [c for c in df.columns if c not in on]
    packed = F.struct(*values) if values else F.lit(1)
    merged = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.any_value(packed).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.lit(f"{what}: repeated key"))
    )
    out = merged.withColumn("_row", checked)
    if values:
        return out.select(*on, *[F.col("_row")[c].alias(c) for c in values])
    return out.filter(F.col("_row") == 1).select(*on)


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    point: Column,
    on: Sequence[str],
    bucket: int,
    start: str = "start_bp",
    end: str = "end_bp",
) -> DataFrame:
    """Point-in-interval join: equality on ``on`` and on a position bucket.

    An interval is listed once in every bucket it touches, a point in one, so each
    match is found once and the work per task stays near the size of a bucket.
    ``points`` and ``intervals`` share only the ``on`` columns; ``start``/``end``
    are columns of ``intervals``.
    """
    on = list(on)
    left = points.withColumn("_pos", point).withColumn("_bucket", F.floor(F.col("_pos") / bucket))
    right = intervals.filter(F.col(end) > F.col(start)).withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))),
    )
    hit = (F.col("_pos") >= F.col(start)) & (F.col("_pos") < F.col(end))
    return left.join(right, [*on, "_bucket"]).filter(hit).drop("_pos", "_bucket")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    bucket: int,
) -> DataFrame:
    """Overlapping pairs of half-open intervals; both sides are bucketed.

    A pair may share several buckets; it is kept in the first one only.
    """
    on = list(on)

    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.filter(F.col(hi) > F.col(lo)).withColumn(
            "_bucket",
            F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket))),
        )

    (ls, le), (rs, re) = left_range, right_range
    pairs = spread(left, ls, le).join(spread(right, rs, re), [*on, "_bucket"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / bucket)
    return pairs.filter(
        (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("_bucket") == first)
    ).drop("_bucket")
