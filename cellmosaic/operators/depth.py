"""Library size, read-depth baseline, clone depth, pseudobulk ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import special

EPS = 1e-12


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def library_size(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "cell_id").agg(F.sum("x").alias("total"))


def _reference_sums(counts: DataFrame, is_ref: str, by: Sequence[str]) -> DataFrame:
    part = F.sum(F.when(F.col(is_ref), F.col("x")).otherwise(0)).alias("x_ref")
    return counts.groupBy(*by, "group_id").agg(part)


def baseline_diploid(counts: DataFrame, is_ref: str, by: Sequence[str] = ()) -> DataFrame:
    """lambda: share of a group in the depth of the reference cells.

    ``counts`` has a row for every group at least once and a boolean ``is_ref``. A
    run without reference depth gets NULL.
    """
    sums = _reference_sums(counts, is_ref, by)
    total = F.sum("x_ref").over(_over(by))
    return sums.select(*by, "group_id", special.ratio(F.col("x_ref"), total).alias("lambda"))


def baseline_corrected(
    counts: DataFrame, ref_cn: DataFrame, is_ref: str, by: Sequence[str] = ()
) -> DataFrame:
    """lambda with the copy ratio of the reference clone divided out.

    ``ref_cn``: one row per group with ``cn_ref``, the total copies of that clone.
    Uniform where the reference has no reads.
    """
    sums = _reference_sums(counts, is_ref, by).join(ref_cn, [*by, "group_id"])
    base = sums.withColumn(
        "_base", F.col("x_ref") / F.greatest(F.col("cn_ref") / 2.0, F.lit(EPS))
    )
    total, rows = F.sum("_base").over(_over(by)), F.count(F.lit(1)).over(_over(by))
    value = F.when(total > 0, F.col("_base") / total).otherwise(1.0 / rows)
    return base.select(*by, "group_id", value.alias("lambda"))


def clone_depth(long: DataFrame, baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rdr`` = C / sum(lambda C) and ``props`` = lambda C / sum(lambda C) per clone.

    Sums run over all groups, so this comes before any mask.
    """
    joined = long.join(baseline, [*by, "group_id"])
    weight = F.col("lambda") * F.col("cn_c")
    norm = F.sum(weight).over(Window.partitionBy(*by, "k"))
    return joined.withColumns({
        "rdr": special.ratio(F.col("cn_c"), norm),
        "props": special.ratio(weight, norm),
    })


def join_baselines(baselines: DataFrame, assays: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One ``<assay>_baseline`` column per assay; a bin of any assay is kept."""
    columns = [F.max(F.when(F.col("assay") == a, F.col("lambda"))).alias(f"{a}_baseline") for a in assays]
    return baselines.groupBy(*keys).agg(*columns)


def pseudobulk_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x, a, b summed over the cells of a label, with the depth of the label."""
    sums = counts.groupBy(*keys, "group_id").agg(*[F.sum(c).alias(c) for c in ("x", "a", "b")])
    return sums.withColumn("total", F.sum("x").over(_over(keys)))


def rdr(x: Column, expected: Column, log2: bool = True) -> Column:
    """Observed over expected depth; NULL without expectation or (log2) reads."""
    value = special.ratio(x, expected)
    return special.log2(value) if log2 else value


def baf(b: Column, n: Column) -> Column:
    return special.ratio(b, n)


def cell_ratios(counts: DataFrame, log2: bool = False) -> DataFrame:
    """Per-cell BAF and RDR; here a zero RDR stays zero under ``log2``.

    ``counts`` has x, a, b, total and lambda.
    """
    value = special.ratio(F.col("x"), F.col("total") * F.col("lambda"))
    if log2:
        value = F.when(value > 0, F.log2(value)).otherwise(value)
    return counts.withColumns({"baf": baf(F.col("b"), F.col("a") + F.col("b")), "rdr": value})


def zscore(value: Column, keys: Sequence[str]) -> Column:
    """(v - mean) / population sd within ``keys``, NULL values left out."""
    w = Window.partitionBy(*keys)
    return special.ratio(value - F.avg(value).over(w), F.stddev_pop(value).over(w))


def standardize(df: DataFrame, value: str, name: str, keys: Sequence[str]) -> DataFrame:
    """:func:`zscore` for groups of any size: moments first, then a join back."""
    from cellmosaic.operators.joins import join_dim

    moments = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")
    )
    joined = join_dim(df, moments, keys, ["cell_id"])
    score = special.ratio(F.col(value) - F.col("_mean"), F.col("_sd"))
    return joined.withColumn(name, score).drop("_mean", "_sd")
