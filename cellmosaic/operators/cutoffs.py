"""Relabelling by purity and posterior cutoffs, choice of the best row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import labels

# fixed values: default cutoff grids
PURITY_CUTOFFS = [0.5, 0.6, 0.7]
POSTERIOR_CUTOFFS = [0.5, 0.6, 0.7, 0.8, 0.9]


def cutoff_grid(
    purity: Sequence[float] = PURITY_CUTOFFS, posterior: Sequence[float] = POSTERIOR_CUTOFFS
) -> list[tuple[float, float]]:
    """Raw labels, each purity cutoff, then each pair of cutoffs."""
    pairs = [(p, t) for p in purity for t in posterior]
    return [(0.0, 0.0), *[(p, 0.0) for p in purity], *pairs]


def cutoff_name(label: str, purity: float, posterior: float) -> str:
    name = label
    if purity > 0:
        name += f"_pcut{purity}"
    if posterior > 0:
        name += f"_post{posterior}"
    return name


def relabel(label: Column, purity: Column, posterior: Column, pcut: Column, tcut: Column) -> Column:
    """Low-purity cells become normal, then remaining tumour cells of low posterior."""
    low = (pcut > 0) & (label != "NA") & purity.isNotNull() & (purity <= pcut)
    first = F.when(low, labels.NORMAL).otherwise(label)
    doubt = (tcut > 0) & ~first.isin("NA", labels.NORMAL) & (posterior <= tcut)
    return F.when(doubt, labels.NORMAL).otherwise(first)


def sweep(
    cells: DataFrame,
    label: str,
    purity: str = "tumor_purity",
    posterior: str = "max_posterior",
    grid: Sequence[tuple[float, float]] | None = None,
) -> DataFrame:
    """Cells once per cutoff pair, in a single pass; the grid has a fixed size."""
    grid = cutoff_grid() if grid is None else grid
    rows = [
        F.struct(
            F.lit(i).alias("cut_no"), F.lit(cutoff_name(label, p, t)).alias("cutoff"),
            F.lit(p).alias("pcut"), F.lit(t).alias("tcut"),
        )
        for i, (p, t) in enumerate(grid)
    ]
    text = F.coalesce(F.col(label), F.lit("NA"))
    many = cells.withColumn(label, text).withColumn("_cut", F.explode(F.array(*rows)))
    new = relabel(F.col(label), F.col(purity), F.col(posterior), F.col("_cut.pcut"), F.col("_cut.tcut"))
    return many.select(
        *[c for c in cells.columns if c != label],
        F.col("_cut.cut_no").alias("cut_no"), F.col("_cut.cutoff").alias("cutoff"), new.alias(label),
    )


def refine_by_reference(label: Column, ref: Column) -> Column:
    """NA where prediction and reference disagree on tumour against normal."""
    tumor = labels.is_tumor(ref)
    clash = (tumor & (label == labels.NORMAL)) | (~tumor & (label != labels.NORMAL))
    return F.when(clash, F.lit("NA")).otherwise(label)


def best_cutoff(rows: DataFrame, metric: str = "ari_clone", order: str = "cut_no", by: Sequence[str] = ()) -> DataFrame:
    """Row with the highest metric (NULL counts as 0), the first on ties."""
    score = F.struct(F.coalesce(F.col(metric), F.lit(0.0)), -F.col(order))
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), score).alias("_r"))
    return best.select("_r.*")


def best_run(runs: DataFrame, sample: str, metric: str, order: str) -> DataFrame:
    """Per sample the run with the highest metric; without any metric the first run.

    NULL sorts below every value inside the struct, so the order decides only then.
    """
    score = F.struct(F.col(metric), -F.col(order))
    best = runs.groupBy(sample).agg(F.max_by(F.struct(*runs.columns), score).alias("_r"))
    return best.select("_r.*")
