"""Cell metadata: barcodes, cell types, exclusion, reference masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import labels
from cellmosaic.operators.joins import join_dim, unique_or_fail


def replicate_of(barcode: Column) -> Column:
    """Everything after the first underscore, NULL without one."""
    at = F.instr(barcode, "_")
    return F.when(at > 0, F.substring(barcode, at + 1, F.length(barcode)))


def label_cells(
    cells: DataFrame,
    cell_types: DataFrame,
    ref_label: str,
    by: Sequence[str] = (),
    check_cells: bool = True,
) -> DataFrame:
    """1:1 left join of cell types by barcode; cells without a type become Unknown."""
    key = [*by, "barcode"]
    purity = f"{ref_label}_tumor_purity"
    wanted = [c for c in (ref_label, purity) if c in cell_types.columns]
    right = unique_or_fail(cell_types.select(*key, *wanted), key, "cell types")
    left = unique_or_fail(cells, key, "barcodes") if check_cells else cells
    joined = left.join(right, key, "left")
    text = F.coalesce(F.col(ref_label).cast("string"), F.lit(labels.UNKNOWN))
    return joined.withColumn(ref_label, text)


def overwrite_label(cells: DataFrame, cell_types: DataFrame, ref_label: str) -> DataFrame:
    """Map labels onto cells, replacing an existing column."""
    return label_cells(cells.drop(ref_label), cell_types, ref_label, check_cells=False)


def excluded(cells: DataFrame, ref_label: str, drop: Sequence[str] = labels.INVALID_LABELS) -> DataFrame:
    """Cells whose label is not in ``drop``; no change without the label column."""
    if ref_label not in cells.columns:
        return cells
    return cells.filter(~F.col(ref_label).isin(list(drop)))


def keep_cells(counts: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the kept cells only."""
    key = [*by, "cell_id"]
    return join_dim(counts, cells.select(*key), key, ["bin_id"], "left_semi")


def reference_mask(cells: DataFrame, ref_label: str, by: Sequence[str] = ()) -> DataFrame:
    """``is_reference`` from normal cell types, NULL for a run without any."""
    flag = labels.is_normal(F.col(ref_label))
    tagged = cells.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    present = tagged.groupBy(*by).agg(F.bool_or("_flag").alias("_any"))
    joined = tagged.join(present, list(by)) if by else tagged.join(F.broadcast(present))
    return joined.withColumn("is_reference", F.when(F.col("_any"), F.col("_flag"))).drop("_flag", "_any")
