"""Label predicates and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: label vocabulary of the domain
TUMOR_LABELS = ["Tumor_cell", "tumor", "Tumor"]
TUMOR_PREFIXES = ["tumor", "clone", "clone_"]
INVALID_LABELS = ["Doublet", "doublet", "Unknown", "NA"]
NA_LABELS = ["Unknown", "NA"]
NORMAL = "normal"
UNKNOWN = "Unknown"


def is_tumor(label: Column) -> Column:
    low = F.lower(label)
    hit = label.isin(TUMOR_LABELS)
    for prefix in TUMOR_PREFIXES:
        hit = hit | low.startswith(prefix)
    return hit


def is_invalid(label: Column) -> Column:
    return label.isin(INVALID_LABELS)


def is_normal(label: Column) -> Column:
    return ~is_tumor(label) & ~is_invalid(label)


def is_na(label: Column) -> Column:
    """Unknown / NA, and NULL."""
    return label.isNull() | label.isin(NA_LABELS)


def is_na_any_case(label: Column) -> Column:
    return F.lower(label).isin([v.lower() for v in NA_LABELS])


def is_normal_like(label: Column) -> Column:
    return F.lower(label).startswith(NORMAL)


def takes_color_slot(label: Column) -> Column:
    return ~is_invalid(label) & ~label.isin(NA_LABELS) & ~is_normal_like(label)


def clone_order(label: Column) -> Column:
    """normal, clone1, clone2, ..., any other label, invalid labels last."""
    number = F.regexp_extract(label, r"^clone(\d+)$", 1)
    kind = (
        F.when(label == NORMAL, 0)
        .when(number != "", 1)
        .when(is_invalid(label), 3)
        .otherwise(2)
    )
    return F.struct(
        kind.alias("kind"),
        F.when(number != "", number.cast("int")).otherwise(0).alias("number"),
        F.when(kind >= 2, label).otherwise("").alias("text"),
    )


def pseudobulk_order(label: Column) -> Column:
    """normal, then clone labels, then others, each by text; NA is to be dropped."""
    kind = F.when(label == NORMAL, 0).when(label.startswith("clone"), 1).otherwise(2)
    return F.struct(kind.alias("kind"), label.alias("text"))


def report_row_order(label: Column) -> Column:
    """Crosstab rows: reference normal labels first, tumour labels last."""
    return F.struct(is_tumor(label).cast("int").alias("kind"), label.alias("text"))


def report_column_order(label: Column) -> Column:
    """Crosstab columns: normal, tumour labels, others, NA."""
    kind = (
        F.when(label == NORMAL, 0)
        .when(is_tumor(label), 1)
        .when(label.isin(NA_LABELS), 3)
        .otherwise(2)
    )
    return F.struct(kind.alias("kind"), label.alias("text"))


def clone_name(k: Column) -> Column:
    return F.when(k == 0, F.lit(NORMAL)).otherwise(F.concat(F.lit("clone"), k.cast("string")))
