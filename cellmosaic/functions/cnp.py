"""Copy-number profile strings ``A|B;A|B;...`` (one entry per clone) and row masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmosaic.functions.special import clip

# fixed values: names of the informative-row masks
MASKS = [
    "cnp", "imbalanced", "clonal_imbalanced", "aneuploid",
    "subclonal", "clonal_loh", "subclonal_loh", "neutral",
]


def _side(cnp: Column, at: int) -> Column:
    return F.transform(F.split(cnp, ";"), lambda s: F.split(s, r"\|").getItem(at).cast("int"))


def parse_a(cnp: Column) -> Column:
    return _side(cnp, 0)


def parse_b(cnp: Column) -> Column:
    return _side(cnp, 1)


def expected_baf(a: Column, b: Column, baf_clip: float) -> Column:
    """B / (A + B), 0 for a lost segment, clipped away from 0 and 1."""
    total = a + b
    raw = F.when(total > 0, b / total).otherwise(0.0)
    return clip(raw, baf_clip, 1.0 - baf_clip)


def to_string(cn_a: Column, cn_b: Column) -> Column:
    pairs = F.zip_with(
        cn_a, cn_b, lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string"))
    )
    return F.concat_ws(";", pairs)


def state(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit("|"), b.cast("string"))


def _tumor(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.size(values) - 1)


def _subclones(values: Column) -> Column:
    return F.slice(values, F.lit(3), F.greatest(F.size(values) - 2, F.lit(0)))


def _is_zero(v: Column) -> Column:
    return v == 0


def _all_positive(values: Column) -> Column:
    return F.forall(values, lambda v: v > 0)


def masks(cn_a: Column, cn_b: Column, and_mask: Column | None = None) -> dict[str, Column]:
    """Informative-row masks of a profile row; arrays run over clones, normal first.

    Pass plain columns: the arrays are used inside lambdas, which must not nest.
    """
    imbalanced = F.exists(F.zip_with(cn_a, cn_b, lambda a, b: a != b), lambda v: v)
    aneuploid = F.exists(F.zip_with(cn_a, cn_b, lambda a, b: (a + b) != 2), lambda v: v)
    ta, tb = _tumor(cn_a), _tumor(cn_b)
    clonal_loh = (F.forall(tb, _is_zero) & _all_positive(ta)) | (F.forall(ta, _is_zero) & _all_positive(tb))
    subclonal_loh = (F.exists(tb, _is_zero) & _all_positive(ta)) | (F.exists(ta, _is_zero) & _all_positive(tb))
    first_a, first_b = F.get(cn_a, F.lit(1)), F.get(cn_b, F.lit(1))
    subclonal = (F.size(cn_a) > 2) & (
        F.exists(_subclones(cn_a), lambda v: v != first_a)
        | F.exists(_subclones(cn_b), lambda v: v != first_b)
    )
    either = imbalanced | aneuploid
    neutral = ~either
    if and_mask is not None:
        either, imbalanced, subclonal = either & and_mask, imbalanced & and_mask, subclonal & and_mask
        clonal_loh, subclonal_loh = clonal_loh & and_mask, subclonal_loh & and_mask
    return {
        "cnp": either,
        "imbalanced": imbalanced,
        "clonal_imbalanced": imbalanced & ~subclonal,
        "aneuploid": aneuploid,
        "subclonal": subclonal,
        "clonal_loh": clonal_loh,
        "subclonal_loh": subclonal_loh,
        "neutral": neutral,
    }
