"""Genome order and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chrom_core(chrom: Column) -> Column:
    text = chrom.cast("string")
    return F.when(F.lower(text).startswith("chr"), F.substr(text, F.lit(4))).otherwise(text)


def chrom_rank(chrom: Column) -> Column:
    """Numbered chromosomes, then X, Y, M (or MT), then other names by text."""
    core = chrom_core(chrom)
    upper = F.upper(core)
    digits = core.rlike("^[0-9]+$")
    special = upper.isin("X", "Y", "M", "MT")
    return F.struct(
        F.when(digits, 0).when(special, 1).otherwise(2).alias("kind"),
        F.when(digits, core.try_cast("bigint"))
        .when(upper == "X", 1)
        .when(upper == "Y", 2)
        .when(special, 3)
        .otherwise(0)
        .alias("number"),
        F.when(digits | special, "").otherwise(core).alias("text"),
    )


def midpoint(start: Column, end: Column) -> Column:
    """Truncated integer midpoint of non-negative coordinates."""
    return F.floor((start + end) / 2).cast("bigint")
