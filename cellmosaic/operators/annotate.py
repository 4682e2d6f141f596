"""Phase correction and mapping of bins onto bulk segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import genome
from cellmosaic.operators.joins import join_dim, range_join, unique_or_fail

SEGMENT_BUCKET = 5_000_000


def attach_phase(bins: DataFrame, phases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``phase`` (1 keep, 0 swap) by exact coordinates.

    Every bin must have one phase row; the query fails when it runs otherwise.
    """
    key = [*by, "chrom", "start_bp", "end_bp"]
    one = unique_or_fail(phases.select(*key, "phase"), key, "phases")
    joined = bins.join(one, key, "left")
    checked = F.coalesce("phase", F.raise_error(F.lit("a bin has no phase row")).cast("double"))
    return joined.withColumn("phase", checked)


def swap_alleles(counts: DataFrame) -> DataFrame:
    """a' = a ph + b (1 - ph) and the mirror for b; also right for fractional phase."""
    keep = F.col("phase")
    a, b = F.col("a"), F.col("b")
    return counts.withColumns({"a": a * keep + b * (1 - keep), "b": b * keep + a * (1 - keep)})


def effective_segments(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cut each segment at the start of the next one.

    "The latest segment that starts at or before the point, if the point is inside
    it" then becomes plain containment in disjoint intervals.
    """
    order = Window.partitionBy(*by, "chrom").orderBy("start_bp", "seg_id")
    following = F.lead("start_bp").over(order)
    return segments.withColumn("_stop", F.least(F.col("end_bp"), F.coalesce(following, F.col("end_bp"))))


def map_bins(bins: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of the segment that holds the bin's midpoint; gap bins drop out."""
    cut = effective_segments(segments, by).withColumnRenamed("start_bp", "_from").drop("end_bp")
    mid = genome.midpoint(F.col("start_bp"), F.col("end_bp"))
    return range_join(bins, cut, mid, [*by, "chrom"], SEGMENT_BUCKET, "_from", "_stop").drop(
        "_from", "_stop"
    )


def gap_bins(bins: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bins outside every segment."""
    inside = map_bins(bins, segments, by).select(*by, "bin_id")
    return bins.join(inside, [*by, "bin_id"], "left_anti")


def annotate_counts(
    counts: DataFrame,
    bins: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    bound: DataFrame | None = None,
) -> DataFrame:
    """Counts of the kept bins with swapped alleles and the named bin columns.

    ``bins`` has one row per bin with ``phase``; ``bound`` is the raw bin table that
    limits its size.
    """
    dim = bins.select(*by, "bin_id", "phase", *columns)
    joined = join_dim(counts, dim, [*by, "bin_id"], ["cell_id"], bound=bound)
    return swap_alleles(joined).drop("phase")
