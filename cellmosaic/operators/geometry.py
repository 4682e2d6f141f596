"""Genome axis: whitelist regions laid end to end, bins placed on them, gaps, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions.genome import chrom_rank
from cellmosaic.operators.joins import interval_join

CHROM_SHIFT = 10_000_000
REGION_BUCKET = 5_000_000


def _over(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def region_axis(regions: DataFrame, by: Sequence[str] = (), bins: DataFrame | None = None) -> DataFrame:
    """Whitelist regions with their offset when laid end to end in genome order.

    ``regions``: ``(.., chrom, region_no, wl_start, wl_end)``; ``region_no`` is the
    order inside the chromosome. With ``bins`` only chromosomes that have bins are on
    the axis. ``is_inner`` marks an end that is drawn as a boundary: all but the last of
    a chromosome, and that of a first region that begins after 0.
    """
    if bins is not None:
        regions = regions.join(bins.select(*by, "chrom").distinct(), [*by, "chrom"], "left_semi")
    order = _over(by).orderBy(chrom_rank(F.col("chrom")), "region_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("wl_end") - F.col("wl_start")
    inside = Window.partitionBy(*by, "chrom").orderBy("region_no")
    late_first = F.lag("region_no").over(inside).isNull() & (F.col("wl_start") != 0)
    return regions.withColumns({
        "offset": F.coalesce(F.sum(length).over(before), F.lit(0)),
        "is_inner": F.lead("region_no").over(inside).isNotNull() | late_first,
    })


def chromosome_ticks(axis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start, end and middle of each chromosome on the axis."""
    stop = F.max(F.col("offset") + F.col("wl_end") - F.col("wl_start"))
    return axis.groupBy(*by, "chrom").agg(
        F.min("offset").alias("axis_start"), stop.alias("axis_end"),
        ((F.min("offset") + stop) / 2).alias("tick"),
    )


def _overlapping(bins: DataFrame, axis: DataFrame, by: Sequence[str]) -> DataFrame:
    side = axis.select(*by, "chrom", "region_no", "wl_start", "wl_end", "offset")
    pairs = interval_join(
        bins, side, [*by, "chrom"], ("start_bp", "end_bp"), ("wl_start", "wl_end"), REGION_BUCKET
    )
    shift = F.col("offset") - F.col("wl_start")
    return pairs.withColumns({
        "axis_from": F.greatest("start_bp", "wl_start") + shift,
        "axis_to": F.least("end_bp", "wl_end") + shift,
    })


def place_bins(bins: DataFrame, axis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clipped axis interval and middle of each bin; the last overlapping region wins."""
    pairs = _overlapping(bins, axis, by)
    pick = F.struct("axis_from", "axis_to")
    best = pairs.groupBy(*by, "bin_id").agg(F.max_by(pick, "region_no").alias("_p"))
    return best.select(
        *by, "bin_id", "_p.axis_from", "_p.axis_to",
        ((F.col("_p.axis_from") + F.col("_p.axis_to")) / 2).alias("position"),
    )


def contained_bins(bins: DataFrame, axis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bins that lie inside one region as a whole, with their axis interval."""
    pairs = _overlapping(bins, axis, by)
    inside = (F.col("start_bp") >= F.col("wl_start")) & (F.col("end_bp") <= F.col("wl_end"))
    return pairs.filter(inside).select(*by, "bin_id", "region_no", "axis_from", "axis_to")


def axis_cells(bins: DataFrame, axis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The axis as consecutive cells: covered by a bin, or a gap (``bin_id`` NULL)."""
    by = list(by)
    pairs = _overlapping(bins, axis, by).select(
        *by, "chrom", "region_no", "bin_id", "axis_from", "axis_to"
    )
    region = [*by, "chrom", "region_no"]
    sides = axis.select(
        *region, F.col("offset").alias("_lo"),
        (F.col("offset") + F.col("wl_end") - F.col("wl_start")).alias("_hi"),
    )
    # a closing row per region makes the trailing gap, or the whole of an empty region
    closing = sides.select(
        *region, F.lit(None).cast("bigint").alias("bin_id"), F.col("_hi").alias("axis_from"),
        F.col("_hi").alias("axis_to"),
    )
    rows = pairs.unionByName(closing).join(sides, region)
    before = Window.partitionBy(*region).orderBy("axis_from", F.col("bin_id").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    cur = F.coalesce(F.max("axis_to").over(before), F.col("_lo"))
    tagged = rows.withColumn("_cur", cur)
    parts = F.array(
        F.struct(F.lit(None).cast("bigint").alias("bin_id"), F.col("_cur").alias("cell_from"), F.col("axis_from").alias("cell_to")),
        F.struct(F.col("bin_id").alias("bin_id"), F.greatest("_cur", "axis_from").alias("cell_from"), F.col("axis_to").alias("cell_to")),
    )
    return tagged.select(*region, F.explode(parts).alias("_p")).select(*region, "_p.*").filter(
        F.col("cell_to") > F.col("cell_from")
    )


def chromosome_offsets(sizes: DataFrame, shift: int = CHROM_SHIFT, by: Sequence[str] = ()) -> DataFrame:
    """Offset of each chromosome from the sizes of those before it, plus a margin."""
    order = _over(by).orderBy(chrom_rank(F.col("chrom")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(
        "offset", F.coalesce(F.sum("size_bp").over(before), F.lit(0)) + F.lit(shift)
    )


def chromosome_gaps(regions: DataFrame, offsets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Uncovered stretches: before, between and after the regions of a chromosome."""
    key = [*by, "chrom"]
    w = Window.partitionBy(*key).orderBy("start_bp", "end_bp")
    joined = regions.join(offsets.select(*key, "size_bp", "offset"), key).withColumns({
        "_before": F.coalesce(F.lag("end_bp").over(w), F.lit(0)), "_next": F.lead("start_bp").over(w),
    })
    tail = F.when(F.col("_next").isNull(), F.struct(
        F.col("end_bp").alias("lo"), F.col("size_bp").alias("hi")
    ))
    head = F.struct(F.col("_before").alias("lo"), F.col("start_bp").alias("hi"))
    spans = joined.select(*key, "offset", F.explode(F.array_compact(F.array(head, tail))).alias("_g"))
    return spans.filter(F.col("_g.lo") < F.col("_g.hi")).select(
        *key, (F.col("_g.lo") + F.col("offset")).alias("gap_start"),
        (F.col("_g.hi") + F.col("offset")).alias("gap_end"),
    )


def merge_equal_runs(
    rows: DataFrame, value: str, keys: Sequence[str], start: str = "axis_from", end: str = "axis_to"
) -> DataFrame:
    """Merge neighbouring rows of equal value; rows with a NULL are skipped first.

    ``keys`` include the chromosome, which bounds a run.
    """
    keys = list(keys)
    kept = rows.filter(F.col(value).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    order = Window.partitionBy(*keys).orderBy(start, end)
    changed = F.when(F.col(value) == F.lag(value).over(order), 0).otherwise(1)
    marked = kept.withColumn("_new", changed)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_run", island).groupBy(*keys, "_run").agg(
        F.min(start).alias("line_from"), F.max(end).alias("line_to"), F.first(value).alias(value),
        F.count(F.lit(1)).alias("n_bins"),
    ).drop("_run")
