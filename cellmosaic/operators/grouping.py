"""Groupings of bins (segments, copy-number clusters, adaptive bins) and count sums.

A grouping is a small table ``(bin_id -> group_id)`` computed on bins only, so all
modalities share it. Counts are then summed with one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions.cnp import MASKS
from cellmosaic.functions.genome import chrom_rank
from cellmosaic.operators.joins import join_dim
from cellmosaic.operators.profile import add_masks

DEFAULT_MIN_SNP = 300
DEFAULT_MAX_LENGTH = 5_000_000
PART_CELLS = 10_000  # cells of a partition of dense counts, so that a task's memory does not grow with the input


def _over(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def segment_groups(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense ids of the bulk segments that hold at least one bin."""
    ids = bins.select(*by, "seg_id").distinct().withColumn(
        "group_id", F.dense_rank().over(_over(by).orderBy("seg_id")) - 1
    )
    return bins.join(ids, [*by, "seg_id"])


def cluster_groups(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ids of the distinct copy-number vectors in lexicographic order."""
    vector = F.concat("cn_a", "cn_b")
    tagged = bins.withColumn("_vector", vector)
    ids = tagged.select(*by, "_vector").distinct().withColumn(
        "group_id", F.dense_rank().over(_over(by).orderBy("_vector")) - 1
    )
    return tagged.join(ids, [*by, "_vector"]).drop("_vector")


def first_seen_groups(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ids of the distinct copy-number vectors in order of first appearance."""
    tagged = bins.withColumn("_vector", F.concat("cn_a", "cn_b"))
    order = F.struct(chrom_rank(F.col("chrom")), F.col("start_bp"))
    ids = tagged.groupBy(*by, "_vector").agg(F.min(order).alias("_first")).withColumn(
        "group_id", F.row_number().over(_over(by).orderBy("_first")) - 1
    )
    return tagged.join(ids.drop("_first"), [*by, "_vector"]).drop("_vector")


def allele_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Allele count per bin, pooled over all cells of all modalities."""
    return counts.groupBy(*by, "bin_id").agg(F.sum(F.col("a") + F.col("b")).alias("snp_count"))


def adaptive_groups(
    bins: DataFrame,
    snp_counts: DataFrame,
    min_snp_count: int = DEFAULT_MIN_SNP,
    max_bin_length: int = DEFAULT_MAX_LENGTH,
    by: Sequence[str] = (),
) -> DataFrame:
    """Merge neighbouring bins of a segment until enough alleles or length is reached.

    The cut depends on what was merged so far, so a segment is read in order. Rows
    stream through a sorted partition with a few numbers as state: nothing is
    collected, and segments run in parallel.
    """
    by = list(by)
    joined = bins.join(snp_counts, [*by, "bin_id"], "left").withColumn(
        "snp_count", F.coalesce("snp_count", F.lit(0)).cast("double")
    )
    key = [*by, "seg_id"]
    ordered = (
        joined.select(*key, "bin_id", "start_bp", "end_bp", "snp_count")
        .repartition(*key)
        .sortWithinPartitions(*key, "start_bp", "bin_id")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, local, opened, alleles = None, 0, 0, 0.0
        for batch in batches:
            ids = []
            owners = batch[key].itertuples(index=False, name=None)
            columns = (batch["start_bp"], batch["end_bp"], batch["snp_count"])
            for owner, start, end, snps in zip(owners, *columns):
                if owner != current:
                    current, local, opened, alleles = owner, 0, start, 0.0
                elif end - opened > max_bin_length or alleles >= min_snp_count:
                    local, opened, alleles = local + 1, start, 0.0
                alleles += snps
                ids.append(local)
            yield batch[[*key, "bin_id"]].assign(local_id=ids)

    schema = ordered.select(*key, "bin_id", F.lit(0).cast("bigint").alias("local_id")).schema
    cut = ordered.mapInPandas(walk, schema)
    sizes = cut.groupBy(*key).agg((F.max("local_id") + 1).alias("_n"))
    ranked = sizes.join(
        bins.groupBy(*key).agg(
            F.min(F.struct(chrom_rank(F.col("chrom")), F.col("start_bp"))).alias("_at")
        ),
        key,
    )
    before = _over(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ids = cut.join(offsets, key).select(
        *by, "bin_id", (F.col("local_id") + F.col("_offset")).alias("group_id")
    )
    return bins.join(ids, [*by, "bin_id"])


def group_table(grouped: DataFrame, by: Sequence[str] = (), positions: bool = True) -> DataFrame:
    """One row per group: coordinates, merged bins, length, profile and masks."""
    first = F.struct(chrom_rank(F.col("chrom")), F.col("start_bp"))
    place = [
        F.min_by("chrom", first).alias("chrom"),
        F.min("start_bp").alias("start_bp"),
        F.max("end_bp").alias("end_bp"),
    ] if positions else []
    table = grouped.groupBy(*by, "group_id").agg(
        *place,
        F.count(F.lit(1)).alias("n_bbc"),
        F.sum(F.col("end_bp") - F.col("start_bp")).alias("length_bp"),
        F.min_by("cn_a", first).alias("cn_a"),
        F.min_by("cn_b", first).alias("cn_b"),
    )
    return add_masks(table)


def masked_rows(groups: DataFrame, mask: str, extra: str | None = None) -> DataFrame:
    if mask not in MASKS:
        raise ValueError(f"unknown mask {mask!r}")
    hit = F.col(mask) if extra is None else F.col(mask) & F.expr(extra)
    return groups.filter(hit)


def legacy_cluster_table(
    grouped: DataFrame, sums: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Clusters in first-seen order with the list of their segments as text."""
    order = F.struct(chrom_rank(F.col("chrom")), F.col("start_bp"))
    span = F.concat_ws(
        "", F.col("chrom"), F.lit(":"), F.col("start_bp").cast("string"), F.lit("-"),
        F.col("end_bp").cast("string"),
    )
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), span.alias("s"))))
    return grouped.groupBy(*by, "group_id").agg(
        F.concat_ws(";", F.transform(listed, lambda r: r["s"])).alias("segments"),
        F.min_by("cnp", order).alias("cnp"),
        *[F.sum(c).alias(c) for c in sums],
    )


def sum_counts(
    counts: DataFrame,
    grouped: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    bound: DataFrame | None = None,
) -> DataFrame:
    """Sum x, a, b over ``group_id`` and ``keys`` (for example assay and cell).

    Alleles are swapped by the phase of the bin on the way.
    """
    from cellmosaic.operators.annotate import annotate_counts

    tagged = annotate_counts(counts, grouped, ["group_id"], by, bound)
    return tagged.groupBy(*by, *keys, "group_id").agg(
        F.sum("x").cast("bigint").alias("x"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )


def densify(
    sums: DataFrame, cells: DataFrame, groups: DataFrame, by: Sequence[str] = (), assay: bool = False,
    n_cells: int = 0,
) -> DataFrame:
    """Add the zero rows: every cell gets one row per group.

    The model needs zeros (their depth likelihood is not constant). The group ids of
    a run form one array (their number is that of copy-number states), which each
    cell unfolds; the zero rows are then merged by a sum. The result is partitioned
    by cell, with ``n_cells`` (a known bound of their number) in parts of about ``PART_CELLS``.
    """
    by = list(by)
    extra = ["assay"] if assay else []
    ids = groups.groupBy(*by).agg(F.collect_set("group_id").alias("_ids"))
    source = cells.select(*by, *extra, "cell_id")
    wide = join_dim(source, ids, by, ["cell_id"]) if by else source.join(F.broadcast(ids))
    zero = wide.select(
        *by, *extra, "cell_id", F.explode("_ids").alias("group_id"),
        *[F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in ("x", "a", "b")],
    )
    cell_key = [*by, "cell_id"]
    known = sums.select(*zero.columns)
    spread = max(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_cells // PART_CELLS))
    both = known.unionByName(zero)
    merged = both.repartition(spread, *cell_key) if n_cells else both.repartition(*cell_key)
    return merged.groupBy(*cell_key, *extra, "group_id").agg(
        *[F.sum(c).alias(c) for c in ("x", "a", "b")]
    )
