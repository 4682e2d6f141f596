"""Tables behind the panel of a modality: histograms, sums and lost heterozygosity per label.

Rows are cells x groups with ``assay, rep_id, label, b, n, x, expected`` (``n``: allele depth,
``expected``: depth that the baseline gives). Cells are counted once per distinct value; the
totals over replicates (``rep_id`` = ``all``) come from those counts by grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import special
from cellmosaic.operators import ordering
from cellmosaic.operators.joins import join_dim

BINS = 50
RDR_END = 5.0
DEEP = 3  # allele depth above which a cell's BAF counts as deep
ALL = "all"


def _with_all(counted: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per key, and over the replicates as ``rep_id`` = ``all``."""
    keys = list(keys)
    rest = [k for k in keys if k != "rep_id"]
    sets = counted.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in rest]], *[F.col(k) for k in keys])
    out = sets.agg(F.grouping("rep_id").alias("_all"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumn("rep_id", F.when(F.col("_all") == 1, ALL).otherwise(F.col("rep_id"))).select(*keys, *sums)


def fraction_bin(part: Column, whole: Column) -> Column:
    """Bin of part / whole on [0, 1], in whole numbers; 1 falls into the last bin."""
    return F.least(F.floor(F.try_divide(part.cast("decimal(20,0)") * BINS, whole.cast("decimal(20,0)"))), F.lit(BINS - 1)).cast("int")


def histograms(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(.., measure, bin, n)``, bins with a count only.

    ``b_count``: B alleles of covered cells between their least and largest value; ``baf_deep`` and ``baf_shallow``:
    BAF by allele depth on [0, 1]; ``rdr``: depth ratio cut to [0, 5].
    """
    keys = list(keys)
    covered = rows.filter("n > 0").groupBy(*keys, "b", "n").agg(F.count(F.lit(1)).alias("c"))
    counted = _with_all(covered, [*keys, "b", "n"], ["c"])
    depth = F.when(F.col("n") > DEEP, "baf_deep").otherwise("baf_shallow")
    baf = counted.select(*keys, depth.alias("measure"), fraction_bin(F.col("b"), F.col("n")).alias("bin"), "c")
    heads = counted.groupBy(*keys, "b").agg(F.sum("c").alias("c"))
    ends = heads.groupBy(*keys).agg(F.min("b").alias("_lo"), F.max("b").alias("_hi"))
    placed = join_dim(heads, ends, keys, ["b"])
    # one value alone is the middle of its range
    inside = F.when(F.col("_hi") > F.col("_lo"), fraction_bin(F.col("b") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    alleles = placed.select(*keys, F.lit("b_count").alias("measure"), F.coalesce(inside, F.lit(BINS // 2)).alias("bin"), "c")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(RDR_END), F.col("x") / F.col("expected")))
    place = F.least(F.floor(ratio * (BINS / RDR_END)), F.lit(BINS - 1)).cast("int")
    depths = rows.filter("expected > 0").groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    ratios = _with_all(depths, [*keys, "bin"], ["c"]).select(*keys, F.lit("rdr").alias("measure"), "bin", "c")
    every = baf.unionByName(alleles).unionByName(ratios)
    return every.groupBy(*keys, "measure", "bin").agg(F.sum("c").alias("n"))


def summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells, coverage, sums and pooled ratios, with the BAF variance over covered cells."""
    keys = list(keys)
    value = special.ratio(F.col("b"), F.col("n"))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(value).alias("n_covered"),
        F.count_if(F.col("n") > DEEP).alias("n_deep"), F.sum("b").alias("b_total"), F.sum("n").alias("n_total"),
        F.sum("x").alias("x_total"), F.sum("expected").alias("expected"),
        F.sum(value).alias("_v"), F.sum(value * value).alias("_vv"))
    names = ["n_cells", "n_covered", "n_deep", "b_total", "n_total", "x_total", "expected", "_v", "_vv"]
    total = _with_all(sums, keys, names)
    mean = F.col("_v") / F.col("n_covered")
    return total.select(
        *keys, *names[:6], special.ratio(F.col("b_total"), F.col("n_total")).alias("baf"),
        special.ratio(F.col("x_total"), F.col("expected")).alias("rdr"),
        F.when(F.col("n_covered") > 0, F.col("_vv") / F.col("n_covered") - mean * mean).alias("baf_variance"))


def lost_heterozygosity(rows: DataFrame, loh: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per cell the B alleles and allele depth over the groups that its own clone has lost.

    ``loh``: ``(group_id, clone)``; cells whose label is no clone with such groups have no row.
    """
    pairs = loh.select("group_id", F.col("clone").alias("label"))
    own = join_dim(rows, pairs, ["group_id", "label"], ["cell_id"])
    return own.groupBy(*by, "cell_id").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))


def loh_summary(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Medians of B alleles, allele depth and BAF of the cells of :func:`lost_heterozygosity`."""
    by = list(by)
    value = special.ratio(F.col("b"), F.col("n"))
    long = cells.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), v.cast("double").alias("v"))
        for m, v in (("b", F.col("b")), ("n", F.col("n")), ("baf", value))
    ])).alias("_s")).select(*by, F.col("_s.m").alias("_m"), F.col("_s.v").alias("_v"))
    medians = ordering.exact_quantiles(long, "_v", {"_q": 0.5}, [*by, "_m"])
    wide = medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("_m") == m, F.col("_q"))).alias(f"{m}_median") for m in ("b", "n", "baf")])
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n") > 0).alias("n_covered"))
    return sizes.join(wide, by)


def loh_histogram(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """BAF over the lost groups in bins on [0, 1], bins with a count only."""
    by = list(by)
    place = fraction_bin(F.col("b"), F.col("n")).alias("bin")
    counted = cells.filter("n > 0").groupBy(*by, place).agg(F.count(F.lit(1)).alias("n"))
    return _with_all(counted, [*by, "bin"], ["n"])
