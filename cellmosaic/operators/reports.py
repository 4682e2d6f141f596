"""Tables behind the report figures: histograms, heatmap rows, sweeps, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import labels, special
from cellmosaic.operators import ordering
from cellmosaic.operators.joins import join_dim


def histogram(
    df: DataFrame, value: Column, lo: float, hi: float, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in equal bins on [lo, hi]; the last bin includes its right edge.

    Values outside the range are left out, empty bins are listed with 0.
    """
    by = list(by)
    width = (hi - lo) / bins
    inside = df.withColumn("_v", value).filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
    guess = F.floor((F.col("_v") - lo) / width)
    # the division can miss an edge by one rounding step; the edges decide
    up = (F.col("_v") >= F.lit(lo) + (guess + 1) * F.lit(width)).cast("int")
    down = (F.col("_v") < F.lit(lo) + guess * F.lit(width)).cast("int")
    index = F.least(guess + up - down, F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if by:
        frame = counts.select(*by).distinct().select(*by, every)
    else:
        frame = counts.agg(F.count(F.lit(1)).alias("_c")).select(every)
    return frame.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def row_layout(cells: DataFrame, label: str, secondary: Sequence[str], agg_size: int) -> DataFrame:
    """Heatmap rows: cells of a label in order of ``secondary`` and id, ``agg_size`` each.

    Adds ``row_in_label`` from 0.
    """
    numbered = ordering.row_numbers(cells, "cell_id", "_rn", [label], list(secondary))
    return numbered.withColumn("row_in_label", F.floor((F.col("_rn") - 1) / agg_size)).drop("_rn")


def aggregate_rows(counts: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x, a, b and depth of the cells of a heatmap row, per group."""
    joined = join_dim(counts, rows.select("cell_id", *keys), ["cell_id"], ["group_id"])
    sums = joined.groupBy(*keys, "group_id").agg(*[F.sum(c).alias(c) for c in ("x", "a", "b")])
    return sums.withColumn("total", F.sum("x").over(Window.partitionBy(*keys)))


def heatmap_values(sums: DataFrame, baseline: DataFrame) -> DataFrame:
    """BAF, RDR, log2 RDR (zero stays zero) and depth share (zero is NULL)."""
    joined = join_dim(sums, baseline, ["group_id"], ["row_in_label"])
    value = special.ratio(F.col("x"), F.col("total") * F.col("lambda"))
    share = special.ratio(F.col("x"), F.col("total"))
    return joined.withColumns({
        "baf": special.ratio(F.col("b"), F.col("a") + F.col("b")),
        "rdr": value,
        "log2rdr": F.when(value > 0, F.log2(value)).otherwise(value),
        "depth_share": F.when(share > 0, share),
    })


def row_summary(rows: DataFrame, keys: Sequence[str], column: str, purity: str) -> DataFrame:
    """Most frequent value (the smallest on ties) and mean purity of each row."""
    counts = rows.groupBy(*keys, column).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(purity).alias("_s")
    )
    whole = F.sum("_n")
    top = F.max("_n")
    ranked = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("_o"), F.col(column).alias("v")))).alias("_l"),
        whole.alias("n_cells"), (F.sum("_s") / whole).alias("mean_purity"), top.alias("_top"),
    )
    return ranked.select(*keys, F.col("_l")[0]["v"].alias("mode"), "n_cells", "mean_purity")


def order_by_purity(rows: DataFrame, label: str, order: str = "row_in_label") -> DataFrame:
    """Position of each row inside its label by falling mean purity, then input order."""
    key = rows.withColumn("_neg", -F.col("mean_purity"))
    return ordering.row_numbers(key, "_neg", "row_pos", [label], ties=[order]).drop("_neg")


def contamination_sweep(
    cells: DataFrame, post: str, ref: str, cutoffs: Sequence[float] | None = None
) -> DataFrame:
    """Tumour cells left in the reference for each posterior cutoff.

    The pool are the cells that look normal (posterior below 0.5).
    """
    cutoffs = [i / 10 for i in range(11)] if cutoffs is None else list(cutoffs)
    known = cells.filter(~labels.is_na(F.col(ref)) & F.col(post).isNotNull())
    tumor = labels.is_tumor(F.col(ref))
    pool = tumor & (F.col(post) < 0.5)
    wide = known.agg(
        F.count_if(tumor).alias("n_tumor"),
        F.array(*[F.count_if(pool & (F.col(post) < c)) for c in cutoffs]).alias("_fn"),
    )
    values = F.array(*[F.lit(float(c)) for c in cutoffs])
    rows = F.explode(F.arrays_zip(values.alias("cutoff"), F.col("_fn").alias("n_false"))).alias("_r")
    long = wide.select("n_tumor", rows)
    n = F.col("_r.n_false")
    return long.select(
        F.col("_r.cutoff").alias("cutoff"), n.alias("n_false"),
        F.coalesce(special.ratio(n, F.col("n_tumor")), F.lit(0.0)).alias("rate"),
    )


def top_fraction_sweep(cells: DataFrame, post: str, ref: str, steps: int = 10) -> DataFrame:
    """Tumour cells among the most normal-looking share of the pool.

    The first ``max(1, round(share * pool))`` cells count, with half-even rounding and
    ties in the posterior in order of the cell id.
    """
    known = cells.filter(~labels.is_na(F.col(ref)) & F.col(post).isNotNull())
    tumor = labels.is_tumor(F.col(ref))
    pool = known.filter(F.col(post) < 0.5).select(post, "cell_id", tumor.cast("int").alias("_t"))
    ranked = ordering.row_numbers(pool, post, "_rn", ties=["cell_id"])
    sizes = pool.agg(F.count(F.lit(1)).alias("_pool"))
    n_tumor = known.agg(F.count_if(tumor).alias("n_tumor"))
    fractions = [i / steps for i in range(1, steps + 1)]
    takes = [F.greatest(F.lit(1), F.bround(F.lit(p) * F.col("_pool"))) for p in fractions]
    wide = ranked.join(F.broadcast(sizes)).agg(
        F.array(*[F.sum(F.when(F.col("_rn") <= k, F.col("_t")).otherwise(0)) for k in takes]).alias("_fn")
    ).join(F.broadcast(n_tumor))
    values = F.array(*[F.lit(float(p)) for p in fractions])
    rows = F.explode(F.arrays_zip(values.alias("fraction"), F.col("_fn").alias("n_false"))).alias("_r")
    long = wide.select("n_tumor", rows)
    n = F.col("_r.n_false")
    return long.select(
        F.col("_r.fraction").alias("fraction"), n.alias("n_false"),
        F.coalesce(special.ratio(n, F.col("n_tumor")), F.lit(0.0)).alias("rate"),
    )


def loh_baf(counts: DataFrame, loh: DataFrame) -> DataFrame:
    """BAF of each cell over the lost-heterozygosity groups of each clone.

    ``loh``: ``(group_id, clone)``, a few rows. NULL without allele coverage.
    """
    small = loh.groupBy("group_id").agg(F.collect_set("clone").alias("_clones"))
    joined = join_dim(counts, small, ["group_id"], ["cell_id"])
    sums = joined.withColumn("clone", F.explode("_clones")).groupBy("cell_id", "clone").agg(
        F.sum("b").alias("b"), F.sum(F.col("a") + F.col("b")).alias("n")
    )
    return sums.withColumn("baf", special.ratio(F.col("b"), F.col("n")))


def baf_within_variance(cells: DataFrame, label: str) -> DataFrame:
    """Within-label BAF variance per group, over all cells and over tumour cells.

    ``cells``: ``(group_id, label, b, n)`` with coverage. Labels with one cell add
    nothing to the sum but count in the total.
    """
    covered = cells.filter(F.col("n") > 0).withColumn("_v", F.col("b") / F.col("n"))
    per_label = covered.groupBy("group_id", F.col(label).alias("_l")).agg(
        F.count(F.lit(1)).alias("_n"), F.var_pop("_v").alias("_var")
    )
    part = F.when(F.col("_n") > 1, F.col("_n") * F.col("_var")).otherwise(0.0)
    tumor = F.col("_l") != labels.NORMAL
    return per_label.groupBy("group_id").agg(
        special.ratio(F.sum(part), F.sum("_n")).alias("within_var"),
        special.ratio(
            F.sum(F.when(tumor, part).otherwise(0.0)), F.sum(F.when(tumor, F.col("_n")).otherwise(0))
        ).alias("within_var_tumor"),
    )


def count_totals(counts: DataFrame, masks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per cell: depth in all and in aneuploid groups, alleles in all and imbalanced."""
    joined = join_dim(counts, masks.select("group_id", "aneuploid", "imbalanced"), ["group_id"], ["cell_id"])
    n = F.col("a") + F.col("b")
    return joined.groupBy(*by, "cell_id").agg(
        F.sum("x").alias("x_all"),
        F.sum(F.when(F.col("aneuploid"), F.col("x")).otherwise(0)).alias("x_aneuploid"),
        F.sum(n).alias("n_all"),
        F.sum(F.when(F.col("imbalanced"), n).otherwise(0)).alias("n_imbalanced"),
    )


def total_medians(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median of each per-cell total within ``by``, one row per measure."""
    names = ["x_all", "x_aneuploid", "n_all", "n_imbalanced"]
    stacked = totals.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names
    ])).alias("_m")).select(*by, "_m.*")
    return ordering.exact_quantiles(stacked, "value", {"median": 0.5}, [*by, "measure"])


def observed_summary(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and label: cells, coverage above 3, median BAF and median RDR.

    ``cells`` has b, n, x, expected (depth times baseline).
    """
    keys = list(keys)
    tagged = cells.withColumns({
        "_baf": special.ratio(F.col("b"), F.col("n")),
        "_rdr": special.ratio(F.col("x"), F.col("expected")),
    })
    basic = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("_baf").alias("n_covered"),
        F.count_if(F.col("n") > 3).alias("n_deep"), F.sum("b").alias("b_total"),
    )
    long = tagged.select(*keys, F.explode(F.array(
        F.struct(F.lit("baf").alias("m"), F.col("_baf").alias("v")),
        F.struct(F.lit("rdr").alias("m"), F.col("_rdr").alias("v")),
    )).alias("_s")).select(*keys, F.col("_s.m").alias("_m"), F.col("_s.v").alias("_v"))
    medians = ordering.exact_quantiles(long, "_v", {"_q": 0.5}, [*keys, "_m"])
    wide = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("_m") == "baf", F.col("_q"))).alias("baf_median"),
        F.max(F.when(F.col("_m") == "rdr", F.col("_q"))).alias("rdr_median"),
    )
    return basic.join(wide, keys, "left")


def facet_points(cells: DataFrame, min_cells: int = 10) -> DataFrame:
    """BAF and log2 RDR of the covered cells of each group with enough of them.

    ``cells`` has group_id, b, n, x, expected and labels; RDR is floored at 1e-6.
    """
    valid = cells.filter((F.col("n") > 0) & (F.col("expected") > 0))
    sizes = valid.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_valid"))
    kept = join_dim(valid, sizes.filter(F.col("n_valid") >= min_cells), ["group_id"], ["cell_id"])
    floor = F.greatest(F.col("x") / F.col("expected"), F.lit(1e-6))
    return kept.withColumns({"baf": F.col("b") / F.col("n"), "log2rdr": F.log2(floor)})


def facet_counts(points: DataFrame, row: str, col: str) -> DataFrame:
    """Cells per facet with row and column sums (NULL marks a sum)."""
    counted = points.groupBy("group_id", F.col(row).alias("row"), F.col(col).alias("col")).agg(
        F.count(F.lit(1)).alias("n")
    )
    g, r, c = (F.col(name) for name in ("group_id", "row", "col"))
    sums = counted.groupingSets([[g, r, c], [g, r], [g, c]], g, r, c).agg(
        F.sum("n").alias("n"), F.grouping("row").alias("_r"), F.grouping("col").alias("_c")
    )
    return sums.select(
        "group_id", F.when(F.col("_r") == 0, r).otherwise("total").alias("row"),
        F.when(F.col("_c") == 0, c).otherwise("total").alias("col"), "n",
    )


def landmarks(long: DataFrame) -> DataFrame:
    """Expected BAF and log2 RDR of each clone and group (0.5 and 0 when undefined).

    ``long`` carries ``rdr`` of the clone (copies over baseline-weighted copies).
    """
    c = F.col("cn_c")
    return long.select(
        "group_id", "k", "clone",
        F.when(c > 0, F.col("cn_b") / c).otherwise(0.5).alias("exp_baf"),
        F.coalesce(special.log2(F.col("rdr")), F.lit(0.0)).alias("exp_log2rdr"),
    )


def label_shares(counts: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """Cells, share in percent, depth and alleles per label."""
    sizes = cells.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells"))
    sizes = sizes.withColumn(
        "pct", F.round(100.0 * F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(F.lit(1))), 1)
    )
    joined = join_dim(counts, cells.select("cell_id", label), ["cell_id"], ["bin_id"])
    sums = joined.groupBy(label).agg(
        F.sum("x").alias("x_total"), F.sum(F.col("a") + F.col("b")).alias("n_total")
    )
    return sizes.join(sums, label, "left")


def label_slots(columns: Sequence[tuple[DataFrame, str, bool]], palette: int = 10) -> DataFrame:
    """One colour slot per distinct label value over several label columns.

    ``columns``: frame, column and whether it is the primary one; values are visited
    primary first (clone order), then column by column in text order. Normal and
    invalid labels take no slot.
    """
    seen = None
    for i, (df, name, primary) in enumerate(columns):
        value = F.col("label")
        order = labels.clone_order(value) if primary else F.struct(
            F.lit(0).alias("kind"), F.lit(0).alias("number"), value.alias("text")
        )
        part = df.select(F.col(name).alias("label")).distinct().select(
            "label", F.struct(F.lit(i).alias("column"), order.alias("order")).alias("_at")
        )
        seen = part if seen is None else seen.unionByName(part)
    first = seen.groupBy("label").agg(F.min("_at").alias("_at")).filter(labels.takes_color_slot(F.col("label")))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_at")) - 1
    whole = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    slots = F.when(whole > palette, 2 * palette).otherwise(palette)
    return first.select("label", F.pmod(rank, slots).cast("int").alias("slot"))


def box_summary(long: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 interquartile ranges)."""
    quartiles = ordering.exact_quantiles(long, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, [key])
    joined = join_dim(long.filter(F.col(value).isNotNull()), quartiles, [key], [value])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.any_value("q1").alias("q1"), F.any_value("q2").alias("q2"),
        F.any_value("q3").alias("q3"),
        F.least(F.min(F.when(v >= F.col("q1") - reach, v)), F.any_value("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(v <= F.col("q3") + reach, v)), F.any_value("q3")).alias("whisker_high"),
    )
