"""Agreement of predicted labels with a reference.

Everything is first counted as a contingency table (one row per pair of labels), so
that the metrics themselves work on a few rows whatever the number of cells is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import labels
from cellmosaic.functions.special import ratio
from cellmosaic.operators import ordering


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def contingency(
    df: DataFrame, ref: str, pred: str, by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    return df.groupBy(*by, F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), *extra
    )


def crosstab_margins(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """Counts with ``total`` margins, rows with a known reference only."""
    known = df.filter(~labels.is_na(F.col(ref)))
    cube = contingency(known, ref, pred).cube("ref", "pred").agg(
        F.sum("n").alias("n"), F.grouping("ref").alias("_gr"), F.grouping("pred").alias("_gp")
    )
    return cube.select(
        F.when(F.col("_gr") == 1, "total").otherwise(F.col("ref")).alias("ref"),
        F.when(F.col("_gp") == 1, "total").otherwise(F.col("pred")).alias("pred"),
        "n",
    )


def adjusted_rand(table: DataFrame, by: Sequence[str] = (), name: str = "ari") -> DataFrame:
    """Adjusted Rand index of a contingency table ``(ref, pred, n)``.

    1 when both partitions are trivial in the same way (no pair is in doubt).
    """
    by = list(by)
    rows = table.groupBy(*by, "ref").agg(F.sum("n").alias("n"))
    cols = table.groupBy(*by, "pred").agg(F.sum("n").alias("n"))
    zero = F.lit(0.0)
    parts = (
        table.select(*by, _pairs(F.col("n")).alias("c"), zero.alias("r"), zero.alias("p"), F.col("n").alias("n"))
        .unionByName(rows.select(*by, zero.alias("c"), _pairs(F.col("n")).alias("r"), zero.alias("p"), F.lit(0).cast("bigint").alias("n")))
        .unionByName(cols.select(*by, zero.alias("c"), zero.alias("r"), _pairs(F.col("n")).alias("p"), F.lit(0).cast("bigint").alias("n")))
    )
    sums = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("c", "r", "p", "n")])
    expected = ratio(F.col("r") * F.col("p"), _pairs(F.col("n")))
    top = (F.col("r") + F.col("p")) / 2.0
    spread = top - F.coalesce(expected, F.lit(0.0))
    value = F.when(F.col("n") == 0, F.lit(None).cast("double")).when(
        F.abs(spread) < 1e-300, F.lit(1.0)
    ).otherwise((F.col("c") - F.coalesce(expected, F.lit(0.0))) / spread)
    return sums.select(*by, value.alias(name))


def binary_counts(df: DataFrame, ref: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp/fp/fn/tn of tumour calls over rows where both labels are known."""
    r, p = labels.is_tumor(F.col(ref)), labels.is_tumor(F.col(pred))
    known = ~labels.is_na(F.col(ref)) & ~labels.is_na(F.col(pred))

    def hits(cond: Column) -> Column:
        return F.count_if(known & cond)

    return df.groupBy(*by).agg(
        hits(r & p).alias("tp"), hits(~r & p).alias("fp"),
        hits(r & ~p).alias("fn"), hits(~r & ~p).alias("tn"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(labels.is_na(F.col(pred))).alias("n_na"),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, hard AUC and binary ARI from tp/fp/fn/tn.

    NULL unless the reference holds both classes; 0 where a denominator is 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    n = tp + fp + fn + tn

    def safe(num: Column, den: Column) -> Column:
        return F.when(both, F.coalesce(ratio(num, den), F.lit(0.0)))

    same = _pairs(tp) + _pairs(fp) + _pairs(fn) + _pairs(tn)
    rows = _pairs(tp + fn) + _pairs(fp + tn)
    cols = _pairs(tp + fp) + _pairs(fn + tn)
    expected = ratio(rows * cols, _pairs(n))
    spread = (rows + cols) / 2.0 - expected
    ari = F.when(both, F.when(F.abs(spread) > 0, (same - expected) / spread).otherwise(1.0))
    auc = F.when(both, (ratio(tp, tp + fn) + ratio(tn, fp + tn)) / 2.0)
    return counts.withColumns({
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "f1": safe(2.0 * tp, 2.0 * tp + fp + fn),
        "accuracy": safe((tp + tn).cast("double"), n),
        "auc_hard": auc,
        "ari_binary": ari,
    })


def auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve with tied scores averaged; NULL for a single class.

    ``truth`` is boolean; rows without a score are left out.
    """
    by = list(by)
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*by, score)
        .agg(F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg"))
    )
    ranked = ordering.running_totals(per_score, score, {"_neg_upto": "_neg"}, by)
    wins = F.col("_pos") * (F.col("_neg_upto") - F.col("_neg") / 2.0)
    sums = ranked.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    return sums.select(*by, ratio(F.col("_wins"), F.col("_p") * F.col("_n")).alias(name))


def clone_ari(df: DataFrame, ref: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """ARI over clone labels; NULL unless the reference has several tumour labels."""
    both = df.filter(~labels.is_na(F.col(ref)) & ~labels.is_na(F.col(pred)))
    table = contingency(both, ref, pred, by)
    kinds = table.groupBy(*by).agg(
        F.count_distinct(F.when(labels.is_tumor(F.col("ref")), F.col("ref"))).alias("_kinds")
    )
    value = adjusted_rand(table, by, "ari_clone")
    joined = value.join(kinds, list(by)) if by else value.join(F.broadcast(kinds))
    return joined.withColumn("ari_clone", F.when(F.col("_kinds") > 1, F.col("ari_clone"))).drop("_kinds")


def label_counts(df: DataFrame, pred: str, purity: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cells per predicted label and their mean purity."""
    extra = [F.avg(purity).alias("mean_purity")] if purity else []
    return df.groupBy(*by, F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("n"), *extra)


def class_report(df: DataFrame, ref: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label in either column."""
    table = contingency(df, ref, pred, by)
    hit = F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = table.select(*by, F.col("ref").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")).unionByName(
        table.select(*by, F.col("pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"))
    )
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])

    def safe(num: Column, den: Column) -> Column:
        return F.coalesce(ratio(num, den), F.lit(0.0))

    return sums.select(
        *by, "label",
        safe(F.col("tp"), F.col("predicted")).alias("precision"),
        safe(F.col("tp"), F.col("support")).alias("recall"),
        safe(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def multiclass_summary(df: DataFrame, ref: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1, weighted F1 and ARI over the union of labels."""
    by = list(by)
    report = class_report(df, ref, pred, by)
    n = F.sum("support")
    summary = report.groupBy(*by).agg(
        n.alias("n_cells"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )
    rand = adjusted_rand(contingency(df, ref, pred, by), by)
    return summary.join(rand, by) if by else summary.join(F.broadcast(rand))


def confusion(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """Counts over the union of both label sets, zeros included."""
    table = contingency(df, ref, pred)
    names = table.select(F.explode(F.array("ref", "pred")).alias("label")).agg(
        F.array_sort(F.collect_set("label")).alias("_names")
    )
    # the vocabulary is one row; unfolding it twice gives the empty cells
    grid = names.select(F.explode("_names").alias("ref"), "_names").select(
        "ref", F.explode("_names").alias("pred")
    )
    return grid.join(table, ["ref", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def purity_agreement(df: DataFrame, truth: str, value: str) -> DataFrame:
    """Pearson, Spearman (average ranks) and mean absolute error, one row."""
    both = df.filter(F.col(truth).isNotNull() & F.col(value).isNotNull()).select(truth, value)
    basic = both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.corr(truth, value).alias("pearson"),
        F.avg(F.abs(F.col(truth) - F.col(value))).alias("mae"),
    )
    # ranks depend on the value only, so equal pairs are counted first
    pairs = both.groupBy(truth, value).agg(F.count(F.lit(1)).alias("_w"))
    ranked = pairs.join(ordering.average_ranks(both, truth, "_ra").drop("_n"), truth).join(
        ordering.average_ranks(both, value, "_rb").drop("_n"), value
    )
    w, a, b = F.col("_w"), F.col("_ra"), F.col("_rb")
    moments = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n")
    cov = F.col("sab") / n - F.col("sa") / n * F.col("sb") / n
    va = F.col("saa") / n - F.pow(F.col("sa") / n, 2)
    vb = F.col("sbb") / n - F.pow(F.col("sb") / n, 2)
    spearman = moments.select(ratio(cov, F.sqrt(va * vb)).alias("spearman"))
    return basic.join(F.broadcast(spearman))


def init_normal(df: DataFrame, is_normal: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """How well a set of presumed normal cells matches the reference, per ``by``."""
    known = ~labels.is_na(F.col(ref))
    called, truth = F.col(is_normal), ~labels.is_tumor(F.col(ref))
    rows = df.filter(known)
    counts = (rows.groupBy(*by) if by else rows).agg(
        F.count_if(called & truth).alias("tp"), F.count_if(called & ~truth).alias("fp"),
        F.count_if(~called & truth).alias("fn"), F.count_if(~called & ~truth).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    with_rates = counts.withColumns({
        "precision": tp / F.greatest(tp + fp, F.lit(1)),
        "recall": tp / F.greatest(tp + fn, F.lit(1)),
    })
    p, r = F.col("precision"), F.col("recall")
    return with_rates.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-10)))


def posterior_stats(df: DataFrame, label: str, value: str = "max_posterior") -> DataFrame:
    """n, min, mean, median and max of the posterior per label."""
    basic = df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("post_min"),
        F.avg(value).alias("post_mean"), F.max(value).alias("post_max"),
    )
    medians = ordering.exact_quantiles(
        df.select(F.col(label).alias("label"), value), value, {"post_median": 0.5}, ["label"]
    )
    medians = medians.withColumnRenamed("label", "_label")
    return basic.join(medians, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def clone_fractions(df: DataFrame, label: str, clones: Sequence[str]) -> DataFrame:
    """Share of each clone, clones without cells included."""
    names = F.explode(F.array(*[F.lit(c) for c in clones])).alias("clone")
    counts = df.groupBy(F.col(label).alias("clone")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    wanted = total.select("total", names)
    joined = wanted.join(counts, "clone", "left")
    return joined.select(
        "clone", F.coalesce("n", F.lit(0)).alias("n"),
        ratio(F.coalesce("n", F.lit(0)), F.col("total")).alias("fraction"),
    )


def marginal_shares(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row and column totals of a contingency table with their percentage."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    row = Window.partitionBy(*by, "ref")
    col = Window.partitionBy(*by, "pred")
    n = F.col("n")
    return table.withColumns({
        "row_total": F.sum(n).over(row),
        "col_total": F.sum(n).over(col),
        "row_pct": 100.0 * F.sum(n).over(row) / F.sum(n).over(whole),
        "col_pct": 100.0 * F.sum(n).over(col) / F.sum(n).over(whole),
    })


def crosstab_report(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """Contingency table in report order with an error flag and marginal shares."""
    table = marginal_shares(contingency(df, ref, pred))
    r, p = F.col("ref"), F.col("pred")
    wrong = (
        p.isin(labels.NA_LABELS)
        | (labels.is_tumor(r) & (p == labels.NORMAL))
        | (~labels.is_tumor(r) & labels.is_tumor(p))
    )
    rows = table.select("ref").distinct().withColumn(
        "row_pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(labels.report_row_order(r)))
    )
    cols = table.select("pred").distinct().withColumn(
        "col_pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(labels.report_column_order(p)))
    )
    return (
        table.withColumn("is_error", ~labels.is_na_any_case(r) & wrong)
        .join(rows, "ref").join(cols, "pred")
    )
