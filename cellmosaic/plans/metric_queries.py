"""Queries on agreement of predicted labels with the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import labels
from cellmosaic.operators import cutoffs, metrics, ordering
from cellmosaic.operators.panel import metric_bars
from cellmosaic.plans.inputs import CLONES, Inputs
from cellmosaic.plans.registry import query, r6

REF, PRED = "cell_type", "label"

# closed form of the adjusted Rand index over a table ``tab(ref, pred, n)``
_ARI = """
  cc AS (SELECT sum(n * (n - 1) / 2.0) AS v, sum(n) AS n FROM tab),
  rr AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT ref, sum(n) AS n FROM tab GROUP BY ref)),
  pp AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT pred, sum(n) AS n FROM tab GROUP BY pred)),
  rand AS (SELECT (cc.v - rr.v * pp.v / (cc.n * (cc.n - 1) / 2.0)) / ((rr.v + pp.v) / 2.0 - rr.v * pp.v / (cc.n * (cc.n - 1) / 2.0)) AS ari
    FROM cc, rr, pp)
"""


@query("""SELECT CASE WHEN grouping(cell_type) = 1 THEN 'total' ELSE cell_type END AS ref,
  CASE WHEN grouping(label) = 1 THEN 'total' ELSE label END AS pred, count(*) AS n
  FROM typed WHERE NOT ref_na GROUP BY CUBE (cell_type, label)""")
def crosstab_margins(t: Inputs) -> DataFrame:
    return metrics.crosstab_margins(t.cells, REF, PRED)


_BINARY = """b AS (SELECT {keys}
    count(CASE WHEN {r} AND {p} THEN 1 END)::DOUBLE AS tp, count(CASE WHEN NOT {r} AND {p} THEN 1 END)::DOUBLE AS fp,
    count(CASE WHEN {r} AND NOT {p} THEN 1 END)::DOUBLE AS fn, count(CASE WHEN NOT {r} AND NOT {p} THEN 1 END)::DOUBLE AS tn
    FROM {src} WHERE {known} {group})"""
_ARI2 = """((tp*(tp-1) + fp*(fp-1) + fn*(fn-1) + tn*(tn-1)) / 2
   - ((tp+fn)*(tp+fn-1) + (fp+tn)*(fp+tn-1)) / 2 * ((tp+fp)*(tp+fp-1) + (fn+tn)*(fn+tn-1)) / 2 / ((tp+fp+fn+tn)*(tp+fp+fn+tn-1)/2))
  / ((((tp+fn)*(tp+fn-1) + (fp+tn)*(fp+tn-1)) / 2 + ((tp+fp)*(tp+fp-1) + (fn+tn)*(fn+tn-1)) / 2) / 2
   - ((tp+fn)*(tp+fn-1) + (fp+tn)*(fp+tn-1)) / 2 * ((tp+fp)*(tp+fp-1) + (fn+tn)*(fn+tn-1)) / 2 / ((tp+fp+fn+tn)*(tp+fp+fn+tn-1)/2))"""


@query(_BINARY.format(keys="rep_id,", r="ref_tumor", p="pred_tumor", src="typed", known="NOT ref_na AND NOT pred_na", group="GROUP BY rep_id") + f"""
  SELECT b.rep_id, s.total, s.n_na, round(tp / nullif(tp + fp, 0), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) + 0.0 AS accuracy,
    round((tp / (tp + fn) + tn / (fp + tn)) / 2, 6) + 0.0 AS auc_hard, round({_ARI2}, 6) + 0.0 AS ari_binary
  FROM b JOIN (SELECT rep_id, count(*) AS total, count(CASE WHEN pred_na THEN 1 END) AS n_na FROM typed GROUP BY rep_id) s USING (rep_id)""")
def binary_metrics(t: Inputs) -> DataFrame:
    out = metrics.binary_metrics(metrics.binary_counts(t.cells, REF, PRED, ["rep_id"]))
    names = ["precision", "recall", "f1", "accuracy", "auc_hard", "ari_binary"]
    return out.select("rep_id", "total", "n_na", *[r6(F.col(c)).alias(c) for c in names])


@query("SELECT label, count(*) AS n, round(avg(tumor_purity), 6) + 0.0 AS mean_purity FROM cells GROUP BY label")
def label_counts(t: Inputs) -> DataFrame:
    return metrics.label_counts(t.cells, PRED, "tumor_purity").withColumn("mean_purity", r6(F.col("mean_purity")))


@query("""known AS (SELECT rep_id, ref_tumor, tumor_purity FROM typed WHERE NOT ref_na AND NOT pred_na),
  ranked AS (SELECT rep_id, ref_tumor, rank() OVER (PARTITION BY rep_id ORDER BY tumor_purity)
     + (count(*) OVER (PARTITION BY rep_id, tumor_purity) - 1) / 2.0 AS r FROM known)
  SELECT rep_id, round((sum(CASE WHEN ref_tumor THEN r END) - count(CASE WHEN ref_tumor THEN 1 END) * (count(CASE WHEN ref_tumor THEN 1 END) + 1) / 2.0)
    / (count(CASE WHEN ref_tumor THEN 1 END) * count(CASE WHEN NOT ref_tumor THEN 1 END)), 6) + 0.0 AS auc_soft FROM ranked GROUP BY rep_id""")
def auc_soft(t: Inputs) -> DataFrame:
    known = t.cells.filter(~labels.is_na(F.col(REF)) & ~labels.is_na(F.col(PRED)))
    truth = known.withColumn("truth", labels.is_tumor(F.col(REF)))
    out = metrics.auc(truth, "truth", "tumor_purity", ["rep_id"], "auc_soft")
    return out.withColumn("auc_soft", r6(F.col("auc_soft")))


@query("""ranked AS (SELECT ref_tumor AS y, rank() OVER (ORDER BY max_posterior) + (count(*) OVER (PARTITION BY max_posterior) - 1) / 2.0 AS r FROM typed WHERE NOT ref_na)
  SELECT round((sum(CASE WHEN y THEN r END) - count(CASE WHEN y THEN 1 END) * (count(CASE WHEN y THEN 1 END) + 1) / 2.0)
    / (count(CASE WHEN y THEN 1 END) * count(CASE WHEN NOT y THEN 1 END)), 6) + 0.0 AS auc FROM ranked""")
def auc_overall(t: Inputs) -> DataFrame:
    known = t.cells.filter(~labels.is_na(F.col(REF))).withColumn("truth", labels.is_tumor(F.col(REF)))
    out = metrics.auc(known, "truth", "max_posterior")
    return out.withColumn("auc", r6(F.col("auc")))


@query("tab AS (SELECT cell_type AS ref, label AS pred, count(*) AS n FROM typed WHERE NOT ref_na AND NOT pred_na GROUP BY 1, 2)," + _ARI
       + "SELECT round(ari, 6) + 0.0 AS ari_clone FROM rand")
def clone_ari(t: Inputs) -> DataFrame:
    return metrics.clone_ari(t.cells, REF, PRED).withColumn("ari_clone", r6(F.col("ari_clone")))


def _truth(t: Inputs) -> DataFrame:
    """Truth joined with predictions on the barcode; NA predictions are left out."""
    n = F.col("cell_id") * 3 % 7
    name = F.when(n < 3, "normal").when(n < 5, "clone1").otherwise("clone3")
    truth = t.cells.select("barcode", name.alias("true_label"))
    pred = t.cells.select("barcode", PRED)
    return truth.join(pred, "barcode").filter(~labels.is_na(F.col(PRED)))


_TRUTH = """truth AS (SELECT CASE WHEN cell_id * 3 % 7 < 3 THEN 'normal' WHEN cell_id * 3 % 7 < 5 THEN 'clone1' ELSE 'clone3' END AS ref, label AS pred
    FROM typed WHERE NOT pred_na),
  tab AS (SELECT ref, pred, count(*) AS n FROM truth GROUP BY 1, 2),
  names AS (SELECT ref AS label FROM tab UNION SELECT pred FROM tab),
  rep AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM tab WHERE ref = label)::DOUBLE AS support,
     (SELECT coalesce(sum(n), 0) FROM tab WHERE pred = label)::DOUBLE AS predicted,
     (SELECT coalesce(sum(n), 0) FROM tab WHERE pred = label AND ref = label)::DOUBLE AS tp FROM names),
  report AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
     coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, support FROM rep)
"""


@query(_TRUTH + """SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1,
  CAST(support AS BIGINT) AS support FROM report""")
def class_report(t: Inputs) -> DataFrame:
    out = metrics.class_report(_truth(t), "true_label", PRED)
    return out.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_TRUTH + "," + _ARI + """SELECT CAST(sum(support) AS BIGINT) AS n_cells, round(sum(recall * support) / sum(support), 6) + 0.0 AS accuracy,
  round(avg(f1), 6) + 0.0 AS f1_macro, round(sum(f1 * support) / sum(support), 6) + 0.0 AS f1_weighted, round(min(ari), 6) + 0.0 AS ari FROM report, rand""")
def multiclass_summary(t: Inputs) -> DataFrame:
    out = metrics.multiclass_summary(_truth(t), "true_label", PRED)
    return out.select("n_cells", *[r6(F.col(c)).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted", "ari")])


@query(_TRUTH + """SELECT a.label AS ref, b.label AS pred, coalesce(n, 0) AS n FROM names a CROSS JOIN names b
  LEFT JOIN tab ON tab.ref = a.label AND tab.pred = b.label""")
def confusion_table(t: Inputs) -> DataFrame:
    return metrics.confusion(_truth(t), "true_label", PRED)


@query("""v AS (SELECT tumor_purity AS a, (cell_id * 13 % 50) / 50.0::DOUBLE AS b FROM cells),
  r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
     rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM v)
  SELECT count(*) AS n_rows, round(corr(a, b), 6) + 0.0 AS pearson, round(corr(ra, rb), 6) + 0.0 AS spearman, round(avg(abs(a - b)), 6) + 0.0 AS mae FROM r""")
def purity_agreement(t: Inputs) -> DataFrame:
    both = t.cells.select("tumor_purity", ((F.col("cell_id") * 13 % 50) / 50.0).alias("truth"))
    out = metrics.purity_agreement(both, "tumor_purity", "truth")
    return out.select("n_rows", *[r6(F.col(c)).alias(c) for c in ("pearson", "spearman", "mae")])


@query("""c AS (SELECT count(CASE WHEN n AND NOT ref_tumor THEN 1 END) AS tp, count(CASE WHEN n AND ref_tumor THEN 1 END) AS fp,
    count(CASE WHEN NOT n AND NOT ref_tumor THEN 1 END) AS fn, count(CASE WHEN NOT n AND ref_tumor THEN 1 END) AS tn
    FROM (SELECT *, label = 'normal' AS n FROM typed) WHERE NOT ref_na),
  p AS (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS precision, tp::DOUBLE / greatest(tp + fn, 1) AS recall FROM c)
  SELECT tp, fp, fn, tn, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
    round(2 * precision * recall / greatest(precision + recall, 1e-10), 6) + 0.0 AS f1 FROM p""")
def init_normal(t: Inputs) -> DataFrame:
    out = metrics.init_normal(t.cells.withColumn("called", F.col(PRED) == "normal"), "called", REF)
    return out.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT label, count(*) AS n, min(max_posterior) AS post_min, round(avg(max_posterior), 6) + 0.0 AS post_mean,
  round(median(max_posterior), 6) + 0.0 AS post_median, max(max_posterior) AS post_max FROM cells GROUP BY label""")
def posterior_stats(t: Inputs) -> DataFrame:
    out = metrics.posterior_stats(t.cells, PRED)
    return out.withColumns({c: r6(F.col(c)) for c in ("post_mean", "post_median")})


@query("""names(clone) AS (VALUES ('normal'), ('clone1'), ('clone2'), ('clone3'))
  SELECT clone, count(cell_id) AS n, round(count(cell_id)::DOUBLE / (SELECT count(*) FROM cells), 6) + 0.0 AS fraction
  FROM names LEFT JOIN cells ON label = clone GROUP BY clone""")
def clone_fractions(t: Inputs) -> DataFrame:
    out = metrics.clone_fractions(t.cells, PRED, [*CLONES, "clone3"])
    return out.withColumn("fraction", r6(F.col("fraction")))


@query("""tab AS (SELECT cell_type AS ref, label AS pred, count(*) AS n, bool_or(ref_tumor) AS rt, bool_or(ref_na) AS rn,
    bool_or(pred_tumor) AS pt, bool_or(pred_na) AS pn FROM typed GROUP BY 1, 2),
  rp AS (SELECT ref, row_number() OVER (ORDER BY rt, ref) AS row_pos FROM (SELECT DISTINCT ref, rt FROM tab)),
  cp AS (SELECT pred, row_number() OVER (ORDER BY CASE WHEN pred = 'normal' THEN 0 WHEN pt THEN 1 WHEN pn THEN 3 ELSE 2 END, pred) AS col_pos
    FROM (SELECT DISTINCT pred, pt, pn FROM tab))
  SELECT ref, pred, n, NOT rn AND (pn OR (rt AND pred = 'normal') OR (NOT rt AND pt)) AS is_error,
    CAST(sum(n) OVER (PARTITION BY ref) AS BIGINT) AS row_total, CAST(sum(n) OVER (PARTITION BY pred) AS BIGINT) AS col_total,
    round(100.0 * sum(n) OVER (PARTITION BY ref) / sum(n) OVER (), 4) + 0.0 AS row_pct,
    round(100.0 * sum(n) OVER (PARTITION BY pred) / sum(n) OVER (), 4) + 0.0 AS col_pct, row_pos, col_pos
  FROM tab JOIN rp USING (ref) JOIN cp USING (pred)""")
def crosstab_report(t: Inputs) -> DataFrame:
    out = metrics.crosstab_report(t.cells, REF, PRED)
    return out.withColumns({
        "row_pct": r6(F.col("row_pct"), 4), "col_pct": r6(F.col("col_pct"), 4),
        "row_pos": F.col("row_pos").cast("bigint"), "col_pos": F.col("col_pos").cast("bigint"),
    })


_SWEEP = """grid AS (SELECT 0 AS cut_no, 'label' AS cutoff, 0.0::DOUBLE AS pc, 0.0::DOUBLE AS tc
    UNION ALL SELECT 1 + i, 'label_pcut' || ['0.5', '0.6', '0.7'][i + 1], [0.5, 0.6, 0.7][i + 1]::DOUBLE, 0.0 FROM range(3) r(i)
    UNION ALL SELECT 4 + 5 * i + j, 'label_pcut' || ['0.5', '0.6', '0.7'][i + 1] || '_post' || ['0.5', '0.6', '0.7', '0.8', '0.9'][j + 1],
       [0.5, 0.6, 0.7][i + 1]::DOUBLE, [0.5, 0.6, 0.7, 0.8, 0.9][j + 1]::DOUBLE FROM range(3) r(i), range(5) q(j)),
  low AS (SELECT g.*, t.*, CASE WHEN pc > 0 AND label <> 'NA' AND tumor_purity <= pc THEN 'normal' ELSE label END AS l1 FROM typed t CROSS JOIN grid g),
  swept AS (SELECT *, CASE WHEN tc > 0 AND l1 NOT IN ('NA', 'normal') AND max_posterior <= tc THEN 'normal' ELSE l1 END AS l2 FROM low)
"""


@query(_SWEEP + "SELECT cutoff, l2 AS label, count(*) AS n FROM swept GROUP BY 1, 2")
def cutoff_labels(t: Inputs) -> DataFrame:
    swept = cutoffs.sweep(t.cells, PRED)
    return swept.groupBy("cutoff", PRED).agg(F.count(F.lit(1)).alias("n"))


@query(_SWEEP + "," + _BINARY.format(keys="cutoff,", r="ref_tumor", p="(l2 IN ('clone1', 'clone2'))", src="swept", known="NOT ref_na AND l2 <> 'NA'", group="GROUP BY cutoff") + f"""
  SELECT cutoff, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1, round({_ARI2}, 6) + 0.0 AS ari_binary FROM b""")
def cutoff_sweep(t: Inputs) -> DataFrame:
    swept = cutoffs.sweep(t.cells, PRED)
    out = metrics.binary_metrics(metrics.binary_counts(swept, REF, PRED, ["cutoff"]))
    names = ["precision", "recall", "f1", "ari_binary"]
    return out.select("cutoff", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in names])


_CUT_ARI = _SWEEP + """, tab AS (SELECT cut_no, cutoff, cell_type AS ref, l2 AS pred, count(*)::DOUBLE AS n FROM swept WHERE NOT ref_na AND l2 <> 'NA' GROUP BY ALL),
  cc AS (SELECT cut_no, cutoff, sum(n * (n - 1) / 2.0) AS v, sum(n) AS n FROM tab GROUP BY ALL),
  rr AS (SELECT cut_no, sum(n * (n - 1) / 2.0) AS r FROM (SELECT cut_no, ref, sum(n) AS n FROM tab GROUP BY ALL) GROUP BY ALL),
  pp AS (SELECT cut_no, sum(n * (n - 1) / 2.0) AS p FROM (SELECT cut_no, pred, sum(n) AS n FROM tab GROUP BY ALL) GROUP BY ALL),
  rand AS (SELECT cut_no, cutoff, (v - r * p / (n * (n - 1) / 2.0)) / ((r + p) / 2.0 - r * p / (n * (n - 1) / 2.0)) AS ari
    FROM cc JOIN rr USING (cut_no) JOIN pp USING (cut_no))
"""


@query(_CUT_ARI + "SELECT CAST(cut_no AS BIGINT) AS cut_no, cutoff, round(ari, 6) + 0.0 AS ari_clone FROM rand ORDER BY round(ari, 9) DESC, cut_no LIMIT 1")
def best_cutoff(t: Inputs) -> DataFrame:
    swept = cutoffs.sweep(t.cells, PRED)
    values = metrics.clone_ari(swept, REF, PRED, ["cut_no", "cutoff"])
    # rounding makes a tie of equal cutoffs independent of summation order
    best = cutoffs.best_cutoff(values.withColumn("ari_clone", F.round("ari_clone", 9)))
    return best.select(F.col("cut_no").cast("bigint").alias("cut_no"), "cutoff", r6(F.col("ari_clone")).alias("ari_clone"))


_RUNS = """runs AS (SELECT s_suppkey AS run_no, 'S' || (s_suppkey % 7) AS sample, 'G' || (s_suppkey % 2) AS cancer_type,
   CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 7 = 5 THEN NULL ELSE (s_suppkey * 37 % 100) / 100.0::DOUBLE END AS f1,
   CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey * 31 % 100) / 100.0::DOUBLE END AS precision FROM supplier)
"""


def _runs(t: Inputs) -> DataFrame:
    n = F.col("s_suppkey")
    none = F.lit(None).cast("double")
    return t.raw("supplier").select(
        n.alias("run_no"), F.concat(F.lit("S"), (n % 7).cast("string")).alias("sample"),
        F.concat(F.lit("G"), (n % 2).cast("string")).alias("cancer_type"),
        F.when((n % 3 == 0) | (n % 7 == 5), none).otherwise((n * 37 % 100) / 100.0).alias("f1"),
        F.when(n % 5 == 0, none).otherwise((n * 31 % 100) / 100.0).alias("precision"),
    )


@query(_RUNS + """SELECT run_no, sample, f1 FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY f1 DESC NULLS LAST, run_no) AS rn FROM runs) WHERE rn = 1""")
def best_run(t: Inputs) -> DataFrame:
    return cutoffs.best_run(_runs(t), "sample", "f1", "run_no").select("run_no", "sample", "f1")


@query(_RUNS + """SELECT cancer_type, sample, run_no, f1, precision FROM (SELECT *, row_number() OVER (PARTITION BY cancer_type, sample ORDER BY f1 DESC NULLS LAST, run_no) AS rn
   FROM runs WHERE f1 IS NOT NULL OR precision IS NOT NULL) WHERE rn = 1""")
def metric_bar_rows(t: Inputs) -> DataFrame:
    return metric_bars(_runs(t), ["f1", "precision"], "sample", "cancer_type", "run_no")


@query("""SELECT refined, count(*) AS n FROM (SELECT CASE WHEN (ref_tumor AND label = 'normal') OR (NOT ref_tumor AND label <> 'normal') THEN 'NA' ELSE label END AS refined
  FROM typed) GROUP BY refined""")
def refined_labels(t: Inputs) -> DataFrame:
    out = t.cells.select(cutoffs.refine_by_reference(F.col(PRED), F.col(REF)).alias("refined"))
    return out.groupBy("refined").agg(F.count(F.lit(1)).alias("n"))


@query("""g AS (SELECT CASE WHEN c_custkey % 4 <> 3 THEN c_mktsegment END AS kind, c_acctbal AS v FROM customer)
  SELECT kind, count(*) AS n, round(quantile_cont(v, 0.5), 6) + 0.0 AS median FROM g GROUP BY kind""")
def medians_with_null_group(t: Inputs) -> DataFrame:
    """A NULL key is a group of its own."""
    kind = F.when(F.col("c_custkey") % 4 != 3, F.col("c_mktsegment"))
    rows = t.raw("customer").select(kind.alias("kind"), F.col("c_acctbal").alias("v"))
    sizes = rows.groupBy(F.col("kind").alias("_kind")).agg(F.count(F.lit(1)).alias("n"))
    medians = ordering.exact_quantiles(rows, "v", {"median": 0.5}, ["kind"])
    joined = medians.join(sizes, F.col("kind").eqNullSafe(F.col("_kind")))
    return joined.select("kind", "n", r6(F.col("median")).alias("median"))
