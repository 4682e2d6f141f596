"""Queries behind the report figures, the clustering baseline and panels of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.operators import clustering, grouping, modality, panel, profile, reports
from cellmosaic.operators.joins import join_dim
from cellmosaic.plans.inputs import Inputs
from cellmosaic.plans.registry import query, r6
from cellmosaic.session import durable

ROW_CELLS = 10


def _long_id(df: DataFrame) -> DataFrame:
    return df.withColumn("group_id", F.col("group_id").cast("bigint"))


_ROWS = """rows AS (SELECT cell_id, label, cell_type, tumor_purity, (row_number() OVER (PARTITION BY label ORDER BY cell_type, cell_id) - 1) // 10 AS row_in_label FROM cells)
"""


def _rows(t: Inputs) -> DataFrame:
    return reports.row_layout(t.cells, "label", ["cell_type"], ROW_CELLS)


@query(_ROWS + "SELECT cell_id, label, row_in_label FROM rows")
def heatmap_rows(t: Inputs) -> DataFrame:
    return _rows(t).select("cell_id", "label", "row_in_label")


@query(_ROWS + """, m AS (SELECT label, row_in_label, cell_type, count(*) AS n FROM rows GROUP BY ALL),
  top AS (SELECT label, row_in_label, cell_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY label, row_in_label ORDER BY n DESC, cell_type) AS rn FROM m) WHERE rn = 1),
  p AS (SELECT label, row_in_label, count(*) AS n_cells, round(avg(tumor_purity), 6) AS mean_purity FROM rows GROUP BY ALL)
  SELECT label, row_in_label, mode, n_cells, mean_purity + 0.0 AS mean_purity, row_number() OVER (PARTITION BY label ORDER BY mean_purity DESC, row_in_label) AS row_pos
  FROM p JOIN top USING (label, row_in_label)""")
def row_mode(t: Inputs) -> DataFrame:
    summary = reports.row_summary(_rows(t), ["label", "row_in_label"], "cell_type", "tumor_purity")
    rounded = summary.withColumn("mean_purity", r6(F.col("mean_purity")))
    return reports.order_by_purity(rounded, "label").withColumn("row_pos", F.col("row_pos").cast("bigint"))


@query(_ROWS + """, s AS (SELECT label, row_in_label, group_id, sum(x) AS x, sum(a) AS a, sum(b) AS b FROM dense JOIN rows USING (cell_id) GROUP BY ALL),
  v AS (SELECT s.*, sum(x) OVER (PARTITION BY label, row_in_label) AS total, lam_g FROM s JOIN baseline USING (group_id))
  SELECT label, row_in_label, group_id, round(CASE WHEN a + b > 0 THEN b / (a + b) END, 6) + 0.0 AS baf, round(x / (total * lam_g), 6) + 0.0 AS rdr,
    round(CASE WHEN x > 0 THEN log2(x / (total * lam_g)) ELSE 0 END, 6) + 0.0 AS log2rdr, round(CASE WHEN x > 0 THEN x / total END, 6) + 0.0 AS depth_share FROM v""")
def heatmap_matrix(t: Inputs) -> DataFrame:
    sums = reports.aggregate_rows(t.dense, _rows(t), ["label", "row_in_label"])
    out = reports.heatmap_values(sums, t.baseline)
    return _long_id(out).select(
        "label", "row_in_label", "group_id", *[r6(F.col(c)).alias(c) for c in ("baf", "rdr", "log2rdr", "depth_share")]
    )


_HIST = """(SELECT CAST(least(g + CASE WHEN v >= 0.0 + (g + 1) * {w} THEN 1 ELSE 0 END - CASE WHEN v < 0.0 + g * {w} THEN 1 ELSE 0 END, {last}) AS INTEGER) AS bin {keys}
   FROM (SELECT *, floor((v - 0.0) / {w}) AS g FROM {src}) WHERE v >= 0 AND v <= {hi})"""


@query("v AS (SELECT label, tumor_purity AS v FROM cells), h AS (SELECT label, bin, count(*) AS n FROM "
       + _HIST.format(w="0.02::DOUBLE", last=49, hi=1, src="v", keys=", label") + """ GROUP BY ALL)
  SELECT l.label, CAST(r.i AS INTEGER) AS bin, round(r.i * 0.02::DOUBLE, 6) + 0.0 AS edge, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT label FROM cells) l CROSS JOIN range(50) r(i) LEFT JOIN h ON h.label = l.label AND h.bin = r.i""")
def purity_histogram(t: Inputs) -> DataFrame:
    out = reports.histogram(t.cells, F.col("tumor_purity"), 0.0, 1.0, 50, ["label"])
    return out.withColumn("edge", r6(F.col("edge")))


@query("v AS (SELECT max_posterior AS v FROM cells), h AS (SELECT bin, count(*) AS n FROM "
       + _HIST.format(w="0.025::DOUBLE", last=39, hi=1, src="v", keys="") + """ GROUP BY ALL)
  SELECT CAST(r.i AS INTEGER) AS bin, round(r.i * 0.025::DOUBLE, 6) + 0.0 AS edge, coalesce(n, 0) AS n FROM range(40) r(i) LEFT JOIN h ON h.bin = r.i""")
def posterior_histogram(t: Inputs) -> DataFrame:
    out = reports.histogram(t.cells, F.col("max_posterior"), 0.0, 1.0, 40)
    return out.withColumn("edge", r6(F.col("edge")))


@query("""g AS (SELECT i, round(i * 0.1, 1)::DOUBLE AS c FROM range(11) r(i)), k AS (SELECT * FROM typed WHERE NOT ref_na)
  SELECT c AS cutoff, (SELECT count(*) FROM k WHERE ref_tumor AND max_posterior < 0.5 AND max_posterior < c) AS n_false,
    round((SELECT count(*) FROM k WHERE ref_tumor AND max_posterior < 0.5 AND max_posterior < c)::DOUBLE / (SELECT count(*) FROM k WHERE ref_tumor), 6) + 0.0 AS rate FROM g""")
def contamination_sweep(t: Inputs) -> DataFrame:
    out = reports.contamination_sweep(t.cells, "max_posterior", "cell_type")
    return out.withColumn("rate", r6(F.col("rate")))


@query("""k AS (SELECT * FROM typed WHERE NOT ref_na), pool AS (SELECT *, row_number() OVER (ORDER BY max_posterior, cell_id) AS rn FROM k WHERE max_posterior < 0.5),
  n AS (SELECT count(*) AS n FROM pool), f AS (SELECT (i / 10.0)::DOUBLE AS p, greatest(1, round_even((i / 10.0)::DOUBLE * (SELECT n FROM n), 0)) AS take FROM range(1, 11) r(i))
  SELECT p AS fraction, (SELECT count(*) FROM pool WHERE ref_tumor AND rn <= take) AS n_false,
    round((SELECT count(*) FROM pool WHERE ref_tumor AND rn <= take)::DOUBLE / (SELECT count(*) FROM k WHERE ref_tumor), 6) + 0.0 AS rate FROM f""")
def top_fraction_sweep(t: Inputs) -> DataFrame:
    out = reports.top_fraction_sweep(t.cells, "max_posterior", "cell_type")
    return out.withColumn("rate", r6(F.col("rate")))


@query("""SELECT d.cell_id, c.clone, CAST(sum(d.b) AS BIGINT) AS b, CAST(sum(d.a + d.b) AS BIGINT) AS n, round(CASE WHEN sum(d.a + d.b) > 0 THEN sum(d.b) / sum(d.a + d.b) END, 6) + 0.0 AS baf
  FROM dense d JOIN clones c USING (group_id) WHERE c.k >= 1 AND c.cn_b = 0 AND c.cn_a > 0 GROUP BY 1, 2""")
def loh_baf(t: Inputs) -> DataFrame:
    from cellmosaic.operators.profile import loh_rows

    out = reports.loh_baf(t.dense, loh_rows(t.clones_long).select("group_id", "clone"))
    return out.withColumn("baf", r6(F.col("baf")))


def _labelled(t: Inputs) -> DataFrame:
    """Dense counts on informative groups with labels, n and the default expectation."""
    tags = t.cells.select("cell_id", "label", "cell_type", "rep_id")
    share = t.cluster_sums.groupBy("group_id").agg(F.sum("x").alias("_x"))
    whole = share.agg(F.sum("_x").alias("_all"))
    lam = share.join(F.broadcast(whole)).select("group_id", (F.col("_x") / F.col("_all")).alias("share"))
    masks = t.clusters.filter("imbalanced OR aneuploid").select("group_id", "imbalanced", "aneuploid")
    side = masks.join(lam, "group_id")
    rows = join_dim(t.dense_total, side, ["group_id"], ["cell_id"], bound=t.bins)
    joined = join_dim(rows, tags, ["cell_id"], ["group_id"], bound=t.raw("customer"))
    return joined.withColumns({
        "n": F.col("a") + F.col("b"), "expected": F.col("total") * F.col("share"),
    })


_LAB = """share AS (SELECT group_id, sum(x)::DOUBLE / sum(sum(x)) OVER () AS share FROM cluster_sums GROUP BY 1),
  lab AS (SELECT d.cell_id, d.group_id, d.x, d.b, d.a + d.b AS n, d.total * s.share AS expected, c.label, c.cell_type, c.rep_id
    FROM depth d JOIN share s USING (group_id) JOIN cells c USING (cell_id) JOIN clusters g USING (group_id) WHERE g.imbalanced OR g.aneuploid)
"""


@query(_LAB + """, v AS (SELECT group_id, label, count(*) AS n, var_pop(b / n::DOUBLE) AS v FROM lab WHERE n > 0 GROUP BY 1, 2)
  SELECT group_id, round(sum(CASE WHEN n > 1 THEN n * v ELSE 0 END) / sum(n), 6) + 0.0 AS within_var,
    round(sum(CASE WHEN n > 1 AND label <> 'normal' THEN n * v ELSE 0 END) / sum(CASE WHEN label <> 'normal' THEN n END), 6) + 0.0 AS within_var_tumor FROM v GROUP BY 1""")
def baf_within_variance(t: Inputs) -> DataFrame:
    out = _long_id(reports.baf_within_variance(_labelled(t), "label"))
    return out.withColumns({c: r6(F.col(c)) for c in ("within_var", "within_var_tumor")})


@query(_LAB + """SELECT group_id, label, count(*) AS n_cells, count(CASE WHEN n > 0 THEN 1 END) AS n_covered, count(CASE WHEN n > 3 THEN 1 END) AS n_deep, CAST(sum(b) AS BIGINT) AS b_total,
  round(median(CASE WHEN n > 0 THEN b / n::DOUBLE END), 6) + 0.0 AS baf_median, round(median(x / expected), 6) + 0.0 AS rdr_median FROM lab GROUP BY 1, 2""")
def observed_medians(t: Inputs) -> DataFrame:
    out = _long_id(reports.observed_summary(_labelled(t), ["group_id", "label"]))
    return out.withColumns({c: r6(F.col(c)) for c in ("baf_median", "rdr_median")})


@query(_LAB + """SELECT cell_id, group_id, round(b / n::DOUBLE, 6) + 0.0 AS baf, round(log2(greatest(x / expected, 1e-6)), 6) + 0.0 AS log2rdr
  FROM lab WHERE n > 0 AND expected > 0 AND group_id IN (SELECT group_id FROM lab WHERE n > 0 AND expected > 0 GROUP BY 1 HAVING count(*) >= 10)""")
def facet_points(t: Inputs) -> DataFrame:
    out = _long_id(reports.facet_points(_labelled(t)))
    return out.select("cell_id", "group_id", r6(F.col("baf")).alias("baf"), r6(F.col("log2rdr")).alias("log2rdr"))


@query(_LAB + """SELECT group_id, coalesce(cell_type, 'total') AS row, coalesce(label, 'total') AS col, count(*) AS n FROM lab
  WHERE n > 0 AND expected > 0 GROUP BY GROUPING SETS ((group_id, cell_type, label), (group_id, cell_type), (group_id, label))""")
def facet_counts(t: Inputs) -> DataFrame:
    points = reports.facet_points(_labelled(t), min_cells=1)
    return _long_id(reports.facet_counts(points, "cell_type", "label"))


@query("""SELECT group_id, k, clone, round(CASE WHEN cn_c > 0 THEN cn_b / cn_c::DOUBLE ELSE 0.5 END, 6) + 0.0 AS exp_baf, round(CASE WHEN cn_c > 0 THEN log2(rdr) ELSE 0 END, 6) + 0.0 AS exp_log2rdr FROM clone_depth""")
def clone_landmarks(t: Inputs) -> DataFrame:
    out = _long_id(reports.landmarks(t.clone_depth))
    return out.withColumns({c: r6(F.col(c)) for c in ("exp_baf", "exp_log2rdr")})


@query("""tot AS (SELECT d.cell_id, c.rep_id, sum(d.x)::DOUBLE AS x_all, sum(CASE WHEN aneuploid THEN d.x ELSE 0 END)::DOUBLE AS x_aneuploid, sum(d.a + d.b)::DOUBLE AS n_all,
    sum(CASE WHEN imbalanced THEN d.a + d.b ELSE 0 END)::DOUBLE AS n_imbalanced FROM dense d JOIN clusters USING (group_id) JOIN cells c USING (cell_id) GROUP BY 1, 2),
  long AS (UNPIVOT tot ON x_all, x_aneuploid, n_all, n_imbalanced INTO NAME measure VALUE v)
  SELECT rep_id, measure, round(median(v), 4) + 0.0 AS median FROM long GROUP BY 1, 2""")
def count_totals(t: Inputs) -> DataFrame:
    totals = reports.count_totals(t.dense, t.clusters)
    tagged = join_dim(totals, t.cells.select("cell_id", "rep_id"), ["cell_id"], ["x_all"], bound=t.raw("customer"))
    out = reports.total_medians(tagged, ["rep_id"])
    return out.withColumn("median", r6(F.col("median"), 4))


@query("""s AS (SELECT c.label, sum(l.x) AS x, sum(l.a + l.b) AS n FROM lines l JOIN cells c USING (cell_id) GROUP BY 1)
  SELECT c.label, count(*) AS n_cells, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM cells), 1) + 0.0 AS pct, CAST(min(s.x) AS BIGINT) AS x_total, CAST(min(s.n) AS BIGINT) AS n_total
  FROM cells c JOIN s USING (label) GROUP BY 1""")
def label_shares(t: Inputs) -> DataFrame:
    out = reports.label_shares(t.lines, t.cells, "label")
    return out.withColumn("pct", F.col("pct") + F.lit(0.0))


@query("""v AS (SELECT label AS l, 0 AS c, CASE WHEN label = 'normal' THEN 0 WHEN label LIKE 'clone%' THEN 1 ELSE 2 END AS o FROM cells UNION SELECT cell_type, 1, 0 FROM cells UNION SELECT rep_id, 2, 0 FROM cells),
  f AS (SELECT l, min((c, o, l)) AS first_at FROM v WHERE l NOT IN ('Doublet', 'doublet', 'Unknown', 'NA') AND lower(l) NOT LIKE 'normal%' GROUP BY l)
  SELECT l AS label, CAST((row_number() OVER (ORDER BY first_at) - 1) % 10 AS INTEGER) AS slot FROM f""")
def label_slots(t: Inputs) -> DataFrame:
    c = t.cells
    return reports.label_slots([(c, "label", True), (c, "cell_type", False), (c, "rep_id", False)])


_FEATURES = """raw AS (SELECT d.cell_id, d.group_id, 'baf' AS kind, CASE WHEN a + b > 0 THEN b / (a + b)::DOUBLE END AS v FROM depth d JOIN clusters USING (group_id) WHERE imbalanced
    UNION ALL SELECT d.cell_id, d.group_id, 'rdr', CASE WHEN x > 0 THEN log2(x / (total * lam_g)) END FROM depth d JOIN clusters USING (group_id) WHERE aneuploid)
"""


@query(_FEATURES + "SELECT cell_id, group_id, kind, round(coalesce(v, CASE WHEN kind = 'baf' THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS value FROM raw")
def feature_matrix(t: Inputs) -> DataFrame:
    out = clustering.long_features(t.dense_depth, t.clusters, norm=False, by=[])
    return _long_id(out).withColumn("value", r6(F.col("value")))


@query(_FEATURES + """SELECT cell_id, group_id, kind, round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 5) + 0.0 AS value
  FROM raw WINDOW w AS (PARTITION BY kind, group_id)""")
def feature_zscores(t: Inputs) -> DataFrame:
    out = clustering.long_features(t.dense_depth, t.clusters, norm=True, by=[])
    return _long_id(out).withColumn("value", r6(F.col("value"), 5))


def _vectors(t: Inputs) -> DataFrame:
    long = clustering.long_features(t.dense_depth, t.clusters, norm=False, by=[])
    return clustering.feature_vectors(long, by=[])


@query()
def kmeans_labels(t: Inputs) -> DataFrame:
    clusters = clustering.kmeans_labels(_vectors(t), k=3)
    named = clusters.join(t.cells.select("cell_id", "cell_type"), "cell_id")
    votes = clustering.majority_vote(named, "cluster", "cell_type")
    return clusters.join(F.broadcast(votes.select("cluster", "label")), "cluster")


@query("""c AS (SELECT cell_id, cell_id * 5 % 7 AS cluster, ref_tumor FROM typed ),
  v AS (SELECT cluster, count(CASE WHEN ref_tumor THEN 1 END) AS n_tumor, count(CASE WHEN NOT ref_tumor THEN 1 END) AS n_normal, min(cell_id) AS first_cell FROM c GROUP BY 1)
  SELECT cluster, n_tumor, n_normal, first_cell, CASE WHEN n_normal >= n_tumor THEN 'normal' ELSE 'tumor' || row_number() OVER (PARTITION BY n_normal >= n_tumor ORDER BY first_cell) END AS label FROM v""")
def majority_vote(t: Inputs) -> DataFrame:
    return clustering.majority_vote(t.cells.withColumn("cluster", F.col("cell_id") * 5 % 7), "cluster", "cell_type")


@query()
def pca_features(t: Inputs) -> DataFrame:
    scores = clustering.principal_components(_vectors(t), 2)
    return scores.select("cell_id", *[r6(F.col("scores")[i], 3).alias(f"pc{i + 1}") for i in range(2)])


@query()
def embedding_clusters(t: Inputs) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    values = F.col("embedding").cast("array<double>")
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("cell_id"), array_to_vector(values).alias("features"))
    labels = clustering.kmeans_labels(vectors, k=10)
    scores = clustering.principal_components(vectors, 2)
    return labels.join(scores, "cell_id").select("cell_id", "cluster", r6(F.col("scores")[0], 3).alias("pc1"))


def _panel(t: Inputs) -> DataFrame:
    n = F.col("s_suppkey")
    text = n.cast("string")
    platform = F.element_at(F.array(F.lit("spatial"), F.lit("single_cell"), F.lit("multiome")), (n % 3 + 1).cast("int"))
    rows = t.raw("supplier").select(
        F.concat(F.lit("S"), text).alias("SAMPLE"), platform.alias("PLATFORM"),
        *[F.concat(F.lit(f"/in/{c}/"), text).alias(f"PATH_TO_{c}") for c in ("SEG", "BBC_PHASE", "BB_INPUT")],
        F.concat(F.lit("/sol/"), (n % 5).cast("string")).alias("PATH_TO_SOLDIR"),
        F.when(n % 4 == 0, "DEFAULT").when(n % 4 == 1, None).otherwise((n % 4).cast("string")).alias("SOLID"),
        F.lit("2").alias("PLOIDY"), (n % 3 + 1).cast("string").alias("CLONE"), F.lit("cell_type").alias("REF_LABEL"),
    )
    return panel.clean_panel(rows)


def _files(t: Inputs) -> DataFrame:
    n = F.col("n_nationkey")
    folder = F.concat(F.lit("/sol/"), (n % 5).cast("string"))
    name = F.concat(F.lit("run_sol"), (n % 4).cast("string"), F.lit("_v"), n.cast("string"), F.lit(".tsv"))
    return t.raw("nation").select(folder.alias("dir"), F.concat(folder, F.lit("/"), name).alias("path"))


_PANEL = """p AS (SELECT s_suppkey AS n, 'S' || s_suppkey AS sample, ['spatial', 'single_cell', 'multiome'][s_suppkey % 3 + 1] AS platform, s_suppkey % 5 AS d, s_suppkey % 4 AS q FROM supplier),
  files AS (SELECT n_nationkey AS f, n_nationkey % 5 AS d, n_nationkey % 4 AS q FROM nation),
  runs AS (SELECT p.*, 'default' AS tag FROM p WHERE q < 2 UNION ALL SELECT p.*, 'run_sol' || f.q || '_v' || f.f FROM p JOIN files f ON f.d = p.d AND f.q = p.q WHERE p.q >= 2),
  keyed AS (SELECT *, sample || '/' || platform || '/2_n' || (n % 3 + 1) || '_' || tag AS run_id FROM runs)
"""


def _panel_runs(t: Inputs) -> DataFrame:
    return panel.run_key(panel.resolve_solutions(_panel(t), _files(t)))


@query(_PANEL + "SELECT run_id, sample, tag FROM keyed WHERE platform <> 'multiome'")
def panel_runs(t: Inputs) -> DataFrame:
    runs = _panel_runs(t)
    kept = panel.select_runs(runs, "spatial").unionByName(panel.select_runs(runs, "single_cell"))
    return kept.select("run_id", F.col("SAMPLE").alias("sample"), "tag")


@query(_PANEL + "SELECT run_id FROM keyed WHERE n % 2 = 1")
def pending_runs(t: Inputs) -> DataFrame:
    runs = _panel_runs(t)
    finished = runs.filter(F.expr("cast(substring(SAMPLE, 2) as int) % 2 = 0"))
    return panel.pending_runs(runs, finished).select("run_id")


@query(_PANEL + """, a AS (SELECT DISTINCT n, assay FROM (SELECT l_suppkey AS n, CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 5 <> 0 THEN 'gex' ELSE 'atac' END AS assay FROM lineitem)),
  s AS (SELECT n, string_agg(assay, '+' ORDER BY assay DESC) AS assay_types FROM a GROUP BY n)
  SELECT p.sample AS run_id, coalesce(assay_types, '') AS assay_types, CASE platform WHEN 'spatial' THEN coalesce(assay_types LIKE '%gex%', false)
    WHEN 'multiome' THEN coalesce(assay_types = 'gex+atac', false) ELSE assay_types IS NOT NULL END AS is_valid FROM p LEFT JOIN s USING (n)""")
def assay_check(t: Inputs) -> DataFrame:
    runs = _panel(t).select(F.col("SAMPLE").alias("run_id"), "PLATFORM")
    n = F.col("l_suppkey")
    lines = t.raw("lineitem").select(
        n, F.concat(F.lit("S"), n.cast("string")).alias("run_id"),
        F.when((F.col("l_linenumber") % 2 == 0) & (n % 5 != 0), "gex").otherwise("atac").alias("assay"),
    )
    found = lines.select("run_id", "assay").distinct()
    return panel.check_assays(found, runs).select("run_id", "assay_types", "is_valid")


@query("""SELECT 'S' || s_suppkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS f1, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey * 1.0::DOUBLE END AS purity_normal,
  CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::DOUBLE END AS n_clone1 FROM supplier""")
def run_summary(t: Inputs) -> DataFrame:
    s = t.raw("supplier").withColumn("run_id", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    even = s.filter("s_suppkey % 2 = 0").select("run_id", F.col("s_acctbal").alias("f1"), F.col("s_nationkey").cast("double").alias("n_clone1"))
    odd = s.filter("s_suppkey % 2 = 1").select("run_id", F.col("s_suppkey").cast("double").alias("purity_normal"))
    out = panel.summarise_runs([odd, even])
    return out.select(*panel.metric_columns(out.columns))


@query("""SELECT 'S' || c_nationkey AS run_id, max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS f1, max(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END) AS recall
  FROM customer GROUP BY 1""")
def wide_metrics(t: Inputs) -> DataFrame:
    names = F.create_map(F.lit("BUILDING"), F.lit("f1"), F.lit("MACHINERY"), F.lit("recall"))
    long = t.raw("customer").select(
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("run_id"),
        F.coalesce(names[F.col("c_mktsegment")], F.lit("other")).alias("name"), F.col("c_acctbal").alias("value"),
    )
    return panel.wide_metrics(long, ["f1", "recall"])




_PANEL = """assay_sums AS (SELECT p.assay, p.cell_id, i.group_id, sum(p.x) AS x, sum(p.a) AS a, sum(p.b) AS b FROM phased p JOIN state_ids i USING (state) GROUP BY 1, 2, 3),
  assay_cells AS (SELECT DISTINCT assay, cell_id FROM assay_sums),
  assay_share AS (SELECT assay, group_id, sum(x)::DOUBLE / sum(sum(x)) OVER (PARTITION BY assay) AS share FROM assay_sums GROUP BY 1, 2),
  panel AS (
    SELECT e.assay, c.rep_id, c.label, e.cell_id, g.group_id, coalesce(s.x, 0) AS x, coalesce(s.b, 0) AS b, coalesce(s.a + s.b, 0) AS n,
           sum(coalesce(s.x, 0)) OVER (PARTITION BY e.assay, e.cell_id) * h.share AS expected
    FROM assay_cells e CROSS JOIN clusters g JOIN cells c USING (cell_id) LEFT JOIN assay_sums s USING (assay, cell_id, group_id) JOIN assay_share h USING (assay, group_id)),
  every AS (SELECT * FROM panel UNION ALL SELECT * REPLACE ('all' AS rep_id) FROM panel)
"""
_KEYS = ["assay", "rep_id", "label", "group_id"]


def _modality_rows(t: Inputs) -> DataFrame:
    """Dense counts of both modalities with labels and the depth that all cells' shares expect."""
    sums = durable(grouping.sum_counts(t.lines, t.cluster_bins, ["assay", "cell_id"], bound=t.bins))
    cells = sums.select("assay", "cell_id").distinct()
    dense = grouping.densify(sums, cells, t.clusters, assay=True)
    depth = sums.groupBy("assay", "group_id").agg(F.sum("x").alias("_x"))
    share = depth.select("assay", "group_id", (F.col("_x") / F.sum("_x").over(Window.partitionBy("assay"))).alias("share"))
    total = F.sum("x").over(Window.partitionBy("assay", "cell_id"))
    rows = join_dim(dense.withColumn("total", total), share, ["assay", "group_id"], ["cell_id"])
    tags = t.cells.select("cell_id", "label", "rep_id")
    joined = join_dim(rows, tags, ["cell_id"], ["group_id"], bound=t.raw("customer"))
    return joined.withColumns({"n": F.col("a") + F.col("b"), "expected": F.col("total") * F.col("share")})


@query(_PANEL + """, b_ends AS (SELECT assay, rep_id, label, group_id, min(b) AS lo, max(b) AS hi FROM every WHERE n > 0 GROUP BY ALL),
  h AS (
    SELECT assay, rep_id, label, group_id, CASE WHEN n > 3 THEN 'baf_deep' ELSE 'baf_shallow' END AS measure, least(b * 50 // n, 49)::INTEGER AS bin FROM every WHERE n > 0
    UNION ALL SELECT assay, rep_id, label, group_id, 'b_count', CASE WHEN hi > lo THEN least((b - lo) * 50 // (hi - lo), 49)::INTEGER ELSE 25 END
      FROM every JOIN b_ends USING (assay, rep_id, label, group_id) WHERE n > 0
    UNION ALL SELECT assay, rep_id, label, group_id, 'rdr', least(floor(greatest(0.0::DOUBLE, least(5.0::DOUBLE, x / expected)) * 10.0::DOUBLE), 49)::INTEGER FROM every WHERE expected > 0)
  SELECT assay, rep_id, label, group_id, measure, bin, count(*) AS n FROM h GROUP BY ALL""")
def modality_histograms(t: Inputs) -> DataFrame:
    return _long_id(modality.histograms(_modality_rows(t), _KEYS))


@query(_PANEL + """SELECT assay, rep_id, label, group_id, count(*) AS n_cells, count(CASE WHEN n > 0 THEN 1 END) AS n_covered, count(CASE WHEN n > 3 THEN 1 END) AS n_deep,
  CAST(sum(b) AS BIGINT) AS b_total, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(x) AS BIGINT) AS x_total, round(sum(b)::DOUBLE / sum(n), 6) + 0.0 AS baf,
  round(sum(x)::DOUBLE / sum(expected), 6) + 0.0 AS rdr, round(var_pop(CASE WHEN n > 0 THEN b / n::DOUBLE END), 6) + 0.0 AS baf_variance FROM every GROUP BY ALL""")
def modality_summary(t: Inputs) -> DataFrame:
    out = _long_id(modality.summary(_modality_rows(t), _KEYS))
    return out.withColumns({c: r6(F.col(c)) for c in ("baf", "rdr", "baf_variance")})


_LOST = _PANEL + """, lost AS (
  SELECT p.assay, p.rep_id, p.label, p.cell_id, sum(p.b) AS b, sum(p.n) AS n FROM panel p JOIN clones c ON c.group_id = p.group_id AND c.clone = p.label
  WHERE c.k >= 1 AND c.cn_b = 0 AND c.cn_a > 0 GROUP BY ALL)
"""


def _lost(t: Inputs) -> DataFrame:
    loh = profile.loh_rows(t.clones_long).select("group_id", "clone")
    return modality.lost_heterozygosity(_modality_rows(t), loh, ["assay", "rep_id", "label"])


@query(_LOST + """SELECT assay, rep_id, label, count(*) AS n_cells, count(CASE WHEN n > 0 THEN 1 END) AS n_covered, median(b)::DOUBLE AS b_median, median(n)::DOUBLE AS n_median,
  round(median(CASE WHEN n > 0 THEN b / n::DOUBLE END), 6) + 0.0 AS baf_median FROM lost GROUP BY ALL""")
def modality_loh(t: Inputs) -> DataFrame:
    out = modality.loh_summary(_lost(t), ["assay", "rep_id", "label"])
    return out.withColumn("baf_median", r6(F.col("baf_median")))


@query(_LOST + """SELECT assay, rep_id, label, least(b * 50 // n, 49)::INTEGER AS bin, count(*) AS n FROM (
    SELECT * FROM lost UNION ALL SELECT * REPLACE ('all' AS rep_id) FROM lost) WHERE n > 0 GROUP BY ALL""")
def modality_loh_histogram(t: Inputs) -> DataFrame:
    return modality.loh_histogram(_lost(t), ["assay", "rep_id", "label"])
