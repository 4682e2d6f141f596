"""Queries on parsing, mapping, grouping and cell metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import cnp, genome, labels
from cellmosaic.operators import annotate, cells, depth, grouping, profile
from cellmosaic.operators.joins import join_dim
from cellmosaic.plans.inputs import BAF_CLIP, Inputs
from cellmosaic.plans.registry import query, r6
from cellmosaic.session import work_folder
from cellmosaic.sources import sinks, tables


@query("""SELECT g.seg_id, s.k, s.clone, s.cn_a, s.cn_b, s.cn_a + s.cn_b AS cn_c,
  round(greatest(0.001, least(0.999, CASE WHEN s.cn_a + s.cn_b > 0 THEN CAST(s.cn_b AS DOUBLE) / (s.cn_a + s.cn_b) ELSE 0 END)), 6) + 0.0 AS baf
  FROM segments g JOIN states s USING (state)""")
def cnp_parse(t: Inputs) -> DataFrame:
    long = profile.explode_clones(t.segments, ["seg_id"], BAF_CLIP)
    return long.withColumn("baf", r6(F.col("baf")))


@query("""SELECT seg_id, state <> 0 AS cnp, state <> 0 AS imbalanced, state IN (1, 3) AS clonal_imbalanced,
  state IN (1, 2, 4) AS aneuploid, state IN (2, 4) AS subclonal, state IN (1, 3) AS clonal_loh,
  state IN (1, 3) AS subclonal_loh, state = 0 AS neutral FROM segments""")
def cnp_masks(t: Inputs) -> DataFrame:
    masks = cnp.masks(F.col("cn_a"), F.col("cn_b"))
    return t.segments.select("seg_id", *[c.alias(n) for n, c in masks.items()])


@query("""SELECT k.seg_id, min(k.chrom) AS chrom, min(k.start_bp) AS start_bp, max(k.end_bp) AS end_bp,
  count(*) AS n_bbc, CAST(sum(k.end_bp - k.start_bp) AS BIGINT) AS length_bp, min(k.cnp) AS cnp
  FROM kept k GROUP BY k.seg_id""")
def cnp_profile(t: Inputs) -> DataFrame:
    ids = t.segment_bins.select("group_id", "seg_id").distinct()
    table = profile.profile_table(grouping.group_table(t.segment_bins))
    return table.join(ids, "group_id").select(
        "seg_id", "chrom", "start_bp", "end_bp", "n_bbc", "length_bp", "cnp"
    )


@query("""SELECT group_id, cnp, imbalanced AND state IN (2, 4) AS imbalanced,
  aneuploid AND state IN (2, 4) AS aneuploid, state IN (2, 4) AS subclonal, false AS neutral FROM clusters""")
def cnp_keep_rows(t: Inputs) -> DataFrame:
    kept = profile.restrict_masks(t.clusters.drop("cnp"), " 1|1;2|1;1|1 ,1|1;2|2;3|1,")
    return profile.profile_table(kept).select("group_id", "cnp", "imbalanced", "aneuploid", "subclonal", "neutral")


@query("SELECT chrom, bool_or(s.k >= 1 AND s.cn_b > s.cn_a) AS has_mirror FROM segments g JOIN states s USING (state) GROUP BY chrom")
def cnp_mirror(t: Inputs) -> DataFrame:
    return profile.has_mirror(profile.explode_clones(t.segments, ["chrom", "seg_id"], BAF_CLIP), ["chrom"])


@query("SELECT g.seg_id, s.clone FROM segments g JOIN states s USING (state) WHERE s.k >= 1 AND s.cn_b = 0 AND s.cn_a > 0")
def loh_rows(t: Inputs) -> DataFrame:
    long = profile.explode_clones(t.segments, ["seg_id"], BAF_CLIP)
    return profile.loh_rows(long).select("seg_id", "clone")


@query("SELECT group_id, cnp, n_bbc FROM clusters WHERE imbalanced AND n_bbc > 1")
def masked_groups(t: Inputs) -> DataFrame:
    rows = grouping.masked_rows(t.clusters, "imbalanced", "n_bbc > 1")
    return rows.select("group_id", cnp.to_string(F.col("cn_a"), F.col("cn_b")).alias("cnp"), "n_bbc")


@query("SELECT bin_id, chrom, start_bp, end_bp, seg_id, cnp FROM kept")
def bin_to_segment(t: Inputs) -> DataFrame:
    return t.kept_bins.select("bin_id", "chrom", "start_bp", "end_bp", "seg_id", "cnp")


@query("SELECT bin_id, chrom, start_bp FROM bins WHERE bin_id NOT IN (SELECT bin_id FROM kept)")
def gap_bins(t: Inputs) -> DataFrame:
    return annotate.gap_bins(t.bins, t.segments).select("bin_id", "chrom", "start_bp")


@query("""SELECT l.bin_id, CAST(sum(CASE WHEN b.phase = 1 THEN l.a ELSE l.b END) AS BIGINT) AS a,
  CAST(sum(CASE WHEN b.phase = 1 THEN l.b ELSE l.a END) AS BIGINT) AS b FROM lines l JOIN bins b USING (bin_id) GROUP BY l.bin_id""")
def phased_alleles(t: Inputs) -> DataFrame:
    phased = annotate.attach_phase(t.bins.drop("phase"), t.phases)
    swapped = annotate.annotate_counts(t.lines, phased, [], bound=t.bins)
    return swapped.groupBy("bin_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("a", "b")])


@query("""SELECT g.seg_id, CASE g.s % 4 WHEN 0 THEN '1|1;2|1' WHEN 1 THEN '1|1;1|0' WHEN 2 THEN '1|1;3|1' ELSE '1|1;1|1' END AS cnp,
  CASE WHEN g.s % 4 = 3 THEN 0.0::DOUBLE ELSE round(0.1 * (1 + g.s % 4), 6) END AS u_clone1,
  (SELECT arg_min(CASE s % 4 WHEN 0 THEN '0.5;0.1' WHEN 1 THEN '0.25;0.2' WHEN 2 THEN '0.125;0.3' ELSE '0.0;0.0' END, chrom_no * 1000000 + s) FROM segments) AS props
  FROM segments g""")
def solution_override(t: Inputs) -> DataFrame:
    """The first sample of a solution file, in the order of its lines."""
    # clusters 0..2 have a solution row, cluster 3 falls back to diploid
    old = t.segments.join(t.segment_rows.select("seg_id", (F.col("s") % 4).alias("cluster")), "seg_id")
    old = old.withColumns({"cn_normal": F.lit("1|1"), "u_normal": F.lit(1.0)}).drop("cn_a", "cn_b")
    present = t.segment_rows.select((F.col("s") % 4).alias("CLUSTER")).distinct().filter("CLUSTER < 3")
    picked = F.element_at(F.array(F.lit("2|1"), F.lit("1|0"), F.lit("3|1")), F.col("CLUSTER").cast("int") + 1)
    share = F.element_at(F.array(F.lit("0.1"), F.lit("0.2"), F.lit("0.3")), F.col("CLUSTER").cast("int") + 1)
    rows = present.select(
        "CLUSTER", F.lit("S1").alias("SAMPLE"), F.lit("1|1").alias("cn_normal"), picked.alias("cn_clone1"),
        (0.5 / F.pow(F.lit(2.0), F.col("CLUSTER"))).cast("string").alias("u_normal"), share.alias("u_clone1"),
    )
    # another sample follows in the file; its name is smaller and its copy numbers differ
    other = rows.withColumns({"SAMPLE": F.lit("R9"), "cn_clone1": F.lit("9|9"), "u_clone1": F.lit("0.9")})
    lines = rows.withColumn("_first", F.lit(1)).unionByName(other.withColumn("_first", F.lit(2)))
    path = work_folder(t.spark, "solution")
    sinks.write_tsv(lines.coalesce(1).sortWithinPartitions("_first", "CLUSTER").drop("_first"), path)
    new, _ = profile.override_solution(old, tables.read_solution(t.spark, path))
    return new.select("seg_id", "cnp", r6(F.col("u_clone1")).alias("u_clone1"), "props")


@query("SELECT seg_id, 'S0' AS sample FROM segment_rows WHERE seg_id % 2 = (SELECT arg_min(seg_id, chrom_no * 1000000 + s) % 2 FROM segment_rows)")
def first_sample_segments(t: Inputs) -> DataFrame:
    order = F.struct(genome.chrom_rank(F.col("chrom")), F.col("start_bp"))
    lead = t.segment_rows.agg((F.min_by("seg_id", order) % 2).alias("_p"))
    tagged = t.segment_rows.join(F.broadcast(lead)).withColumn(
        "sample", F.concat(F.lit("S"), F.pmod(F.col("seg_id") - F.col("_p"), F.lit(2)).cast("string"))
    )
    return profile.first_sample(tagged).select("seg_id", "sample")


@query("""SELECT CAST(dense_rank() OVER (ORDER BY seg_id) - 1 AS BIGINT) AS group_id, seg_id, n_cells, x, a, b FROM (
  SELECT seg_id, count(DISTINCT cell_id) AS n_cells, CAST(sum(x) AS BIGINT) AS x, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b
  FROM phased GROUP BY seg_id)""")
def segment_counts(t: Inputs) -> DataFrame:
    sums = grouping.sum_counts(t.lines, t.segment_bins, ["cell_id"], bound=t.bins)
    ids = t.segment_bins.select("group_id", "seg_id").distinct()
    per_group = sums.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.sum(c).alias(c) for c in ("x", "a", "b")]
    )
    return per_group.join(ids, "group_id").withColumn("group_id", F.col("group_id").cast("bigint"))


@query("SELECT cell_id, group_id, x, a, b FROM dense")
def cluster_counts(t: Inputs) -> DataFrame:
    return t.dense.select("cell_id", F.col("group_id").cast("bigint").alias("group_id"), "x", "a", "b")


@query("""SELECT CAST(row_number() OVER (ORDER BY first_at) - 1 AS BIGINT) AS group_id, cnp, segments, n_bbc, length_bp FROM (
  SELECT cnp, min(chrom_no * 10000000000 + start_bp) AS first_at,
    string_agg(chrom || ':' || start_bp || '-' || end_bp, ';' ORDER BY chrom_no, start_bp) AS segments,
    count(*) AS n_bbc, CAST(sum(end_bp - start_bp) AS BIGINT) AS length_bp FROM segments GROUP BY cnp)""")
def cluster_legacy(t: Inputs) -> DataFrame:
    rows = t.segments.withColumns({"length_bp": F.col("end_bp") - F.col("start_bp"), "n_bbc": F.lit(1)})
    table = grouping.legacy_cluster_table(grouping.first_seen_groups(rows), ["n_bbc", "length_bp"])
    return table.withColumn("group_id", F.col("group_id").cast("bigint"))


@query("""snp AS (SELECT bin_id, sum(a + b) AS n FROM lines GROUP BY bin_id),
  ordered AS (SELECT k.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY seg_id ORDER BY start_bp) AS i
    FROM kept k LEFT JOIN snp USING (bin_id)),
  walk AS (
    WITH RECURSIVE w AS (
      SELECT seg_id, bin_id, i, 0 AS local_id, start_bp AS opened, n AS acc FROM ordered WHERE i = 1
      UNION ALL
      SELECT o.seg_id, o.bin_id, o.i,
        CASE WHEN o.end_bp - w.opened > 1000000 OR w.acc >= 300 THEN w.local_id + 1 ELSE w.local_id END,
        CASE WHEN o.end_bp - w.opened > 1000000 OR w.acc >= 300 THEN o.start_bp ELSE w.opened END,
        CASE WHEN o.end_bp - w.opened > 1000000 OR w.acc >= 300 THEN o.n ELSE w.acc + o.n END
      FROM w JOIN ordered o ON o.seg_id = w.seg_id AND o.i = w.i + 1)
    SELECT * FROM w)
  SELECT bin_id, CAST(dense_rank() OVER (ORDER BY seg_id, local_id) - 1 AS BIGINT) AS group_id FROM walk""")
def adaptive_bins(t: Inputs) -> DataFrame:
    snp = grouping.allele_totals(t.lines)
    ids = grouping.adaptive_groups(t.kept_bins, snp, min_snp_count=300, max_bin_length=1_000_000)
    return ids.select("bin_id", F.col("group_id").cast("bigint").alias("group_id"))


@query("""SELECT p.assay, i.group_id, CAST(sum(p.x) AS BIGINT) AS x, CAST(sum(p.a) AS BIGINT) AS a, CAST(sum(p.b) AS BIGINT) AS b,
  count(DISTINCT p.cell_id) AS n_cells FROM phased p JOIN state_ids i USING (state) GROUP BY 1, 2""")
def joint_modalities(t: Inputs) -> DataFrame:
    # each modality is its own scan; one grouping serves their union
    gex, atac = (t.lines.filter(F.col("assay") == a) for a in ("gex", "atac"))
    sums = grouping.sum_counts(gex.unionByName(atac), t.cluster_bins, ["assay", "cell_id"], bound=t.bins)
    return sums.groupBy("assay", F.col("group_id").cast("bigint").alias("group_id")).agg(
        *[F.sum(c).alias(c) for c in ("x", "a", "b")], F.count(F.lit(1)).alias("n_cells")
    )


@query("""SELECT cell_id, barcode, rep_id, CASE WHEN cell_type = 'Unknown' OR cell_id % 10 = 9 THEN 'Unknown' ELSE cell_type END AS cell_type FROM cells""")
def cells_labelled(t: Inputs) -> DataFrame:
    # every tenth cell has no row in the type table
    kinds = t.cells.filter(F.col("cell_id") % 10 != 9).select("barcode", "cell_type")
    plain = t.cells.select("cell_id", "barcode", cells.replicate_of(F.col("barcode")).alias("rep_id"))
    return cells.label_cells(plain, kinds, "cell_type").select("cell_id", "barcode", "rep_id", "cell_type")


@query("SELECT cell_id, CASE WHEN cell_id % 2 = 0 THEN cell_type ELSE 'Unknown' END AS label FROM cells")
def labels_overwritten(t: Inputs) -> DataFrame:
    kinds = t.cells.filter(F.col("cell_id") % 2 == 0).select("barcode", F.col("cell_type").alias("label"))
    return cells.overwrite_label(t.cells.select("cell_id", "barcode", "label"), kinds, "label").select("cell_id", "label")


@query("""SELECT count(DISTINCT l.cell_id) AS n_cells, count(*) AS n_rows, CAST(sum(l.x) AS BIGINT) AS x
  FROM counts l JOIN cells c USING (cell_id) WHERE c.cell_type NOT IN ('Doublet', 'doublet', 'Unknown', 'NA')""")
def cells_excluded(t: Inputs) -> DataFrame:
    kept = cells.keep_cells(t.counts, t.excluded_cells)
    per_cell = kept.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    return per_cell.agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"), F.sum("x").alias("x")
    )


@query("""v AS (SELECT cell_id, label AS v FROM cells UNION ALL SELECT cell_id, cell_type FROM cells
   UNION ALL SELECT cell_id, CASE cell_id % 5 WHEN 0 THEN 'Doublet' WHEN 1 THEN 'unknown' WHEN 2 THEN 'Normal_x' WHEN 3 THEN 'clone10' ELSE 'TUMOR' END FROM cells)
  SELECT v AS label, count(*) AS n, bool_or(lower(v) LIKE 'tumor%' OR lower(v) LIKE 'clone%') AS is_tumor,
    bool_or(NOT (lower(v) LIKE 'tumor%' OR lower(v) LIKE 'clone%') AND v NOT IN ('Doublet', 'doublet', 'Unknown', 'NA')) AS is_normal,
    bool_or(v IN ('Unknown', 'NA')) AS is_na, bool_or(lower(v) IN ('unknown', 'na')) AS is_na_any_case,
    bool_or(lower(v) LIKE 'normal%') AS is_normal_like FROM v GROUP BY v""")
def label_predicates(t: Inputs) -> DataFrame:
    odd = F.element_at(
        F.array(*[F.lit(v) for v in ("Doublet", "unknown", "Normal_x", "clone10", "TUMOR")]),
        (F.col("cell_id") % 5 + 1).cast("int"),
    )
    names = t.cells.select(F.explode(F.array("label", "cell_type", odd)).alias("label"))
    v = F.col("label")
    return names.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "is_tumor": labels.is_tumor(v), "is_normal": labels.is_normal(v), "is_na": labels.is_na(v),
        "is_na_any_case": labels.is_na_any_case(v), "is_normal_like": labels.is_normal_like(v),
    })


@query("SELECT rep_id, count(*) AS n_cells, count(CASE WHEN ref_normal THEN 1 END) AS n_reference FROM typed GROUP BY rep_id")
def reference_mask(t: Inputs) -> DataFrame:
    flagged = cells.reference_mask(t.cells, "cell_type", ["rep_id"])
    return flagged.groupBy("rep_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("is_reference").alias("n_reference")
    )


@query("""SELECT c.rep_id, count(*) AS n_rows, CAST(sum(l.x) AS BIGINT) AS x FROM counts l JOIN cells c USING (cell_id)
  WHERE c.rep_id = 'R1' GROUP BY c.rep_id""")
def replicate_subset(t: Inputs) -> DataFrame:
    rep = t.cells.filter(F.col("rep_id") == "R1")
    kept = cells.keep_cells(t.counts, rep).withColumn("rep_id", F.lit("R1"))
    return kept.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("x"))


@query("SELECT group_id, k, cn_a, cn_b FROM clones WHERE k IN (0, 1)")
def clone_projection(t: Inputs) -> DataFrame:
    kept = profile.select_clones(t.clones_long, [0, 1])
    return kept.select(F.col("group_id").cast("bigint").alias("group_id"), "k", "cn_a", "cn_b")


@query("""v AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chr10' WHEN 2 THEN 'MT' WHEN 3 THEN '2'
    WHEN 4 THEN 'chrUn_a' WHEN 5 THEN 'Y' ELSE 'chr' || (p_partkey % 30) END AS chrom FROM part),
  c AS (SELECT chrom, CASE WHEN chrom LIKE 'chr%' THEN substr(chrom, 4) ELSE chrom END AS core FROM v)
  SELECT chrom, row_number() OVER (ORDER BY
    CASE WHEN regexp_full_match(core, '[0-9]+') THEN 0 WHEN core IN ('X', 'Y', 'M', 'MT') THEN 1 ELSE 2 END,
    CASE WHEN regexp_full_match(core, '[0-9]+') THEN CAST(core AS INTEGER) WHEN core = 'X' THEN 1 WHEN core = 'Y' THEN 2
      WHEN core IN ('M', 'MT') THEN 3 ELSE 0 END, core, chrom) AS pos FROM c""")
def chromosome_order(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    key = F.col("p_partkey") % 7
    names = ["chrX", "chr10", "MT", "2", "chrUn_a", "Y"]
    chrom = F.when(key == 6, F.concat(F.lit("chr"), (F.col("p_partkey") % 30).cast("string")))
    for i, name in enumerate(names):
        chrom = F.when(key == i, name).otherwise(chrom)
    distinct = t.raw("part").select(chrom.alias("chrom")).distinct()
    # a handful of chromosome names, so one task is enough
    order = Window.partitionBy(F.lit(1)).orderBy(genome.chrom_rank(F.col("chrom")), "chrom")
    return distinct.withColumn("pos", F.row_number().over(order).cast("bigint"))


@query("SELECT cell_id, CAST(sum(x) AS BIGINT) AS total FROM cluster_sums GROUP BY cell_id")
def library_size(t: Inputs) -> DataFrame:
    return depth.library_size(t.cluster_sums)


@query("SELECT group_id, round(lam_g, 6) + 0.0 AS baseline FROM baseline")
def baseline_diploid(t: Inputs) -> DataFrame:
    return _group(t.baseline).select("group_id", r6(F.col("lambda")).alias("baseline"))


@query("""base AS (SELECT s.group_id, sum(CASE WHEN t.label = 'clone1' THEN s.x ELSE 0 END) / greatest(min(c.cn_c) / 2.0, 1e-12) AS v
    FROM cluster_sums s JOIN typed t USING (cell_id) JOIN clones c ON c.group_id = s.group_id AND c.k = 1 GROUP BY s.group_id)
  SELECT group_id, round(v / sum(v) OVER (), 6) + 0.0 AS baseline FROM base""")
def baseline_corrected(t: Inputs) -> DataFrame:
    flags = t.cells.select("cell_id", (F.col("label") == "clone1").alias("is_reference"))
    counts = join_dim(t.cluster_sums, flags, ["cell_id"], ["group_id"], bound=t.raw("customer"))
    copies = t.clones_long.filter("k = 1").select("group_id", F.col("cn_c").alias("cn_ref"))
    out = depth.baseline_corrected(counts, copies, "is_reference")
    return _group(out).select("group_id", r6(F.col("lambda")).alias("baseline"))


@query("SELECT group_id, k, round(rdr, 6) + 0.0 AS rdr, round(props, 6) + 0.0 AS props FROM clone_depth")
def clone_depth_shares(t: Inputs) -> DataFrame:
    return _group(t.clone_depth).select("group_id", "k", r6(F.col("rdr")).alias("rdr"), r6(F.col("props")).alias("props"))


@query("""base AS (SELECT l.assay, b.chrom, b.start_bp, b.end_bp, sum(CASE WHEN t.ref_normal THEN l.x ELSE 0 END) AS v
    FROM lines l JOIN kept b USING (bin_id) JOIN typed t USING (cell_id) GROUP BY ALL),
  lam AS (SELECT *, v / sum(v) OVER (PARTITION BY assay) AS lam_g FROM base),
  g AS (SELECT * FROM lam WHERE assay = 'gex'), a AS (SELECT * FROM lam WHERE assay = 'atac')
  SELECT coalesce(g.chrom, a.chrom) AS chrom, coalesce(g.start_bp, a.start_bp) AS start_bp, coalesce(g.end_bp, a.end_bp) AS end_bp,
    round(g.lam_g, 8) + 0.0 AS gex_baseline, round(a.lam_g, 8) + 0.0 AS atac_baseline
  FROM g FULL JOIN a ON g.chrom = a.chrom AND g.start_bp = a.start_bp""")
def baseline_table(t: Inputs) -> DataFrame:
    place = t.kept_bins.withColumn("group_id", F.col("bin_id"))
    tagged = annotate.annotate_counts(t.lines, place, ["group_id"], bound=t.bins)
    flags = t.cells.select("cell_id", labels.is_normal(F.col("cell_type")).alias("is_reference"))
    flagged = join_dim(tagged, flags, ["cell_id"], ["group_id"], bound=t.raw("customer"))
    lam = depth.baseline_diploid(flagged, "is_reference", ["assay"])
    wide = depth.join_baselines(lam, ["gex", "atac"], ["group_id"])
    named = wide.join(place.select("group_id", "chrom", "start_bp", "end_bp"), "group_id")
    return named.select(
        "chrom", "start_bp", "end_bp", *[r6(F.col(f"{a}_baseline"), 8).alias(f"{a}_baseline") for a in ("gex", "atac")]
    )


def _group(df: DataFrame) -> DataFrame:
    return df.withColumn("group_id", F.col("group_id").cast("bigint"))


def _pseudobulk(t: Inputs) -> DataFrame:
    """x, a, b per predicted label and segment, with depth of the label and lambda."""
    tagged = annotate.annotate_counts(t.lines, t.kept_bins, ["seg_id"], bound=t.bins)
    tags = t.cells.select("cell_id", "label", labels.is_normal(F.col("cell_type")).alias("is_reference"))
    counts = join_dim(tagged, tags, ["cell_id"], ["seg_id"], bound=t.raw("customer")).withColumnRenamed("seg_id", "group_id")
    # one aggregate serves the label sums and, summed once more, the baseline
    sums = counts.groupBy("label", "is_reference", "group_id").agg(*[F.sum(c).alias(c) for c in ("x", "a", "b")])
    lam = depth.baseline_diploid(sums, "is_reference")
    bulk = depth.pseudobulk_counts(sums, ["label"])
    known = bulk.filter(F.col("label") != "NA")
    return known.join(lam, "group_id").withColumn("expected", F.col("total") * F.col("lambda"))


_BULK = """bulk AS (SELECT c.label, p.seg_id, sum(p.x) AS x, sum(p.a) AS a, sum(p.b) AS b FROM phased p JOIN cells c USING (cell_id) GROUP BY 1, 2),
  lam AS (SELECT p.seg_id, sum(CASE WHEN t.ref_normal THEN p.x ELSE 0 END) / sum(sum(CASE WHEN t.ref_normal THEN p.x ELSE 0 END)) OVER () AS lam_g
    FROM phased p JOIN typed t USING (cell_id) GROUP BY 1),
  full_bulk AS (SELECT b.*, l.lam_g, sum(b.x) OVER (PARTITION BY b.label) AS total FROM bulk b JOIN lam l USING (seg_id))
"""


@query(_BULK + """SELECT label, seg_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b,
  round(CASE WHEN a + b > 0 THEN b / (a + b) END, 6) + 0.0 AS baf FROM full_bulk WHERE label <> 'NA'""")
def pseudobulk_baf_segment(t: Inputs) -> DataFrame:
    bulk = _pseudobulk(t)
    return bulk.select(
        "label", F.col("group_id").alias("seg_id"), F.col("a").cast("bigint").alias("a"),
        F.col("b").cast("bigint").alias("b"), r6(depth.baf(F.col("b"), F.col("a") + F.col("b"))).alias("baf"),
    )


@query(_BULK + """SELECT label, seg_id, CAST(x AS BIGINT) AS x,
  round(CASE WHEN lam_g > 0 AND total > 0 AND x > 0 THEN log2(x / (total * lam_g)) END, 6) + 0.0 AS log2rdr
  FROM full_bulk WHERE label <> 'NA'""")
def pseudobulk_rdr_segment(t: Inputs) -> DataFrame:
    bulk = _pseudobulk(t)
    return bulk.select(
        "label", F.col("group_id").alias("seg_id"), "x", r6(depth.rdr(F.col("x"), F.col("expected"))).alias("log2rdr")
    )


@query("""SELECT label, row_number() OVER (ORDER BY CASE WHEN label = 'normal' THEN 0 WHEN label LIKE 'clone%' THEN 1 ELSE 2 END, label) AS pos
  FROM (SELECT DISTINCT label FROM cells WHERE label <> 'NA')""")
def pseudobulk_group_order(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    names = t.cells.select("label").distinct().filter("label <> 'NA'")
    order = Window.partitionBy(F.lit(1)).orderBy(labels.pseudobulk_order(F.col("label")))
    return names.withColumn("pos", F.row_number().over(order).cast("bigint"))


@query("""SELECT d.cell_id, d.group_id, round((baf - avg(baf) OVER w) / nullif(stddev_pop(baf) OVER w, 0), 5) + 0.0 AS baf_z,
    round(log2rdr, 6) + 0.0 AS log2rdr FROM (
   SELECT cell_id, group_id, CASE WHEN a + b > 0 THEN b / (a + b)::DOUBLE END AS baf,
     CASE WHEN x > 0 THEN log2(x / (total * lam_g)) WHEN total * lam_g > 0 THEN 0.0 END AS log2rdr FROM depth) d
   WINDOW w AS (PARTITION BY d.cell_id)""")
def cell_zscores(t: Inputs) -> DataFrame:
    values = depth.cell_ratios(t.dense_depth, log2=True)
    # per cell the window holds one row per group
    scored = values.withColumn("baf_z", depth.zscore(F.col("baf"), ["cell_id"]))
    return _group(scored).select(
        "cell_id", "group_id", r6(F.col("baf_z"), 5).alias("baf_z"), r6(F.col("rdr")).alias("log2rdr")
    )


@query("SELECT bin_id, cell_id, CAST(sum(x) AS BIGINT) AS x, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM lines GROUP BY bin_id, cell_id")
def aligned_counts(t: Inputs) -> DataFrame:
    def coo(name: str) -> DataFrame:
        return t.lines.select("bin_id", "cell_id", F.col(name).alias("value"))

    return tables.align_counts(coo("x"), coo("a"), coo("b"))


@query("SELECT bin_id, cell_id, CAST(sum(x) AS BIGINT) AS x FROM lines WHERE bin_id NOT IN (SELECT bin_id FROM kept) GROUP BY bin_id, cell_id")
def stray_counts(t: Inputs) -> DataFrame:
    """Counts in bins that no segment covers; all cells are known."""
    return tables.stray_rows(t.counts, t.kept_bins, t.cells).select("bin_id", "cell_id", "x")
