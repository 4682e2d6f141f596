"""SQL prelude of the oracle queries: the input mapping of ``inputs.py`` restated."""

PRELUDE = """
WITH RECURSIVE lines AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'gex' ELSE 'atac' END AS assay,
         l_partkey AS bin_id, o_custkey AS cell_id, CAST(l_quantity AS BIGINT) AS x,
         CAST(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS BIGINT) AS a,
         CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS BIGINT) AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bins AS (
  SELECT p_partkey AS bin_id, 1 + p_partkey % 5 AS chrom_no, 'chr' || (1 + p_partkey % 5) AS chrom,
         (p_partkey // 5) * 100000 AS start_bp, (p_partkey // 5 + 1) * 100000 AS end_bp,
         p_size % 2 AS phase
  FROM part),
segment_rows AS (
  SELECT chrom, chrom_no, s, s * 2000000 AS start_bp, (s + 1) * 2000000 AS end_bp,
         chrom_no * 100000 + s AS seg_id, (chrom_no * 3 + s) % 5 AS state,
         CASE (chrom_no * 3 + s) % 5 WHEN 0 THEN '1|1;1|1;1|1' WHEN 1 THEN '1|1;1|0;1|0'
              WHEN 2 THEN '1|1;2|1;1|1' WHEN 3 THEN '1|1;2|0;2|0' ELSE '1|1;2|2;3|1' END AS cnp
  FROM (SELECT DISTINCT chrom, chrom_no, start_bp // 2000000 AS s FROM bins)),
segments AS (SELECT * FROM segment_rows WHERE s % 7 <> 6),
kept AS (
  SELECT b.bin_id, b.chrom, b.chrom_no, b.start_bp, b.end_bp, b.phase, g.seg_id, g.cnp, g.state
  FROM bins b JOIN segments g ON b.chrom = g.chrom
   AND (b.start_bp + b.end_bp) // 2 >= g.start_bp AND (b.start_bp + b.end_bp) // 2 < g.end_bp),
states(state, cnp, k, clone, cn_a, cn_b) AS (VALUES
  (0, '1|1;1|1;1|1', 0, 'normal', 1, 1), (0, '1|1;1|1;1|1', 1, 'clone1', 1, 1), (0, '1|1;1|1;1|1', 2, 'clone2', 1, 1),
  (1, '1|1;1|0;1|0', 0, 'normal', 1, 1), (1, '1|1;1|0;1|0', 1, 'clone1', 1, 0), (1, '1|1;1|0;1|0', 2, 'clone2', 1, 0),
  (2, '1|1;2|1;1|1', 0, 'normal', 1, 1), (2, '1|1;2|1;1|1', 1, 'clone1', 2, 1), (2, '1|1;2|1;1|1', 2, 'clone2', 1, 1),
  (3, '1|1;2|0;2|0', 0, 'normal', 1, 1), (3, '1|1;2|0;2|0', 1, 'clone1', 2, 0), (3, '1|1;2|0;2|0', 2, 'clone2', 2, 0),
  (4, '1|1;2|2;3|1', 0, 'normal', 1, 1), (4, '1|1;2|2;3|1', 1, 'clone1', 2, 2), (4, '1|1;2|2;3|1', 2, 'clone2', 3, 1)),
state_ids AS (
  SELECT state, CAST(row_number() OVER (ORDER BY vec) - 1 AS BIGINT) AS group_id FROM (
    SELECT DISTINCT k.state,
      CASE k.state WHEN 0 THEN [1,1,1,1,1,1] WHEN 1 THEN [1,1,1,1,0,0] WHEN 2 THEN [1,2,1,1,1,1]
                   WHEN 3 THEN [1,2,2,1,0,0] ELSE [1,2,3,1,2,1] END AS vec FROM kept k)),
cluster_bins AS (SELECT k.*, i.group_id FROM kept k JOIN state_ids i USING (state)),
clusters AS (
  SELECT group_id, min(state) AS state, min(cnp) AS cnp, count(*) AS n_bbc,
         CAST(sum(end_bp - start_bp) AS BIGINT) AS length_bp,
         min(state) <> 0 AS imbalanced, min(state) IN (1, 2, 4) AS aneuploid, min(state) IN (2, 4) AS subclonal
  FROM cluster_bins GROUP BY group_id),
clones AS (
  SELECT c.group_id, s.k, s.clone, s.cn_a, s.cn_b, s.cn_a + s.cn_b AS cn_c,
         greatest(0.001, least(0.999, CASE WHEN s.cn_a + s.cn_b > 0 THEN CAST(s.cn_b AS DOUBLE) / (s.cn_a + s.cn_b) ELSE 0 END)) AS baf,
         c.imbalanced, c.aneuploid, c.subclonal
  FROM clusters c JOIN states s USING (state)),
cells AS (
  SELECT c_custkey AS cell_id, 'C' || c_custkey || '-1_R' || (c_nationkey % 3) AS barcode,
         'R' || (c_nationkey % 3) AS rep_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Tumor_cell' WHEN 'AUTOMOBILE' THEN 'clone2'
              WHEN 'MACHINERY' THEN 'T_cell' WHEN 'HOUSEHOLD' THEN 'B_cell' WHEN 'FURNITURE' THEN 'Unknown' END AS cell_type,
         CASE c_custkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'clone1' WHEN 2 THEN 'clone2' ELSE 'NA' END AS label,
         (c_custkey % 100) / 100.0::DOUBLE AS max_posterior, (c_custkey * 7 % 100) / 100.0::DOUBLE AS tumor_purity,
         2 * (c_custkey % 40) + (c_custkey // 40) % 2 AS x, c_custkey // 40 AS y
  FROM customer),
typed AS (
  SELECT *, cell_type IN ('Tumor_cell', 'clone2') AS ref_tumor, cell_type IN ('T_cell', 'B_cell') AS ref_normal,
         cell_type = 'Unknown' AS ref_na, label IN ('clone1', 'clone2') AS pred_tumor, label = 'NA' AS pred_na
  FROM cells),
counts AS (
  SELECT bin_id, cell_id, CAST(sum(x) AS BIGINT) AS x, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b
  FROM lines GROUP BY bin_id, cell_id),
phased AS (
  SELECT l.assay, l.cell_id, k.*, l.x, CASE WHEN k.phase = 1 THEN l.a ELSE l.b END AS a,
         CASE WHEN k.phase = 1 THEN l.b ELSE l.a END AS b
  FROM lines l JOIN kept k USING (bin_id)),
cluster_sums AS (
  SELECT p.cell_id, i.group_id, CAST(sum(p.x) AS BIGINT) AS x, CAST(sum(p.a) AS BIGINT) AS a, CAST(sum(p.b) AS BIGINT) AS b
  FROM phased p JOIN state_ids i USING (state) GROUP BY 1, 2),
dense AS (
  SELECT c.cell_id, g.group_id, coalesce(s.x, 0) AS x, coalesce(s.a, 0) AS a, coalesce(s.b, 0) AS b
  FROM cells c CROSS JOIN clusters g LEFT JOIN cluster_sums s USING (cell_id, group_id)),
baseline AS (
  SELECT s.group_id, CAST(sum(CASE WHEN t.ref_normal THEN s.x ELSE 0 END) AS DOUBLE)
       / sum(sum(CASE WHEN t.ref_normal THEN s.x ELSE 0 END)) OVER () AS lam_g
  FROM cluster_sums s JOIN typed t USING (cell_id) GROUP BY s.group_id),
clone_depth AS (
  SELECT c.*, l.lam_g, c.cn_c / sum(l.lam_g * c.cn_c) OVER (PARTITION BY c.k) AS rdr,
         l.lam_g * c.cn_c / sum(l.lam_g * c.cn_c) OVER (PARTITION BY c.k) AS props
  FROM clones c JOIN baseline l USING (group_id)),
depth AS (
  SELECT d.*, CAST(sum(d.x) OVER (PARTITION BY d.cell_id) AS BIGINT) AS total, l.lam_g
  FROM dense d JOIN baseline l USING (group_id))
"""


def r6(expr: str, digits: int = 6) -> str:
    """Rounded value without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def sql(body: str) -> str:
    """Prelude plus a final query, or plus further ``name AS (..)`` parts and a query."""
    text = body.strip()
    joint = "\n" if text.upper().startswith("SELECT") else ", "
    return PRELUDE.rstrip() + joint + text
