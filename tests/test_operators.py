from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.operators import (
    annotate, cells, cutoffs, grouping, joins, metrics, ordering, panel, profile, reports, spatial,
)
from cellmosaic.session import durable


def test_latest_segment_wins_and_gaps_drop(spark):
    segments = spark.createDataFrame(
        [("chr1", 0, 1000, 1), ("chr1", 100, 200, 2), ("chr2", 0, 50, 3)],
        "chrom string, start_bp bigint, end_bp bigint, seg_id bigint")
    bins = spark.createDataFrame(
        [(1, "chr1", 0, 100), (2, "chr1", 100, 199), (3, "chr1", 300, 400), (4, "chr2", 40, 61), (5, "chr3", 0, 1)],
        "bin_id bigint, chrom string, start_bp bigint, end_bp bigint")
    got = {r.bin_id: r.seg_id for r in annotate.map_bins(bins, segments).collect()}
    # bin 3 starts after segment 2, which is the latest start but ends before it
    assert got == {1: 1, 2: 2}
    assert {r.bin_id for r in annotate.gap_bins(bins, segments).collect()} == {3, 4, 5}


def test_phases_must_match_once(spark):
    bins = spark.createDataFrame([(1, "chr1", 0, 10)], "bin_id bigint, chrom string, start_bp bigint, end_bp bigint")
    schema = "chrom string, start_bp bigint, end_bp bigint, phase double"
    twice = spark.createDataFrame([("chr1", 0, 10, 1.0), ("chr1", 0, 10, 0.0)], schema)
    none = spark.createDataFrame([("chr1", 5, 10, 1.0)], schema)
    for bad in (twice, none):
        with pytest.raises(Exception):
            annotate.attach_phase(bins, bad).collect()


def test_salted_join_equals_broadcast_join(spark, monkeypatch):
    fact = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    small = sorted(map(tuple, joins.join_dim(fact, dim, ["k"], ["v"], "left").collect()), key=str)
    monkeypatch.setattr(joins, "is_small", lambda *a, **k: False)
    monkeypatch.setattr(joins, "few_bytes", lambda *a, **k: False)
    large = sorted(map(tuple, joins.join_dim(fact, dim, ["k"], ["v"], "left").collect()), key=str)
    assert small == large and len(large) == 1000


def test_a_stored_table_with_small_files_and_wide_rows_is_not_broadcast(spark):
    fact = spark.range(4000).withColumnRenamed("id", "k")
    wide = durable(spark.range(0, 4000, 2).select(F.col("id").alias("k"), F.expr("repeat('wide row ', 4000)").alias("w")))
    assert joins.is_small(wide) and not joins.few_bytes(wide)
    out = joins.join_dim(fact, wide, ["k"], ["k"], stored=True).select("k", F.length("w").alias("n"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("rightHint=(strategy=broadcast)") == 1  # of the keys alone
    assert sorted(map(tuple, out.collect())) == [(k, 36_000) for k in range(0, 4000, 2)]


def greedy(rows, min_snp, max_len):
    out, seg, start, acc, i = {}, None, 0, 0, -1
    for b, s, lo, hi, n in rows:
        if s != seg or hi - start > max_len or acc >= min_snp:
            i, seg, start, acc = i + 1, s, lo, 0
        out[b] = i
        acc += n
    return out


def test_adaptive_bins_equal_the_greedy_walk(spark):
    rng = np.random.default_rng(1)
    rows, b = [], 0
    for s in range(6):
        for i in range(60):
            rows.append((b, s, (s * 60 + i) * 10, (s * 60 + i + 1) * 10, int(rng.integers(0, 40))))
            b += 1
    bins = spark.createDataFrame([(b, "chr1", s, lo, hi) for b, s, lo, hi, _ in rows],
                                 "bin_id bigint, chrom string, seg_id bigint, start_bp bigint, end_bp bigint")
    snp = spark.createDataFrame([(b, n) for b, _, _, _, n in rows], "bin_id bigint, snp_count bigint")
    got = {r.bin_id: r.group_id for r in grouping.adaptive_groups(bins, snp, 100, 80).collect()}
    assert got == greedy(rows, 100, 80)


def test_densify_adds_zero_rows(spark):
    sums = spark.createDataFrame([(1, 0, 5, 1, 2)], "cell_id bigint, group_id int, x bigint, a bigint, b bigint")
    cell = spark.createDataFrame([(1,), (2,)], "cell_id bigint")
    groups = spark.createDataFrame([(0,), (1,)], "group_id int")
    got = {(r.cell_id, r.group_id): (r.x, r.a, r.b) for r in grouping.densify(sums, cell, groups).collect()}
    assert got == {(1, 0): (5, 1, 2), (1, 1): (0, 0, 0), (2, 0): (0, 0, 0), (2, 1): (0, 0, 0)}


def test_profile_whitelist_without_match_fails(spark):
    df = spark.createDataFrame([(0, "1|1;2|1")], "group_id int, cnp string")
    groups = profile.add_masks(profile.parse_profile(df)).drop("cnp")
    with pytest.raises(Exception):
        profile.restrict_masks(groups, "9|9").collect()
    assert profile.restrict_masks(groups, " ").count() == 1


def test_duplicate_cell_types_fail(spark):
    left = spark.createDataFrame([(1, "c1")], "cell_id bigint, barcode string")
    right = spark.createDataFrame([("c1", "x"), ("c1", "y")], "barcode string, cell_type string")
    with pytest.raises(Exception):
        cells.label_cells(left, right, "cell_type").collect()


def test_running_totals_with_ties_and_one_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(4000) < 0.4, 0.5, rng.random(4000))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, v double")
    got = {r.id: r.rn for r in ordering.row_numbers(df, "v", "rn", ties=["id"]).collect()}
    order = np.lexsort((np.arange(len(values)), values))
    assert got == {int(i): n + 1 for n, i in enumerate(order)}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 1001), ("b", 2), ("c", 1)) for v in rng.normal(size=n).round(2)]
    df = spark.createDataFrame([*rows, ("a", None)], "g string, v double")
    got = {r.g: (r.q, r.m) for r in ordering.exact_quantiles(df, "v", {"q": 0.25, "m": 0.5}, ["g"]).collect()}
    for g in "abc":
        mine = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(tuple(np.percentile(mine, [25, 50])))


def test_order_is_exact_if_its_bounds_come_out_differently_each_time(spark, monkeypatch):
    df = spark.range(0, 20_000, 1, 8).selectExpr("id % 3 AS g", "CAST(pmod(xxhash64(id), 5000) AS DOUBLE) AS v")
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    draw = F.udf(lambda v: sorted(random.SystemRandom().choices(v, k=40)), "array<double>").asNondeterministic()
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda value, probs, accuracy: draw(F.collect_list(value)))
    got = {r.g: r.m for r in ordering.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == want


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(5)
    truth, score = rng.random(300) < 0.3, rng.integers(0, 20, 300) / 20.0
    df = spark.createDataFrame([(bool(t), float(s)) for t, s in zip(truth, score)] + [(True, None)], "t boolean, s double")
    wins = [(p > n) + (p == n) / 2 for p in score[truth] for n in score[~truth]]
    assert metrics.auc(df, "t", "s").first()[0] == pytest.approx(float(np.mean(wins)))
    assert metrics.auc(df.filter("t"), "t", "s").first()[0] is None


def test_rand_index_limits(spark):
    schema = "ref string, pred string, n bigint"
    same = spark.createDataFrame([("a", "x", 5), ("b", "y", 7)], schema)
    trivial = spark.createDataFrame([("a", "x", 5)], schema)
    apart = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "x", 5), ("b", "y", 5)], schema)
    assert metrics.adjusted_rand(same).first()[0] == pytest.approx(1.0)
    assert metrics.adjusted_rand(trivial).first()[0] == 1.0
    assert metrics.adjusted_rand(apart).first()[0] < 0


def test_binary_metrics_need_both_classes(spark):
    df = spark.createDataFrame([("T_cell", "normal"), ("B_cell", "clone1")], "ref string, pred string")
    row = metrics.binary_metrics(metrics.binary_counts(df, "ref", "pred")).first()
    assert row.precision is None and row.auc_hard is None


def test_relabel_order(spark):
    df = spark.createDataFrame([("clone1", 0.4, 0.99), ("clone1", 0.9, 0.5), ("NA", 0.1, 0.1), ("clone2", None, 0.9)],
                               "l string, p double, m double")
    out = df.select(cutoffs.relabel(F.col("l"), F.col("p"), F.col("m"), F.lit(0.5), F.lit(0.5)))
    assert [r[0] for r in out.collect()] == ["normal", "normal", "NA", "clone2"]
    assert cutoffs.cutoff_name("label", 0.5, 0.6) == "label_pcut0.5_post0.6"
    assert len(cutoffs.cutoff_grid()) == 19


def brute_neighbours(points, n):
    out = set()
    for i, (x, y) in points.items():
        d = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, (a, b) in points.items() if j != i)
        out |= {(i, j) for _, j in d[:n]}
    return out


@pytest.mark.parametrize("kind", ["uniform", "crowded", "few", "stacked"])
def test_neighbours_match_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "uniform":
        xy = rng.random((150, 2)) * 100
    elif kind == "crowded":  # a third of the spots in a tiny area
        xy = np.vstack([rng.random((100, 2)) * 1000, 500 + rng.random((60, 2)) * 0.01])
    elif kind == "few":
        xy = rng.random((4, 2))
    else:  # many spots at one position
        xy = np.vstack([np.full((50, 2), 3.0), rng.random((40, 2)) * 10])
    points = {i: (float(x), float(y)) for i, (x, y) in enumerate(xy)}
    df = spark.createDataFrame([("R", i, x, y) for i, (x, y) in points.items()],
                               "rep_id string, cell_id bigint, x double, y double")
    got = {(r.src, r.dst) for r in spatial.nearest_neighbours(df, 6).collect()}
    assert got == brute_neighbours(points, 6)


def test_incomplete_replicate_is_not_smoothed(spark):
    spots = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("B", 4)], "rep_id string, cell_id bigint")
    counted = spots.filter("cell_id <> 4")
    assert {r.cell_id for r in spatial.complete_replicates(spots, counted).collect()} == {1, 2}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.58,), (1.0,), (1.2,)], "v double")
    got = {r.bin: r.n for r in reports.histogram(df, F.col("v"), 0.0, 1.0, 50).collect()}
    assert len(got) == 50 and got[0] == 1 and got[29] == 1 and got[49] == 1 and sum(got.values()) == 3


def test_panel_columns_and_solution_pattern(spark):
    with pytest.raises(ValueError):
        panel.clean_panel(spark.createDataFrame([("a",)], "SAMPLE string"))
    assert panel.metric_columns(["JC_b", "f1", "n_clone2", "purity_x", "n_clone1"]) == [
        "f1", "n_clone1", "n_clone2", "purity_x", "JC_b"]
    assert panel.prediction_column(["x_label-refined", "a_label", "b_label"]) == "a_label"


def plain_neighbours(points, n):
    """(src, dst) of the n nearest others by (distance, id)."""
    out = set()
    for i, x, y in points:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in points if j != i)
        out |= {(i, j) for _, j in near[:n]}
    return out


def test_neighbours_of_a_blob_with_outliers(spark):
    """Lone spots read the border of a dense blob alone; all results are exact."""
    rng = np.random.default_rng(6)
    blob = np.unique(rng.normal(0, 30, (2500, 2)).round(3), axis=0)
    far = np.array([[1e6, 1e6], [-4e5, 3.0], [200.0, 0.0], [0.0, 260.0], [150.0, 151.0], [-900.0, -900.0], [1e6, 1e6 + 1]])
    stacked = np.repeat(blob[:1], 40, axis=0)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([blob, far, stacked]))]
    df = spark.createDataFrame([("r", *p) for p in points], "rep_id string, cell_id bigint, x double, y double")
    lost = spark.createDataFrame([("r", 9999, None, 1.0)], df.schema)
    got = {(r.src, r.dst) for r in spatial.nearest_neighbours(df.unionByName(lost), 5).collect()}
    assert got == plain_neighbours(points, 5)
    placed = spatial._placed(spatial._places(df, ["rep_id"], 6), ["rep_id"], 6)
    runs = spatial._candidate_runs(placed, ["rep_id"], 6)
    per = runs.groupBy("_rn", "x", "y").count().collect()
    assert max(r["count"] for r in per) <= 40  # of about 160
    assert sum(r["count"] for r in per) <= 9 * len(per)


def test_neighbours_of_few_and_stacked_spots(spark):
    points = [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 5, 5)]
    df = spark.createDataFrame([("a", *p) for p in points] + [("b", 7, 1, 1)], "rep_id string, cell_id bigint, x bigint, y bigint")
    got = {(r.src, r.dst) for r in spatial.nearest_neighbours(df, 3).collect()}
    assert got == plain_neighbours(points, 3)
    assert spatial.nearest_neighbours(df.filter("false"), 3).collect() == []


def test_order_with_heavy_ties_fills_many_tasks(spark):
    """95 % of the values are equal; ranks stay exact and no group holds much of them."""
    rng = np.random.default_rng(9)
    rows = [("g", 0.25 if i % 20 else float(rng.integers(0, 5)) / 4, int(i)) for i in rng.permutation(8000)]
    rows += [(None, 1.0, 1), (None, None, 2), (None, 1.0, 3)]
    df = spark.createDataFrame(rows, "rep string, v double, cell_id bigint")
    got = ordering.row_numbers(df, "v", "rn", ["rep"], ties=["cell_id"]).collect()
    want = {}
    for rep in ("g", None):
        mine = sorted((v is not None, v or 0, i) for r, v, i in rows if r == rep)
        want |= {(rep, i): n for n, (_, _, i) in enumerate(mine, 1)}
    assert {(r.rep, r.cell_id): r.rn for r in got} == want
    tagged = ordering._with_bucket(df, ["rep"], "v", ordering.BUCKETS, "cell_id")
    sizes = [r["count"] for r in tagged.groupBy("rep", "_bucket", "_part").count().collect()]
    assert max(sizes) <= 0.05 * len(rows) and len(sizes) > 40


def test_partitions_of_the_neighbour_search_grow_with_the_spots(spark, monkeypatch):
    from cellmosaic.operators import spatial

    monkeypatch.setattr(spatial, "PART_PLACES", 8)
    monkeypatch.setattr(spatial, "PART_READS", 16)
    rows = [("r", i, i % 10, i // 10) for i in range(100)]
    df = spark.createDataFrame(rows, "rep_id string, cell_id bigint, x bigint, y bigint")
    edges = spatial.nearest_neighbours(df, 4)
    pairs = spatial.reachable(df, edges, 1)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 13" in plan.split("RepartitionByExpression")[1].splitlines()[0]
    want = {}
    for _, i, x, y in rows:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for _, j, u, v in rows if j != i)[:4]
        want[i] = {j for _, j in near}
    got = {}
    for r in edges.collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert got == want


def test_partitions_of_dense_counts_grow_with_the_cells(spark, monkeypatch):
    from cellmosaic.operators import grouping

    monkeypatch.setattr(grouping, "PART_CELLS", 4)
    sums = spark.createDataFrame([(i, i % 3, 1, 2, 3) for i in range(40)], "cell_id bigint, group_id int, x bigint, a bigint, b bigint")
    groups = spark.createDataFrame([(g,) for g in range(3)], "group_id int")
    dense = grouping.densify(sums, sums.select("cell_id"), groups, n_cells=40)
    assert dense.rdd.getNumPartitions() == 10
    assert dense.count() == 120 and dense.agg({"x": "sum"}).first()[0] == 40


def test_the_join_of_raw_lines_spreads_with_their_number(spark, monkeypatch):
    from cellmosaic.plans import inputs

    def sums(t):
        return sorted(map(tuple, t.lines.groupBy("assay", "cell_id").sum("x", "a", "b").collect()))

    plain = sums(inputs.Inputs(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(inputs, "LINE_ROWS", 600)
    spread = inputs.Inputs(spark, "/root/testdata/sf0.001")
    parts = -(-spread.raw("lineitem").count() // 600)
    plan = spread.lines._jdf.queryExecution().optimizedPlan().toString()
    assert parts > 4 and "RepartitionByExpression [l_orderkey" in plan and plan.count(f", {parts}") == 2
    assert sums(spread) == plain
