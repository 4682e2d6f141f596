"""The fits against a plain numpy version of the same model."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import likelihood
from cellmosaic.models import cell_model, common, solver, spot_model
from cellmosaic.models.common import FitSettings
from cellmosaic.operators.profile import add_masks, parse_profile

PROFILES = ["1|1;1|1;1|1", "1|1;1|0;2|1", "1|1;2|1;1|1", "1|1;2|0;2|0", "1|1;2|2;3|1", "1|1;1|1;1|0"]
lgamma = np.vectorize(math.lgamma)


def simulate(seed=11, cells=90, depth=600, purity=None):
    rng = np.random.default_rng(seed)
    cn = np.array([[[int(v) for v in s.split("|")] for s in p.split(";")] for p in PROFILES])
    a, b = cn[..., 0], cn[..., 1]
    size = rng.dirichlet(np.full(len(PROFILES), 20.0))
    truth = np.arange(cells) % 3
    x, na, nb = (np.zeros((len(PROFILES), cells), dtype=int) for _ in range(3))
    for n, k in enumerate(truth):
        theta = 1.0 if purity is None else purity[n]
        copies = theta * (a + b)[:, k] + (1 - theta) * 2
        p = size * copies
        x[:, n] = rng.multinomial(depth, p / p.sum())
        total = rng.poisson(p / p.sum() * depth / 2)
        baf = (theta * b[:, k] + (1 - theta)) / np.maximum(copies, 1e-9)
        nb[:, n] = rng.binomial(total, np.clip(baf, 0.001, 0.999))
        na[:, n] = total - nb[:, n]
    return a, b, truth, x, na, nb


def frames(spark, x, na, nb, run="r1"):
    rows = [
        (run, "gex", g, n, int(x[g, n]), int(na[g, n]), int(nb[g, n]))
        for g in range(x.shape[0]) for n in range(x.shape[1])
    ]
    counts = spark.createDataFrame(
        rows, "run_id string, assay string, group_id int, cell_id bigint, x bigint, a bigint, b bigint")
    plain = spark.createDataFrame([(run, g, p) for g, p in enumerate(PROFILES)], "run_id string, group_id int, cnp string")
    return counts, add_masks(parse_profile(plain))


def numpy_scores(a, b, x, na, nb, lam, tau, size, clip=0.001):
    c = a + b
    p = np.clip(np.divide(b, c, out=np.zeros(b.shape), where=c > 0), clip, 1 - clip)[:, None, :]
    n = (na + nb)[:, :, None]
    nb3, x3 = nb[:, :, None], x[:, :, None]
    al, be = tau * p, tau * (1 - p)
    ll_a = (lgamma(n + 1) - lgamma(nb3 + 1) - lgamma(n - nb3 + 1) + lgamma(nb3 + al) + lgamma(n - nb3 + be)
            - lgamma(n + tau) + lgamma(tau) - lgamma(al) - lgamma(be))
    props = lam[:, None] * c
    props = props / props.sum(0)
    mu = np.maximum(props[:, None, :] * x.sum(0)[None, :, None], 1e-12)
    ll_t = (lgamma(x3 + size) - lgamma(size) - lgamma(x3 + 1) + size * np.log(size / (size + mu))
            + x3 * np.log(mu / (size + mu)))
    imb = (a != b).any(1)
    ane = (c != 2).any(1)
    return ll_a[imb].sum(0) + ll_t[ane].sum(0) + math.log(1 / a.shape[1])


def test_cell_fit_agrees_with_numpy(spark):
    a, b, truth, x, na, nb = simulate()
    counts, profile = frames(spark, x, na, nb)
    ref = counts.select("run_id", "cell_id").distinct().withColumn("is_reference", F.col("cell_id") % 3 == 0)
    fit = cell_model.fit_cells(counts, profile, FitSettings(), ref, partitions=4)
    rows = common.wide_annotations(fit, ["normal", "clone1", "clone2"]).orderBy("cell_id").collect()
    labels = np.array([r.label for r in rows])
    names = np.array(["normal", "clone1", "clone2"])
    assert (labels == names[truth]).mean() > 0.95
    for r in rows:
        assert r.normal + r.clone1 + r.clone2 == pytest.approx(1.0)
    value = {(p.name): p.value for p in fit.params.filter("name in ('tau', 'inv_phi', 'log_likelihood')").collect()}
    lam = x[:, truth == 0].sum(1) / x[:, truth == 0].sum()
    scores = numpy_scores(a, b, x, na, nb, lam, value["tau"], value["inv_phi"])
    assert scores.max(1).sum() == pytest.approx(value["log_likelihood"], abs=1e-4)
    assert (names[scores.argmax(1)] == labels).all()
    z = scores.argmax(1)

    def objective(tau, size):
        return numpy_scores(a, b, x, na, nb, lam, tau, size)[np.arange(len(z)), z].sum()

    best = objective(value["tau"], value["inv_phi"])
    for factor in (0.2, 0.8, 1.25, 5.0):
        assert objective(min(value["tau"] * factor, 1e6), value["inv_phi"]) <= best + 1e-3
        assert objective(value["tau"], min(value["inv_phi"] * factor, 1e6)) <= best + 1e-3
    assert 1e-6 <= value["tau"] <= 1e6 and 1e-6 <= value["inv_phi"] <= 1e6


def test_reference_cells_and_no_normal(spark):
    _, _, truth, x, na, nb = simulate(depth=900)
    counts, profile = frames(spark, x, na, nb)
    obs = common.prepare_observations(counts, 4)
    cells, ref = cell_model.estimate_reference(obs, profile, FitSettings(ref_post_cutoff=0.5))
    got = {r.cell_id: r.is_reference for r in cells.collect()}
    assert np.mean([got[i] == (t == 0) for i, t in enumerate(truth)]) > 0.9
    assert ref.first().ref_k == 0
    fit = cell_model.fit_cells(counts, profile, FitSettings(no_normal=True, niters=4), partitions=4)
    assert {r.label for r in fit.annotations.select("label").distinct().collect()} <= {"clone1", "clone2"}


def test_runs_are_fitted_independently(spark):
    _, _, _, x, na, nb = simulate(seed=1, cells=30)
    _, _, _, x2, na2, nb2 = simulate(seed=2, cells=30)
    settings = FitSettings(fit_mode="allele", share_dispersion=False, niters=5)
    one, profile1 = frames(spark, x, na, nb, "r1")
    two, profile2 = frames(spark, x2, na2, nb2, "r2")
    both = cell_model.fit_cells(one.unionByName(two), profile1.unionByName(profile2), settings, partitions=4)
    alone = cell_model.fit_cells(one, profile1, settings, partitions=4)
    pick = ["cell_id", "label", F.round("max_posterior", 6).alias("p")]
    got = sorted(map(tuple, both.annotations.filter("run_id = 'r1'").select(*pick).collect()))
    assert got == sorted(map(tuple, alone.annotations.select(*pick).collect()))


def test_informative_groups_are_required(spark):
    _, _, _, x, na, nb = simulate(cells=6)
    counts, profile = frames(spark, x, na, nb)
    flat = profile.withColumn("imbalanced", F.lit(False))
    with pytest.raises(ValueError):
        cell_model.fit_cells(counts, flat, FitSettings(fit_mode="allele"), partitions=4)


def test_spot_purity(spark):
    rng = np.random.default_rng(0)
    purity = np.where(np.arange(60) % 3 == 0, 0.0, rng.uniform(0.3, 0.9, 60))
    _, _, truth, x, na, nb = simulate(cells=60, depth=8000, purity=purity)
    counts, profile = frames(spark, x, na, nb)
    ref = counts.select("run_id", "cell_id").distinct().withColumn("is_reference", F.col("cell_id") % 3 == 0)
    fit = spot_model.fit_spots(counts, profile, FitSettings(), ref, partitions=4)
    rows = {r.cell_id: r for r in fit.annotations.collect()}
    got = np.array([rows[i].tumor_purity for i in range(60)])
    tumor = truth > 0
    assert np.abs(got[tumor] - purity[tumor]).mean() < 0.1
    assert got[~tumor].mean() < 0.1
    calls = np.array([rows[i].label for i in range(60)])
    assert (calls[tumor] == np.array(["", "clone1", "clone2"])[truth[tumor]]).mean() > 0.9
    with pytest.raises(ValueError):
        spot_model.fit_spots(counts, profile, FitSettings(no_normal=True), ref)


def test_em_iterations_need_no_exchange(spark):
    _, _, _, x, na, nb = simulate(cells=12)
    counts, profile = frames(spark, x, na, nb)
    obs = common.prepare_observations(counts, 4)
    obs.count()
    groups = cell_model.static_groups(obs, profile, FitSettings(fit_mode="allele"), None)
    table = spark.createDataFrame([("r1", "gex", "*", 50.0, 30.0)],
                                  "run_id string, assay string, state string, tau double, inv_phi double")
    params = spark.createDataFrame(
        cell_model.with_dispersion(groups, table, FitSettings(fit_mode="allele")).toPandas())
    clones = spark.createDataFrame([("r1", k, 0.0) for k in range(3)], "run_id string, k int, log_pi double")
    calls = cell_model.posteriors(obs, params.withColumn("k", F.col("k").cast("int")), clones, small=True)
    calls.collect()
    plan = calls._jdf.queryExecution().executedPlan().toString()
    above = plan.split("InMemoryTableScan")[0] if "InMemoryTableScan" in plan else plan
    assert "Exchange hashpartitioning" not in above


STATS = "run_id string, assay string, state string, cell_id bigint, x double, mu double, log_mu double"


def depth_rows(spark, rows=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.negative_binomial(4, 0.1, rows)
    mu = rng.uniform(20, 60, rows)
    state = [["1|1", "2|1", "2|0"][i % 3] for i in range(rows)]
    data = [("r1", "gex", state[i], i, float(x[i]), float(mu[i]), math.log(mu[i])) for i in range(rows)]
    return spark.createDataFrame(data, STATS), x, mu, np.array(state)


def plain_nb(x, mu, size):
    return (lgamma(x + size) - lgamma(size) + size * np.log(size / (size + mu)) + x * np.log(mu / (size + mu))).sum()


def test_depth_search_matches_direct_sums(spark):
    stats, x, mu, state = depth_rows(spark)
    bounds = (1e-6, 1e6)
    rounds = cell_model.invphi_rounds(stats, bounds, 33)
    got = {(r.state, r.i): r for r in rounds(None).collect()}
    points = solver.first_points(bounds, 33)
    assert len(got) == 3 * 33
    for name in ("1|1", "2|1", "2|0"):
        own = state == name
        for i in (0, 10, 16, 20, 32):
            assert got[name, i].at == pytest.approx(points[i])
            assert got[name, i].ll == pytest.approx(plain_nb(x[own], mu[own], math.exp(points[i])), rel=1e-9, abs=1e-4)
    best = {r.state: r.value for r in solver.maximise(rounds, cell_model.STATE, bounds, 3).collect()}
    for name, value in best.items():
        own = state == name
        grid = np.exp(np.linspace(math.log(value) - 0.3, math.log(value) + 0.3, 61))
        assert plain_nb(x[own], mu[own], value) >= max(plain_nb(x[own], mu[own], g) for g in grid) - 1e-6


def leaves_below_generate(plan: str) -> list[str]:
    """The first relation under each Generate that no Aggregate comes before."""
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Generate" in line:
            for below in lines[i + 1:]:
                if "Aggregate" in below:
                    break
                if "Relation" in below or "LogicalRDD" in below:
                    out.append(below)
                    break
    return out


def test_depth_rows_are_not_repeated_for_a_grid(spark):
    stats, *_ = depth_rows(spark, 12)
    rounds = cell_model.invphi_rounds(stats, (1e-6, 1e6), 33, small=True)
    ends = spark.createDataFrame([("r1", "gex", "1|1", 0.0, 1.0)], "run_id string, assay string, state string, lo double, hi double")
    for scores in (rounds(None), rounds(ends)):
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan
        assert not [leaf for leaf in leaves_below_generate(plan) if "log_mu" in leaf]


def test_allele_terms_are_counted_apart_and_sum_to_the_pairs(spark):
    pairs = [(b, n, p) for n in range(41) for b in range(n + 1) for p in (0.25, 0.5)]
    stats = spark.createDataFrame([("r1", "gex", "*", float(b), float(n), p, float(1 + (b * n) % 3)) for b, n, p in pairs],
                                  "run_id string, assay string, state string, b double, n double, p double, cnt double")
    assert cell_model.tau_parts(stats).count() <= 4 * 41 + 41 < len(pairs)  # b and n - b by fraction, and n
    got = {r.i: (r.at, r.ll) for r in cell_model.tau_rounds(stats, (1e-3, 1e3), 9)(None).collect()}
    for at, ll in got.values():
        s, g = math.exp(at), math.lgamma
        want = sum((1 + (b * n) % 3) * (
            g(b + s * p) - g(s * p) + g(n - b + s * (1 - p)) - g(s * (1 - p)) - g(n + s) + g(s)) for b, n, p in pairs)
        assert ll == pytest.approx(want, rel=1e-8)
    assert len(got) == 9


def test_constants_of_count_rows_match_their_sql(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0), (1, 3, 4, 9), (2, 250, 0, 4000), (3, 0, 7, 1)], "cell_id bigint, a bigint, b bigint, x bigint")
    rows = rows.withColumns({"run_id": F.lit("r1"), "assay": F.lit("gex"), "group_id": F.lit(0)})
    obs = common.prepare_observations(rows, 2)
    sides = [F.expr(likelihood.bb_constant("b", "n")), F.expr(likelihood.nb_constant("x"))]
    for r in obs.select("bb_const", "nb_const", sides[0].alias("bb"), sides[1].alias("nb")).collect():
        assert (r.bb_const, r.nb_const) == (pytest.approx(r.bb, abs=1e-9), pytest.approx(r.nb, abs=1e-9))


def test_runs_of_a_panel_agree_with_fits_of_their_own(spark):
    """Labels, parameters and the number of iterations of each run."""
    settings = FitSettings(share_dispersion=False, update_pi=True, niters=8, tol=1e-10, grid_rounds=2, grid_points=17)
    tables = [frames(spark, *simulate(seed=s, cells=24, depth=d)[3:], f"r{s}") for s, d in ((1, 25), (2, 4000))]
    counts, profile = (x.unionByName(y) for x, y in zip(*tables))
    ref = counts.select("run_id", "cell_id").distinct().withColumn("is_reference", F.col("cell_id") % 3 == 0)
    both = cell_model.fit_cells(counts, profile, settings, ref, partitions=4)
    last = {r.run_id: r.t for r in both.trace.groupBy("run_id").agg(F.max("iter").alias("t")).collect()}
    pick = ["cell_id", "label", F.round("max_posterior", 6).alias("p")]
    for run, (c, p) in zip(("r1", "r2"), tables):
        alone = cell_model.fit_cells(c, p, settings, ref.filter(F.col("run_id") == run), partitions=4)
        assert sorted(map(tuple, both.annotations.filter(F.col("run_id") == run).select(*pick).collect())) == sorted(
            map(tuple, alone.annotations.select(*pick).collect()))
        assert alone.trace.agg(F.max("iter")).first()[0] == last[run]
        key = lambda r: (r.name, r.assay, r.group_id, r.k, r.state)
        mine = {key(r): r.value for r in both.params.filter(F.col("run_id") == run).collect()}
        assert mine == {key(r): pytest.approx(r.value, rel=1e-6) for r in alone.params.collect()}
        assert {k[0] for k in mine} == {"log_likelihood", "tau", "inv_phi", "pi", "lambda"}


def test_saved_parameters_score_new_cells(spark, tmp_path):
    from cellmosaic.sources import sinks

    a, b, truth, x, na, nb = simulate(seed=5, cells=60)
    counts, profile = frames(spark, x, na, nb)
    seen = F.col("cell_id") < 40
    ref = counts.filter(seen).select("run_id", "cell_id").distinct().withColumn("is_reference", F.col("cell_id") % 3 == 0)
    fit = cell_model.fit_cells(counts.filter(seen), profile, FitSettings(), ref, partitions=4)
    sinks.write_table(fit.params, str(tmp_path / "params"), ["name"])
    params = sinks.read_parameters(spark, str(tmp_path / "params"))
    calls = cell_model.score_cells(counts, profile, params, FitSettings(), partitions=4)
    got = {r.cell_id: (r.label, r.p) for r in calls.select("cell_id", "label", F.round("max_posterior", 9).alias("p")).collect()}
    for r in fit.annotations.select("cell_id", "label", F.round("max_posterior", 9).alias("p")).collect():
        assert got[r.cell_id] == (r.label, pytest.approx(r.p, abs=1e-8))
    value = {p.name: p.value for p in fit.params.filter("name in ('tau', 'inv_phi')").collect()}
    lam = x[:, :40][:, truth[:40] == 0].sum(1) / x[:, :40][:, truth[:40] == 0].sum()
    scores = numpy_scores(a, b, x, na, nb, lam, value["tau"], value["inv_phi"])
    names = np.array(["normal", "clone1", "clone2"])
    assert [got[i][0] for i in range(60)] == list(names[scores.argmax(1)])


def test_groups_without_a_mask_are_not_scored(spark):
    _, _, _, x, na, nb = simulate(cells=6)
    counts, profile = frames(spark, x, na, nb)
    obs = common.prepare_observations(counts, 4)
    groups = cell_model.static_groups(obs, profile, FitSettings(fit_mode="allele"), None)
    kept = {r.group_id for r in groups.filter("scored").select("group_id").distinct().collect()}
    assert kept == {r.group_id for r in profile.filter("imbalanced").collect()} and len(kept) < len(PROFILES)
    flat = cell_model.static_groups(obs, profile.withColumn("imbalanced", F.lit(False)), FitSettings(fit_mode="allele"), None)
    assert flat.filter("NOT scored").isEmpty()


def test_partitions_grow_with_the_count_rows(spark):
    assert common.partition_count(spark, None, 1_000_000) == 20
    assert common.partition_count(spark, None, 10) == 4 and common.partition_count(spark, 3, 1_000_000) == 3


def test_both_dispersions_are_searched_in_the_same_rounds(spark, monkeypatch):
    _, _, truth, x, na, nb = simulate(cells=12)
    counts, profile = frames(spark, x, na, nb)
    obs = common.prepare_observations(counts, 4)
    lam = spark.createDataFrame([("r1", "gex", g, 1.0 / len(PROFILES)) for g in range(len(PROFILES))],
                                "run_id string, assay string, group_id int, lambda double")
    settings = FitSettings(tau_bounds=(1e-3, 1e3))
    groups = cell_model.durable(cell_model.static_groups(obs, profile, settings, lam))
    calls = spark.createDataFrame([("r1", n, int(k)) for n, k in enumerate(truth)], "run_id string, cell_id bigint, z int")
    none = spark.createDataFrame([], cell_model.DISPERSION)
    written, plain = [], solver.durable
    monkeypatch.setattr(solver, "durable", lambda df: written.append(df) or plain(df))
    both = cell_model.m_step(obs, calls, groups, settings, none, small=True).collect()
    assert len(written) == settings.grid_rounds
    alone = [cell_model.m_step(obs, calls, groups, settings.with_(**{off: False}), none, small=True).collect()
             for off in ("update_invphi", "update_tau")]
    assert [(r.state, r.tau, r.inv_phi) for r in both] == [
        ("*", pytest.approx(alone[0][0].tau), pytest.approx(alone[1][0].inv_phi))]
    assert both[0].tau <= 1e3


def test_purity_search_reads_the_counts_once_and_repeats_none(spark):
    _, _, _, x, na, nb = simulate(cells=12)
    counts, profile = frames(spark, x, na, nb)
    obs = common.prepare_observations(counts, 4)
    lam = spark.createDataFrame([("r1", "gex", g, 1.0 / len(PROFILES)) for g in range(len(PROFILES))],
                                "run_id string, assay string, group_id int, lambda double")
    settings = FitSettings(tau_bounds=(1e-6, 50.0), invphi_bounds=(1e-6, 30.0))
    groups = cell_model.durable(spot_model.spot_groups(obs, profile, lam, settings))
    theta = spot_model.estimate_purity(obs, groups, settings)
    assert theta._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    assert "Generate" not in theta._jdf.queryExecution().optimizedPlan().toString()
    # the search against direct sums on a fine grid
    side = groups.filter("k = 1 AND NOT subclonal AND (use_allele OR use_total)")
    rows = obs.join(side.select(*common.GROUP, "baf", "rdr", "lambda", "use_allele", "use_total"), common.GROUP).toPandas()

    def objective(own, t):
        depth = own.rdr * t + 1 - t
        p, mu = np.clip((own.baf * own.rdr * t + 0.5 * (1 - t)) / depth, 1e-12, 1 - 1e-12), own.total * own["lambda"] * depth
        allele = lgamma(own.b + 50 * p) + lgamma(own.n - own.b + 50 * (1 - p)) - lgamma(50 * p) - lgamma(50 * (1 - p))
        total = own.x * np.log(mu) - (own.x + 30.0) * np.log(30.0 + mu)
        return (allele * (own.use_allele & (own.n > 0)) + total * own.use_total).sum()

    for r in theta.collect():
        own = rows[rows.cell_id == r.cell_id]
        assert objective(own, r.theta) >= max(objective(own, t) for t in np.linspace(1e-4, 1 - 1e-4, 101)) - 1e-3
    nothing = spot_model.estimate_purity(obs, groups.withColumn("subclonal", F.lit(True)), settings)
    assert {r.theta for r in nothing.collect()} == {0.5}


def test_scores_of_a_cell_are_summed_from_its_list_of_rows(spark):
    """The E-step holds no likelihood as SQL text, which the JVM does not compile, and fails where one is undefined."""
    _, _, _, x, na, nb = simulate(cells=12)
    counts, profile = frames(spark, x, na, nb)
    obs = common.prepare_observations(counts, 4)
    settings = FitSettings(fit_mode="allele")
    groups = cell_model.static_groups(obs, profile, settings, None)
    table = spark.createDataFrame([("r1", "gex", "*", 50.0, 30.0)], cell_model.DISPERSION)
    params = cell_model.durable(cell_model.with_dispersion(groups, table, settings))
    clones = spark.createDataFrame([("r1", k, -float(k)) for k in range(3)], "run_id string, k int, log_pi double")
    calls = cell_model.posteriors(obs, params, clones, small=True)
    above = calls._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("InMemoryRelation")[0]
    assert "LOG" not in above.upper().replace("LOG_PI", "")
    rows = obs.join(params.filter("scored"), common.GROUP).toPandas()
    head, tail = 50.0 * rows.baf, 50.0 * (1 - rows.baf)
    term = (lgamma(rows.n + 1) - lgamma(rows.b + 1) - lgamma(rows.n - rows.b + 1) + lgamma(rows.b + head) + lgamma(50.0)
            + lgamma(rows.n - rows.b + tail) - lgamma(rows.n + 50.0) - lgamma(head) - lgamma(tail))
    want = (term * (rows.use_allele & (rows.n > 0))).groupby([rows.cell_id, rows.k]).sum().unstack() - np.arange(3)
    for r in calls.collect():
        own = want.loc[r.cell_id].to_numpy()
        assert r.ks == [0, 1, 2] and r.z == own.argmax() and r.best_ll == pytest.approx(own.max())
        assert r.clone_post == pytest.approx(np.exp(own - own.max()) / np.exp(own - own.max()).sum())
    with pytest.raises(Exception, match="undefined log-probability"):
        cell_model.posteriors(obs.withColumn("b", -F.col("n") - 1e6), params, clones, small=True).collect()
