"""Queries on likelihoods, posteriors, dispersion and purity grids, and full fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import labels, likelihood, special
from cellmosaic.models import cell_model, common, solver, spot_model
from cellmosaic.models.common import FitSettings
from cellmosaic.operators import metrics
from cellmosaic.operators.joins import few_bytes, join_dim
from cellmosaic.plans import fit_oracle
from cellmosaic.plans.inputs import CLONES, Inputs
from cellmosaic.plans.registry import query, r6
from cellmosaic.session import durable, work_folder
from cellmosaic.sources import sinks

TAU, SIZE = 50.0, 30.0

# Beta-Binomial and Negative-Binomial of the oracle
_MACROS = {
    "bb": "(lgamma(n + 1) - lgamma(b + 1) - lgamma(n - b + 1) + lgamma(b + {t} * {p}) + lgamma(n - b + {t} * (1 - {p})) - lgamma(n + {t})"
          " + lgamma({t}) - lgamma({t} * {p}) - lgamma({t} * (1 - {p})))",
    "nb": "(lgamma(x + {s}) - lgamma({s}) - lgamma(x + 1) + {s} * ln({s} / ({s} + {m})) + x * ln({m} / ({s} + {m})))",
}


def _bb(t: str, p: str) -> str:
    return _MACROS["bb"].format(t=t, p=p)


def _nb(s: str, m: str) -> str:
    return _MACROS["nb"].format(s=s, m=m)


_OBS = """obs AS (SELECT cell_id, group_id, x::DOUBLE AS x, b::DOUBLE AS b, (a + b)::DOUBLE AS n, total::DOUBLE AS total, d.lam_g FROM depth d),
  full_obs AS (SELECT o.*, c.k, c.clone, c.cn_a, c.cn_b, c.baf, c.rdr, c.props, c.imbalanced, c.aneuploid, c.subclonal
    FROM obs o JOIN clone_depth c USING (group_id))
"""


def _observations(t: Inputs) -> DataFrame:
    counts = t.dense.select(
        F.lit("run").alias("run_id"), F.lit("all").alias("assay"), "group_id", "cell_id", "x", "a", "b"
    )
    return common.prepare_observations(counts)


def _profile(t: Inputs) -> DataFrame:
    return t.clusters.withColumn("run_id", F.lit("run"))


def _baseline(t: Inputs) -> DataFrame:
    return t.baseline.select(F.lit("run").alias("run_id"), F.lit("all").alias("assay"), "group_id", "lambda")


def _fixed(t: Inputs, settings: FitSettings) -> tuple[DataFrame, DataFrame]:
    """Observations and group parameters at fixed dispersions."""
    obs = _observations(t)
    groups = durable(cell_model.static_groups(obs, _profile(t), settings, _baseline(t)))
    table = t.spark.createDataFrame(
        [("run", "all", "*", TAU, SIZE)], "run_id string, assay string, state string, tau double, inv_phi double"
    )
    return obs, cell_model.with_dispersion(groups, table, settings)


def _uniform(t: Inputs, groups: DataFrame) -> DataFrame:
    return common.mixture_table(common.clone_sets(groups))


@query(f"SELECT p_partkey, round(lgamma(p_retailprice / 1000.0 + p_size), 6) + 0.0 AS lg, round(lgamma(p_size + 0.5) + lgamma(p_retailprice) - lgamma(p_size + 0.5 + p_retailprice), 6) + 0.0 AS lb FROM part")
def log_gamma(t: Inputs) -> DataFrame:
    return t.raw("part").select(
        "p_partkey", r6(F.expr(special.lgamma("p_retailprice / 1000D + p_size"))).alias("lg"),
        r6(F.expr(special.lbeta("p_size + 0.5D", "p_retailprice"))).alias("lb"),
    )


@query(_OBS + f"SELECT cell_id, group_id, k, round({_bb('50.0', 'baf')}, 4) + 0.0 AS ll FROM full_obs WHERE imbalanced")
def bb_loglik(t: Inputs) -> DataFrame:
    rows = t.dense.join(F.broadcast(t.clones_long.filter("imbalanced")), "group_id")
    rows = rows.withColumns({"n": (F.col("a") + F.col("b")).cast("double"), "b": F.col("b").cast("double")})
    ll = F.expr(likelihood.bb_logpmf("b", "n", f"{TAU}D", "baf"))
    return rows.select("cell_id", F.col("group_id").cast("bigint").alias("group_id"), "k", r6(ll, 4).alias("ll"))


@query(_OBS + f"SELECT cell_id, group_id, k, round({_nb('30.0', 'greatest(total * props, 1e-12)')}, 6) + 0.0 AS ll FROM full_obs WHERE aneuploid AND lam_g > 0")
def nb_loglik(t: Inputs) -> DataFrame:
    side = t.clone_depth.filter("aneuploid AND lambda > 0").select("group_id", "k", "props")
    rows = t.dense_depth.join(F.broadcast(side), "group_id")
    rows = rows.withColumns({"x": F.col("x").cast("double"), "mu": F.expr(likelihood.nb_mean("total * props"))})
    ll = F.expr(likelihood.nb_logpmf("x", "mu", f"{SIZE}D"))
    return rows.select("cell_id", F.col("group_id").cast("bigint").alias("group_id"), "k", r6(ll).alias("ll"))


_THETA = "(0.05 + (cell_id % 10) / 11.0)"
_PHAT = f"greatest(1e-12, least(1 - 1e-12, (baf * rdr * {_THETA} + 0.5 * (1 - {_THETA})) / greatest(rdr * {_THETA} + 1 - {_THETA}, 1e-12)))"
_MHAT = f"greatest(total * lam_g * ({_THETA} * rdr + 1 - {_THETA}), 1e-12)"


@query(_OBS + f", p AS (SELECT *, {_PHAT} AS ph, {_MHAT} AS mh FROM full_obs WHERE k >= 1) SELECT cell_id, group_id, k, round({_bb('50.0', 'ph')}, 5) + 0.0 AS ll_allele, round({_nb('30.0', 'mh')}, 5) + 0.0 AS ll_total FROM p")
def purity_loglik(t: Inputs) -> DataFrame:
    theta = 0.05 + (F.col("cell_id") % 10) / 11.0
    side = t.clone_depth.filter("k >= 1").select("group_id", "k", "baf", "rdr")
    rows = t.dense_depth.withColumn("theta", theta).join(F.broadcast(side), "group_id").withColumns({
        "n": (F.col("a") + F.col("b")).cast("double"), "b": F.col("b").cast("double"),
        "x": F.col("x").cast("double"),
        "p": F.expr(likelihood.purity_baf("baf", "rdr", "theta")),
        "mu": F.expr(likelihood.nb_mean(likelihood.purity_mean("total", "lambda", "rdr", "theta"))),
    })
    return rows.select(
        "cell_id", F.col("group_id").cast("bigint").alias("group_id"), "k",
        r6(F.expr(likelihood.bb_logpmf("b", "n", f"{TAU}D", "p")), 5).alias("ll_allele"),
        r6(F.expr(likelihood.nb_logpmf("x", "mu", f"{SIZE}D")), 5).alias("ll_total"),
    )


_LL = f"""ll AS (SELECT cell_id, k, sum(CASE WHEN imbalanced AND n > 0 THEN {_bb('50.0', 'baf')} ELSE 0 END)
     + sum(CASE WHEN aneuploid AND lam_g > 0 THEN {_nb('30.0', 'greatest(total * props, 1e-12)')} ELSE 0 END) + ln(1.0 / 3) AS ll FROM full_obs GROUP BY 1, 2),
  mx AS (SELECT cell_id, max(ll) AS m FROM ll GROUP BY 1),
  nrm AS (SELECT cell_id, m, sum(exp(ll - m)) AS z FROM ll JOIN mx USING (cell_id) GROUP BY 1, 2),
  post AS (SELECT cell_id, k, ll, exp(ll - m) / z AS p FROM ll JOIN nrm USING (cell_id)),
  called AS (SELECT cell_id, arg_max(k, (p, -k)) AS z, max(p) AS max_posterior, max(ll) AS best_ll FROM post GROUP BY 1)
"""


@query(_OBS + "," + _LL + """SELECT cell_id, round(max(CASE WHEN k = 0 THEN p END), 6) + 0.0 AS normal, round(max(CASE WHEN k = 1 THEN p END), 6) + 0.0 AS clone1,
  round(max(CASE WHEN k = 2 THEN p END), 6) + 0.0 AS clone2, round(max(p), 6) + 0.0 AS max_posterior FROM post GROUP BY cell_id""")
def posterior_fixed_params(t: Inputs) -> DataFrame:
    settings = FitSettings()
    obs, params = _fixed(t, settings)
    calls = cell_model.posteriors(obs, params, _uniform(t, params), few_bytes(params))
    return calls.select(
        "cell_id", *[r6(common.posterior_of(k)).alias(c) for k, c in enumerate(CLONES)],
        r6(F.col("max_posterior")).alias("max_posterior"),
    )


@query(_OBS + f""", mixed AS (SELECT *, {_PHAT} AS ph, {_MHAT} AS mh FROM full_obs WHERE k >= 1),
  ll AS (SELECT cell_id, k, sum(CASE WHEN imbalanced AND lam_g > 0 AND n > 0 THEN {_bb('50.0', 'ph')} ELSE 0 END)
     + sum(CASE WHEN aneuploid AND lam_g > 0 THEN {_nb('30.0', 'mh')} ELSE 0 END) + ln(0.5) AS ll FROM mixed GROUP BY 1, 2)
  SELECT cell_id, round(1 / (1 + exp(max(CASE WHEN k = 2 THEN ll END) - max(CASE WHEN k = 1 THEN ll END))), 6) + 0.0 AS clone1, round(max(ll), 5) + 0.0 AS best_ll FROM ll GROUP BY cell_id""")
def spot_posterior_fixed(t: Inputs) -> DataFrame:
    settings = FitSettings(tau_bounds=(1e-6, TAU), invphi_bounds=(1e-6, SIZE))
    obs = _observations(t)
    groups = durable(spot_model.spot_groups(obs, _profile(t), _baseline(t), settings))
    theta = obs.select("run_id", "assay", "cell_id").distinct().withColumn("theta", 0.05 + (F.col("cell_id") % 10) / 11.0)
    calls = spot_model.spot_posteriors(obs, groups, theta, _uniform(t, groups), settings)
    return calls.select("cell_id", r6(common.posterior_of(1)).alias("clone1"), r6(F.col("best_ll"), 5).alias("best_ll"))


@query(_OBS + "," + _LL + """SELECT f.clone, f.cn_a, f.cn_b, round(sum(ll), 3) + 0.0 AS ll, count(*) AS n_groups FROM (
    SELECT group_id, clone, cn_a, cn_b, sum(CASE WHEN imbalanced AND n > 0 THEN """ + _bb("50.0", "baf") + """ ELSE 0 END + CASE WHEN aneuploid AND lam_g > 0 THEN """
       + _nb("30.0", "greatest(total * props, 1e-12)") + """ ELSE 0 END) AS ll
    FROM full_obs JOIN called ON called.cell_id = full_obs.cell_id AND called.z = full_obs.k WHERE imbalanced OR aneuploid GROUP BY ALL) f GROUP BY ALL""")
def loglik_by_state(t: Inputs) -> DataFrame:
    settings = FitSettings()
    obs, params = _fixed(t, settings)
    calls = cell_model.posteriors(obs, params, _uniform(t, params), few_bytes(params))
    out = cell_model.loglik_by_state(obs, params, calls, few_bytes(params))
    return out.select("clone", "cn_a", "cn_b", r6(F.col("ll"), 3).alias("ll"), "n_groups")


@query(_OBS + "," + _LL + """SELECT round(avg(e), 6) + 0.0 AS mean_entropy, round(sum(best), 3) + 0.0 AS objective FROM (
   SELECT cell_id, -sum(p * ln(greatest(least(p, 1.0), 1e-30))) AS e, max(ll) AS best FROM post GROUP BY cell_id)""")
def assignment_entropy(t: Inputs) -> DataFrame:
    settings = FitSettings()
    obs, params = _fixed(t, settings)
    calls = cell_model.posteriors(obs, params, _uniform(t, params), few_bytes(params))
    return calls.agg(
        r6(F.avg(special.entropy(F.col("clone_post")))).alias("mean_entropy"),
        r6(F.sum("best_ll"), 3).alias("objective"),
    )


# the grid of one round: even in log scale between the default bounds
_GRID = "grid AS (SELECT i, ln(1e-6) + (ln(1e6) - ln(1e-6)) * i / 32.0 AS pt FROM range(33) r(i))"


def _assigned(t: Inputs, settings: FitSettings) -> DataFrame:
    """Count rows of the clone each cell is predicted to be."""
    obs = _observations(t)
    groups = durable(cell_model.static_groups(obs, _profile(t), settings, _baseline(t)))
    k = F.array_position(F.array(*[F.lit(c) for c in CLONES]), F.col("label")) - 1
    calls = t.cells.filter(F.col("label") != "NA").select(
        F.lit("run").alias("run_id"), "cell_id", k.cast("int").alias("z")
    )
    return cell_model.assigned_rows(obs, calls, groups, few_bytes(groups))


_ASSIGNED = """, mine AS (SELECT f.* FROM full_obs f JOIN cells c USING (cell_id) WHERE f.clone = c.label)"""
# the offset part of the log-probability is left out of the sums on both sides where it is constant
_TAU_TERM = "(CASE WHEN n > 0 THEN lgamma(b + exp(pt) * baf) + lgamma(n - b + exp(pt) * (1 - baf)) - lgamma(n + exp(pt)) + lgamma(exp(pt)) - lgamma(exp(pt) * baf) - lgamma(exp(pt) * (1 - baf)) ELSE 0 END)"
_PHI_TERM = "(lgamma(x + exp(pt)) - lgamma(exp(pt)) + exp(pt) * ln(exp(pt) / (exp(pt) + greatest(total * props, 1e-12))) + x * ln(greatest(total * props, 1e-12) / (exp(pt) + greatest(total * props, 1e-12))))"


def _grid_sql(state: str, where: str, term: str) -> str:
    return _OBS + _ASSIGNED + ", " + _GRID + (
        f" SELECT state, i, round(sum(term), 3) + 0.0 AS ll FROM (SELECT {state} AS state, CAST(i AS INTEGER) AS i, {term} AS term"
        f" FROM mine CROSS JOIN grid WHERE {where}) GROUP BY 1, 2"
    )


def _grid_query(t: Inputs, settings: FitSettings, stats, rounds) -> DataFrame:
    """The first round of the fit's own search."""
    scores = rounds(stats(_assigned(t, settings), settings), (1e-6, 1e6), 33)(None)
    return scores.select("state", "i", r6(F.col("ll"), 3).alias("ll"))


@query(_grid_sql("'*'", "imbalanced", _TAU_TERM))
def tau_grid_round(t: Inputs) -> DataFrame:
    return _grid_query(t, FitSettings(), cell_model.tau_statistics, cell_model.tau_rounds)


@query(_grid_sql("cn_a || '|' || cn_b", "true", _TAU_TERM))
def tau_grid_by_state(t: Inputs) -> DataFrame:
    settings = FitSettings(share_dispersion=False)
    return _grid_query(t, settings, cell_model.tau_statistics, cell_model.tau_rounds)


@query(_grid_sql("'*'", "aneuploid AND lam_g > 0", _PHI_TERM))
def invphi_grid_round(t: Inputs) -> DataFrame:
    return _grid_query(t, FitSettings(), cell_model.invphi_statistics, cell_model.invphi_rounds)


@query(_grid_sql("cn_a || '|' || cn_b", "lam_g > 0", _PHI_TERM))
def invphi_grid_by_state(t: Inputs) -> DataFrame:
    settings = FitSettings(share_dispersion=False)
    return _grid_query(t, settings, cell_model.invphi_statistics, cell_model.invphi_rounds)


_PHAT2 = "greatest(1e-12, least(1 - 1e-12, (baf * rdr * pt + 0.5 * (1 - pt)) / greatest(rdr * pt + 1 - pt, 1e-12)))"
_MHAT2 = "greatest(total * lam_g * (pt * rdr + 1 - pt), 1e-12)"


@query(_OBS + f""", grid AS (SELECT i, 1e-4 + (1.0 - 2e-4) * i / 32.0 AS pt FROM range(33) r(i)),
  p AS (SELECT cell_id, i, pt, x, b, n, imbalanced, aneuploid, {_PHAT2} AS ph, {_MHAT2} AS mh FROM full_obs CROSS JOIN grid
    WHERE k = 1 AND NOT subclonal AND (imbalanced OR aneuploid) AND lam_g > 0)
  SELECT cell_id, CAST(i AS INTEGER) AS i, round(sum(CASE WHEN imbalanced AND n > 0 THEN {_bb('50.0', 'ph')} ELSE 0 END + CASE WHEN aneuploid THEN {_nb('30.0', 'mh')} ELSE 0 END), 5) + 0.0 AS ll
  FROM p GROUP BY 1, 2""")
def purity_grid_round(t: Inputs) -> DataFrame:
    settings = FitSettings(tau_bounds=(1e-6, TAU), invphi_bounds=(1e-6, SIZE))
    obs = _observations(t)
    groups = durable(spot_model.spot_groups(obs, _profile(t), _baseline(t), settings))
    scores = spot_model.purity_scores(spot_model.purity_rows(obs, groups), settings)
    return scores.select("cell_id", "i", r6(F.col("ll"), 5).alias("ll"))


def _solution_sql(what: str, state: str, shared: bool) -> str:
    rows = f"""sol_rows AS (SELECT 'run' AS run, 'all' AS assay, {state} AS st, baf, b, n, x, total, props, imbalanced AS amask,
    aneuploid AS tmask, lam_g > 0 AS covered FROM mine)"""
    return f", {rows}, {fit_oracle.search('best', 'sol_rows', what, shared)} SELECT st AS state, round(ln(value), 4) + 0.0 AS log_value FROM best"


def _solution(t: Inputs, settings: FitSettings, stats, rounds) -> DataFrame:
    """The whole search of the fit for the given labels."""
    found = stats(_assigned(t, settings), settings)
    best = solver.maximise(
        rounds(found, (1e-6, 1e6), settings.grid_points), cell_model.STATE, (1e-6, 1e6), settings.grid_rounds)
    return best.select("state", r6(F.ln("value"), 4).alias("log_value"))


@query(_OBS + _ASSIGNED + _solution_sql("tau", "'*'", True))
def tau_solution(t: Inputs) -> DataFrame:
    return _solution(t, FitSettings(), cell_model.tau_statistics, cell_model.tau_rounds)


@query(_OBS + _ASSIGNED + _solution_sql("tau", "cn_a || '|' || cn_b", False))
def tau_solution_by_state(t: Inputs) -> DataFrame:
    settings = FitSettings(share_dispersion=False)
    return _solution(t, settings, cell_model.tau_statistics, cell_model.tau_rounds)


@query(_OBS + _ASSIGNED + _solution_sql("phi", "'*'", True))
def invphi_solution(t: Inputs) -> DataFrame:
    return _solution(t, FitSettings(), cell_model.invphi_statistics, cell_model.invphi_rounds)


@query(_OBS + _ASSIGNED + _solution_sql("phi", "cn_a || '|' || cn_b", False))
def invphi_solution_by_state(t: Inputs) -> DataFrame:
    settings = FitSettings(share_dispersion=False)
    return _solution(t, settings, cell_model.invphi_statistics, cell_model.invphi_rounds)


@query("SELECT g.group_id, s.k, CASE s.cn_a || '|' || s.cn_b WHEN '1|1' THEN 10.0::DOUBLE WHEN '2|0' THEN 20.0 ELSE 1000000.0 END AS tau FROM clusters g JOIN states s USING (state)")
def dispersion_states(t: Inputs) -> DataFrame:
    settings = FitSettings(share_dispersion=False)
    groups = t.clones_long.withColumns({
        "run_id": F.lit("run"), "assay": F.lit("all"), "clonal_imbalanced": F.lit(True),
    })
    table = t.spark.createDataFrame(
        [("run", "all", "1|1", 10.0, 5.0), ("run", "all", "2|0", 20.0, None)],
        "run_id string, assay string, state string, tau double, inv_phi double",
    )
    out = cell_model.with_dispersion(groups, table, settings)
    return out.select(F.col("group_id").cast("bigint").alias("group_id"), "k", "tau")


def _reference(t: Inputs) -> DataFrame:
    return t.cells.select(
        F.lit("run").alias("run_id"), "cell_id", labels.is_normal(F.col("cell_type")).alias("is_reference")
    )


def _two_assays(t: Inputs) -> DataFrame:
    """Dense counts of both modalities, for cells that occur in both."""
    from cellmosaic.operators import grouping

    sums = grouping.sum_counts(t.lines, t.cluster_bins, ["assay", "cell_id"], bound=t.bins)
    present = sums.select("assay", "cell_id").distinct()
    both = present.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("cell_id")
    cells = both.withColumn("assay", F.explode(F.array(F.lit("gex"), F.lit("atac"))))
    kept = sums.join(both, "cell_id", "left_semi")
    return grouping.densify(kept, cells, t.clusters, assay=True).withColumn("run_id", F.lit("run"))


def _calls(fit: common.Fit) -> DataFrame:
    return common.wide_annotations(fit, CLONES).select("cell_id", *[r6(F.col(c), 4).alias(c) for c in CLONES], "label")


def _rounded() -> str:
    posts = ", ".join(f"round(max(CASE WHEN k = {k} THEN p END), 4) + 0.0 AS {c}" for k, c in enumerate(CLONES))
    return f"SELECT cell_id, {posts} FROM fit_post GROUP BY cell_id"


_NAME = "CASE z WHEN 0 THEN 'normal' ELSE 'clone' || z END AS label"
# dense counts of both modalities for cells that occur in both, and the diploid baseline per modality
_TWO = """
assay_sums AS (
  SELECT p.assay, p.cell_id, i.group_id, sum(p.x) AS x, sum(p.a) AS a, sum(p.b) AS b FROM phased p JOIN state_ids i USING (state) GROUP BY 1, 2, 3),
both_assays AS (SELECT cell_id FROM assay_sums GROUP BY cell_id HAVING count(DISTINCT assay) = 2),
assay_dense AS (
  SELECT s.assay, c.cell_id, g.group_id, coalesce(m.x, 0) AS x, coalesce(m.a, 0) AS a, coalesce(m.b, 0) AS b
  FROM both_assays c CROSS JOIN clusters g CROSS JOIN (VALUES ('gex'), ('atac')) s(assay) LEFT JOIN assay_sums m USING (assay, cell_id, group_id)),
"""


def _fit_tables(run: str = "'run'", dense: str = "dense", assay: str = "'gex'", reference: str = "t.ref_normal", name: str = "fit") -> str:
    """Observations, baseline and clones of a fit over dense counts, with a diploid baseline."""
    return f"""
{name}_obs AS (
  SELECT {run} AS run, {assay} AS assay, d.group_id, d.cell_id, d.x::DOUBLE AS x, d.b::DOUBLE AS b, (d.a + d.b)::DOUBLE AS n,
         (sum(d.x) OVER (PARTITION BY d.cell_id, {assay}))::DOUBLE AS total
  FROM {dense} d JOIN cells c USING (cell_id)),
{name}_ref AS (
  SELECT o.run, o.assay, o.group_id, sum(CASE WHEN {reference} THEN o.x ELSE 0 END) AS x_ref
  FROM {name}_obs o JOIN typed t USING (cell_id) GROUP BY ALL),
{name}_depth AS (SELECT run, assay, group_id, x_ref / sum(x_ref) OVER (PARTITION BY run, assay) AS lam FROM {name}_ref),
{name}_clones AS (
  SELECT r.run, c.group_id, c.k, c.cn_a, c.cn_b, c.imbalanced, c.aneuploid, c.subclonal
  FROM clones c CROSS JOIN (SELECT DISTINCT run FROM {name}_obs) r)"""


_STATE = "c.cn_a || '|' || c.cn_b"


@query(_TWO + _fit_tables(dense="assay_dense", assay="d.assay") + "," + fit_oracle.params("fit", "'*'") + "," + fit_oracle.em("fit")
       + f", w AS ({_rounded()}) SELECT w.*, {_NAME} FROM w JOIN fit USING (cell_id)")
def cell_model_fit(t: Inputs) -> DataFrame:
    return _calls(cell_model.fit_cells(_two_assays(t), _profile(t), FitSettings(), _reference(t)))


@query(_TWO + _fit_tables(dense="assay_dense", assay="d.assay") + "," + fit_oracle.params("fit", _STATE)
       + "," + fit_oracle.em("fit", shared=False, update_pi=True) + f", w AS ({_rounded()}) SELECT w.*, {_NAME} FROM w JOIN fit USING (cell_id)")
def cell_model_fit_by_state(t: Inputs) -> DataFrame:
    settings = FitSettings(share_dispersion=False, update_pi=True)
    return _calls(cell_model.fit_cells(_two_assays(t), _profile(t), settings, _reference(t)))


_ALLELE = {"use_total": "false"}
# the allele-only fit of normal and clone1 on groups that are imbalanced and not subclonal
_TWO_CLONES = fit_oracle.params("fit", "'*'", k="c.k <= 1", allele="c.imbalanced AND NOT c.subclonal", **_ALLELE)


@query(_fit_tables(assay="'all'") + "," + _TWO_CLONES + "," + fit_oracle.em("fit", total=False)
       + ", w AS (SELECT cell_id, 1.0 - max(CASE WHEN k = 0 THEN p END) AS post FROM fit_post GROUP BY cell_id)"
       " SELECT cell_id, post < 0.5 AS is_reference, round(post, 4) + 0.0 AS tumor_post FROM w")
def reference_cells(t: Inputs) -> DataFrame:
    settings = FitSettings(ref_post_cutoff=0.5)
    cells, _ = cell_model.estimate_reference(_observations(t), _profile(t), settings)
    return cells.select("cell_id", "is_reference", r6(F.col("tumor_post"), 4).alias("tumor_post"))


# all tumour clones on all imbalanced groups name the most assigned clone, whose copies are divided out of the baseline
_NO_NORMAL = (
    _fit_tables(name="sub") + "," + fit_oracle.params("sub", "'*'", k="c.k >= 1", **_ALLELE) + "," + fit_oracle.em("sub", total=False)
    + """,
major AS (SELECT run, arg_max(z, (c, -z)) AS z FROM (SELECT run, z, count(*) AS c FROM sub GROUP BY ALL) GROUP BY run),
fit_obs AS (SELECT * FROM sub_obs), fit_clones AS (SELECT * FROM sub_clones),
base AS (
  SELECT o.run, o.assay, o.group_id, sum(CASE WHEN s.z = m.z THEN o.x ELSE 0 END) / any_value(greatest((c.cn_a + c.cn_b) / 2.0, 1e-12)) AS v
  FROM sub_obs o JOIN sub s USING (run, cell_id) JOIN major m USING (run) JOIN sub_clones c ON c.group_id = o.group_id AND c.k = m.z GROUP BY ALL),
fit_depth AS (
  SELECT run, assay, group_id, CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1.0 / count(*) OVER w END AS lam
  FROM base WINDOW w AS (PARTITION BY run, assay)),"""
    + fit_oracle.params("fit", "'*'", k="c.k >= 1") + "," + fit_oracle.em("fit")
)


@query(_NO_NORMAL + f" SELECT cell_id, {_NAME}, round(max_posterior, 4) + 0.0 AS max_posterior FROM fit")
def no_normal_fit(t: Inputs) -> DataFrame:
    counts = t.dense.withColumns({"run_id": F.lit("run"), "assay": F.lit("gex")})
    fit = cell_model.fit_cells(counts, _profile(t), FitSettings(no_normal=True))
    return fit.annotations.select("cell_id", "label", r6(F.col("max_posterior"), 4).alias("max_posterior"))


_MIXED_BAF = "greatest(1e-12, least(1 - 1e-12, (baf * rdr * {v} + 0.5 * (1 - {v})) / greatest(rdr * {v} + 1 - {v}, 1e-12)))"
_MIXED_MEAN = "greatest(total * lam * ({v} * rdr + 1 - {v}), 1e-12)"


def _mixed_term(value: str) -> str:
    allele = fit_oracle.bb("50.0", _MIXED_BAF.format(v=value))
    total = fit_oracle.nb("30.0", _MIXED_MEAN.format(v=value))
    return f"CASE WHEN use_allele AND n > 0 THEN {allele} ELSE 0 END + CASE WHEN use_total THEN {total} ELSE 0 END"


# purity per spot on clone1's columns of groups that are not subclonal, then the posterior of the tumour clones
_SPOTS = (
    _fit_tables() + "," + fit_oracle.params("fit", "'*'", baf_clip="0.1", k="c.k >= 1", use_allele="coalesce(d.lam > 0, false)")
    + """,
informative AS (
  SELECT o.*, f.baf, f.rdr, f.lam, f.use_allele, f.use_total FROM fit_obs o JOIN fit_par f USING (run, assay, group_id)
  WHERE f.k = 1 AND NOT f.subclonal AND (f.use_allele OR f.use_total)),"""
    + fit_oracle.rounds("purity", "informative", "run, assay, cell_id", _mixed_term("v"), "1e-4", "(1 - 1e-4)", 33, 3, False)
    + f""",
theta AS (SELECT s.run, s.assay, s.cell_id, coalesce(p.value, 0.5) AS theta FROM (SELECT DISTINCT run, assay, cell_id FROM fit_obs) s
  LEFT JOIN purity p USING (run, assay, cell_id)),
fit_ll AS (
  SELECT run, cell_id, k, sum({_mixed_term('theta')}) + ln(0.5) AS ll
  FROM fit_obs JOIN theta USING (run, assay, cell_id) JOIN fit_par USING (run, assay, group_id) GROUP BY run, cell_id, k),"""
    + fit_oracle.posteriors("fit", "fit_ll")
)
_SPOT_SETTINGS = FitSettings(baf_clip=0.1, tau_bounds=(1e-6, TAU), invphi_bounds=(1e-6, SIZE))


@query(_SPOTS + " SELECT cell_id, round(theta, 3) + 0.0 AS purity FROM theta")
def purity_solution(t: Inputs) -> DataFrame:
    counts = t.dense.withColumns({"run_id": F.lit("run"), "assay": F.lit("gex")})
    obs = common.prepare_observations(counts)
    lam = t.baseline.select(F.lit("run").alias("run_id"), F.lit("gex").alias("assay"), "group_id", "lambda")
    groups = durable(spot_model.spot_groups(obs, _profile(t), lam, _SPOT_SETTINGS))
    found = spot_model.estimate_purity(obs, groups, _SPOT_SETTINGS)
    return found.select("cell_id", r6(F.col("theta"), 3).alias("purity"))


@query(_SPOTS + f" SELECT cell_id, {_NAME}, round(max_posterior, 4) + 0.0 AS max_posterior, round(theta, 3) + 0.0 AS tumor_purity FROM fit JOIN theta USING (run, cell_id)")
def spot_model_fit(t: Inputs) -> DataFrame:
    counts = t.dense.withColumns({"run_id": F.lit("run"), "assay": F.lit("gex")})
    fit = spot_model.fit_spots(counts, _profile(t), _SPOT_SETTINGS, _reference(t))
    return fit.annotations.select(
        "cell_id", "label", r6(F.col("max_posterior"), 4).alias("max_posterior"),
        r6(F.col("tumor_purity"), 3).alias("tumor_purity"),
    )


@query(_fit_tables() + "," + fit_oracle.params("fit", "'*'", **_ALLELE) + "," + fit_oracle.em("fit", total=False) + """,
  called AS (SELECT CASE z WHEN 0 THEN 'normal' ELSE 'clone' || z END AS label FROM fit)
  SELECT v.label AS clone, count(c.label) AS n, count(c.label) / (SELECT count(*) FROM called)::DOUBLE AS fraction
  FROM (VALUES ('normal'), ('clone1'), ('clone2')) v(label) LEFT JOIN called c ON c.label = v.label GROUP BY v.label""")
def fitted_fractions(t: Inputs) -> DataFrame:
    counts = t.dense.withColumns({"run_id": F.lit("run"), "assay": F.lit("gex")})
    fit = cell_model.fit_cells(counts, _profile(t), FitSettings(fit_mode="allele"))
    return metrics.clone_fractions(fit.annotations, "label", CLONES)


def _by_replicate(t: Inputs, df: DataFrame) -> DataFrame:
    """Every replicate is a run of its own."""
    runs = t.cells.select("cell_id", F.col("rep_id").alias("run_id"))
    return join_dim(df.drop("run_id"), runs, ["cell_id"], ["cell_id"], bound=t.raw("customer"))


def _replicate_profiles(t: Inputs) -> DataFrame:
    return t.clusters.crossJoin(F.broadcast(t.cells.select(F.col("rep_id").alias("run_id")).distinct()))


@query(_fit_tables(run="c.rep_id") + "," + fit_oracle.params("fit", _STATE) + "," + fit_oracle.em("fit", shared=False)
       + f", w AS ({_rounded()}) SELECT fit.run AS run_id, w.*, {_NAME} FROM w JOIN fit USING (cell_id)")
def panel_fit(t: Inputs) -> DataFrame:
    """All runs of a panel in one fit; each settles on its own."""
    counts = _by_replicate(t, t.dense).withColumn("assay", F.lit("gex"))
    settings = FitSettings(share_dispersion=False)
    fit = cell_model.fit_cells(counts, _replicate_profiles(t), settings, _by_replicate(t, _reference(t)))
    posts = [r6(F.col(c), 4).alias(c) for c in CLONES]
    return common.wide_annotations(fit, CLONES).select("run_id", "cell_id", *posts, "label")


@query(_fit_tables(run="c.rep_id") + "," + fit_oracle.params("fit", "'*'") + "," + fit_oracle.em("fit") + """,
  named AS (
    SELECT run, unnest(tau, recursive := true), 'tau' AS name FROM fit_fit
    UNION ALL SELECT run, unnest(phi, recursive := true), 'inv_phi' FROM fit_fit),
  objective AS (SELECT run, sum(best_ll) AS v FROM fit GROUP BY run)
  SELECT run AS run_id, name, st AS state, NULL::BIGINT AS group_id, round(ln(v), 3) + 0.0 AS value FROM named
  UNION ALL SELECT DISTINCT run, 'lambda', NULL, group_id, round(lam, 6) + 0.0 FROM fit_depth
  UNION ALL SELECT run, 'log_likelihood', NULL, NULL, round(v, 2) + 0.0 FROM objective""")
def panel_parameters(t: Inputs) -> DataFrame:
    """The parameter table of a panel, saved and read back."""
    counts = _by_replicate(t, t.dense).withColumn("assay", F.lit("gex"))
    fit = cell_model.fit_cells(counts, _replicate_profiles(t), FitSettings(), _by_replicate(t, _reference(t)))
    path = work_folder(t.spark, "parameters")
    sinks.write_table(fit.params, path, ["name"])
    kept = sinks.read_parameters(t.spark, path).filter("name <> 'pi'")
    log = F.round(F.ln("value"), 3) + 0.0
    shown = F.when(F.col("name").isin("tau", "inv_phi"), log).when(F.col("name") == "lambda", r6(F.col("value"))).otherwise(r6(F.col("value"), 2))
    return kept.select("run_id", "name", "state", "group_id", shown.alias("value"))


@query(_fit_tables() + "," + fit_oracle.params("fit", _STATE) + "," + fit_oracle.em("fit", shared=False, update_pi=True)
       + f", w AS ({_rounded()}) SELECT w.*, {_NAME} FROM w JOIN fit USING (cell_id)")
def scored_from_saved(t: Inputs) -> DataFrame:
    """Cells scored under parameters that were saved and read back."""
    counts = t.dense.withColumns({"run_id": F.lit("run"), "assay": F.lit("gex")})
    settings = FitSettings(share_dispersion=False, update_pi=True)
    fit = cell_model.fit_cells(counts, _profile(t), settings, _reference(t))
    path = work_folder(t.spark, "parameters")
    sinks.write_table(fit.params, path, ["name"])
    calls = cell_model.score_cells(counts, _profile(t), sinks.read_parameters(t.spark, path), settings)
    return calls.select("cell_id", *[r6(common.posterior_of(k), 4).alias(c) for k, c in enumerate(CLONES)], "label")


@query(_fit_tables() + "," + fit_oracle.params("fit", "'*'") + "," + fit_oracle.em("fit", niters=4) + """,
  steps AS (SELECT run, t + 1 AS iter, run || '#' || t AS tagged, tau, phi, pi FROM fit_em
    WHERE t < (SELECT max(t) FROM fit_em)),
  tr_fit AS (SELECT tagged AS run, tau, phi, pi FROM steps),
  tr_par AS (SELECT p.* REPLACE (s.tagged AS run) FROM fit_par p JOIN steps s USING (run)),
  tr_obs AS (SELECT o.* REPLACE (s.tagged AS run) FROM fit_obs o JOIN steps s USING (run)),"""
       + fit_oracle.e_step("tr") + """,
  calls AS (
    SELECT s.iter, c.cell_id, c.z = 0 AS called, NOT t.ref_tumor AS truth, t.ref_tumor AS y, round(1.0 - p.p, 6) AS score
    FROM tr c JOIN steps s ON s.tagged = c.run JOIN typed t USING (cell_id)
    JOIN tr_post p ON p.run = c.run AND p.cell_id = c.cell_id AND p.k = 0 WHERE NOT t.ref_na),
  counted AS (
    SELECT iter, count(*) FILTER (called AND truth) AS tp, count(*) FILTER (called AND NOT truth) AS fp,
           count(*) FILTER (NOT called AND truth) AS fn, count(*) FILTER (NOT called AND NOT truth) AS tn FROM calls GROUP BY iter),
  ranks AS (
    SELECT iter, y, rank() OVER (PARTITION BY iter ORDER BY score) + (count(*) OVER (PARTITION BY iter, score) - 1) / 2.0 AS r FROM calls),
  area AS (
    SELECT iter, (sum(CASE WHEN y THEN r END) - count(CASE WHEN y THEN 1 END) * (count(CASE WHEN y THEN 1 END) + 1) / 2.0)
      / (count(CASE WHEN y THEN 1 END) * count(CASE WHEN NOT y THEN 1 END)) AS auc FROM ranks GROUP BY iter)
  SELECT iter::INTEGER AS iter, tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6) + 0.0 AS precision, round(tp / greatest(tp + fn, 1), 6) + 0.0 AS recall,
         round(auc, 6) + 0.0 AS auc FROM counted JOIN area USING (iter)""")
def trace_metrics(t: Inputs) -> DataFrame:
    """Quality of the normal set and ranking of the tumour posterior after each iteration of a fit."""
    counts = t.dense.withColumns({"run_id": F.lit("run"), "assay": F.lit("gex")})
    path = work_folder(t.spark, "trace")
    cell_model.fit_cells(
        counts, _profile(t), FitSettings(niters=4), _reference(t), observer=sinks.labeling_observer(path))
    trace = t.spark.read.parquet(path)
    kinds = t.cells.select("cell_id", "cell_type")
    known = join_dim(trace, kinds, ["cell_id"], ["cell_id"], bound=t.raw("customer")).withColumns({
        "is_normal": F.col("label") == labels.NORMAL, "score": F.round("tumor_post", 6)})
    truth = F.when(~labels.is_na(F.col("cell_type")), labels.is_tumor(F.col("cell_type")))
    area = metrics.auc(known.withColumn("truth", truth), "truth", "score", ["iter"])
    rates = metrics.init_normal(known, "is_normal", "cell_type", ["iter"])
    return rates.join(area, "iter").select(
        "iter", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "auc")])
