"""Hard-EM clone typing of single cells.

A driver loop over cached counts. What changes between iterations are a few
parameters per run and modality; they are small tables keyed by run, and each iteration's
plan is ``cached counts x parameters`` with no chain from earlier iterations. All
runs of a panel are fitted at once: ``run_id`` is part of every key. A run that has
settled leaves both steps; the driver sees no more than the number of runs left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import likelihood
from cellmosaic.models import solver
from cellmosaic.models.common import (
    CELL,
    GROUP,
    RUN,
    Fit,
    FitSettings,
    cell_posteriors,
    clone_sets,
    em_clones,
    mixture_table,
    parameter_rows,
    posterior_of,
    prepare_observations,
)
from cellmosaic.operators import depth
from cellmosaic.operators.joins import few_bytes, is_small, join_dim
from cellmosaic.session import durable

ASSAY = ["run_id", "assay"]
STATE = [*ASSAY, "state"]
DISPERSION = "run_id string, assay string, state string, tau double, inv_phi double"
Observer = Callable[[int, DataFrame], None]


def static_groups(
    obs: DataFrame, profile: DataFrame, settings: FitSettings, baseline: DataFrame | None,
    drop_normal: bool = False,
) -> DataFrame:
    """Group parameters that stay fixed: copy numbers, BAF, depth shares, masks.

    One row per (run, assay, group, clone). Depth shares are normalised over all
    groups before the masks are applied.
    """
    long = em_clones(profile, settings, drop_normal)
    assays = obs.select(*ASSAY).distinct()
    table = assays.join(long, RUN)
    if baseline is not None:
        table = depth.clone_depth(table, baseline, ASSAY)
        covered = F.col("lambda") > 0
    else:
        table = table.withColumns({
            "lambda": F.lit(None).cast("double"), "rdr": F.lit(None).cast("double"),
            "props": F.lit(None).cast("double"),
        })
        covered = F.lit(False)
    covered = F.coalesce(covered, F.lit(False))
    allele = F.col(settings.allele_mask) if settings.uses_allele else F.lit(False)
    total = F.col(settings.total_mask) & covered if settings.uses_total else F.lit(False)
    return with_scored(table.withColumns({"use_allele": allele, "use_total": total, "covered": covered}))


def with_scored(groups: DataFrame) -> DataFrame:
    """Add ``scored``: the groups that the E-step needs to read.

    Groups that neither likelihood uses are left out, unless a run has no others: its cells still
    get the scores of the mixture.
    """
    uses = F.col("use_allele") | F.col("use_total")
    return groups.withColumn("scored", uses | ~F.bool_or(uses).over(Window.partitionBy(*RUN)))


def check_informative(groups: DataFrame, settings: FitSettings) -> None:
    """Fail for runs without any informative group for the fit mode."""
    per_run = groups.groupBy(*RUN).agg(
        F.bool_or(F.col(settings.allele_mask)).alias("a"), F.bool_or(F.col(settings.total_mask)).alias("t")
    )
    good = {"allele": F.col("a"), "total": F.col("t")}.get(settings.fit_mode, F.col("a") | F.col("t"))
    bad = per_run.filter(~good).select("run_id").take(5)
    if bad:
        names = ", ".join(str(r.run_id) for r in bad)
        raise ValueError(f"no informative groups for fit mode {settings.fit_mode}: {names}")


def with_dispersion(groups: DataFrame, dispersion: DataFrame, settings: FitSettings) -> DataFrame:
    """Add tau, inv_phi and the parameter-only parts of the likelihoods.

    ``dispersion``: ``(run_id, assay, state, tau, inv_phi)``, with state ``*`` for a
    shared value; a state without a value takes the upper bound.
    """
    keyed = groups.withColumn("state", _state(settings))
    joined = keyed.join(dispersion, [*ASSAY, "state"], "left")
    tau = F.coalesce("tau", F.lit(settings.tau_bounds[1]))
    size = F.coalesce("inv_phi", F.lit(settings.invphi_bounds[1]))
    filled = joined.withColumns({"tau": tau, "inv_phi": size})
    return filled.withColumns({
        "bb_offset": F.expr(likelihood.bb_offset("tau", "baf")),
        "nb_offset": F.expr(likelihood.nb_offset("inv_phi")),
    })


def likelihood_rows(rows: DataFrame) -> DataFrame:
    """Count rows joined with their parameters: add the columns of :data:`likelihood.ROW`."""
    return rows.withColumns({
        "p": F.col("baf"), "at_allele": F.col("bb_const") + F.col("bb_offset"),
        "mu": F.expr(likelihood.nb_mean("total * props")), "size": F.col("inv_phi"),
        "at_total": F.col("nb_const") + F.col("nb_offset"),
    })


def attach_groups(obs: DataFrame, params: DataFrame, on: list[str], small: bool | None = None) -> DataFrame:
    """Join counts with a group table; broadcast if it is ``small``.

    A broadcast keeps the counts partitioned by cell. Without a verdict the size
    estimate decides.
    """
    fits = is_small(params) if small is None else small
    return obs.join(F.broadcast(params) if fits else params, on)


def posteriors(obs: DataFrame, params: DataFrame, mixture: DataFrame, small: bool | None = None) -> DataFrame:
    """E-step. The score of a cell and clone is the likelihood over informative groups plus log pi."""
    wanted = [
        *GROUP, "k", "baf", "props", "tau", "inv_phi", "bb_offset", "nb_offset",
        "use_allele", "use_total", "log_pi",
    ]
    tagged = params.filter("scored").join(mixture, [*RUN, "k"])
    return cell_posteriors(likelihood_rows(attach_groups(obs, tagged.select(*wanted), GROUP, small)), True)


def assigned_rows(obs: DataFrame, calls: DataFrame, groups: DataFrame, small: bool | None = None) -> DataFrame:
    """Count rows with the parameters of the clone each cell is assigned to."""
    mine = obs.join(calls.select(*CELL, F.col("z").alias("k")), CELL)
    return attach_groups(mine, groups, [*GROUP, "k"], small)


def _state(settings: FitSettings) -> Column:
    return F.lit("*") if settings.share_dispersion else F.concat_ws("|", "cn_a", "cn_b")


def _allele_rows(settings: FitSettings) -> Column:
    return F.col(settings.allele_mask) if settings.share_dispersion else F.lit(True)


def _depth_rows(settings: FitSettings) -> Column:
    return F.col("covered") & F.col(settings.total_mask) if settings.share_dispersion else F.col("covered")


def tau_statistics(rows: DataFrame, settings: FitSettings) -> DataFrame:
    """Allele pairs of the assigned clone, counted: ``(run, assay, state, p, b, n, cnt)``.

    Shared dispersion pools the imbalanced groups; per-state dispersion pools every
    group of the state.
    """
    return rows.filter(_allele_rows(settings)).groupBy(*ASSAY, _state(settings).alias("state"), F.col("baf").alias("p"), "b", "n").agg(
        F.count(F.lit(1)).cast("double").alias("cnt")
    )


def invphi_statistics(rows: DataFrame, settings: FitSettings) -> DataFrame:
    """Depth and its mean for the assigned clone: ``(run, assay, state, x, mu, log_mu)``."""
    staged = rows.filter(_depth_rows(settings)).withColumn("mu", F.expr(likelihood.nb_mean("total * props")))
    return staged.select(*ASSAY, _state(settings).alias("state"), "x", "mu", F.ln("mu").alias("log_mu"))


def _allele_terms(cnt: Column) -> Column:
    """The log-gammas of ``cnt`` allele pairs, each by a count alone instead of by the pair."""
    def term(u: Column, w: Column, n: Column) -> Column:
        return F.struct(F.lit("tau").alias("what"), u.alias("u"), w.alias("w"), n.alias("cnt"))

    b, n, p = F.col("b"), F.col("n"), F.col("p")
    return F.array(term(b, p, cnt), term(n - b, 1.0 - p, cnt), term(n, F.lit(1.0), -cnt))


def _depth_term() -> dict[str, Column]:
    return {"what": F.lit("inv_phi"), "u": F.col("x"), "w": F.lit(1.0), "cnt": F.lit(1.0)}


def _gamma_parts(terms: DataFrame) -> DataFrame:
    """Rows ``gamma`` of a search (:data:`likelihood.PARTS`): equal terms of a state are counted before the search."""
    counted = terms.groupBy(*STATE, "what", "u", "w").agg(F.sum("cnt").alias("cnt"))
    return counted.select(*STATE, "what", F.lit("gamma").alias("kind"), "u", F.lit(0.0).alias("v"), "w", "cnt")


def _listed(rows: DataFrame, terms: Column) -> DataFrame:
    return rows.select(*STATE, F.explode(terms).alias("_t")).select(*STATE, "_t.*")


def tau_parts(stats: DataFrame) -> DataFrame:
    return _gamma_parts(_listed(stats, _allele_terms(F.col("cnt"))))


def depth_parts(stats: DataFrame) -> DataFrame:
    """The log-gamma part of the depth, which needs how often each depth occurs."""
    return _gamma_parts(stats.select(*STATE, *[c.alias(name) for name, c in _depth_term().items()]))


def mean_parts(stats: DataFrame) -> DataFrame:
    what, kind, cnt = F.lit("inv_phi").alias("what"), F.lit("mean").alias("kind"), F.lit(1.0).alias("cnt")
    return stats.select(*STATE, what, kind, F.col("x").alias("u"), F.col("mu").alias("v"), F.col("log_mu").alias("w"), cnt)


def search_rounds(rows: DataFrame, keys: list[str], bounds: solver.Bounds, points: int, small: bool | None = None) -> solver.Round:
    def attach(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(side), keys) if small else join_dim(rows, side, keys, ["u", "v"])

    return solver.row_round(rows, keys, bounds, points, attach)


def tau_rounds(stats: DataFrame, bounds: tuple[float, float], points: int) -> solver.Round:
    return search_rounds(tau_parts(stats), STATE, bounds, points)


def invphi_rounds(
    stats: DataFrame, bounds: tuple[float, float], points: int, small: bool | None = None
) -> solver.Round:
    return search_rounds(depth_parts(stats).unionByName(mean_parts(stats)), STATE, bounds, points, small)


def m_step(
    obs: DataFrame, calls: DataFrame, groups: DataFrame, settings: FitSettings, previous: DataFrame,
    small: bool | None = None,
) -> DataFrame:
    """Dispersions ``(run_id, assay, state, tau, inv_phi)`` of the assigned clones.

    Both are searched in the same rounds, with ``what`` as a key. A parameter that is not updated keeps
    its value.
    """
    rows = assigned_rows(obs, calls, groups, small)
    allele, depths = settings.uses_allele and settings.update_tau, settings.uses_total and settings.update_invphi
    bounds: dict[str, tuple[float, float]] = {}
    parts, cached, terms = [], [], []

    def kept(df: DataFrame) -> DataFrame:
        cached.append(df.persist())
        return df

    if allele or depths:
        rows = kept(rows.select(
            *ASSAY, _state(settings).alias("state"), F.col("baf").alias("p"), "b", "n", "x",
            F.expr(likelihood.nb_mean("total * props")).alias("mu"),
            _allele_rows(settings).alias("_allele"), _depth_rows(settings).alias("_depth")))
    none = F.array().cast("array<struct<what:string,u:double,w:double,cnt:double>>")
    if allele:
        bounds["tau"] = settings.tau_bounds
        terms.append(F.when(F.col("_allele"), _allele_terms(F.lit(1.0))).otherwise(none))
    if depths:
        bounds["inv_phi"] = settings.invphi_bounds
        depth_term = F.struct(*[c.alias(name) for name, c in _depth_term().items()])
        terms.append(F.when(F.col("_depth"), F.array(depth_term)).otherwise(none))
        parts.append(mean_parts(rows.filter("_depth").withColumn("log_mu", F.ln("mu"))))
    if terms:
        parts.append(kept(_gamma_parts(_listed(rows, F.concat(*terms)))))
    found = {c: previous.select(*STATE, c).filter(F.col(c).isNotNull()) for c in ("tau", "inv_phi")}
    if parts:
        keys = [*STATE, "what"]
        rounds = search_rounds(_union(parts), keys, bounds, settings.grid_points, small)
        best = solver.maximise(rounds, keys, bounds, settings.grid_rounds)
        found |= {c: best.filter(F.col("what") == c).select(*STATE, F.col("value").alias(c)) for c in bounds}
    for df in cached:
        df.unpersist()
    return found["tau"].join(found["inv_phi"], STATE, "full")


def mixture_weights(calls: DataFrame, clones: DataFrame) -> DataFrame:
    """Share of cells per clone ``(run_id, k, pi)`` of the runs that have cells."""
    sizes = calls.groupBy(*RUN, F.col("z").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*RUN))
    shares = clones.join(sizes, [*RUN, "k"], "left").withColumn("_total", total).filter("_total > 0")
    return shares.select(*RUN, "k", (F.coalesce("n", F.lit(0)) / F.col("_total")).alias("pi"))


def estimate_reference(obs: DataFrame, profile: DataFrame, settings: FitSettings) -> tuple[DataFrame, DataFrame]:
    """Reference cells and reference clone from an allele-only fit.

    With normal cells: clones normal and clone1 on clonal imbalanced groups, and the
    confident normal cells are the reference. Without: all tumour clones on all
    imbalanced groups, and the most assigned clone is the reference.
    Returns ``(run_id, cell_id, is_reference, tumor_post, label, max_posterior)`` and
    ``(run_id, ref_k)``.
    """
    if settings.no_normal:
        sub = settings.with_(fit_mode="allele", allele_mask="imbalanced")
        fit = _fit_loop(obs, profile, sub, None)
        ranked = fit.annotations.groupBy(*RUN, "z").agg(F.count(F.lit(1)).alias("n"))
        major = ranked.groupBy(*RUN).agg(F.max_by("z", F.struct(F.col("n"), -F.col("z"))).alias("ref_k"))
        major = durable(major)
        joined = join_dim(fit.annotations, major, RUN, ["cell_id"])
        cells = joined.select(
            *CELL, (F.col("z") == F.col("ref_k")).alias("is_reference"),
            F.lit(None).cast("double").alias("tumor_post"), "label", "max_posterior",
        )
        return durable(cells), major
    two = {c: F.slice(c, 1, 2) for c in ("cn_a", "cn_b")}
    sub = settings.with_(fit_mode="allele", allele_mask="clonal_imbalanced")
    fit = _fit_loop(obs, profile.withColumns(two), sub, None)
    post = 1.0 - posterior_of(0)
    cells = durable(fit.annotations.select(
        *CELL, (post < settings.ref_post_cutoff).alias("is_reference"), post.alias("tumor_post"),
        "label", "max_posterior",
    ))
    empty = cells.groupBy(*RUN).agg(F.bool_or("is_reference").alias("_any")).filter(~F.col("_any")).take(5)
    if empty:
        raise ValueError("no reference cells in runs " + ", ".join(str(r.run_id) for r in empty))
    return cells, cells.select(*RUN).distinct().withColumn("ref_k", F.lit(0))


def baseline(obs: DataFrame, profile: DataFrame, reference: DataFrame, ref_clone: DataFrame, settings: FitSettings) -> DataFrame:
    """lambda per (run, assay, group) from the reference cells."""
    flags = reference.select(*CELL, "is_reference")
    counts = join_dim(obs.select(*GROUP, "cell_id", "x"), flags, CELL, ["group_id"])
    if not settings.no_normal:
        return durable(depth.baseline_diploid(counts, "is_reference", ASSAY))
    at = F.col("ref_k") + 1
    copies = profile.join(ref_clone, RUN).select(
        *RUN, "group_id", (F.element_at("cn_a", at) + F.element_at("cn_b", at)).alias("cn_ref")
    )
    per_assay = obs.select(*ASSAY).distinct().join(copies, RUN)
    return durable(depth.baseline_corrected(counts, per_assay, "is_reference", ASSAY))


def _merged(old: DataFrame, new: DataFrame, active: DataFrame | None) -> DataFrame:
    """New values for the active runs, old ones for the runs that have settled."""
    if active is None:
        return durable(new)
    return durable(new.unionByName(old.join(active, RUN, "left_anti").select(new.columns)))


def _of_runs(df: DataFrame, runs: DataFrame | None, small: bool) -> DataFrame:
    if runs is None:
        return df
    return df.join(F.broadcast(runs) if small else runs, RUN, "left_semi")


def _fit_loop(
    obs: DataFrame, profile: DataFrame, settings: FitSettings, lam: DataFrame | None,
    observer: Observer | None = None,
) -> Fit:
    spark = obs.sparkSession
    groups = durable(static_groups(obs, profile, settings, lam))
    check_informative(groups, settings)
    small = few_bytes(groups)  # proves the keyed tables small too, they have no more rows
    clones = durable(clone_sets(groups))
    dispersion = spark.createDataFrame([], DISPERSION)
    weights: DataFrame | None = None
    active: DataFrame | None = None  # all runs
    finished: list[DataFrame] = []
    trace: list[DataFrame] = []

    def e_step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        table = with_dispersion(groups, dispersion, settings)
        calls = posteriors(rows, table, mixture_table(clones, weights), small).persist()
        return calls, durable(calls.groupBy(*RUN).agg(F.sum("best_ll").alias("ll")))

    calls, score = e_step(obs)
    cached, last = calls, None
    for t in range(1, settings.niters):
        if observer:
            observer(t, calls)
        live = _of_runs(obs, active, small)
        if settings.update_pi:
            shares = mixture_weights(calls, clones)
            weights = _merged(shares if weights is None else weights, shares, None if weights is None else active)
        dispersion = _merged(dispersion, m_step(live, calls, groups, settings, dispersion, small), active)
        calls, score = e_step(live)
        cached.unpersist()
        cached = calls
        trace.append(score.select(F.lit(t).alias("iter"), *RUN, "ll"))
        if last is not None:
            moved = F.abs(F.col("ll") - F.col("_before")) / (F.abs(F.col("_before")) + 1e-10)
            tagged = durable(score.join(last.withColumnRenamed("ll", "_before"), RUN).select(
                *RUN, "ll", (moved < settings.tol).alias("settled")))
            left = tagged.filter("NOT settled")
            if left.isEmpty():
                break
            if not tagged.filter("settled").isEmpty():
                finished.append(durable(_of_runs(calls, tagged.filter("settled").select(*RUN), small)))
                active = left.select(*RUN)
                calls = _of_runs(calls, active, small)
                score = left.select(*RUN, "ll")
        last = score
    finished.append(durable(calls))
    cached.unpersist()
    annotations = _union(finished)
    history = _union(trace) if trace else score.select(F.lit(0).alias("iter"), *RUN, "ll")
    return Fit(annotations, parameters(groups, dispersion, mixture_table(clones, weights), history), groups, history)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parameters(groups: DataFrame, dispersion: DataFrame, mixture: DataFrame, history: DataFrame) -> DataFrame:
    """Fitted parameters as one long table."""
    final = history.groupBy(*RUN).agg(F.max_by("ll", "iter").alias("ll"))
    lam = groups.select(*GROUP, "lambda").distinct()
    return _union([
        parameter_rows(final, "log_likelihood", "ll"), parameter_rows(dispersion, "tau", "tau"),
        parameter_rows(dispersion, "inv_phi", "inv_phi"), parameter_rows(mixture, "pi", F.exp("log_pi")),
        parameter_rows(lam, "lambda", "lambda"),
    ])


def score_cells(
    counts: DataFrame, profile: DataFrame, params: DataFrame, settings: FitSettings, partitions: int | None = None
) -> DataFrame:
    """Posteriors and labels of cells under saved parameters, without a fit.

    ``params`` is the table of a fit, read back; ``counts`` may hold cells that the fit has not seen.
    """
    obs = prepare_observations(counts, partitions)

    def named(name: str, *keys: str, value: str) -> DataFrame:
        return params.filter(F.col("name") == name).select(*keys, F.col("value").alias(value))

    lam = named("lambda", *GROUP, value="lambda") if settings.uses_total else None
    groups = durable(static_groups(obs, profile, settings, lam))
    dispersion = named("tau", *STATE, value="tau").join(named("inv_phi", *STATE, value="inv_phi"), STATE, "full")
    mixture = mixture_table(clone_sets(groups), named("pi", *RUN, "k", value="pi"))
    calls = durable(posteriors(obs, with_dispersion(groups, dispersion, settings), mixture, few_bytes(groups)))
    obs.unpersist()
    return calls


def fit_cells(
    counts: DataFrame, profile: DataFrame, settings: FitSettings | None = None,
    reference: DataFrame | None = None, partitions: int | None = None,
    observer: Observer | None = None,
) -> Fit:
    """Fit the cell model.

    ``counts``: dense ``(run_id, assay, group_id, cell_id, x, a, b)``; ``profile``:
    ``(run_id, group_id, cn_a, cn_b, masks)``; ``reference``: optional cells with
    ``is_reference`` that replace the allele-only estimate; ``observer`` is called
    with the iteration and the labelling (0: the reference stage).
    """
    settings = settings or FitSettings()
    obs = prepare_observations(counts, partitions)
    lam = cells = None
    if settings.uses_total:
        if reference is not None:
            ref_clone = reference.select(*RUN).distinct().withColumn("ref_k", F.lit(0))
            cells = reference
        else:
            cells, ref_clone = estimate_reference(obs, profile, settings)
            if observer:
                observer(0, cells)
        lam = baseline(obs, profile, cells, ref_clone, settings)
    fit = _fit_loop(obs, profile, settings, lam, observer)
    fit.reference = cells
    obs.unpersist()  # the results are written tables
    return fit


def loglik_by_state(obs: DataFrame, params: DataFrame, calls: DataFrame, small: bool | None = None) -> DataFrame:
    """Log-likelihood of the assigned clone, summed by clone and copy-number state."""
    from cellmosaic.functions.labels import clone_name

    rows = assigned_rows(obs, calls, params, small).filter(F.col("use_allele") | F.col("use_total"))
    scored = likelihood_rows(rows).withColumn("ll", likelihood.row_loglik()(*likelihood.ROW))
    per_group = scored.groupBy(*GROUP, "k", "cn_a", "cn_b").agg(F.sum("ll").alias("ll"))
    return per_group.filter("ll <> 0").groupBy(*RUN, clone_name(F.col("k")).alias("clone"), "cn_a", "cn_b").agg(
        F.sum("ll").alias("ll"), F.count(F.lit(1)).alias("n_groups")
    )
