"""Clone typing of spatial spots: tumour clones only, mixed with normal by purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import likelihood
from cellmosaic.models import cell_model
from cellmosaic.models.common import (
    CELL,
    GROUP,
    RUN,
    Fit,
    FitSettings,
    cell_posteriors,
    clone_sets,
    mixture_table,
    parameter_rows,
    partition_count,
    prepare_observations,
)
from cellmosaic.operators.joins import few_bytes
from cellmosaic.session import durable

ASSAY = ["run_id", "assay"]
SPOT = ["run_id", "assay", "cell_id"]
PURITY_RANGE = (1e-4, 1.0 - 1e-4)
PURITY_ROUNDS = 3
PURITY_POINTS = 33


def mixed_rows(rows: DataFrame, theta: str, settings: FitSettings) -> DataFrame:
    """Add the columns of :data:`likelihood.ROW` under the purity column ``theta``.

    Dispersions stay at their upper bounds in this model.
    """
    return rows.withColumns({
        "p": F.expr(likelihood.purity_baf("baf", "rdr", theta)), "tau": F.lit(settings.tau_bounds[1]),
        "mu": F.expr(likelihood.nb_mean(likelihood.purity_mean("total", "lambda", "rdr", theta))),
        "size": F.lit(settings.invphi_bounds[1]), "at_allele": F.col("bb_const"), "at_total": F.col("nb_const"),
    })


def spot_groups(obs: DataFrame, profile: DataFrame, lam: DataFrame, settings: FitSettings) -> DataFrame:
    """Group parameters of the tumour clones; both masks ask for a positive baseline.

    Depth ratios are per clone, so leaving out normal does not change them.
    """
    table = cell_model.static_groups(obs, profile, settings, lam, drop_normal=True)
    return cell_model.with_scored(table.withColumn("use_allele", F.col("use_allele") & F.col("covered")))


def purity_rows(obs: DataFrame, groups: DataFrame) -> DataFrame:
    """Every spot with its counts on clonal informative groups as the list ``_rows``.

    All tumour clones agree on these groups, so clone 1. The counts are partitioned by cell, so the list
    (no longer than the number of groups) needs no exchange.
    """
    clonal = groups.filter((F.col("k") == 1) & ~F.col("subclonal") & (F.col("use_allele") | F.col("use_total")))
    side = clonal.select(*GROUP, "baf", "rdr", "lambda", "use_allele", "use_total")
    rows = obs.join(F.broadcast(side) if few_bytes(side) else side, GROUP, "left")
    known = F.col("use_allele").isNotNull() & F.col("n").isNotNull()
    listed = F.collect_list(F.when(known, F.struct(*likelihood.PURITY_ROW)))
    return rows.groupBy(*SPOT).agg(listed.alias("_rows"))


def _searched(rows: DataFrame, settings: FitSettings, rounds: int) -> DataFrame:
    search = likelihood.purity_grids(
        SPOT, settings.tau_bounds[1], settings.invphi_bounds[1], PURITY_RANGE, PURITY_POINTS, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in SPOT) + ", _sums array<double>, theta double"
    return rows.mapInArrow(search, schema)


def purity_scores(rows: DataFrame, settings: FitSettings) -> DataFrame:
    """The first grid round: summed log-likelihood ``ll`` per informed spot and grid point ``i``."""
    return _searched(rows, settings, 1).select(*SPOT, F.posexplode("_sums").alias("i", "ll"))


def estimate_purity(obs: DataFrame, groups: DataFrame, settings: FitSettings) -> DataFrame:
    """Purity of every spot by grid search, 0.5 where no clonal group informs it.

    A task takes a few hundred spots at a time through all rounds, so its memory does not depend on
    the number of spots.
    """
    found = _searched(purity_rows(obs, groups), settings, PURITY_ROUNDS)
    return found.select(*SPOT, F.coalesce("theta", F.lit(0.5)).alias("theta"))


def spot_posteriors(obs: DataFrame, groups: DataFrame, theta: DataFrame, mixture: DataFrame, settings: FitSettings) -> DataFrame:
    """E-step. The purities of a cell are joined as one row, by the key that the counts are partitioned by."""
    tagged = groups.filter("scored").join(mixture, [*RUN, "k"])
    side = tagged.select(*GROUP, "k", "baf", "rdr", "lambda", "use_allele", "use_total", "log_pi")
    listed = F.map_from_entries(F.collect_list(F.struct("assay", "theta"))).alias("_thetas")
    purities = theta.groupBy(*CELL).agg(listed)
    mixed = obs.join(purities, CELL).withColumn("theta", F.element_at("_thetas", F.col("assay"))).drop("_thetas")
    rows = cell_model.attach_groups(mixed, side, GROUP, few_bytes(groups))
    return cell_posteriors(mixed_rows(rows, "theta", settings), False)


def fit_spots(
    counts: DataFrame, profile: DataFrame, settings: FitSettings | None = None,
    reference: DataFrame | None = None, partitions: int | None = None,
) -> Fit:
    """Fit the spot model on (smoothed) counts; see :func:`cell_model.fit_cells`."""
    settings = settings or FitSettings()
    if settings.no_normal:
        raise ValueError("no_normal applies to single cells only")
    spark = counts.sparkSession
    obs = prepare_observations(counts, partitions)
    if reference is None:
        cells, ref_clone = cell_model.estimate_reference(obs, profile, settings)
    else:
        cells = reference
        ref_clone = reference.select(*RUN).distinct().withColumn("ref_k", F.lit(0))
    lam = cell_model.baseline(obs, profile, cells, ref_clone, settings)
    groups = durable(spot_groups(obs, profile, lam, settings))
    cell_model.check_informative(groups, settings)
    theta = durable(estimate_purity(obs, groups, settings))
    theta = theta.repartition(partition_count(spark, partitions, obs.count()), *CELL).persist()
    clones = durable(clone_sets(groups))
    weights: DataFrame | None = None
    trace: list[DataFrame] = []

    def e_step() -> tuple[DataFrame, DataFrame]:
        calls = spot_posteriors(obs, groups, theta, mixture_table(clones, weights), settings).persist()
        return calls, durable(calls.groupBy(*RUN).agg(F.sum("best_ll").alias("ll")))

    calls, score = e_step()
    # only the mixture can change; with it fixed the first E-step is already final
    trace.append(score.select(F.lit(1).alias("iter"), *RUN, "ll"))
    last = score
    for t in range(2, settings.niters if settings.update_pi else 2):
        weights = durable(cell_model.mixture_weights(calls, clones))
        after, score = e_step()
        calls.unpersist()
        calls = after
        trace.append(score.select(F.lit(t).alias("iter"), *RUN, "ll"))
        moved = F.abs(F.col("ll") - F.col("_before")) / (F.abs(F.col("_before")) + 1e-10)
        if score.join(last.withColumnRenamed("ll", "_before"), RUN).filter(moved >= settings.tol).isEmpty():
            break
        last = score
    # the purity that is reported is that of the first modality
    rank = F.array_position(F.array(*[F.lit(a) for a in settings.assays]), F.col("assay"))
    first = theta.groupBy(*CELL).agg(F.min_by("theta", rank).alias("tumor_purity"))
    annotations = durable(calls.join(first, CELL))
    history = cell_model._union(trace)
    bounds = groups.select(*ASSAY).distinct().withColumns({
        "state": F.lit("*"), "tau": F.lit(settings.tau_bounds[1]), "inv_phi": F.lit(settings.invphi_bounds[1])})
    params = cell_model.parameters(groups, bounds, mixture_table(clones, weights), history).unionByName(
        parameter_rows(durable(theta), "theta", "theta"))
    for cached in (calls, theta, obs):
        cached.unpersist()
    return Fit(annotations, params, groups, history, cells)
