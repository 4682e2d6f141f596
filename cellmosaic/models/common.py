"""Settings and prepared tables shared by the cell and the spot model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import labels, likelihood, special

RUN = ["run_id"]
CELL = ["run_id", "cell_id"]
GROUP = ["run_id", "assay", "group_id"]
PART_ROWS = 50_000  # count rows of a partition, so that a task's memory does not grow with the input


@dataclass(frozen=True)
class FitSettings:
    """Model options; the values are the documented defaults."""

    fit_mode: str = "allele_total"
    no_normal: bool = False
    ref_post_cutoff: float = 0.1
    niters: int = 100
    tol: float = 1e-4
    baf_clip: float = 0.001
    tau_bounds: tuple[float, float] = (1e-6, 1e6)
    invphi_bounds: tuple[float, float] = (1e-6, 1e6)
    update_pi: bool = False
    update_tau: bool = True
    update_invphi: bool = True
    share_dispersion: bool = True
    allele_mask: str = "imbalanced"
    total_mask: str = "aneuploid"
    grid_rounds: int = 3
    grid_points: int = 65
    assays: tuple[str, ...] = ("gex", "atac")

    def with_(self, **changes) -> FitSettings:
        return replace(self, **changes)

    @property
    def uses_allele(self) -> bool:
        return self.fit_mode in ("allele", "allele_total")

    @property
    def uses_total(self) -> bool:
        return self.fit_mode in ("total", "allele_total")


@dataclass
class Fit:
    """Result of a fit.

    ``annotations``: one row per cell with ``clone_post`` (array over the EM clones),
    ``max_posterior``, ``label`` and, for spots, ``tumor_purity``.
    ``params``: long table ``(run_id, assay, name, group_id, cell_id, k, state, value)``.
    ``trace``: objective ``(iter, run_id, ll)`` of the runs that an iteration fitted.
    ``reference``: cells with ``is_reference``, where a depth baseline was needed.
    """

    annotations: DataFrame
    params: DataFrame
    groups: DataFrame
    trace: DataFrame | None = None
    reference: DataFrame | None = None


def partition_count(spark, partitions: int | None, rows: int = 0) -> int:
    """The given number, else that of a shuffle, or more so that a partition holds about ``PART_ROWS`` rows."""
    return partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def prepare_observations(counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Dense counts with library size and the data-only parts of the likelihoods.

    ``counts`` has one row per (run_id, assay, group_id, cell_id). The result is hash
    partitioned by cell and cached, so the per-cell sums of every iteration need no
    exchange. A lost block is recomputed from the checkpoint below the cache.
    """
    from cellmosaic.session import durable

    spark = counts.sparkSession
    per_cell = Window.partitionBy(*CELL, "assay")
    total = F.sum("x").over(per_cell)
    tot = F.col("a") + F.col("b")
    stored = durable(counts.select(*GROUP, "cell_id", "x", "a", "b"))
    allele, depth = likelihood.row_constants()
    typed = stored.select(
        *GROUP, "cell_id", "x", F.col("b").cast("double").alias("b"), tot.cast("double").alias("n"))
    fixed = typed.withColumns({"bb_const": allele("b", "n"), "nb_const": depth(F.col("x").cast("double"))})
    base = fixed.repartition(partition_count(spark, partitions, stored.count()), *CELL)
    return base.withColumns({
        "total": total.cast("double"), "x": F.col("x").cast("double"),
    }).select(*GROUP, "cell_id", "x", "b", "n", "total", "bb_const", "nb_const").persist()


def em_clones(profile: DataFrame, settings: FitSettings, drop_normal: bool) -> DataFrame:
    """Long profile restricted to the clones the EM ranges over."""
    from cellmosaic.operators.profile import explode_clones

    keep = ["run_id", "group_id", "imbalanced", "clonal_imbalanced", "aneuploid", "subclonal"]
    long = explode_clones(profile, keep, settings.baf_clip)
    return long.filter(F.col("k") >= 1) if drop_normal or settings.no_normal else long


def cell_posteriors(rows: DataFrame, offsets: bool) -> DataFrame:
    """Array of posteriors, MAP clone (the first on ties) and best score per cell.

    ``rows``: count rows per clone, ``(run_id, cell_id, k, log_pi)`` and :data:`likelihood.ROW`; the arrays
    hold one value per clone. Rows that are partitioned by cell need no exchange.
    """
    listed = F.collect_list(F.struct("k", "log_pi", *likelihood.ROW)).alias("_rows")
    packed = rows.groupBy(*CELL).agg(listed)
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in CELL) + ", ks array<int>, lls array<double>"
    arrays = packed.mapInArrow(likelihood.clone_sums(CELL, offsets), schema)
    post = special.softmax(F.col("lls"))
    scored = arrays.withColumns({"clone_post": post, "best_ll": F.array_max("lls")})
    at = F.array_position("lls", F.col("best_ll")).cast("int")
    return scored.withColumns({
        "z": F.element_at("ks", at),
        "max_posterior": F.element_at("clone_post", at),
        "label": labels.clone_name(F.element_at("ks", at)),
    }).drop("lls")


def posterior_of(k: int) -> Column:
    """Posterior of clone ``k`` in a table of :func:`cell_posteriors`."""
    at = F.array_position("ks", k).cast("int")
    return F.when(at > 0, F.element_at("clone_post", at))


def wide_annotations(fit: Fit, clones: Sequence[str], label: str = "label") -> DataFrame:
    """One column per clone next to ``max_posterior`` and the label."""
    columns = [
        posterior_of(0 if c == labels.NORMAL else int(c.removeprefix("clone"))).alias(c) for c in clones
    ]
    rest = [c for c in ("tumor_purity",) if c in fit.annotations.columns]
    return fit.annotations.select(
        *CELL, *columns, "max_posterior", F.col("label").alias(label), *rest
    )


def clone_sets(groups: DataFrame) -> DataFrame:
    """The EM clones ``(run_id, k)`` of every run."""
    return groups.select(*RUN, "k").distinct()


def mixture_table(clones: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``log_pi`` per run and clone from ``(run_id, k, pi)``; uniform for runs without weights."""
    even = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*RUN))
    if weights is None:
        return clones.withColumn("log_pi", F.ln(even))
    known = clones.withColumn("_even", even).join(weights, [*RUN, "k"], "left")
    return known.select(*RUN, "k", F.ln(F.greatest(F.coalesce("pi", "_even"), F.lit(1e-30))).alias("log_pi"))


PARAMETERS = {
    "run_id": "string", "assay": "string", "name": "string", "group_id": "bigint", "cell_id": "bigint", "k": "int",
    "state": "string", "value": "double",
}


def parameter_rows(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Rows of the long parameter table; keys that ``df`` does not have are NULL."""
    keys = [
        (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in PARAMETERS.items() if c not in ("name", "value")
    ]
    at = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, F.lit(name).alias("name"), at.cast("double").alias("value")).filter("value IS NOT NULL")
    return rows.select(*PARAMETERS)
