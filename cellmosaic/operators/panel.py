"""Panels of runs: selection, solution discovery, missing runs, summaries.

``run_id`` is a key in every table, so one job handles all runs of a panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: columns a panel must have
REQUIRED = [
    "SAMPLE", "PLATFORM", "PATH_TO_SEG", "PATH_TO_BBC_PHASE", "PATH_TO_BB_INPUT",
    "PATH_TO_SOLDIR", "SOLID", "PLOIDY", "CLONE", "REF_LABEL",
]


def clean_panel(panel: DataFrame) -> DataFrame:
    """All columns as text, missing values as empty text; required columns checked."""
    missing = [c for c in REQUIRED if c not in panel.columns]
    if missing:
        raise ValueError(f"panel lacks columns {missing}")
    return panel.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in panel.columns])


def select_runs(panel: DataFrame, platform: str | None = None, samples: Sequence[str] | None = None) -> DataFrame:
    rows = panel
    if platform:
        rows = rows.filter(F.col("PLATFORM") == platform)
    if samples:
        rows = rows.filter(F.col("SAMPLE").isin(list(samples)))
    return rows


def with_inputs(panel: DataFrame, files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose named paths all occur in ``files`` (column ``path``)."""
    rows = panel
    for c in columns:
        rows = rows.join(files.select(F.col("path").alias(c)).distinct(), c, "left_semi")
    return rows


def solution_tag(path: Column) -> Column:
    """File name without ``.tsv``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.tsv", "")


def resolve_solutions(panel: DataFrame, files: DataFrame, pattern: str = "*sol{SOLID}*.tsv") -> DataFrame:
    """One row per run: the default solution, or each solution file that matches.

    ``files``: ``(dir, path)``. Files of a folder meet only the panel rows of the
    same folder.
    """
    fixed = (F.col("SOLID") == "DEFAULT") | (F.col("SOLID") == "")
    default = panel.filter(fixed).select("*", F.lit("").alias("SOLFILE"), F.lit("default").alias("tag"))
    head, tail = pattern.split("{SOLID}")

    def escaped(text: str) -> Column:
        return F.lit("".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in text))

    regex = F.concat(F.lit("^"), escaped(head), F.lit("\\Q"), F.col("SOLID"), F.lit("\\E"), escaped(tail), F.lit("$"))
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    found = panel.filter(~fixed).join(
        files.withColumnRenamed("dir", "PATH_TO_SOLDIR"), "PATH_TO_SOLDIR"
    ).filter(F.regexp_like(name, regex))
    matched = found.withColumns({"SOLFILE": F.col("path"), "tag": solution_tag(F.col("path"))}).drop("path")
    return default.unionByName(matched.select(*default.columns))


def run_key(runs: DataFrame) -> DataFrame:
    """``run_id`` = sample/platform/ploidy_nclone_tag."""
    last = F.concat_ws("", F.col("PLOIDY"), F.lit("_n"), F.col("CLONE"), F.lit("_"), F.col("tag"))
    return runs.withColumn("run_id", F.concat_ws("/", F.col("SAMPLE"), F.col("PLATFORM"), last))


def check_assays(assays: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with their assays and whether the platform allows them.

    Spatial runs need gex, multiome runs need both, single-cell runs at least one.
    """
    sets = assays.groupBy("run_id").agg(F.array_sort(F.collect_set("assay")).alias("_a"))
    joined = runs.join(sets, "run_id", "left").withColumn("_a", F.coalesce("_a", F.array().cast("array<string>")))
    gex, atac = F.array_contains("_a", "gex"), F.array_contains("_a", "atac")
    ok = (
        F.when(F.col("PLATFORM") == "spatial", gex)
        .when(F.col("PLATFORM") == "multiome", gex & atac)
        .otherwise(gex | atac)
    )
    text = F.array_join(F.reverse("_a"), "+")
    return joined.withColumns({"assay_types": text, "is_valid": ok}).drop("_a")


def pending_runs(runs: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    """Runs without existing results, or all of them when forced."""
    return runs if force else runs.join(finished.select("run_id").distinct(), "run_id", "left_anti")


def prediction_column(columns: Sequence[str]) -> str | None:
    """The first ``*_label`` column that is not a refined one."""
    names = [c for c in columns if c.endswith("_label") and not c.endswith("-refined")]
    return names[0] if names else None


def summarise_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of run summaries with different columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def metric_columns(columns: Sequence[str]) -> list[str]:
    """Column order of a summary: fixed, ``n_clone*``, ``purity_*``, ``JC_*``."""
    groups = [("n_clone", []), ("purity_", []), ("JC_", [])]
    fixed = []
    for c in columns:
        home = next((names for prefix, names in groups if c.startswith(prefix)), fixed)
        home.append(c)
    return fixed + [c for _, names in groups for c in sorted(names)]


def wide_metrics(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(run_id, name, value)`` to one column per metric name."""
    return long.groupBy("run_id").pivot("name", list(names)).agg(F.max("value"))


def metric_bars(summary: DataFrame, metrics: Sequence[str], sample: str, group: str, order: str) -> DataFrame:
    """Best run per group and sample by F1; runs without any metric are dropped."""
    some = summary.filter(F.greatest(*[F.col(m).isNotNull().cast("int") for m in metrics]) == 1)
    score = F.struct(F.col("f1"), -F.col(order))
    best = some.groupBy(group, sample).agg(F.max_by(F.struct(order, *metrics), score).alias("_r"))
    return best.select(group, sample, "_r.*")
