"""Bulk copy-number profiles: parsing, solution override, row masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import cnp
from cellmosaic.functions.genome import chrom_rank
from cellmosaic.functions.labels import clone_name
from cellmosaic.operators.joins import join_dim, unique_or_fail

DIPLOID = "1|1"


def clone_columns(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def first_sample(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the rows of the first sample in genome order."""
    if "sample" not in segments.columns:
        return segments
    order = F.struct(chrom_rank(F.col("chrom")), F.col("start_bp"), F.col("sample"))
    first = segments.groupBy(*by).agg(F.min_by("sample", order).alias("_first"))
    joined = segments.join(first, list(by)) if by else segments.join(F.broadcast(first))
    return joined.filter(F.col("sample") == F.col("_first")).drop("_first")


def join_clones(segments: DataFrame, clones: Sequence[str]) -> DataFrame:
    """Build ``cnp`` from the per-clone columns ``cn_<clone>``."""
    return segments.withColumn("cnp", F.concat_ws(";", *[F.col(f"cn_{c}") for c in clones]))


def clone_proportions(segments: DataFrame, clones: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``props``: the ``u_<clone>`` values of the first row in genome order."""
    order = F.struct(chrom_rank(F.col("chrom")), F.col("start_bp"))
    text = F.concat_ws(";", *[F.col(f"u_{c}").cast("string") for c in clones])
    return segments.groupBy(*by).agg(F.min_by(text, order).alias("props"))


def override_solution(
    segments: DataFrame, solution: DataFrame, by: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Replace all clone columns by those of a solution table, matched on cluster.

    Of several samples the first in the file (``row_no``) counts, per ``by``. Returns the
    segments and the clone names in the order of the solution. Clusters that the
    solution lacks become diploid with zero proportion; ``cnp`` and ``props`` are built anew.
    """
    cn, u = clone_columns(solution, "cn_"), clone_columns(solution, "u_")
    clones = [c[len("cn_"):] for c in cn]
    if "sample" in solution.columns:
        order = F.col("row_no") if "row_no" in solution.columns else F.col("sample")
        first = solution.groupBy(*by).agg(F.min_by("sample", order).alias("_first"))
        solution = solution.join(first, list(by)) if by else solution.join(F.broadcast(first))
        solution = solution.filter(F.col("sample") == F.col("_first"))
    old = clone_columns(segments, "cn_") + clone_columns(segments, "u_") + ["cnp", "props"]
    key = [*by, "cluster"]
    rows = unique_or_fail(solution.select(*key, *cn, *u), key, "solution clusters")
    joined = segments.drop(*old).join(rows, key, "left")
    filled = joined.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in u},
        **{c: F.coalesce(F.col(c), F.lit(DIPLOID)) for c in cn},
    })
    named = join_clones(filled, clones)
    if u:
        props = clone_proportions(named, clones, by)
        named = join_dim(named, props, list(by), ["cluster"]) if by else named.crossJoin(F.broadcast(props))
    return named, clones


def parse_profile(segments: DataFrame) -> DataFrame:
    """Add the arrays ``cn_a`` and ``cn_b`` (one value per clone, normal first)."""
    return segments.withColumns(
        {"cn_a": cnp.parse_a(F.col("cnp")), "cn_b": cnp.parse_b(F.col("cnp"))}
    )


def explode_clones(profile: DataFrame, keep: Sequence[str], baf_clip: float) -> DataFrame:
    """Long form ``(.., k, clone, cn_a, cn_b, cn_c, baf)``."""
    pair = F.arrays_zip(F.col("cn_a").alias("a"), F.col("cn_b").alias("b"))
    long = profile.select(*keep, F.posexplode(pair).alias("k", "_s"))
    a, b = F.col("_s.a"), F.col("_s.b")
    return long.select(
        *keep,
        "k",
        clone_name(F.col("k")).alias("clone"),
        a.alias("cn_a"),
        b.alias("cn_b"),
        (a + b).alias("cn_c"),
        cnp.expected_baf(a, b, baf_clip).alias("baf"),
    )


def select_clones(long: DataFrame, ks: Sequence[int]) -> DataFrame:
    return long.filter(F.col("k").isin(list(ks)))


def add_masks(profile: DataFrame) -> DataFrame:
    return profile.withColumns(cnp.masks(F.col("cn_a"), F.col("cn_b")))


def profile_table(groups: DataFrame) -> DataFrame:
    """Group coordinates with the profile string."""
    return groups.withColumn("cnp", cnp.to_string(F.col("cn_a"), F.col("cn_b")))


def restrict_masks(groups: DataFrame, keep: str | None, by: Sequence[str] = ()) -> DataFrame:
    """AND all masks with membership in a comma-separated list of profiles.

    A blank list changes nothing; a list without any match fails when the query runs.
    """
    wanted = [r.strip() for r in (keep or "").split(",") if r.strip()]
    if not wanted:
        return groups
    hit = cnp.to_string(F.col("cn_a"), F.col("cn_b")).isin(wanted)
    matched = F.max(hit).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    tagged = groups.withColumns({"_hit": hit, "_any": matched})
    ok = F.when(F.col("_any"), F.col("_hit")).otherwise(
        F.raise_error(F.lit("no profile row matches the whitelist")).cast("boolean")
    )
    names = [m for m in cnp.MASKS if m in groups.columns and dict(groups.dtypes)[m] == "boolean"]
    return tagged.withColumns({m: F.col(m) & ok for m in names}).drop("_hit", "_any")


def has_mirror(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True where some tumour clone has more B than A copies."""
    return long.filter("k >= 1").groupBy(*by).agg(
        F.bool_or(F.col("cn_b") > F.col("cn_a")).alias("has_mirror")
    )


def loh_rows(long: DataFrame) -> DataFrame:
    """Rows with lost heterozygosity of a tumour clone: B = 0 and A > 0."""
    return long.filter((F.col("k") >= 1) & (F.col("cn_b") == 0) & (F.col("cn_a") > 0))
