"""Neighbour graphs of spots, k-hop pooling, spatial join counts.

Spots have ``(.., cell_id, x, y)``; ``by`` names the replicate (and run, assay)
columns. Edges are ``(.., src, dst, dist2, w)``, directed, with weights that sum to
one over the neighbours of ``src``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import labels
from cellmosaic.operators.joins import join_dim
from cellmosaic.operators.ordering import row_numbers
from cellmosaic.session import durable

RUN = 16  # positions of a run, at least
FANOUT = 8  # boxes of the next level
READERS = 4096  # spots that read one part of a salted spot
PART_READS = 50_000  # readings of a run in a partition, so that a task's memory does not grow with the input
PART_PLACES = 10_000  # positions or spots in a partition, likewise
READ_SALTS = 4  # parts of the positions that read one run


def _spread(df: DataFrame, part: int) -> int:
    """Partitions of about ``part`` rows of ``df``, at least as many as a shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // part))


def _named(spots: DataFrame, by: Sequence[str]) -> DataFrame:
    """``spots``; a NULL replicate, run or assay fails the query when it runs."""
    checks = {c: F.coalesce(c, F.raise_error(F.lit(f"spot without {c}")).cast(spots.schema[c].dataType)) for c in by}
    return spots.withColumns(checks) if checks else spots


def _places(spots: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """Distinct positions with the ``keep`` smallest ids found there.

    Ids of one position are at equal distance from everywhere, so more of them can
    never be among the nearest. The row limit is applied before the shuffle too,
    which keeps a position with very many spots small.
    """
    w = Window.partitionBy(*by, "x", "y").orderBy("cell_id")
    few = spots.select(*by, "x", "y", "cell_id").withColumn("_rn", F.row_number().over(w))
    few = few.filter(F.col("_rn") <= keep)
    return few.groupBy(*by, "x", "y").agg(F.array_sort(F.collect_list("cell_id")).alias("ids"))


def _interleaved(value: Column) -> Column:
    """The low 31 bits of a BIGINT spread to the even bits."""
    steps = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
    masks = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(m).cast("bigint").alias("mask")) for s, m in steps])
    spread = lambda v, s: v.bitwiseOR(F.call_function("shiftleft", v, s["shift"])).bitwiseAND(s["mask"])
    return F.aggregate(masks, value, spread)


def _placed(places: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """``places`` numbered along a Z-order curve and cut into runs of equal numbers of positions."""
    far = (1 << 31) - 1
    box = places.groupBy(*by).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(
        F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double").alias("_span"))
    joined = join_dim(places, box, by, ["x", "y"]) if by else places.crossJoin(F.broadcast(box))

    def cell(c: str) -> Column:
        share = (F.col(c) - F.col(f"_{c}")).cast("double") / F.col("_span")
        return F.when(F.col("_span") > 0, F.floor(share * far)).otherwise(0).cast("bigint")

    coded = joined.withColumns({"_u": cell("x"), "_v": cell("y")})
    code = _interleaved(F.col("_u")).bitwiseOR(F.shiftleft(_interleaved(F.col("_v")), 1)).alias("_code")
    coded = coded.select(*by, "x", "y", "ids", code)
    numbered = row_numbers(coded, "_code", "_rn", by, ties=["x", "y"])
    run = F.floor((F.col("_rn") - 1) / max(RUN, 2 * keep)).cast("bigint")
    return durable(numbered.select(*by, "x", "y", "ids", "_rn", run.alias("node")))


def _merged_boxes(rows: DataFrame, by: Sequence[str], node: Column, x0: str, x1: str, y0: str, y1: str, n: Column) -> DataFrame:
    return rows.groupBy(*by, node.alias("node")).agg(
        F.min(x0).alias("x0"), F.max(x1).alias("x1"), F.min(y0).alias("y0"), F.max(y1).alias("y1"), F.sum(n).alias("size"))


def _levels(placed: DataFrame, by: Sequence[str]) -> list[DataFrame]:
    """Bounding boxes of the runs, of ``FANOUT`` neighbouring runs and so on, the top ones last."""
    levels = [durable(_merged_boxes(placed, by, F.col("node"), "x", "x", "y", "y", F.lit(1)))]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last >= FANOUT:
        last //= FANOUT
        node = F.floor(F.col("node") / FANOUT).cast("bigint")
        levels.append(durable(_merged_boxes(levels[-1], by, node, "x0", "x1", "y0", "y1", F.col("size"))))
    return levels


def _in_reach(rows: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """Boxes that may hold one of the nearest: no farther than the far corner of a box that holds enough."""
    def near(v: str) -> Column:
        return F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), F.lit(0))

    def far(v: str) -> Column:
        return F.greatest(F.col(v) - F.col(f"{v}0"), F.col(f"{v}1") - F.col(v))

    least = (near("x") * near("x") + near("y") * near("y")).cast("double")
    most = (far("x") * far("x") + far("y") * far("y")).cast("double")
    seen = F.min(F.when(F.col("size") >= keep, most)).over(Window.partitionBy(*by, "_rn"))
    return rows.withColumn("reach", F.least("reach", seen)).filter(least <= F.coalesce("reach", F.lit(float("inf"))))


def _candidate_runs(placed: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """``(.., _rn, x, y, node)``: the runs that may hold a nearest neighbour of a position.

    The reach of a position starts as the distance to the last of ``keep`` in its own run and
    shrinks on the way down the levels, so that a lone position beside a dense blob reads the
    border of the blob alone.
    """
    here = placed.select(*by, "node", "_rn", "x", "y")
    other = placed.select(*by, "node", F.col("x").alias("px"), F.col("y").alias("py"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    own = here.join(other, [*by, "node"]).groupBy(*by, "_rn", "x", "y").agg(
        F.get(F.array_sort(F.collect_list((dx * dx + dy * dy).cast("double"))), F.lit(keep - 1)).alias("reach"))
    levels, spread = _levels(placed, by), _spread(placed, PART_PLACES)
    top = levels[-1]
    rows = (join_dim_many(own, top, by, spread) if by else own.crossJoin(F.broadcast(top)))
    rows = _in_reach(rows, by, keep)
    for level in reversed(levels[:-1]):
        parent = F.floor(F.col("node") / FANOUT).cast("bigint").alias("parent")
        below = level.select(*by, parent, "node", "x0", "x1", "y0", "y1", "size")
        rows = rows.select(*by, "_rn", "x", "y", "reach", F.col("node").alias("parent"))
        rows = _in_reach(join_dim_many(rows, below, [*by, "parent"], spread, by), by, keep)
    return durable(rows.select(*by, "_rn", "x", "y", "node"))


def join_dim_many(
    rows: DataFrame, boxes: DataFrame, on: Sequence[str], spread: int, by: Sequence[str] | None = None
) -> DataFrame:
    """``rows`` with all of the few boxes of their key, which travel as one array.

    The rows of a position come together in ``spread`` partitions before the arrays are unfolded.
    """
    on = list(on)
    values = [c for c in boxes.columns if c not in on]
    packed = boxes.groupBy(*on).agg(F.collect_list(F.struct(*values)).alias("_boxes"))
    held = join_dim(rows, packed, on, ["_rn"]).repartition(spread, *(on if by is None else by), "_rn")
    return held.select(*rows.columns, F.explode("_boxes").alias("_b")).select(
        *rows.columns, *[F.col(f"_b.{c}").alias(c) for c in values])


def _nearest_of_runs(placed: DataFrame, reads: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """``(.., x, y, near)``: the ``keep`` nearest ``(dist2, id)`` of every position, out of the runs that it reads.

    A run travels as one array and each reading keeps its nearest alone, so that no row per candidate is
    made or sorted. Readings lie in partitions of about ``PART_READS``, whatever the number of spots.
    """
    spread = _spread(reads, PART_READS)
    inside = placed.groupBy(*by, "node").agg(F.collect_list(F.struct(F.col("x").alias("px"), F.col("y").alias("py"), "ids")).alias("_run"))

    def of_place(p: Column) -> Column:
        dx, dy = F.col("x") - p["px"], F.col("y") - p["py"]
        return F.transform(p["ids"], lambda i: F.struct((dx * dx + dy * dy).alias("dist2"), i.alias("id")))

    def first(found: Column) -> Column:
        return F.slice(F.array_sort(found), 1, keep)

    salt = F.pmod(F.col("_rn"), F.lit(READ_SALTS)).cast("int").alias("_salt")
    dealt = reads.select(*by, "_rn", "x", "y", "node", salt).repartition(spread, *by, "node", "_salt")
    held = inside.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(READ_SALTS - 1)))).repartition(spread, *by, "node", "_salt")
    read = dealt.join(held, [*by, "node", "_salt"]).select(
        *by, "_rn", "x", "y", first(F.flatten(F.transform("_run", of_place))).alias("_best"))
    return read.repartition(spread, *by, "_rn").groupBy(*by, "_rn").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), first(F.flatten(F.collect_list("_best"))).alias("near")).drop("_rn")


def nearest_neighbours(spots: DataFrame, n: int, by: Sequence[str] = ("rep_id",)) -> DataFrame:
    """The n nearest other spots of every spot, ties by id.

    Positions are cut into runs along a Z-order curve, with a tree of bounding boxes above them.
    Runs hold equal numbers of positions, whatever the density, and a position reads only
    the runs that the boxes leave. Spots without coordinates have no neighbours.
    """
    by, keep = list(by), n + 1
    spots = _named(spots, by)
    known = spots.filter("x IS NOT NULL AND y IS NOT NULL")
    placed = _placed(_places(known, by, keep), by, keep)
    done = durable(_nearest_of_runs(placed, _candidate_runs(placed, by, keep), by, keep))
    joined = join_dim(known.select(*by, "cell_id", "x", "y"), done, [*by, "x", "y"], ["cell_id"])
    others = F.slice(F.filter("near", lambda c: c["id"] != F.col("cell_id")), 1, n)
    edges = joined.select(*by, F.col("cell_id").alias("src"), others.alias("near"))
    return edges.select(*by, "src", F.size("near").alias("_deg"), F.explode("near").alias("_e")).select(
        *by, "src", F.col("_e.id").alias("dst"), F.col("_e.dist2").alias("dist2"),
        (1.0 / F.col("_deg")).alias("w"),
    )


def reachable(spots: DataFrame, edges: DataFrame, max_k: int, by: Sequence[str] = ("rep_id",)) -> DataFrame:
    """Pairs ``(src, dst, hop)`` with the least number of steps up to ``max_k``.

    Only the last frontier is extended in each round.
    """
    by = list(by)
    nearby = edges.groupBy(*by, F.col("src").alias("dst")).agg(F.collect_list("dst").alias("_next"))
    known = spots.select(*by, F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(0).alias("hop"))
    spread = _spread(spots, PART_PLACES)
    for hop in range(1, max_k + 1):
        frontier = known.filter(F.col("hop") == hop - 1)
        step = join_dim(frontier, nearby, [*by, "dst"], ["src"], bound=edges).select(
            *by, "src", F.explode("_next").alias("dst"), F.lit(hop).alias("hop")
        )
        known = known.unionByName(step).repartition(spread, *by, "src").groupBy(*by, "src", "dst").agg(F.min("hop").alias("hop"))
        if hop < max_k:
            known = durable(known)
    return known


def replicate_report(spots: DataFrame, annotations: DataFrame, by: Sequence[str] = ("rep_id",)) -> DataFrame:
    """Spots and annotated spots per replicate, and whether all spots are annotated."""
    by = list(by)
    present = annotations.select(*by, "cell_id").distinct().withColumn("_hit", F.lit(1))
    joined = spots.select(*by, "cell_id").join(present, [*by, "cell_id"], "left")
    counts = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spots"), F.count("_hit").alias("n_annotated"))
    return counts.withColumn("complete", F.col("n_spots") == F.col("n_annotated"))


def slices(
    spots: DataFrame, annotations: DataFrame, ref_label: str | None, order: str = "cell_id", by: Sequence[str] = ("rep_id",)
) -> DataFrame:
    """Annotated spots of every replicate in the order of its spots, numbered from 0.

    Takes the columns of ``annotations``; a missing reference label becomes ``Unknown``.
    """
    by = list(by)
    columns = [c for c in annotations.columns if c not in (*by, "cell_id", "x", "y")]
    held = join_dim(spots.select(*by, "cell_id", "x", "y", *([order] if order != "cell_id" else [])),
                    annotations.select(*by, "cell_id", *columns), [*by, "cell_id"], ["cell_id"])
    numbered = row_numbers(held, order, "_no", by, ties=[] if order == "cell_id" else ["cell_id"])
    if ref_label is not None:
        numbered = numbered.withColumn(ref_label, F.coalesce(ref_label, F.lit("Unknown")))
    return numbered.withColumn("spot_no", F.col("_no") - 1).select(*by, "spot_no", "cell_id", "x", "y", *columns)


def smoothing_radius(
    reach: DataFrame, totals: DataFrame, max_k: int, min_umi: int, min_snp_umi: int,
    by: Sequence[str] = ("rep_id",),
) -> DataFrame:
    """Least radius whose pooled totals meet both thresholds, else ``max_k``.

    The totals at a radius depend on the original counts only, so the radius is
    known before any counts are pooled. ``totals``: one row per spot with
    ``umi`` and ``snp``.
    """
    by = list(by)
    target = totals.select(*by, F.col("cell_id").alias("dst"), "umi", "snp")
    joined = join_dim(reach, target, [*by, "dst"], ["src"])
    sums = joined.groupBy(*by, "src").agg(
        *[
            F.sum(F.when(F.col("hop") <= k, F.col(c)).otherwise(0)).alias(f"{c}_{k}")
            for k in range(max_k + 1) for c in ("umi", "snp")
        ]
    )
    radius = F.lit(max_k)
    for k in reversed(range(max_k + 1)):
        fine = (F.col(f"umi_{k}") >= min_umi) & (F.col(f"snp_{k}") >= min_snp_umi)
        radius = F.when(fine, F.lit(k)).otherwise(radius)
    return sums.select(*by, F.col("src").alias("cell_id"), radius.alias("k"))


def complete_replicates(spots: DataFrame, cells: DataFrame, by: Sequence[str] = ("rep_id",)) -> DataFrame:
    """Spots of the replicates whose spots all have counts; others are not smoothed."""
    by = list(by)
    present = cells.select(*by, "cell_id", F.lit(1).alias("_hit"))
    joined = spots.join(present, [*by, "cell_id"], "left")
    full = joined.groupBy(*by).agg((F.count(F.lit(1)) == F.count("_hit")).alias("_full"))
    return spots.join(full.filter("_full").select(*by), by, "left_semi")


def pool_counts(
    counts: DataFrame, reach: DataFrame, radius: DataFrame, by: Sequence[str] = ("rep_id",)
) -> DataFrame:
    """Replace the counts of spots with radius > 0 by sums over their neighbourhood.

    Counts stay in long rows. A spot that many others read is salted by how many do: its readers are
    dealt over parts of about ``READERS``, and only its own rows are repeated, once per part.
    """
    by = list(by)
    chosen = join_dim(
        reach, radius.filter("k > 0").withColumnRenamed("cell_id", "src"), [*by, "src"], ["dst"]
    ).filter(F.col("hop") <= F.col("k")).select(*by, "src", "dst")
    degree = chosen.groupBy(*by, "dst").agg(F.ceil(F.count(F.lit(1)) / READERS).cast("int").alias("_parts"))
    busy = durable(degree.filter("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    readers = join_dim(chosen, busy, [*by, "dst"], ["src"], how="left").withColumn("_part", F.pmod(F.xxhash64("src"), parts).cast("int"))
    own = counts.select(*by, F.col("cell_id").alias("dst"), "group_id", "x", "a", "b")
    read = join_dim(own, busy, [*by, "dst"], ["group_id"], how="left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    gathered = readers.drop("_parts").join(read.drop("_parts"), [*by, "dst", "_part"])
    pooled = gathered.groupBy(*by, F.col("src").alias("cell_id"), "group_id").agg(
        *[F.sum(c).alias(c) for c in ("x", "a", "b")]
    )
    moved = radius.filter("k > 0").select(*by, "cell_id")
    kept = counts.join(moved, [*by, "cell_id"], "left_anti").select(*pooled.columns)
    return kept.unionByName(pooled)


def smooth(
    counts: DataFrame, spots: DataFrame, edges: DataFrame, max_k: int, min_umi: int, min_snp_umi: int,
    by: Sequence[str] = ("rep_id",),
) -> tuple[DataFrame, DataFrame | None]:
    """Adaptive smoothing; returns the counts and the radius per spot."""
    if max_k <= 0:
        return counts, None
    by = list(by)
    totals = counts.groupBy(*by, "cell_id").agg(
        F.sum("x").alias("umi"), F.sum(F.col("a") + F.col("b")).alias("snp")
    )
    usable = complete_replicates(spots, totals, by)
    reach = durable(reachable(usable, edges, max_k, by))
    radius = durable(smoothing_radius(reach, totals, max_k, min_umi, min_snp_umi, by))
    return pool_counts(counts, reach, radius, by), radius


def smoothing_report(before: DataFrame, after: DataFrame, radius: DataFrame, by: Sequence[str] = ("rep_id",)) -> DataFrame:
    """Spots per radius with median totals before and after."""
    from cellmosaic.operators.ordering import exact_quantiles

    by = list(by)

    def totals(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*by, "cell_id").agg(
            F.sum("x").cast("double").alias(f"umi_{tag}"),
            F.sum(F.col("a") + F.col("b")).cast("double").alias(f"snp_{tag}"),
        )

    wide = radius.join(totals(before, "before"), [*by, "cell_id"]).join(totals(after, "after"), [*by, "cell_id"])
    long = wide.select(
        "k", F.explode(F.array(*[
            F.struct(F.lit(c).alias("measure"), F.col(c).alias("value"))
            for c in ("umi_before", "umi_after", "snp_before", "snp_after")
        ])).alias("_m"),
    ).select("k", "_m.*")
    medians = exact_quantiles(long, "value", {"median": 0.5}, ["k", "measure"])
    sizes = radius.groupBy("k").agg(F.count(F.lit(1)).alias("n_spots"))
    return medians.join(sizes, "k")


def join_count_zscores(
    spots: DataFrame, edges: DataFrame, label: str, by: Sequence[str] = ("rep_id",)
) -> DataFrame:
    """Join-count z-score per label: do spots of a label sit together?

    ``spots`` carries the label and holds annotated spots only, edges to others are
    left out. NULL for a label with (almost) no or all spots, or without variance;
    the label ``normal`` is not reported.
    """
    by = list(by)
    tags = spots.select(*by, "cell_id", F.col(label).alias("_label"))
    ends = join_dim(
        join_dim(edges, tags.withColumnsRenamed({"cell_id": "src", "_label": "_from"}), [*by, "src"], ["dst"]),
        tags.withColumnsRenamed({"cell_id": "dst", "_label": "_to"}), [*by, "dst"], ["src"],
    )
    w = F.col("w")
    weights = ends.groupBy(*by).agg(F.sum(w).alias("s0"), F.sum(w * w).alias("s2"))
    same = ends.filter(F.col("_from") == F.col("_to")).groupBy(*by, F.col("_from").alias("_label")).agg(
        (0.5 * F.sum(w)).alias("joins")
    )
    sizes = tags.groupBy(*by, "_label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    joined = sizes.join(same, [*by, "_label"], "left").join(weights, by, "left")
    p = F.col("share")
    p2 = p * p
    variance = 0.5 * F.col("s2") * p2 * (1.0 - p2)
    gap = F.coalesce("joins", F.lit(0.0)) - 0.5 * F.col("s0") * p2
    defined = (p >= 1e-6) & (p <= 1.0 - 1e-6) & (variance > 0)
    return joined.filter(F.col("_label") != labels.NORMAL).select(
        *by, F.col("_label").alias("label"), "n",
        F.when(defined, gap / F.sqrt(variance)).alias("zscore"),
    )
