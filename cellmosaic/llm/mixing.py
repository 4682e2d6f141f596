"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: its weight's share of all words, at most
``max_copies`` times the source; what a full source cannot take is shared again by
weight. A source whose target is r times its size gives every document floor(r) whole
copies. The rest is a fixed-size sample without replacement: each document has the
random odds u / (1 - u), u from a hash of its id, and inclusion odds p / (1 - p) times
the root of its size, p being the part of r after the point. Documents are taken in
the order of random odds / inclusion odds up to the number of words that is missing.
Where the first text that overruns it ends this order, rounds go on down it until no text
is left that fits: a round takes texts of at most half the words still missing, up to the
first that overruns them, or the first text that fits if all are longer. What is missing
is halved in two rounds at the latest, so that a source needs at most 2 log2(missing) + 1
of them and then misses less than its smallest text left. At last up to ``FILL_ROUNDS``
single documents that come nearer to the target, if only by overrunning it, are taken.
``go_on=False`` leaves out the rounds: the rule of the SQL of op1_source_mix.

The order is cut without sorting a source in one task: documents are counted in bands
of the logarithm of their rank value, as many bands as the source needs, and only the
band that the cut falls into is sorted. A decision is a function of (id, source, size)
and one small row per source, so that texts are never shuffled.

Null text has size 0. Null sources form one source, which sorts last. Documents of
size 0 are taken with 0 words. Rows repeated with the same id and size are taken or
left together. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import word_count
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

MAX_COPIES = 3
FILL_ROUNDS = 2
BAND_ROWS = 16_384


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, for the sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("bigint"))


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds size, the key of the source, the id used for ties and the random odds."""
    tie = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), tie).cast("binary")), 1, 13), 16, 10)
    u = (bits.cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    return docs.withColumns({
        "_size": word_count(F.col("text")),
        "_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "_tie": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 62))),
        "_odds": u / (1 - u),
    })


def source_targets(sized: DataFrame, weigh=cyclic_weights, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: size, weight, target and the split of target / size."""
    totals = sized.groupBy("_source").agg(
        F.first("source", ignorenulls=True).alias("source"),
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"),
    )
    t = weigh(totals)
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "_all": F.sum("source_size").over(everything),
        "_full": F.coalesce(
            F.sum("source_size").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
        "_rest": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("_all") - max_copies * F.col("_full")).cast("double") / F.col("_rest")
    fits = F.col("weight") * level <= max_copies * F.col("source_size")
    # the fuller sources come first; the first one that is not full sets the level for the rest
    place = F.row_number().over(by_fill)
    t = t.withColumns({"_level": level, "_fits": fits, "_place": place})
    t = t.withColumn("_share", F.min(F.when(F.col("_fits"), F.struct("_place", "_level"))).over(everything))
    target = F.least(
        (max_copies * F.col("source_size")).cast("double"), F.col("weight") * F.col("_share._level")
    )
    t = t.withColumn("target", F.coalesce(target, F.lit(0.0)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    return t.select(
        "_source", "source_size", "weight", "target", "_rows", whole.alias("_whole"),
        (ratio - whole).alias("_part"),
        (F.col("target") - (whole * F.col("source_size")).cast("double")).alias("_budget"),
    )


def _rank_value() -> Column:
    inclusion = F.col("_part") / (1 - F.col("_part")) * F.sqrt(F.col("_size").cast("double"))
    return F.when((F.col("_part") > 0) & (F.col("_size") > 0), F.col("_odds") / inclusion)


def _tuple(value: str = "_value") -> Column:
    return F.struct(F.col(value).alias("value"), F.col("_tie").alias("tie"), F.col("_size").alias("size"))


def _cut(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source the last whole band and the last row inside its budget, down the order of ranks."""
    ranked = ranked.withColumn(
        "_band",
        F.floor(F.log2("_value") * F.greatest(F.lit(64), F.col("_rows") / BAND_ROWS)),
    )
    bands = ranked.groupBy("_source", "_band").agg(
        F.sum("_size").alias("_words"), F.max(_tuple()).alias("_last"), F.first("_budget").alias("_budget")
    )
    upto = Window.partitionBy("_source").orderBy("_band")
    bands = bands.withColumn("_sum", F.sum("_words").over(upto))
    inside = durable(bands.groupBy("_source").agg(
        F.max(F.when(F.col("_sum") <= F.col("_budget"), F.struct("_band", "_sum", "_last"))).alias("_below"),
        F.min(F.when(F.col("_sum") > F.col("_budget"), F.col("_band"))).alias("_cut_band"),
    ))
    edge = join_dim(ranked, inside, ["_source"], ["_tie"], bound=inside).filter("_band = _cut_band")
    order = Window.partitionBy("_source").orderBy("_value", "_tie", "_size")
    edge = edge.withColumn(
        "_sum", F.coalesce(F.col("_below._sum"), F.lit(0)) + F.sum("_size").over(order.rangeBetween(
            Window.unboundedPreceding, Window.currentRow))
    ).filter("_sum <= _budget")
    edge = edge.groupBy("_source").agg(F.max(F.struct(_tuple().alias("_last"), "_sum")).alias("_edge"))
    return inside, edge


_TUPLE = "struct<value:double,tie:bigint,size:bigint>"


def _extra() -> Column:
    """Whether a row with a rank is taken once more than the whole copies."""
    later = F.exists("_more", lambda m: (F.col("_size") <= m["limit"]) & (_tuple() <= m["cut"])
                     & ~F.array_contains(m["without"], _tuple()))
    return F.coalesce(_tuple() <= F.col("_cut"), F.lit(False)) | F.array_contains(F.col("_fill"), _tuple()) | later


def _go_on(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with rounds down the order until no text left fits its source's gap."""
    columns = plan.columns
    while True:
        plan = durable(plan)
        gap = F.col("_budget") - F.col("_taken")
        free = join_dim(rows, plan.filter(gap >= 1), ["_source"], ["_tie"], bound=plan).withColumn("_value", _rank_value())
        free = free.filter("_value IS NOT NULL").filter((F.col("_size") <= gap) & ~_extra())
        # rows repeated with the same id and size are one text here
        texts = free.groupBy("_source", "_value", "_tie", "_size").agg(
            F.sum("_size").alias("_words"), F.first("_rows").alias("_rows"), F.first(gap).alias("_gap"))
        texts = durable(texts)
        limits = durable(texts.filter("_words <= _gap").groupBy("_source").agg(
            F.when(F.min("_words") <= F.first("_gap") / 2, F.first("_gap") / 2).otherwise(F.first("_gap")).alias("_limit")))
        if limits.isEmpty():
            return plan
        texts = join_dim(texts, limits, ["_source"], ["_tie"], bound=limits)
        fit = texts.filter("_words <= _limit").select(
            "_source", "_value", "_tie", F.col("_words").alias("_size"), F.col("_size").alias("_one"), "_rows",
            F.col("_gap").alias("_budget"))
        inside, edge = _cut(fit)
        step = inside.join(edge, "_source", "left").join(limits, "_source").select(
            "_source", "_limit", F.coalesce(F.col("_edge._last"), F.col("_below._last")).alias("_end"),
            F.coalesce(F.col("_edge._sum"), F.col("_below._sum")).alias("_got"))
        step = durable(step)
        # repeated rows that only fit one by one
        without = join_dim(texts.filter("_size <= _limit AND _words > _limit").drop("_limit"), step, ["_source"], ["_tie"], bound=step)
        without = without.filter((F.col("_value") <= F.col("_end.value"))).groupBy("_source").agg(
            F.collect_list(_tuple()).alias("_without"))
        step = step.join(without, "_source", "left")
        # the end's place in the order counts, whatever its size
        end = F.struct(F.col("_end.value").alias("value"), F.col("_end.tie").alias("tie"), F.lit((1 << 63) - 1).alias("size"))
        more = F.struct(
            F.col("_limit").alias("limit"), end.alias("cut"),
            F.coalesce("_without", F.array().cast(f"array<{_TUPLE}>")).alias("without"))
        plan = plan.join(step, "_source", "left").withColumns({
            "_more": F.when(F.col("_end").isNull(), F.col("_more")).otherwise(F.concat("_more", F.array(more))),
            "_taken": F.col("_taken") + F.coalesce("_got", F.lit(0)),
        }).select(*columns)


def plan_mix(sized: DataFrame, weigh=cyclic_weights, max_copies: int = MAX_COPIES, go_on: bool = True) -> DataFrame:
    """One row per source: target, whole copies, the last taken rank, the fillers and the later rounds."""
    rows = durable(sized.select("_source", "source", "_size", "_tie", "_odds"))
    targets = durable(source_targets(rows, weigh, max_copies))
    ranked = join_dim(rows, targets, ["_source"], ["_tie"], bound=targets).withColumn("_value", _rank_value())
    inside, edge = _cut(ranked.filter("_value IS NOT NULL"))
    plan = targets.join(inside, "_source", "left").join(edge, "_source", "left").select(
        *targets.columns,
        F.coalesce(F.col("_edge._last"), F.col("_below._last")).alias("_cut"),
        F.coalesce(F.col("_edge._sum"), F.col("_below._sum"), F.lit(0)).alias("_taken"),
        F.array().cast(f"array<{_TUPLE}>").alias("_fill"),
        F.array().cast(f"array<struct<limit:double,cut:{_TUPLE},without:array<{_TUPLE}>>>").alias("_more"),
    )
    if go_on:
        plan = _go_on(rows, plan)
    for _ in range(FILL_ROUNDS):
        plan = durable(plan)
        gap = F.col("_budget") - F.col("_taken")
        free = join_dim(rows, plan, ["_source"], ["_tie"], bound=plan).withColumn("_value", _rank_value())
        free = free.filter("_value IS NOT NULL").filter(
            ~_extra() & (F.col("_size") < 2 * gap)
        )
        best = free.groupBy("_source").agg(
            F.min(F.struct(F.abs(gap - F.col("_size")).alias("off"), _tuple().alias("row"))).alias("_best")
        )
        plan = plan.join(best, "_source", "left").select(
            *targets.columns, "_cut", "_more",
            (F.col("_taken") + F.coalesce(F.col("_best.row.size"), F.lit(0))).alias("_taken"),
            F.when(F.col("_best").isNull(), F.col("_fill"))
            .otherwise(F.concat("_fill", F.array("_best.row"))).alias("_fill"),
        )
    return durable(plan)


def apply_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with source_size, target, copies and taken; a join with one row per source."""
    out = join_dim(sized, plan, ["_source"], ["_tie"], bound=plan).withColumn("_value", _rank_value())
    extra = F.col("_value").isNotNull() & _extra()
    copies = (F.col("_whole") + F.when(extra, 1).otherwise(0)).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("_size"))


def mix(docs: DataFrame, weigh=cyclic_weights, max_copies: int = MAX_COPIES, go_on: bool = True) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    sized = with_sizes(docs.select("doc_id", "source", "text"))
    plan = plan_mix(sized, weigh, max_copies, go_on)
    # sizes are counted once more here rather than kept with the id: the scan is cheap
    return apply_plan(sized, plan).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "copies",
        F.col("taken").cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weigh=cyclic_weights, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    # a row travels packed, so that its columns cannot meet those of the plan
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    sized = with_sizes(packed)
    chosen = apply_plan(sized, plan_mix(sized, weigh, max_copies)).filter("copies > 0")
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
