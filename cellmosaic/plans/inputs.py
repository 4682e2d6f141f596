"""Maps the given test tables onto the tables of the domain.

Line items are the sparse counts (part = bin, customer = cell), parts are genome
bins in five chromosomes, customers are cells on a staggered lattice. The oracle
prelude in ``oracle.py`` states the same mapping in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmosaic.functions import labels
from cellmosaic.operators import annotate, cells as cell_ops, depth, grouping, profile
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

# fixed values: profile of a segment by (3 * chromosome + segment) modulo 5
PROFILES = ["1|1;1|1;1|1", "1|1;1|0;1|0", "1|1;2|1;1|1", "1|1;2|0;2|0", "1|1;2|2;3|1"]
# fixed values: cell type by market segment
CELL_TYPES = {
    "BUILDING": "Tumor_cell", "AUTOMOBILE": "clone2", "MACHINERY": "T_cell",
    "HOUSEHOLD": "B_cell", "FURNITURE": "Unknown",
}
# fixed values: predicted label by cell id modulo 4
PREDICTIONS = ["normal", "clone1", "clone2", "NA"]

BIN_BP = 100_000
SEGMENT_BINS = 20
CLONES = ["normal", "clone1", "clone2"]
BAF_CLIP = 0.001
LINE_ROWS = 500_000  # raw count rows of a task of their join with the orders, so that its memory does not grow


def pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Inputs:
    """Lazily built tables for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bins(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_size")
        i = F.expr("p_partkey div 5")
        number = F.col("p_partkey") % 5 + 1
        return p.select(
            F.col("p_partkey").alias("bin_id"),
            F.concat(F.lit("chr"), number.cast("string")).alias("chrom"),
            number.alias("chrom_no"),
            (i * BIN_BP).alias("start_bp"),
            ((i + 1) * BIN_BP).alias("end_bp"),
            (F.col("p_size") % 2).cast("bigint").alias("phase"),
        )

    @cached_property
    def phases(self) -> DataFrame:
        return self.bins.select("chrom", "start_bp", "end_bp", "phase")

    @cached_property
    def segment_rows(self) -> DataFrame:
        """All bulk segments, those of the gaps included."""
        s = F.expr(f"start_bp div {SEGMENT_BINS * BIN_BP}")
        distinct = self.bins.select("chrom", "chrom_no", s.alias("s")).distinct()
        return distinct.select(
            "chrom", "chrom_no", "s",
            (F.col("s") * SEGMENT_BINS * BIN_BP).alias("start_bp"),
            ((F.col("s") + 1) * SEGMENT_BINS * BIN_BP).alias("end_bp"),
            (F.col("chrom_no") * 100_000 + F.col("s")).alias("seg_id"),
            pick((F.col("chrom_no") * 3 + F.col("s")) % 5, PROFILES).alias("cnp"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        rows = self.segment_rows.filter(F.col("s") % 7 != 6)
        return profile.parse_profile(rows).select(
            "chrom", "start_bp", "end_bp", "seg_id", "cnp", "cn_a", "cn_b"
        )

    @cached_property
    def kept_bins(self) -> DataFrame:
        """Bins inside a segment, with phase and profile."""
        return annotate.map_bins(self.bins, self.segments)

    @cached_property
    def lines(self) -> DataFrame:
        """Ungrouped count rows; operators that only sum can use them directly."""
        items = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
        )
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        spread = -(-self.raw("lineitem").count() // LINE_ROWS)
        if spread > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            items, orders = items.repartition(spread, "l_orderkey"), orders.repartition(spread, "o_orderkey")
        flag, number = F.col("l_returnflag"), F.col("l_linenumber").cast("bigint")
        joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
        return joined.select(
            F.when(F.col("l_linenumber") % 2 == 0, "gex").otherwise("atac").alias("assay"),
            F.col("l_partkey").alias("bin_id"), F.col("o_custkey").alias("cell_id"),
            F.col("l_quantity").cast("bigint").alias("x"),
            F.when(flag == "A", number).otherwise(0).alias("a"),
            F.when(flag == "R", number).otherwise(0).alias("b"),
        )

    @cached_property
    def counts(self) -> DataFrame:
        """One row per bin and cell."""
        return self.lines.groupBy("bin_id", "cell_id").agg(
            *[F.sum(c).alias(c) for c in ("x", "a", "b")]
        )

    @cached_property
    def cells(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        rep = F.concat(F.lit("R"), (F.col("c_nationkey") % 3).cast("string"))
        key = F.col("c_custkey")
        kind = F.create_map(*[F.lit(v) for pair in CELL_TYPES.items() for v in pair])
        row = F.expr("c_custkey div 40")
        return c.select(
            key.alias("cell_id"),
            F.concat(F.lit("C"), key.cast("string"), F.lit("-1_"), rep).alias("barcode"),
            rep.alias("rep_id"),
            kind[F.col("c_mktsegment")].alias("cell_type"),
            pick(key % 4, PREDICTIONS).alias("label"),
            ((key % 100) / 100.0).alias("max_posterior"),
            ((key * 7 % 100) / 100.0).alias("tumor_purity"),
            (2 * (key % 40) + row % 2).alias("x"), row.alias("y"),
        )

    @cached_property
    def spots(self) -> DataFrame:
        return self.cells.select("rep_id", "cell_id", "x", "y")

    @cached_property
    def segment_bins(self) -> DataFrame:
        return grouping.segment_groups(self.kept_bins)

    @cached_property
    def cluster_bins(self) -> DataFrame:
        return grouping.cluster_groups(self.kept_bins)

    @cached_property
    def clusters(self) -> DataFrame:
        return grouping.group_table(self.cluster_bins, positions=False)

    @cached_property
    def cluster_sums(self) -> DataFrame:
        """Counts per copy-number cluster and cell.

        The raw counts shrink to cells x clusters here; the sums are written out once
        because later steps read them several times.
        """
        return durable(grouping.sum_counts(self.lines, self.cluster_bins, ["cell_id"], bound=self.bins))

    @cached_property
    def dense(self) -> DataFrame:
        return grouping.densify(self.cluster_sums, self.cells, self.clusters, n_cells=self.raw("customer").count())

    @cached_property
    def clones_long(self) -> DataFrame:
        return profile.explode_clones(
            self.clusters, ["group_id", "imbalanced", "aneuploid", "subclonal"], BAF_CLIP
        )

    @cached_property
    def flagged(self) -> DataFrame:
        """Cluster sums with ``is_reference`` (normal cell types)."""
        flags = self.cells.select("cell_id", labels.is_normal(F.col("cell_type")).alias("is_reference"))
        return join_dim(self.cluster_sums, flags, ["cell_id"], ["group_id"], bound=self.raw("customer"))

    @cached_property
    def baseline(self) -> DataFrame:
        return depth.baseline_diploid(self.flagged, "is_reference")

    @cached_property
    def clone_depth(self) -> DataFrame:
        return depth.clone_depth(self.clones_long, self.baseline)

    @cached_property
    def dense_total(self) -> DataFrame:
        """Dense cluster counts with the library size ``total``."""
        return self.dense.withColumn("total", F.sum("x").over(Window.partitionBy("cell_id")))

    @cached_property
    def dense_depth(self) -> DataFrame:
        """Dense cluster counts with ``total`` and ``lambda``."""
        return join_dim(self.dense_total, self.baseline, ["group_id"], ["cell_id"], bound=self.bins)

    @cached_property
    def excluded_cells(self) -> DataFrame:
        return cell_ops.excluded(self.cells, "cell_type")
