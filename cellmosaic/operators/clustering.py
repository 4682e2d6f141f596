"""K-means baseline: feature matrix, clusters, majority vote, principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions import labels, special
from cellmosaic.operators.depth import standardize
from cellmosaic.operators.joins import join_dim


def long_features(cells: DataFrame, groups: DataFrame, norm: bool, by: Sequence[str] = ("assay",)) -> DataFrame:
    """``(.., cell_id, kind, group_id, value)``: BAF on imbalanced, log2 RDR on
    aneuploid groups.

    ``cells``: dense counts with ``total`` and ``lambda``. Missing values become the
    neutral value (0.5, 0), or 0 after standardising each feature over cells.
    """
    by = list(by)
    joined = join_dim(cells, groups.select("group_id", "imbalanced", "aneuploid"), ["group_id"], ["cell_id"])
    baf = special.ratio(F.col("b"), F.col("a") + F.col("b"))
    rdr = special.log2(special.ratio(F.col("x"), F.col("total") * F.col("lambda")))
    parts = F.array_compact(F.array(
        F.when(F.col("imbalanced"), F.struct(F.lit("baf").alias("kind"), baf.alias("value"))),
        F.when(F.col("aneuploid"), F.struct(F.lit("rdr").alias("kind"), rdr.alias("value"))),
    ))
    long = joined.select(*by, "cell_id", "group_id", F.explode(parts).alias("_f")).select(
        *by, "cell_id", "_f.kind", "group_id", "_f.value"
    )
    if not norm:
        neutral = F.when(F.col("kind") == "baf", 0.5).otherwise(0.0)
        return long.withColumn("value", F.coalesce(F.col("value"), neutral))
    scored = standardize(long, "value", "_z", [*by, "kind", "group_id"])
    return scored.withColumn("value", F.coalesce("_z", F.lit(0.0))).drop("_z")


def feature_vectors(long: DataFrame, by: Sequence[str] = ("assay",)) -> DataFrame:
    """One ML vector per cell, features in the order (assay, kind, group)."""
    at = F.struct(*[F.col(c) for c in by], F.col("kind"), F.col("group_id"), F.col("value"))
    packed = F.array_sort(F.collect_list(at))
    values = F.transform(packed, lambda s: s["value"])
    return long.groupBy("cell_id").agg(values.alias("_v")).select(
        "cell_id", array_to_vector("_v").alias("features")
    )


def kmeans_labels(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``(cell_id, cluster)`` by k-means++ with a fixed seed."""
    cached = vectors.persist()
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(cached)
    cached.unpersist()
    return model.transform(vectors).select("cell_id", F.col("prediction").alias("cluster"))


def majority_vote(cells: DataFrame, cluster: str, ref: str) -> DataFrame:
    """Name clusters: normal unless tumour cells are the majority; tumour clusters are
    numbered by first appearance (the least cell id)."""
    tumor = labels.is_tumor(F.col(ref))
    table = cells.groupBy(cluster).agg(
        F.count_if(tumor).alias("n_tumor"), F.count_if(~F.coalesce(tumor, F.lit(False))).alias("n_normal"),
        F.min("cell_id").alias("first_cell"),
    )
    is_normal = F.col("n_normal") >= F.col("n_tumor")
    order = Window.partitionBy(is_normal).orderBy("first_cell")
    name = F.when(is_normal, labels.NORMAL).otherwise(
        F.concat(F.lit("tumor"), F.row_number().over(order).cast("string"))
    )
    return table.withColumn("label", name)


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """Scores on the first ``k`` components, as an array."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(vectors)
    return model.transform(vectors).select("cell_id", vector_to_array("_pc").alias("scores"))
