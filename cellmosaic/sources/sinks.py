"""Writers and read-back of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.models.common import PARAMETERS, posterior_of
from cellmosaic.operators.panel import metric_columns


def write_tsv(df: DataFrame, path: str, gzip: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Tab-separated folder, NULL as empty text."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "")
    if gzip:
        writer = writer.option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_labeling(calls: DataFrame, path: str, iteration: int) -> None:
    """Labels of one iteration as a partition of the labelling trace.

    ``tumor_post`` is one minus the posterior of normal, NULL where normal is not among the clones.
    """
    if "clone_post" in calls.columns:
        calls = calls.withColumn("tumor_post", 1.0 - posterior_of(0))
    columns = [
        c for c in ("run_id", "cell_id", "label", "max_posterior", "tumor_post", "tumor_purity") if c in calls.columns
    ]
    calls.select(*columns).write.mode("overwrite").parquet(f"{path}/iter={iteration}")


def labeling_observer(path: str):
    """Observer for a fit that writes the labelling trace."""
    return lambda iteration, calls: write_labeling(calls, path, iteration)


def write_summary(summary: DataFrame, path: str) -> None:
    """Summary with its metric columns grouped."""
    write_tsv(summary.select(*[f"`{c}`" for c in metric_columns(summary.columns)]), path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """The long parameter table of a fit, saved by :func:`write_table`."""
    schema = ", ".join(f"{c} {kind}" for c, kind in PARAMETERS.items())
    return spark.read.schema(schema).parquet(path)


def read_loglik(spark: SparkSession, params_path: str, runs: DataFrame) -> DataFrame:
    """Final log-likelihood per run, NULL for a run without saved parameters."""
    saved = spark.read.parquet(params_path).filter(F.col("name") == "log_likelihood")
    return runs.select("run_id").join(saved.select("run_id", F.col("value").alias("log_likelihood")), "run_id", "left")


def write_key_values(spark: SparkSession, values: dict[str, str], path: str) -> None:
    write_tsv(spark.createDataFrame(sorted(values.items()), "key string, value string"), path)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata as rows ``(key, value)``."""
    return spark.read.csv(path, sep="\t", header=True).select("key", "value")
