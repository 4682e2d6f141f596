"""Helpers shared by the operators: text access in Arrow batches, hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.session import checkpoint_root, durable

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/cellmosaic-{what}-{uuid.uuid4().hex}"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_values(array: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow array, without decoding them."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    valid, offsets, data = array.buffers()
    n, first = len(array), array.offset
    at = np.frombuffer(offsets, kind, n + 1, first * np.dtype(kind).itemsize).tolist() if n else []
    view = memoryview(data) if data is not None else b""
    nulls = array.is_null().to_pylist() if array.null_count else None
    for i in range(n):
        yield None if nulls and nulls[i] else bytes(view[at[i]:at[i + 1]])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that links reach from node.

    Large-star and small-star rounds alternate until the edge table is a set of stars.
    Each round is written to the shared folder, so that a lost executor costs one round.
    Nodes without an edge are not listed. The stars' centres are kept apart by the hash
    of the pair, no neighbour list is gathered.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        before = _edge_sum(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = durable(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        )
        e = durable(small)
        if _edge_sum(e) == before:
            break
    child = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return child.unionByName(child.select(F.col("component").alias("node"), "component").distinct())


def _edge_sum(e: DataFrame) -> tuple:
    row = e.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u"), F.min("v")
    ).first()
    return tuple(row)
