"""Bulk ingest of sparse-matrix archives (CSR ``.npz``) into coordinate rows.

Many archives are decoded in parallel, one per task; the format itself cannot be
split. Rows leave a task in chunks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                kind = archive["format"].item()
                if kind not in (b"csr", "csr"):
                    raise ValueError(f"{path}: expected a CSR archive, got {kind!r}")
                indptr, indices, data = archive["indptr"], archive["indices"], archive["data"]
            lengths = np.diff(indptr)
            for lo in range(0, len(data), CHUNK):
                hi = min(lo + CHUNK, len(data))
                first = np.searchsorted(indptr, lo, side="right") - 1
                last = np.searchsorted(indptr, hi, side="left")
                rows = np.repeat(np.arange(first, last), lengths[first:last])
                skip = lo - indptr[first]
                rows = rows[skip:skip + hi - lo]
                yield pd.DataFrame({
                    "path": path, "bin_id": rows.astype("int64"),
                    "cell_id": indices[lo:hi].astype("int64"), "value": data[lo:hi].astype("int64"),
                })


def read_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, bin_id, cell_id, value)`` of every archive of a glob."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    rows = files.mapInPandas(_decode, "path string, bin_id bigint, cell_id bigint, value bigint")
    return rows.filter(F.col("value") != 0)
