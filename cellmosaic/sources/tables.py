"""Readers of the text tables of the domain. Schemas are explicit, names have no ``#``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.operators.cells import replicate_of
from cellmosaic.operators.joins import join_dim
from cellmosaic.operators.panel import clean_panel, solution_tag
from cellmosaic.operators.profile import clone_columns, join_clones

_RENAME = {
    "#CHR": "chrom", "START": "start_bp", "END": "end_bp", "PHASE": "phase", "NAME": "name",
    "SAMPLE": "sample", "CLUSTER": "cluster", "BARCODE": "barcode", "#SNPS": "n_snps", "#gene": "n_genes",
}
_TYPES = {
    "start_bp": "bigint", "end_bp": "bigint", "phase": "double", "n_snps": "bigint", "n_genes": "bigint",
}


def read_tsv(spark: SparkSession, path: str | Sequence[str], header: bool = True) -> DataFrame:
    """Tab-separated text, all columns as strings."""
    return spark.read.csv(path, sep="\t", header=header, inferSchema=False)


def _canonical(df: DataFrame) -> DataFrame:
    named = df.select(*[F.col(f"`{c}`").alias(_RENAME.get(c, c)) for c in df.columns])
    casts = {c: F.col(f"`{c}`").cast(t) for c, t in _TYPES.items() if c in named.columns}
    casts.update({c: F.col(c).cast("double") for c in clone_columns(named, "u_")})
    return named.withColumns(casts) if casts else named


def _require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def read_cell_types(spark: SparkSession, path: str | None, ref_label: str) -> DataFrame | None:
    if path is None:
        return None
    return _require(_canonical(read_tsv(spark, path)), ["barcode", ref_label], "cell types")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless list; ``rep_id`` is the part after the first underscore."""
    lines = spark.read.text(path).select(F.trim("value").alias("barcode")).filter("barcode <> ''")
    return lines.withColumn("rep_id", replicate_of(F.col("barcode")))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    return _require(_canonical(read_tsv(spark, path)), ["chrom", "start_bp", "end_bp"], "bins")


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    return _require(_canonical(read_tsv(spark, path)), ["chrom", "start_bp", "end_bp", "phase"], "phases")


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Bulk segments with ``cnp``; clones are normal, clone1, .. by the number of
    ``cn_*`` columns."""
    df = _require(_canonical(read_tsv(spark, path)), ["chrom", "start_bp", "end_bp"], "segments")
    n = len(clone_columns(df, "cn_"))
    clones = ["normal", *[f"clone{i}" for i in range(1, n)]]
    return join_clones(df, clones), clones


def _with_row_number(df: DataFrame) -> DataFrame:
    """``df`` of a file scan with ``row_no``, the place of a row in its file, as a sortable pair.

    Blocks of a file are told by where they start; within a block rows keep their order.
    """
    return df.withColumn("row_no", F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """Solution rows with ``row_no``, the order of the file."""
    return _require(_canonical(_with_row_number(read_tsv(spark, path))), ["cluster"], "solution")


def read_solutions(spark: SparkSession, pattern: str) -> DataFrame:
    """All solution files of a glob in one scan, with file path and tag."""
    df = spark.read.csv(pattern, sep="\t", header=True).withColumn("path", F.col("_metadata.file_path"))
    df = _with_row_number(df)
    return _canonical(df).withColumn("tag", solution_tag(F.col("path")))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(dir, path)`` of the files of a glob; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    local = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(F.regexp_extract(local, r"^(.*)/[^/]*$", 1).alias("dir"), local.alias("path"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, wl_start bigint, wl_end bigint, name string")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("size_bp"))


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Spot coordinates; both must be present."""
    df = _canonical(read_tsv(spark, path))
    _require(df, ["barcode", "x", "y"], "spots")
    return df.withColumns({
        "x": F.col("x").cast("double"), "y": F.col("y").cast("double"),
        "rep_id": replicate_of(F.col("barcode")),
    })


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return clean_panel(read_tsv(spark, path))


def align_counts(x: DataFrame, a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One table from three COO tables ``(.., bin_id, cell_id, value)``; absent is 0."""
    key = [*by, "bin_id", "cell_id"]

    def tag(df: DataFrame, name: str) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return df.select(*key, *[
            (F.col("value").cast("bigint") if c == name else zero).alias(c) for c in ("x", "a", "b")
        ])

    rows = tag(x, "x").unionByName(tag(a, "a")).unionByName(tag(b, "b"))
    return rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("x", "a", "b")])


def stray_rows(counts: DataFrame, bins: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count rows whose bin or cell is not in its table; a valid input has none."""
    b = bins.select(*by, "bin_id").distinct().withColumn("_b", F.lit(True))
    c = cells.select(*by, "cell_id").distinct().withColumn("_c", F.lit(True))
    one = join_dim(counts, b, [*by, "bin_id"], ["cell_id"], "left", bound=bins)
    both = join_dim(one, c, [*by, "cell_id"], ["bin_id"], "left", bound=cells)
    return both.filter(F.col("_b").isNull() | F.col("_c").isNull()).drop("_b", "_c")
