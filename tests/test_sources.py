from __future__ import annotations

import gzip
import io
import zipfile

import numpy as np
import pytest

from cellmosaic.operators.profile import clone_proportions
from cellmosaic.sources import archives, sinks, tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_segment_table(spark, tmp_path):
    p = write(tmp_path / "seg.tsv", "#CHR\tSTART\tEND\tSAMPLE\tCLUSTER\tcn_normal\tu_normal\tcn_clone1\tu_clone1\n"
              "chr10\t0\t5\tS1\t1\t1|1\t0.4\t2|1\t0.6\nchr2\t0\t9\tS1\t2\t1|1\t0.4\t1|0\t0.6\n")
    df, clones = tables.read_segments(spark, p)
    assert clones == ["normal", "clone1"]
    rows = {r.chrom: r for r in df.collect()}
    assert rows["chr2"].cnp == "1|1;1|0" and rows["chr10"].end_bp == 5
    assert clone_proportions(df, clones).first().props == "0.4;0.6"


def test_barcodes_sizes_whitelist_spots(spark, tmp_path):
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("ACGT-1_U1_x\nTTTT-1\n")
    rows = {r.barcode: r.rep_id for r in tables.read_barcodes(spark, str(tmp_path / "b.tsv.gz")).collect()}
    assert rows == {"ACGT-1_U1_x": "U1_x", "TTTT-1": None}
    sizes = tables.read_chrom_sizes(spark, write(tmp_path / "s.txt", "chr1  100\nchrX\t50\n"))
    assert {(r.chrom, r.size_bp) for r in sizes.collect()} == {("chr1", 100), ("chrX", 50)}
    wl = tables.read_whitelist(spark, write(tmp_path / "w.bed", "chr1\t0\t10\tp\n"))
    assert wl.first().wl_end == 10
    with pytest.raises(ValueError):
        tables.read_spots(spark, write(tmp_path / "x.tsv", "BARCODE\tx\na_1\t3\n"))
    assert tables.read_cell_types(spark, None, "cell_type") is None


def test_solution_glob_and_files(spark, tmp_path):
    for tag in ("sol1_a", "sol1_b"):
        write(tmp_path / f"{tag}.tsv", "CLUSTER\tcn_normal\tu_normal\n1\t1|1\t1.0\n")
    df = tables.read_solutions(spark, str(tmp_path / "*sol1*.tsv"))
    assert {r.tag for r in df.collect()} == {"sol1_a", "sol1_b"}
    files = tables.list_files(spark, str(tmp_path / "*.tsv")).collect()
    assert {r.dir for r in files} == {str(tmp_path)}


def save_csr(path, dense):
    indptr, indices, data = [0], [], []
    for row in dense:
        hit = np.flatnonzero(row)
        indices += list(hit)
        data += list(row[hit])
        indptr.append(len(indices))
    arrays = {"format": np.array(b"csr"), "indptr": np.array(indptr), "indices": np.array(indices),
              "data": np.array(data), "shape": np.array(dense.shape)}
    with zipfile.ZipFile(path, "w") as z:
        for name, value in arrays.items():
            buffer = io.BytesIO()
            np.save(buffer, value)
            z.writestr(f"{name}.npy", buffer.getvalue())


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 4)
    rng = np.random.default_rng(0)
    dense = {}
    for name in ("x", "a"):
        m = rng.integers(0, 3, (9, 5)) * (rng.random((9, 5)) < 0.5)
        m[0] = m[4] = 0
        dense[name] = m
        save_csr(tmp_path / f"{name}.npz", m)
    rows = archives.read_archives(spark, str(tmp_path / "*.npz")).collect()
    for name, m in dense.items():
        got = np.zeros_like(m)
        for r in rows:
            if r.path.endswith(f"/{name}.npz"):
                got[r.bin_id, r.cell_id] += r.value
        assert (got == m).all()


def test_align_counts_and_stray_rows(spark):
    schema = "bin_id bigint, cell_id bigint, value bigint"
    x = spark.createDataFrame([(1, 1, 5)], schema)
    a = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], schema)
    b = spark.createDataFrame([(9, 1, 1)], schema)
    counts = tables.align_counts(x, a, b)
    assert {(r.bin_id, r.x, r.a, r.b) for r in counts.collect()} == {(1, 5, 2, 0), (2, 0, 3, 0), (9, 0, 0, 1)}
    bins = spark.createDataFrame([(1,), (2,)], "bin_id bigint")
    cells = spark.createDataFrame([(1,)], "cell_id bigint")
    assert [r.bin_id for r in tables.stray_rows(counts, bins, cells).collect()] == [9]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, "clone1", 0.9), ("r1", 2, None, None)],
                               "run_id string, cell_id bigint, label string, max_posterior double")
    sinks.write_tsv(df, str(tmp_path / "anns"), gzip=True)
    assert tables.read_tsv(spark, str(tmp_path / "anns")).count() == 2
    observe = sinks.labeling_observer(str(tmp_path / "trace"))
    observe(0, df)
    observe(1, df)
    assert spark.read.parquet(str(tmp_path / "trace")).select("iter").distinct().count() == 2
    params = spark.createDataFrame([("r1", "log_likelihood", -5.0)], "run_id string, name string, value double")
    sinks.write_table(params, str(tmp_path / "params"))
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    got = {r.run_id: r.log_likelihood for r in sinks.read_loglik(spark, str(tmp_path / "params"), runs).collect()}
    assert got == {"r1": -5.0, "r2": None}
    sinks.write_key_values(spark, {"assay_types": "gex"}, str(tmp_path / "meta"))
    assert [tuple(r) for r in sinks.read_key_values(spark, str(tmp_path / "meta")).collect()] == [("assay_types", "gex")]
    many = {f"key{i:04d}": str(i) for i in range(1001)}
    sinks.write_key_values(spark, many, str(tmp_path / "many"))
    assert {r.key: r.value for r in sinks.read_key_values(spark, str(tmp_path / "many")).collect()} == many
    sinks.write_summary(spark.createDataFrame([(1.0, 0.5)], "JC_a double, f1 double"), str(tmp_path / "summary"))
    assert tables.read_tsv(spark, str(tmp_path / "summary")).columns == ["f1", "JC_a"]
