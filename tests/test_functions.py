from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import cnp, genome, labels, likelihood, special
from cellmosaic.operators.profile import add_masks, parse_profile


def test_lgamma_matches_math(spark):
    xs = [1e-9, 1e-3, 0.5, 1.0, 1.5, 2.0, 7.99, 8.0, 50.0, 1e3, 1e4, 1e6, 1e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in df.select("x", F.expr(special.lgamma("x"))).collect():
        assert got == pytest.approx(math.lgamma(x), rel=2e-13, abs=5e-12)


def test_lgamma_is_null_outside_its_domain(spark):
    df = spark.createDataFrame([(0.0,), (-0.5,), (-1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(F.expr(special.lgamma("x"))).collect()] == [None] * 4


def bb(b, n, tau, p):
    g = math.lgamma
    a, c = tau * p, tau * (1 - p)
    return (g(n + 1) - g(b + 1) - g(n - b + 1) + g(b + a) + g(n - b + c) - g(n + tau)
            - g(a) - g(c) + g(tau))


def test_betabin_sums_to_one_and_is_symmetric(spark):
    df = spark.createDataFrame([(float(b), 12.0, t, p) for b in range(13) for t in (0.5, 40.0) for p in (0.25, 0.5)],
                               "b double, n double, tau double, p double")
    rows = df.withColumn("ll", F.expr(likelihood.bb_logpmf("b", "n", "tau", "p"))).collect()
    for t in (0.5, 40.0):
        for p in (0.25, 0.5):
            some = {r.b: r.ll for r in rows if r.tau == t and r.p == p}
            assert sum(math.exp(v) for v in some.values()) == pytest.approx(1.0)
            if p == 0.5:
                assert some[3.0] == pytest.approx(some[9.0])
    for r in rows:
        assert r.ll == pytest.approx(bb(r.b, r.n, r.tau, r.p), abs=1e-9)


def test_negbin_tends_to_poisson(spark):
    df = spark.createDataFrame([(float(x), 3.0) for x in range(8)], "x double, mu double")
    for x, got in df.select("x", F.expr(likelihood.nb_logpmf("x", "mu", "1e6D"))).collect():
        assert got == pytest.approx(x * math.log(3) - 3 - math.lgamma(x + 1), abs=1e-4)


def test_purity_limits(spark):
    df = spark.createDataFrame([(0.001, 1.5, 0.0), (0.001, 1.5, 1.0)], "baf double, rdr double, theta double")
    got = [r[0] for r in df.select(F.expr(likelihood.purity_baf("baf", "rdr", "theta"))).collect()]
    assert got == pytest.approx([0.5, 0.001])


MASK_ROWS = ["1|1;1|1;1|1"] * 3 + ["1|1;2|0;2|0"] * 3 + ["1|1;3|1;3|1"] * 2 + ["1|1;1|1;1|1"] * 2


def test_mask_truth_table(spark):
    df = spark.createDataFrame(list(enumerate(MASK_ROWS)), "g int, cnp string")
    rows = add_masks(parse_profile(df)).orderBy("g").collect()
    expect = {
        "imbalanced": {3, 4, 5, 6, 7}, "aneuploid": {6, 7}, "neutral": {0, 1, 2, 8, 9},
        "clonal_loh": {3, 4, 5}, "subclonal": set(), "clonal_imbalanced": {3, 4, 5, 6, 7},
    }
    for name, hit in expect.items():
        assert {r.g for r in rows if r[name]} == hit, name


def test_masks_of_subclones_and_small_profiles(spark):
    df = spark.createDataFrame([("1|1;1|0;1|1",), ("1|1;0|2;0|2",), ("1|1;2|0",), ("1|1",)], "cnp string")
    r = add_masks(parse_profile(df.coalesce(1))).collect()
    assert r[0].subclonal and r[0].subclonal_loh and not r[0].clonal_loh and not r[0].clonal_imbalanced
    assert r[1].clonal_loh and not r[1].subclonal
    assert not r[2].subclonal and r[2].clonal_imbalanced
    assert not r[3].subclonal and r[3].neutral


def test_profile_text_round_trip_and_baf(spark):
    df = spark.createDataFrame([("1|1;0|0;10|2",)], "cnp string")
    a, b = cnp.parse_a(F.col("cnp")), cnp.parse_b(F.col("cnp"))
    assert df.select(cnp.to_string(a, b)).first()[0] == "1|1;0|0;10|2"
    pairs = df.select(F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("s"))
    got = [r[0] for r in pairs.select(cnp.expected_baf(F.col("s.a"), F.col("s.b"), 0.01)).collect()]
    assert got == pytest.approx([0.5, 0.01, 2 / 12])


def test_label_predicates(spark):
    names = ["Tumor_cell", "CLONE7", "normal", "T_cell", "Doublet", "NA", "unknown"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    v = F.col("v")
    rows = df.select(v, labels.is_tumor(v).alias("t"), labels.is_normal(v).alias("n"), labels.is_na(v).alias("na")).collect()
    assert {r.v for r in rows if r.t} == {"Tumor_cell", "CLONE7"}
    assert {r.v for r in rows if r.n} == {"normal", "T_cell", "unknown"}
    assert {r.v for r in rows if r.na} == {"NA"}


def test_clone_and_chromosome_order(spark):
    names = ["NA", "zeta", "clone10", "clone2", "normal"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r.v for r in df.orderBy(labels.clone_order(F.col("v"))).collect()] == [
        "normal", "clone2", "clone10", "zeta", "NA"]
    chroms = ["chrUn", "chrM", "Y", "chrX", "chr10", "2"]
    df = spark.createDataFrame([(n,) for n in chroms], "c string")
    assert [r.c for r in df.orderBy(genome.chrom_rank(F.col("c"))).collect()] == [
        "2", "chr10", "chrX", "Y", "chrM", "chrUn"]


def test_softmax_and_entropy(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -1e9],)], "v array<double>")
    post, = df.select(special.softmax(F.col("v"))).first()
    assert post == pytest.approx([0.5, 0.5, 0.0])
    assert df.select(special.entropy(special.softmax(F.col("v")))).first()[0] == pytest.approx(math.log(2))
