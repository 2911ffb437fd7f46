"""Operators on small hand-made frames with known results, and latent algebra against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import expressions as x
from quillon.operators import aggregate, harmonize, latent, metrics, panel, select

LONG = [
    (1, "BP", "V0", 1.0, 2.0, None, 4.0, None), (1, "BP", "V1", 1.1, 2.1, None, 4.1, None), (1, "BP", "V2", 1.2, None, None, 4.2, 5.2),
    (2, "SZ", "V0", 1.0, None, None, 4.0, None), (2, "SZ", "V1", 1.1, None, None, 4.1, None), (2, "SZ", "V2", 1.2, 2.2, None, None, 5.2),
    (3, "DR", "V0", 1.0, 2.0, None, 4.0, None), (3, "DR", "V1", None, 2.1, None, 4.1, None), (3, "DR", "V2", 1.2, 2.2, None, 4.2, 5.2),
    (4, "BP", "V0", None, None, None, 4.0, None), (4, "BP", "V1", 1.1, 2.1, None, 4.1, None),
]
ITEMS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(LONG, "patient long, cohort string, visit string, a double, b double, c double, d double, e double")


def test_completeness_and_anchor(long):
    at0 = {r["variable"]: r["completeness"] for r in select.completeness(long.where("visit = 'V0'"), ITEMS).collect()}
    assert at0 == {"a": 0.75, "b": 0.5, "c": 0.0, "d": 1.0, "e": 0.0}
    assert select.filter_variables(long, ITEMS, 0.75, "V0") == ["a", "d"]
    a = select.anchor(long, ITEMS, ["cohort", "patient"])
    assert a.items == ("a", "d") and {r["patient"] for r in a.roster.collect()} == {1, 2, 3}
    assert a.apply(long).columns == ["patient", "cohort", "visit", "a", "d"] and a.apply(long).count() == 9
    assert set(select.completeness(long.limit(0), ITEMS).toPandas()["completeness"]) == {0.0}


def test_gates_fill_only_what_they_prove(spark):
    df = spark.createDataFrame([(0.0, None, None, None), (1.0, None, 0.0, None), (None, None, 1.0, None), (0.0, 5.0, 1.0, None)], "g double, d double, h double, k double")
    rules = [("g", 0.0, "d", 0.0), ("g", 0.0, "h", 0.0), ("h", 0.0, "k", 0.0)]
    rows = [(r.d, r.h, r.k) for r in harmonize.decode_gates(df, rules).collect()]
    assert rows == [(0.0, 0.0, 0.0), (None, 0.0, 0.0), (None, 1.0, None), (5.0, 1.0, None)]
    assert [r.n_filled for r in harmonize.gate_report(df, rules).collect()] == [1, 1, 2]


def test_retention(spark):
    rows = [("1", "bp", "V0"), ("1", "bp", "V1"), ("1", "bp", "V2"), ("2", "bp", "V0"), ("2", "bp", "V1"), ("3", "bp", "V0"), ("3", "bp", "V0"), ("1", "sz", "V0"), ("1", "sz", "V1")]
    out = {(r.cohort, r.visit): (r.n, r.fraction) for r in panel.retention(spark.createDataFrame(rows, "patient string, cohort string, visit string"), ["V0", "V1", "V2"]).collect()}
    assert out["bp", "V0"] == (3, 1.0) and out["bp", "V1"][0] == 2 and out["bp", "V2"] == (1, pytest.approx(1 / 3)) and out["sz", "V2"] == (0, 0.0)
    late = spark.createDataFrame([("1", "V0"), ("1", "V2"), ("1", "V10"), ("2", "V1")], "patient string, visit string")
    row = panel.entity_retention(late, ["patient"], ["V1", "V2"]).collect()
    assert len(row) == 1 and (row[0].last_visit, row[0].last_label, row[0].n_visits) == ("V10", "V2", 3)


def test_endpoints(spark):
    e0, e1, e2 = [50, 80, 40, None], [55, 75, 50, 60], [75, 60, 45, 70]
    g0, g1, g2 = [4, 2, 5, 3], [3, 2, 5, 4], [2, 4, 5, 3]
    df = spark.createDataFrame([(k, *map(lambda v: None if v is None else float(v), r)) for k, r in enumerate(zip(e0, e1, e2, g0, g1, g2))], "k int, e_V0 double, e_V1 double, e_V2 double, g_V0 double, g_V1 double, g_V2 double")
    out = df.select("k", *[c.alias(n) for n, c in panel.functioning_endpoints("e", "g").items()]).orderBy("k").collect()
    want = {"remission": [1, 0, 0, None], "recovery": [1, None, 0, None], "deterioration": [0, 1, 0, None], "sustained_impairment": [0, 0, 1, None], "severity_remission": [1, 0, 0, 0], "relapse": [0, 1, 0, 0], "sustained_severe": [0, 0, 1, 0]}
    assert {n: [r[n] for r in out] for n in want} == want
    with pytest.raises(ValueError):
        panel.threshold(F.col("k"), "==", 1)


def test_medications_and_recodes(spark):
    df = spark.createDataFrame([("['N05AN01']",), ("['N05AH02', 'N06AB06']",), ("[]",), (None,)], "t string")
    flags = harmonize.token_flags(F.col("t"), [("N05AN", "lithium"), ("N05A", "antipsychotic"), ("N06A", "antidepressant")], ["lithium", "antipsychotic", "antidepressant"])
    assert [tuple(r) for r in df.select(*flags).collect()] == [(1, 0, 0), (0, 1, 1), (0, 0, 0), (None, None, None)]
    t = spark.createDataFrame([(" five ",), ("7.9",), ("-7.9",), ("junk",), (None,)], "t string")
    assert [r[0] for r in t.select(harmonize.recode(F.col("t"), {"five": 5}, {7: 70})).collect()] == [5, 70, -7, None, None]
    c = spark.createDataFrame([(">10",), ("3,5",), ("junk",)], "t string")
    assert [r[0] for r in c.select(harmonize.capped_count(F.col("t"))).collect()] == [10.0, 3.5, None]


def test_reliable_change_on_a_single_mover(spark):
    rows = [("A", "V0", 0.0, 0.3), ("A", "V2", 3.0, 0.3), ("B", "V0", 1.0, 0.3), ("B", "V2", 1.0, 0.3), ("C", "V0", 1.0, 0.3)]
    pairs = panel.at_both(spark.createDataFrame(rows, "patient string, visit string, m double, s double"), ["patient"], ["m", "s"], "V0", "V2")
    out = panel.reliable_change(pairs, [("m", "s")]).first()
    assert (out.n, out.frac_reliable, out.frac_increase, out.frac_decrease) == (2, 0.5, 0.5, 0.0)


def test_normal_functions(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.975, 0.9999]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    got = [r[0] for r in df.select(x.normal_ppf(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(v) for v in p], atol=1e-7)
    back = [r[0] for r in df.select(x.normal_cdf(x.normal_ppf(F.col("p")))).collect()]
    assert np.allclose(back, p, atol=2e-7)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,)], "p double").select(x.normal_ppf(F.col("p"))).collect()] == [None, None]


@pytest.fixture(scope="module")
def ragged(spark):
    r = np.random.default_rng(0)
    lam, phi, sigma = r.normal(size=(5, 2)), np.array([[1.0, 0.4], [0.4, 1.0]]), np.array([0.5, 0.6, 0.7, 0.8, 0.9])
    data = r.multivariate_normal(np.zeros(5), lam @ phi @ lam.T + np.diag(sigma**2), 300)
    data[r.random(data.shape) < 0.3] = np.nan
    data[0] = np.nan
    rows = [(k, *[None if np.isnan(v) else float(v) for v in row]) for k, row in enumerate(data)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"i{j} double" for j in range(5))), data, lam, phi, sigma


def test_scores_and_loglik_equal_dense_algebra(ragged):
    df, data, lam, phi, sigma = ragged
    items = [f"i{j}" for j in range(5)]
    got = {r.k: r for r in latent.conditional_scores(df, ["k"], items, lam, phi, sigma, ["f", "g"]).collect()}
    ll = {r.k: r.loglik for r in latent.observed_loglik(df, ["k"], items, lam, phi, sigma).collect()}
    for k, row in enumerate(data):
        on = np.flatnonzero(~np.isnan(row))
        l = lam[on]
        s = l @ phi @ l.T + np.diag(sigma[on] ** 2)
        mean = phi @ l.T @ np.linalg.solve(s, row[on]) if len(on) else np.zeros(2)
        cov = phi - phi @ l.T @ np.linalg.solve(s, l @ phi) if len(on) else phi
        assert np.allclose([got[k]["f__mean"], got[k]["g__mean"]], mean) and np.allclose([got[k]["f__sd"], got[k]["g__sd"]], np.sqrt(np.diag(cov)))
        want = -0.5 * (len(on) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + row[on] @ np.linalg.solve(s, row[on])) if len(on) else 0.0
        assert ll[k] == pytest.approx(want)


def test_factor_em_recovers_the_covariance(spark):
    r = np.random.default_rng(1)
    lam = np.array([0.9, 0.8, 0.7, 0.6])
    data = r.normal(size=(4000, 1)) * lam + r.normal(size=(4000, 4)) * np.sqrt(1 - lam**2)
    data[r.random(data.shape) < 0.2] = np.nan
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in data], ", ".join(f"i{j} double" for j in range(4))).cache()
    fit = latent.factor_em(df, [f"i{j}" for j in range(4)], 1, 40)
    assert np.allclose(np.abs(fit["loadings"][:, 0]), lam, atol=0.06)


def test_deconvolution_finds_noise_free_spread(spark):
    r = np.random.default_rng(2)
    centre = np.where(r.random(3000) < 0.5, -2.0, 2.0)
    rows = [(float(c + r.normal() * 0.3 + r.normal() * 0.5), 0.5) for c in centre]
    fit = latent.xd_mixture(spark.createDataFrame(rows, "x double, s double").cache(), ["x"], ["s"], np.array([[-1.0], [1.0]]), 60)
    assert np.allclose(np.sort(fit["mu"][:, 0]), [-2, 2], atol=0.08) and np.allclose(np.sqrt(fit["V"][:, 0, 0]), 0.3, atol=0.06)


def test_simplex_weights_are_optimal():
    r = np.random.default_rng(3)
    z, pts = r.normal(size=(4, 3)), r.normal(size=(60, 3))
    w = latent.simplex_weights(pts, z)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()
    slope = 2 * (w @ z - pts) @ z.T
    for row, g in zip(w, slope):  # at the optimum no other vertex descends
        assert g[row > 1e-3].max() - g.min() < 1e-3


def test_metrics_of_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    out = metrics.auc_brier(df, "y", "p").first()
    assert out.auc == pytest.approx(0.625) and out.n == 4
    assert metrics.auc_brier(df.where("y = 1"), "y", "p").first().auc is None
    folds = metrics.stratified_folds(df.withColumn("k", F.monotonically_increasing_id()), "k", ["y"], 2)
    assert {r["n"] for r in folds.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()} == {1}
    const = spark.createDataFrame([(1, 2.0), (0, 2.0)], "t int, v double")
    assert aggregate.standardized_difference(const, ["v"], "t", F.lit(1.0)).first().smd == 0.0
