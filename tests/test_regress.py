import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import latent, mixed, ordered, regress as r, structure


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(0)
    n = 1500
    x, t = g.normal(size=(n, 2)), (g.random(n) < 0.4).astype(float)
    y = 1 + 0.5 * x[:, 0] - 0.8 * x[:, 1] + 0.6 * t + 0.9 * t * x[:, 0] + g.normal(size=n)
    b = (g.random(n) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    o = np.digitize(x[:, 0] - 0.5 * x[:, 1] + g.logistic(size=n), [-1.0, 0.5, 2.0]).astype(float)
    w = g.random(n) + 0.5
    data = np.c_[np.arange(n), x, t, y, b, o, w]
    df = spark.createDataFrame([tuple(map(float, v)) for v in data] + [(9e9, None, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0), (9e9 + 1, 1.0, 1.0, 0.0, None, None, None, 1.0)], "k double, x0 double, x1 double, t double, y double, b double, o double, w double").cache()
    return df, data


def xs():
    return {"x0": F.col("x0"), "x1": F.col("x1")}


def test_gaussian_fit_and_left_out_densities(rows):
    df, a = rows
    x, y, w = np.c_[np.ones(len(a)), a[:, 1:3]], a[:, 4], a[:, 7]
    f = r.fit(df, "y", xs(), weight=F.col("w"))
    want = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * y))
    assert f.coef == pytest.approx(want) and f.n == len(a)
    plain = r.fit(df, "y", xs())
    got = {v.k: v.elpd for v in r.left_out(df, "y", xs(), plain, keep=["k"]).collect()}
    for k in (0, 7, 300):
        m = np.arange(len(a)) != k
        beta = np.linalg.lstsq(x[m], y[m], rcond=None)[0]
        h = x[k] @ np.linalg.inv(x.T @ x) @ x[k]
        s2 = ((y - x @ plain.coef) ** 2).mean() / (1 - h)
        assert got[k] == pytest.approx(-0.5 * (math.log(2 * math.pi * s2) + (y[k] - x[k] @ beta) ** 2 / s2))
    ridge = r.fit(df, "y", xs(), ridge=1e6)
    assert np.abs(ridge.coef[1:]).max() < 0.01


def test_bernoulli_and_ordinal_fits_are_at_the_top(rows):
    df, a = rows
    x = np.c_[np.ones(len(a)), a[:, 1:3]]

    def bernoulli(p):
        eta = x @ p
        return (a[:, 7] * (a[:, 5] * eta - np.logaddexp(0, eta))).sum() - 0.5 * 2.0 * (p[1:] ** 2).sum()

    f = r.fit(df, "b", xs(), "bernoulli", F.col("w"), 2.0)
    slope = [(bernoulli(f.coef + 1e-5 * e) - bernoulli(f.coef - 1e-5 * e)) / 2e-5 for e in np.eye(3)]
    assert np.abs(slope).max() < 1e-3 and f.coef[1:] == pytest.approx([1.2, -0.7], abs=0.2)

    def ordinal(p):
        c, eta, y = np.r_[-np.inf, p[:3], np.inf], a[:, 1:3] @ p[3:], a[:, 6].astype(int)
        cdf = lambda z: 1 / (1 + np.exp(-z))
        return np.log(cdf(c[y + 1] - eta) - cdf(c[y] - eta)).sum()

    f = r.fit(df, "o", xs(), "ordinal")
    slope = [(ordinal(f.coef + 1e-5 * e) - ordinal(f.coef - 1e-5 * e)) / 2e-5 for e in np.eye(5)]
    assert np.abs(slope).max() < 1e-2 and f.loglik == pytest.approx(ordinal(f.coef))
    curve = [(ordinal(f.coef + 1e-3 * e) - 2 * f.loglik + ordinal(f.coef - 1e-3 * e)) / 1e-6 for e in np.eye(5)]
    assert np.diag(np.linalg.inv(f.cov)) == pytest.approx(-np.array(curve), rel=1e-2)


def test_errors_in_predictors_are_corrected(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=4000)
    seen, y = x + 0.7 * g.normal(size=4000), 2 * x + 0.5 * g.normal(size=4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(seen, y)], "x double, y double")
    assert r.fit(df, "y", {"x": F.col("x")}).of("x")[0] < 1.5
    assert r.fit(df, "y", {"x": F.col("x")}, errors={"x": F.lit(0.7)}).of("x")[0] == pytest.approx(2, abs=0.12)


def test_moderation_and_survival(rows):
    df, _ = rows
    out = r.moderation(df, "y", "t", {"x0": F.col("x0")}, {"x1": F.col("x1")}, "k").collect()[0]
    assert out.ate == pytest.approx(0.6, abs=0.2) and out.ate_excludes0 and out.any_axis and out.interaction == pytest.approx(0.9, abs=0.2) and out.d_elpd > 2 * out.d_se > 0
    kept = r.survival(df, "y", {"x0": F.col("x0")}, {}, {"x1": F.col("x1"), "t": F.col("t")}).collect()[0]
    assert kept.survives and abs(kept.attenuation_pct) < 30


def test_out_of_fold_equals_separate_fits(rows):
    df, a = rows
    folded = df.withColumn("fold", (F.col("k") % 3).cast("int"))
    got = {v.k: v.p for v in r.out_of_fold(folded, "b", xs(), "fold", 3, keep=["k"]).collect()}
    for f in range(3):
        fit = r.fit(folded.where(F.col("fold") != f), "b", xs(), "bernoulli", ridge=1.0)
        for k in range(f, 60, 3):
            assert got[k] == pytest.approx(1 / (1 + math.exp(-(fit.coef[0] + fit.coef[1:] @ a[k, 1:3]))), abs=1e-6)


def test_auc_gain_and_bootstraps(rows, spark):
    df, a = rows
    scored = df.where("b is not null").withColumns({"p0": F.col("x1"), "p1": F.col("x0")})

    def auc(y, p):
        order = np.argsort(np.argsort(p)) + 1
        n1 = y.sum()
        return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))

    out = r.paired_auc(scored.where("x0 is not null"), "k", "b", "p0", "p1", 400).collect()[0]
    want = auc(a[:, 5], a[:, 1]) - auc(a[:, 5], a[:, 2])
    assert out.delta == pytest.approx(want) and out.lo < want < out.hi
    g = np.random.default_rng(0)
    slow = [auc(a[i, 5], a[i, 1]) - auc(a[i, 5], a[i, 2]) for i in (g.integers(0, len(a), len(a)) for _ in range(400))]
    assert (out.lo, out.hi) == pytest.approx(tuple(np.percentile(slow, [3, 97])), abs=0.015)
    diff = r.bootstrap_difference(df, "k", "y", "x0", 400).collect()[0]
    d = a[:, 4] - a[:, 1]
    assert diff.delta == pytest.approx(d.mean()) and (diff.hi - diff.lo) == pytest.approx(2 * 1.96 * d.std() / math.sqrt(len(d)), rel=0.2)


def test_chi_square_tails():
    assert [r.chi_square_tail(x, k) for x, k in ((3.841, 1), (5.991, 2), (7.815, 3), (9.488, 4), (11.07, 5))] == pytest.approx([0.05] * 5, abs=1e-4)


def test_splines_sum_to_one(spark):
    df = spark.range(41).select((F.col("id") / 40.0).alias("x"))
    got = np.array([list(v) for v in df.select(*r.spline(F.col("x"), [0.3, 0.7], 0.0, 1.0)).collect()])
    assert got.shape == (41, 6) and got.sum(1) == pytest.approx(np.ones(41)) and (got >= 0).all() and got[-1, -1] == 1


def test_ranks_and_quantiles_of_columns(spark):
    g = np.random.default_rng(2)
    values = [(int(k % 3) if k % 50 else None, float(v) if k % 7 else None) for k, v in enumerate(np.round(g.normal(size=4000), 2))]
    df = spark.createDataFrame(values, "c int, x double")
    got = {v.c: v.q for v in ordered.quantiles(df, ["c"], "x", [0.1, 0.5, 0.99]).collect()}
    for c in (0, 1, 2, None):
        own = [x for d, x in values if d == c and x is not None]
        assert got[c] == pytest.approx(np.quantile(own, [0.1, 0.5, 0.99]).tolist())
    ranked = ordered.with_rank(df, "x", []).collect()
    own = sorted(x for _, x in values if x is not None)
    assert all(v["rank"] == pytest.approx((np.searchsorted(own, v.x) + np.searchsorted(own, v.x, "right") + 1) / 2) for v in ranked if v.x is not None)
    placed = ordered.with_place(df.withColumn("k", F.monotonically_increasing_id()), ["c"], "k").collect()
    for c in (0, 1, 2, None):
        assert sorted(v.place for v in placed if v.c == c) == list(range(sum(d == c for d, _ in values)))


def test_permutations_keep_the_size_of_a_null(spark):
    g = np.random.default_rng(3)
    y, b, e = g.normal(size=(3, 600))
    for strength in (0.0, 0.5):
        df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(zip(y + strength * e, b, e))], "k long, y double, b double, e double")
        out = structure.permutation_test(df, "k", "y", "b", "e", 300, lot=200).collect()[0]
        whole = structure.incremental_r2(df, "y", "b", "e").collect()[0]
        assert out.gain == pytest.approx(whole.gain) and out.null_mean == pytest.approx(1 / 600, rel=0.4)
        assert (out.p_value < 0.01) == (strength > 0)


def test_likelihoods_sum_to_one(spark):
    df = spark.range(400).select(F.col("id").cast("double").alias("y"))
    one = F.lit(1.7), F.lit(0.8)
    cells = {"nb": mixed.negative_binomial_loglik(F.col("y"), *one), "hurdle": mixed.hurdle_loglik(F.col("y"), F.lit(0.4), *one)}
    got = df.agg(*[F.sum(F.exp(c)).alias(n) for n, c in cells.items()]).collect()[0]
    assert list(got) == pytest.approx([1.0, 1.0])
    levels = spark.range(4).agg(F.sum(F.exp(mixed.ordered_loglik(F.col("id"), F.lit(0.3), [-1.0, 0.2, 1.5])))).collect()[0][0]
    assert levels == pytest.approx(1.0)


def test_vine_gives_correlations():
    g = np.random.default_rng(4)
    partial = np.tril(g.uniform(-0.9, 0.9, (5, 5)), -1)
    m = mixed.vine_correlation(partial)
    assert np.diag(m) == pytest.approx(np.ones(5)) and np.linalg.eigvalsh(m).min() > 0
    inv = np.linalg.inv(m[np.ix_([0, 1, 2], [0, 1, 2])])
    assert -inv[1, 2] / math.sqrt(inv[1, 1] * inv[2, 2]) == pytest.approx(partial[2, 1])  # given the first


def test_draws_follow_the_posterior(spark):
    lam, phi, sigma = np.array([[0.8, 0.1], [0.2, 0.7]]), np.array([[1.0, 0.3], [0.3, 1.0]]), np.array([0.6, 0.5])
    df = spark.createDataFrame([(1, 0.5, None), (2, 1.0, -1.0), (3, None, None)], "k long, a double, b double")
    mean = {v.k: v for v in latent.conditional_scores(df, ["k"], ["a", "b"], lam, phi, sigma, ["f", "g"]).collect()}
    draws = mixed.conditional_draws(df, ["k"], ["a", "b"], lam, phi, sigma, ["f", "g"], 4000).toPandas()
    assert len(draws) == 12000
    for k, d in draws.groupby("k"):
        assert d.f.mean() == pytest.approx(mean[k].f__mean, abs=0.06) and d.g.std() == pytest.approx(mean[k].g__sd, rel=0.06)
    assert draws[draws.k == 3][["f", "g"]].corr().iloc[0, 1] == pytest.approx(0.3, abs=0.06)
    again = mixed.conditional_draws(df.repartition(3), ["k"], ["a", "b"], lam, phi, sigma, ["f", "g"], 4000).toPandas()
    assert np.allclose(*[x.sort_values(["k", "draw"]).f.to_numpy() for x in (draws, again)])


def test_battery_and_localization():
    g = np.random.default_rng(5)
    lam, phi, sigma = g.uniform(-0.8, 0.8, (7, 2)), np.eye(2), np.full(7, 0.6)
    order = mixed.greedy_battery(lam, phi, sigma)
    values = [v for _, v in order]
    assert sorted(j for j, _ in order) == list(range(7)) and values == sorted(values)
    best = max(range(7), key=lambda j: (1 - np.diag(mixed.localization(lam, phi, sigma, [j])[-1])).mean())
    assert order[0][0] == best
    whole = np.linalg.inv(np.eye(2) + (lam / 0.36).T @ lam)
    assert mixed.localization(lam, phi, sigma, list(range(7)))[-1] == pytest.approx(whole)


def test_groups_of_a_clustered_and_a_fixed_partition(spark):
    g = np.random.default_rng(6)
    label = g.integers(0, 3, 600)
    x = np.array([[0, 0], [4, 0], [0, 4]])[label] + g.normal(size=(600, 2)) * 0.6
    df = spark.createDataFrame([(k, *map(float, v), 0.2, 0.2, int(l), int(5 - l), int(g.integers(0, 3))) for k, (v, l) in enumerate(zip(x, label))], "k long, x double, y double, s double, t double, label int, told int, idle int").cache()
    gap = structure.gap_statistic(df, ["x", "y"], 5, 3).collect()
    assert {v.k_best for v in gap} == {3}
    chosen = latent.choose_groups(df, "k", ["x", "y"], ["s", "t"], range(2, 5), (1,)).collect()
    assert {v.chosen for v in chosen} <= {2, 3} and all(v.confident > 0.5 for v in chosen)
    right, wrong = (latent.xd_fixed(df, ["x", "y"], ["s", "t"], c, 10)["bic"] for c in ("label", "idle"))
    assert right < wrong
    art = structure.coverage_artefact(df, "k", "label", ["told"], trees=5, folds=2, permutations=2).collect()[0]
    idle = structure.coverage_artefact(df, "k", "label", ["idle"], trees=5, folds=2, permutations=2).collect()[0]
    assert art.accuracy > 0.95 and art.p == 0 and idle.balanced < 0.5


def test_a_stage_runs_once_for_a_key(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for key in ("a", "a", "b"):
        assert structure.cached_stage(spark, str(tmp_path), "s", key, build).count() == 3
    assert len(calls) == 2


def test_alignment_is_the_least_of_all():
    g = np.random.default_rng(7)
    for n in (1, 2, 5, 7):
        a, b = g.normal(size=(n, 3)), g.normal(size=(n, 3))
        cost = lambda p: sum(((a[i] - b[j]) ** 2).sum() for i, j in enumerate(p))
        assert cost(structure.align(a, b)) == pytest.approx(min(map(cost, itertools.permutations(range(n)))))


def test_incremental_density_tells_what_adds(rows):
    df, _ = rows
    base = {"x1": F.col("x1")}
    assert r.incremental_density(df, "b", base, xs(), "k").collect()[0].verdict == "predictive"
    idle = {**base, "idle": F.sin(F.col("k") * 12.9898)}
    assert r.incremental_density(df, "b", base, idle, "k").collect()[0].verdict != "predictive"


def test_anchors_of_a_triangle_are_robust(spark):
    g = np.random.default_rng(8)
    corners = np.array([[0.0, 0], [4, 0], [0, 4]])
    x = g.dirichlet([0.5] * 3, 900) @ corners
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k long, x double, y double").cache()
    out = structure.archetype_robustness(df, "k", ["x", "y"], corners + 0.3, 2, 8).collect()
    assert all(v.drift < 0.3 and v.explained > 0.95 for v in out)
