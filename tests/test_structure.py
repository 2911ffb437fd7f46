import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import structure as s


def frame(spark, x, names):
    return spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "k long, " + ", ".join(f"{n} double" for n in names)).cache()


def test_trait_and_state_variance(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(5 + u + r.normal() * 0.5 + r.normal() * 0.3)) for i, u in enumerate(r.normal(size=1500)) for _ in range(int(r.integers(1, 5)))]
    fit = s.trait_state(spark.createDataFrame(rows, "k long, x double"), ["k"], "x", 0.09, 300)
    assert fit["mu"] == pytest.approx(5, abs=0.1) and fit["between"] == pytest.approx(1, abs=0.12) and fit["within"] == pytest.approx(0.25, abs=0.06) and fit["verdict"] == "trait"


def test_omnibus_normality(spark):
    r = np.random.default_rng(1)
    out = {x["item"]: x["k2"] for x in s.normality_k2(frame(spark, np.c_[r.normal(size=3000), r.exponential(size=3000)], ["a", "b"]).drop("k"), ["a", "b"]).collect()}
    assert out["a"] < 12 and out["b"] > 300


def test_copula_is_monotone_clamped_and_keeps_missing(spark):
    df = frame(spark, np.random.default_rng(2).exponential(size=(800, 1)), ["x"])
    knots = s.copula_knots(df, "x")
    new = spark.createDataFrame([(-5.0,), (0.2,), (0.9,), (99.0,), (None,)], "x double")
    z = [r["x_z"] for r in s.copula_forward(new, "x", knots).orderBy(F.col("x").asc_nulls_last()).collect()]
    ks = [r["z"] for r in knots.orderBy("k").collect()]
    assert z[0] == pytest.approx(ks[0]) and z[3] == pytest.approx(ks[-1]) and z[0] < z[1] < z[2] < z[3] and z[4] is None


def test_hopkins_of_uniform_and_clustered_points(spark):
    r = np.random.default_rng(3)
    even = s.hopkins(frame(spark, r.random((1500, 2)), ["x", "y"]), "k", ["x", "y"]).first()[0]
    tight = s.hopkins(frame(spark, r.integers(0, 3, (1500, 2)) + r.normal(size=(1500, 2)) * 0.01, ["x", "y"]), "k", ["x", "y"]).first()[0]
    assert 0.4 < even < 0.6 and tight > 0.9


def test_archetypes_explain_a_triangle(spark):
    r = np.random.default_rng(4)
    corners = np.array([[0.0, 0], [4, 0], [0, 4]])
    x = r.dirichlet([0.4] * 3, 800) @ corners
    fit = s.archetypes(frame(spark, x, ["x", "y"]), ["x", "y"], np.array([[1.0, 1], [2, 1], [1, 2]]), 40)
    assert fit["explained"] > 0.98
    assert np.abs(fit["anchors"][np.argmin(fit["anchors"].sum(1))] - corners[0]).max() < 0.6


def test_permutation_keeps_the_values(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = s.permuted(df, "k", "v", 1).collect()
    assert sorted(r.v for r in out) == [2 * k for k in range(500)] and sum(r.v == 2 * r.k for r in out) < 250


def test_digests(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "c string, p int")
    h = lambda d: s.index_hash(d, ["c", "p"]).first()
    assert h(df) == h(df.orderBy(F.desc("p"))) and h(df) != h(df.distinct()) and h(df) != h(df.withColumn("p", F.lit(1)))
    assert s.cache_key({"a": 1, "b": 2}) == s.cache_key({"b": 2, "a": 1}) != s.cache_key({"a": 2, "b": 2})
