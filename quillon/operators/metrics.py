"""Prediction metrics, model comparison, weighting and sensitivity, as aggregates and expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import normal_cdf, normal_pdf
from quillon.operators.ordered import median, sums_before, with_place


def auc_brier(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, auc, brier. Ranks with ties averaged come from counts by distinct score, and these from sums by bins of scores."""
    by = by or []
    have = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    c = have.groupBy(*by, p).agg(F.count("*").alias("k"), F.sum(F.col(y).cast("bigint")).alias("k1"))
    r = sums_before(c, by, p, ["k"]).withColumn("rank", F.col("k_before") + (F.col("k") + 1) / 2.0)
    s = r.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("k1").alias("n1"), F.sum(F.col("rank") * F.col("k1")).alias("s"), F.sum(F.col("k1") * (1 - F.col(p)) ** 2 + (F.col("k") - F.col("k1")) * F.col(p) ** 2).alias("b"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return s.select(*by, "n", ((F.col("s") - n1 * (n1 + 1) / 2.0) / F.when(n1 * n0 > 0, n1 * n0)).alias("auc"), (F.col("b") / F.col("n")).alias("brier"))


def net_benefit(df: DataFrame, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """threshold, model, treat_all: decision curve, all thresholds in one pass."""
    t = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    act, one, w = F.col(p) >= F.col("threshold"), F.col(y) == 1, F.col("threshold") / (1 - F.col("threshold"))
    s = t.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(act & one).alias("tp"), F.count_if(act & ~one).alias("fp"), F.avg(F.col(y)).alias("prev"))
    return s.select("threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * w).alias("model"), (F.col("prev") - (1 - F.col("prev")) * w).alias("treat_all"))


def crps_gaussian(y: Column, mu: Column, sigma: Column) -> Column:
    s = F.greatest(sigma, F.lit(1e-9))
    z = (y - mu) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / 3.141592653589793**0.5)


def crps_ensemble(y: Column, draws: Column) -> Column:
    """Energy form for an array of draws, by its sorted order."""
    m = F.size(draws)
    first = F.aggregate(draws, F.lit(0.0), lambda s, x: s + F.abs(x - y)) / m
    ordered = F.transform(F.array_sort(draws), lambda x, k: (2 * (k + 1) - m - 1) * x)
    return first - F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x) / (m * m)


def log_loss(y: Column, p: Column, eps: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def incremental_verdict(d: Column, se: Column, k: float = 2.0) -> Column:
    """Strict bands: predictive, not-predictive, ambiguous."""
    return F.when(se.isNull() | F.isnan(se) | (se == 0), "ambiguous").when(d - k * se > 0, "predictive").when(d + k * se < 0, "not-predictive").otherwise("ambiguous")


def dominance(d_map: Column, se_map: Column, d_dx: Column, se_dx: Column, k: float = 2.0) -> Column:
    """Which of two predictors adds over the other."""
    m, x = d_map - k * se_map > 0, d_dx - k * se_dx > 0
    return F.when(m & ~x, "map").when(x & ~m, "diagnosis").when(m & x, "both").otherwise("neither")


def paired_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, d (sum of a - b), se = sqrt(n) times the sample deviation."""
    x = F.col(a) - F.col(b)
    return df.agg(F.count(x).alias("n"), F.sum(x).alias("d"), (F.sqrt(F.count(x).cast("double")) * F.stddev_samp(x)).alias("se"))


def gaussian_loo(df: DataFrame, y: str, x: str) -> DataFrame:
    """df with elpd: log density of each row's y, left out, under its least-squares line on x, by the hat matrix in one pass."""
    have = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    s = have.agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.covar_pop(x, y).alias("_c"), F.var_pop(y).alias("_vy"))
    j = have.crossJoin(F.broadcast(s))
    n, dx = F.col("_n"), F.col(x) - F.col("_mx")
    slope = F.col("_c") / F.col("_vx")
    res, h = F.col(y) - F.col("_my") - slope * dx, 1 / n + dx * dx / (n * F.col("_vx"))
    s2 = n * (F.col("_vy") - slope * F.col("_c")) / (n - 2)
    e, v = res / (1 - h), s2 / (1 - h)
    return j.withColumn("elpd", -0.5 * (F.log(2 * 3.141592653589793 * v) + e * e / v)).drop("_n", "_mx", "_my", "_vx", "_c", "_vy")


def stratified_folds(df: DataFrame, key: str, strata: list[str], k: int, repeat: int = 0) -> DataFrame:
    """df with fold 0..k-1: rows of a stratum dealt in the order of a digest of key and repeat."""
    return with_place(df, strata, key, str(repeat), "_place").withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place")


def overlap(df: DataFrame, ps: str, treat: str) -> DataFrame:
    """Arms' sizes and medians, the common range and its share of rows."""
    arm = lambda t, c: F.when(F.col(treat) == t, c)
    p = F.col(ps)
    s = df.agg(F.count(arm(1, p)).alias("n_treated"), F.count(arm(0, p)).alias("n_control"), F.greatest(F.min(arm(1, p)), F.min(arm(0, p))).alias("common_lo"), F.least(F.max(arm(1, p)), F.max(arm(0, p))).alias("common_hi"))
    m = median(df.where(F.col(treat).isin(0, 1)), [treat], ps).agg(*[F.max(F.when(F.col(treat) == t, F.col(f"{ps}_median"))).alias(f"ps_{n}_median") for t, n in ((1, "treated"), (0, "control"))])
    s = s.crossJoin(F.broadcast(m)).select("n_treated", "n_control", "ps_treated_median", "ps_control_median", "common_lo", "common_hi")
    inside = df.crossJoin(F.broadcast(s.select("common_lo", "common_hi"))).agg(F.avg(p.between(F.col("common_lo"), F.col("common_hi")).cast("double")).alias("frac_in_support"))
    return s.crossJoin(F.broadcast(inside))


def stabilized_weights(df: DataFrame, ps: str, treat: str, clip: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """df with weight and keep (inside the common range)."""
    arm = lambda t: F.when(F.col(treat) == t, F.col(ps))
    s = df.agg(F.greatest(F.min(arm(1)), F.min(arm(0))).alias("common_lo"), F.least(F.max(arm(1)), F.max(arm(0))).alias("common_hi")).crossJoin(F.broadcast(df.agg(F.avg(treat).alias("_pt"))))
    p = F.least(F.greatest(F.col(ps), F.lit(clip[0])), F.lit(clip[1]))
    j = df.crossJoin(F.broadcast(s))
    w = F.when(F.col(treat) == 1, F.col("_pt") / p).otherwise((1 - F.col("_pt")) / (1 - p))
    return j.withColumns({"weight": w, "keep": F.col(ps).between(F.col("common_lo"), F.col("common_hi"))}).drop("_pt", "common_lo", "common_hi")


def overlap_verdict(n_treated: Column, n_control: Column, support: Column, worst_smd: Column) -> Column:
    return F.when((n_treated < 30) | (n_control < 30) | (support < 0.5), "fail").when((support >= 0.8) & (worst_smd <= 0.1), "pass").otherwise("conditional")


def minimum_detectable(se: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    from statistics import NormalDist

    z = NormalDist().inv_cdf
    return (z(1 - alpha / 2) + z(power)) * F.abs(se)


def sd_from_interval(lo: Column, hi: Column, mass: float = 0.94) -> Column:
    from statistics import NormalDist

    return (hi - lo) / (2 * NormalDist().inv_cdf((1 + mass) / 2))


def normal_equations(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef of least squares with a constant: all cross products in one pass, solved on the driver (p x p)."""
    import numpy as np

    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    have = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [y, *xs]]))
    row = have.agg(*[F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j >= i], *[F.sum(a * F.col(y)).alias(f"b{i}") for i, a in enumerate(terms)]).first()
    p = len(terms)
    if row["b0"] is None:
        return df.sparkSession.createDataFrame([], "term string, coef double")
    m = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    b = np.linalg.lstsq(m, np.array([row[f"b{i}"] for i in range(p)]), rcond=None)[0]
    return df.sparkSession.createDataFrame([(t, float(c)) for t, c in zip(["const", *xs], b)], "term string, coef double")
