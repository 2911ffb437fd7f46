"""Regressions with covariates: Gaussian, Bernoulli and ordinal outcomes, weights, priors, errors in predictors.

A pass over the rows returns sums whose size depends on the number of terms alone; the rest is done on the driver with
matrices of that size. Estimates are the posterior's mode under independent normal priors (precision `ridge`, none for
constants), intervals come from the curvature there. A row that misses the outcome or a term is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.latent import _partials

#: Share of a logistic effect that is comparable with a standardised difference: sqrt(3) / pi.
LOGIT_TO_D = math.sqrt(3) / math.pi
CONST = "const"


@dataclass
class Fit:
    """A fitted regression: terms (constants or thresholds first), their estimates and covariance."""

    family: str
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    sigma: float = 1.0

    def of(self, term: str) -> tuple[float, float]:
        k = self.terms.index(term)
        return float(self.coef[k]), float(np.sqrt(max(self.cov[k, k], 0.0)))

    def interval(self, term: str, mass: float = 0.94) -> tuple[float, float]:
        b, se = self.of(term)
        z = NormalDist().inv_cdf((1 + mass) / 2)
        return b - z * se, b + z * se

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, *self.of(t), *self.interval(t)) for t in self.terms]
        return spark.createDataFrame(rows, "term string, coef double, se double, lo double, hi double")


def design(df: DataFrame, y: str | Column, xs: dict[str, Column], weight: Column | None = None, errors: dict[str, Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """y, w, the terms x0.. and their errors' deviations s0.. as doubles, of rows that have them all; and the columns `keep`."""
    errors = errors or {}
    y = F.col(y) if isinstance(y, str) else y
    cols = {"y": y, "w": F.lit(1.0) if weight is None else weight, **{f"x{k}": c for k, c in enumerate(xs.values())}, **{f"s{k}": errors.get(t, F.lit(0.0)) for k, t in enumerate(xs)}}
    out = df.select(*(keep or []), *[c.cast("double").alias(n) for n, c in cols.items()])
    return out.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols]))


def _columns(p: int) -> list[str]:
    return ["y", "w", *[f"x{k}" for k in range(p)], *[f"s{k}" for k in range(p)]]


def _prior(terms: list[str], ridge: float | dict[str, float], free: int) -> np.ndarray:
    return np.array([0.0] * free + [ridge.get(t, 0.0) if isinstance(ridge, dict) else ridge for t in terms])


def fit(df: DataFrame, y: str | Column, xs: dict[str, Column], family: str = "gaussian", weight: Column | None = None, ridge: float | dict[str, float] = 0.0, errors: dict[str, Column] | None = None, iterations: int = 30) -> Fit:
    """y on a constant and the terms xs. family: gaussian, bernoulli (y 0 or 1) or ordinal (y 0, 1, ... without gaps).

    errors: known deviations of predictors' errors, for the Gaussian family: their variances are taken off the
    predictors' cross products, so slopes are not attenuated.
    """
    rows = design(df, y, xs, weight, errors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {"gaussian": _gaussian, "bernoulli": _bernoulli, "ordinal": _ordinal}[family](rows, list(xs), ridge, iterations)
    finally:
        rows.unpersist()


def _gaussian(rows: DataFrame, terms: list[str], ridge, iterations: int) -> Fit:
    p = len(terms)
    q = p + 1

    def step(m: np.ndarray) -> np.ndarray:
        w, y = m[:, 1], m[:, 0]
        x = np.c_[np.ones(len(m)), m[:, 2 : 2 + p]]
        xtx = (x * w[:, None]).T @ x
        xtx[1:, 1:] -= np.diag((w[:, None] * m[:, 2 + p :] ** 2).sum(0))
        return np.r_[xtx.ravel(), x.T @ (w * y), (w * y * y).sum(), w.sum(), len(m)]

    t = _partials(rows, _columns(p), step, q * q + q + 3)
    xtx, xty, yy, total, n = t[: q * q].reshape(q, q), t[q * q : q * q + q], t[-3], t[-2], t[-1]
    lam, s2, coef = np.diag(_prior(terms, ridge, 1)), 1.0, np.zeros(q)
    for _ in range(iterations if lam.any() else 1):
        coef = np.linalg.lstsq(xtx + s2 * lam, xty, rcond=None)[0]
        s2 = max((yy - 2 * coef @ xty + coef @ xtx @ coef) / max(total, 1e-300), 1e-300)
    unbiased = s2 * total / max(n - q, 1)
    cov = unbiased * np.linalg.pinv(xtx + s2 * lam)
    return Fit("gaussian", [CONST, *terms], coef, cov, float(-0.5 * total * (math.log(2 * math.pi * s2) + 1)), int(n), math.sqrt(unbiased))


def _bernoulli_step(m: np.ndarray, beta: np.ndarray, p: int) -> np.ndarray:
    y, w, x = m[:, 0], m[:, 1], np.c_[np.ones(len(m)), m[:, 2 : 2 + p]]
    eta = np.clip(x @ beta, -35, 35)
    mu = 1 / (1 + np.exp(-eta))
    return np.r_[((x * (w * mu * (1 - mu))[:, None]).T @ x).ravel(), x.T @ (w * (y - mu)), (w * (y * eta - np.logaddexp(0, eta))).sum(), len(m)]


def _bernoulli(rows: DataFrame, terms: list[str], ridge, iterations: int) -> Fit:
    p = len(terms)
    q, lam, beta = p + 1, _prior(terms, ridge, 1), np.zeros(p + 1)
    info, ll, n = np.eye(q), 0.0, 0
    for _ in range(iterations):
        t = _partials(rows, _columns(p), lambda m, beta=beta: _bernoulli_step(m, beta, p), q * q + q + 2)
        info, grad, ll, n = t[: q * q].reshape(q, q) + np.diag(lam), t[q * q : q * q + q] - lam * beta, float(t[-2]), int(t[-1])
        move = np.linalg.lstsq(info + 1e-12 * np.eye(q), grad, rcond=None)[0]
        if np.abs(move).max() < 1e-9:
            break
        beta = beta + move / max(1.0, np.abs(move).max() / 5)
    return Fit("bernoulli", [CONST, *terms], beta, np.linalg.pinv(info), ll, n)


def _ordinal(rows: DataFrame, terms: list[str], ridge, iterations: int) -> Fit:
    """Proportional odds: P(y <= k) = logistic(c_k - x b). The outcome's levels are few; the driver sees their counts."""
    p, counts = len(terms), {int(r["y"]): r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    levels = max(counts, default=0) + 1
    cuts = levels - 1
    share = np.cumsum([counts.get(k, 0.0) for k in range(levels)])[:-1] / max(sum(counts.values()), 1e-300)
    theta = np.r_[np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))), np.zeros(p)]
    q, lam = cuts + p, _prior(terms, ridge, cuts)
    info, ll, n = np.eye(q), 0.0, 0
    for _ in range(iterations):

        def step(m: np.ndarray, theta=theta) -> np.ndarray:
            y, w, x = m[:, 0].astype(int), m[:, 1], m[:, 2 : 2 + p]
            eta = x @ theta[cuts:]
            c = np.r_[-np.inf, theta[:cuts], np.inf]
            cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            fa, fb = cdf(c[y + 1] - eta), cdf(c[y] - eta)
            prob = np.maximum(fa - fb, 1e-300)
            da, db = fa * (1 - fa), fb * (1 - fb)
            ga, gb = da / prob, -db / prob
            a, b = np.zeros((len(m), q)), np.zeros((len(m), q))
            at = np.arange(len(m))
            a[at[y < cuts], y[y < cuts]] = 1
            b[at[y > 0], y[y > 0] - 1] = 1
            a[:, cuts:] = b[:, cuts:] = -x
            g = a * ga[:, None] + b * gb[:, None]
            haa, hbb = da * (1 - 2 * fa) / prob, -db * (1 - 2 * fb) / prob
            hess = (g * w[:, None]).T @ g - (a * (w * haa)[:, None]).T @ a - (b * (w * hbb)[:, None]).T @ b
            return np.r_[hess.ravel(), (g * w[:, None]).sum(0), (w * np.log(prob)).sum(), len(m)]

        t = _partials(rows, _columns(p), step, q * q + q + 2)
        info, grad, ll, n = t[: q * q].reshape(q, q) + np.diag(lam), t[q * q : q * q + q] - lam * theta, float(t[-2]), int(t[-1])
        move = np.linalg.lstsq(info + 1e-12 * np.eye(q), grad, rcond=None)[0]
        if np.abs(move).max() < 1e-9:
            break
        theta = theta + move / max(1.0, np.abs(move).max() / 2)
        theta[:cuts] = np.maximum.accumulate(theta[:cuts])
    return Fit("ordinal", [*[f"cut{k}" for k in range(cuts)], *terms], theta, np.linalg.pinv(info), ll, n)


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square of `df` degrees of freedom, by its finite series."""
    if df <= 0 or x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, total = math.exp(-half), 0.0
        for k in range(df // 2):
            total += term
            term *= half / (k + 1)
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range((df - 1) // 2):
        total += term
        term *= half / (k + 1.5)
    return min(1.0, total)


def likelihood_ratio(base: Fit, full: Fit) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) of a model against one that it nests."""
    stat, df = 2 * (full.loglik - base.loglik), len(full.terms) - len(base.terms)
    return stat, df, chi_square_tail(stat, df)


def left_out(df: DataFrame, y: str | Column, xs: dict[str, Column], model: Fit, weight: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """`keep` and elpd: each row's log density under the fit without it, by its leverage; exact for the Gaussian family
    without priors, one Newton step for the Bernoulli family."""
    p = len(xs)
    rows = design(df, y, xs, weight, keep=keep)
    coef, cov, s2, kind = model.coef, model.cov, model.sigma**2, model.family
    n, q = model.n, len(model.terms)
    names = [*(keep or []), "y", "w", *[f"x{k}" for k in range(p)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b[names[len(keep or []) :]].to_numpy(dtype=np.float64)
            yy, w, x = m[:, 0], m[:, 1], np.c_[np.ones(len(m)), m[:, 2:]]
            spread = np.einsum("ni,ij,nj->n", x, cov, x)
            eta = x @ coef
            if kind == "gaussian":
                h = np.clip(w * spread / s2, 0, 1 - 1e-9)
                e = (yy - eta) / (1 - h)
                var = s2 * (n - q) / n / (1 - h)
                elpd = -0.5 * (np.log(2 * np.pi * var) + e**2 / var)
            else:
                mu = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
                h = np.clip(w * mu * (1 - mu) * spread, 0, 1 - 1e-9)
                other = eta - w * spread * (yy - mu) / (1 - h)
                elpd = yy * other - np.logaddexp(0, other)
            yield b[keep or []].assign(elpd=elpd)

    kinds = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*(keep or [])).schema.fields], "elpd double"])
    return rows.select(*names).mapInPandas(run, kinds)


def interactions(treat: Column, axes: dict[str, Column]) -> dict[str, Column]:
    return {f"treat:{a}": treat * c for a, c in axes.items()}


def moderation(df: DataFrame, y: str, treat: str, axes: dict[str, Column], confounders: dict[str, Column], key: str, family: str = "gaussian", weight: Column | None = None, ridge: float = 1.0, errors: dict[str, Column] | None = None) -> DataFrame:
    """One row: the treatment's effect without interactions, its interval and E-value, the gain in left-out density of
    treatment by axis terms (sum and deviation), whether any interval leaves 0; and a row for each interaction's estimate."""
    t = F.col(treat).cast("double")
    base = {**confounders, "treat": t, **axes}
    full = {**base, **interactions(t, axes)}
    f0, f1 = (fit(df, y, xs, family, weight, ridge, errors) for xs in (base, full))
    both = left_out(df, y, base, f0, weight, [key]).withColumnRenamed("elpd", "e0").join(left_out(df, y, full, f1, weight, [key]).withColumnRenamed("elpd", "e1"), key)
    gain = both.agg(F.count("*").alias("n"), F.sum(F.col("e1") - F.col("e0")).alias("d"), (F.sqrt(F.count("*").cast("double")) * F.stddev_samp(F.col("e1") - F.col("e0"))).alias("se")).first()
    ate, se = f0.of("treat")
    lo, hi = f0.interval("treat")
    effect = abs(ate if family == "gaussian" else ate * LOGIT_TO_D)
    ratio = math.exp(0.91 * effect)
    inter = {a: (*f1.of(f"treat:{a}"), *f1.interval(f"treat:{a}")) for a in axes}
    moved = any(l > 0 or h < 0 for _, _, l, h in inter.values())
    rows = [(int(gain["n"]), ate, se, lo, hi, lo > 0 or hi < 0, ratio + math.sqrt(ratio * (ratio - 1)), gain["d"], gain["se"], moved, a, *v) for a, v in inter.items()]
    return df.sparkSession.createDataFrame(rows, "n long, ate double, ate_se double, ate_lo double, ate_hi double, ate_excludes0 boolean, e_value double, d_elpd double, d_se double, any_axis boolean, axis string, interaction double, int_se double, int_lo double, int_hi double")


def survival(df: DataFrame, y: str, carriers: dict[str, Column], base: dict[str, Column], exposures: dict[str, Column], weight: Column | None = None, ridge: float = 1.0, errors: dict[str, Column] | None = None) -> DataFrame:
    """A row for each carrier: its slope without and with the exposures, intervals, whether it survives, attenuation in %."""
    xs = {**base, **carriers}
    f0, f1 = fit(df, y, xs, "gaussian", weight, ridge, errors), fit(df, y, {**xs, **exposures}, "gaussian", weight, ridge, errors)
    rows = []
    for c in carriers:
        (b0, _), (b1, _) = f0.of(c), f1.of(c)
        lo, hi = f1.interval(c)
        rows.append((c, f1.n, b0, *f0.interval(c), b1, lo, hi, lo > 0 or hi < 0, 100 * (1 - abs(b1) / (abs(b0) or 1e-9))))
    return df.sparkSession.createDataFrame(rows, "axis string, n long, beta_without double, lo_without double, hi_without double, beta_with double, lo_with double, hi_with double, survives boolean, attenuation_pct double")


def out_of_fold(df: DataFrame, y: str, xs: dict[str, Column], fold: str, folds: int, ridge: float = 1.0, keep: list[str] | None = None, iterations: int = 25) -> DataFrame:
    """keep, fold, y and p: each row's probability under a logistic fit to the rows of all other folds.

    All folds' fits share a pass: a row adds to the sums of every fold but its own.
    """
    p, q = len(xs), len(xs) + 1
    rows = design(df.withColumn("_fold", F.col(fold).cast("double")), y, xs, keep=[*(keep or []), "_fold"]).persist(StorageLevel.MEMORY_AND_DISK)
    lam, beta, size = _prior(list(xs), ridge, 1), np.zeros((folds, q)), q * q + q + 2
    names = ["_fold", "y", "w", *[f"x{k}" for k in range(p)]]
    for _ in range(iterations):

        def step(m: np.ndarray, beta=beta) -> np.ndarray:
            return np.concatenate([_bernoulli_step(m[m[:, 0] != f, 1:], beta[f], p) for f in range(folds)])

        t = _partials(rows, names, step, folds * size).reshape(folds, size)
        moves = np.stack([np.linalg.lstsq(s[: q * q].reshape(q, q) + np.diag(lam + 1e-12), s[q * q : q * q + q] - lam * b, rcond=None)[0] for s, b in zip(t, beta)])
        if np.abs(moves).max() < 1e-9:
            break
        beta = beta + moves / np.maximum(1.0, np.abs(moves).max(1, keepdims=True) / 5)
    rows.unpersist()
    own = F.get(F.lit([[float(v) for v in b] for b in beta]), F.col("_fold").cast("int"))
    eta = sum((F.get(own, F.lit(k + 1)) * F.col(f"x{k}") for k in range(p)), F.get(own, F.lit(0)))
    return rows.select(*(keep or []), F.col("_fold").cast("int").alias("fold"), "y", (1 / (1 + F.exp(-eta))).alias("p"))


def calibration_slope(df: DataFrame, y: str, p: str, eps: float = 1e-6) -> Fit:
    """y on the log odds of p: slope 1 is calibrated, less is over-confident."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return fit(df, y, {"slope": F.log(q / (1 - q))}, "bernoulli", ridge=1e-6)


def bootstrap_difference(df: DataFrame, key: str, a: str, b: str, replicates: int = 1000, mass: float = 0.95) -> DataFrame:
    """n, delta (mean of a - b), lo, hi and share_above of its bootstrap: every row weighs in each replicate by a Poisson number.

    One pass: a batch returns `replicates` pairs of sums.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, replicates))
        for m in batches:
            w = poisson_matrix(m["_k"].to_numpy().astype(np.uint64), replicates)
            d = m["_d"].to_numpy(dtype=np.float64)
            total += [d @ w, w.sum(0), np.r_[len(d), d.sum(), np.zeros(replicates - 2)]]
        yield pd.DataFrame({"r": np.arange(replicates), "s": total[0], "w": total[1], "x": total[2]})

    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.xxhash64(key).alias("_k"), (F.col(a) - F.col(b)).cast("double").alias("_d"))
    rows = d.mapInPandas(run, "r long, s double, w double, x double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("x").alias("x")).orderBy("r").collect()  # `replicates` rows
    n, total = int(rows[0]["x"]), rows[1]["x"]
    found = np.array([r["s"] / max(r["w"], 1.0) for r in rows])
    lo, hi = np.percentile(found, [50 * (1 - mass), 50 * (1 + mass)])
    return df.sparkSession.createDataFrame([(n, total / max(n, 1), float(lo), float(hi), float((found > 0).mean()))], "n long, delta double, lo double, hi double, share_above double")


def poisson_matrix(keys: np.ndarray, replicates: int) -> np.ndarray:
    """A Poisson(1) number for each key and replicate, the same wherever the key is met."""
    u = np.uint64
    r = np.arange(1, replicates + 1, dtype=np.uint64) * u(0x9E3779B97F4A7C15)
    h = keys[:, None] ^ r[None]
    h ^= h >> u(30)
    h *= u(0xBF58476D1CE4E5B9)
    h ^= h >> u(27)
    h *= u(0x94D049BB133111EB)
    h ^= h >> u(31)
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(edges, (h >> u(11)).astype(np.float64) / float(1 << 53), side="right").astype(np.float64)


def placements(df: DataFrame, y: str, p: str) -> DataFrame:
    """df with {p}_place: for a row of either class, the share of the other class that its score is on the right side of
    (ties half): their mean over a class is the AUC. By counts of distinct scores."""
    from quillon.operators.ordered import joined_by, sums_before

    one, zero = F.col(y) == 1, F.col(y) == 0
    have = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    c = have.groupBy(p).agg(F.count_if(one).alias("k1"), F.count_if(zero).alias("k0"))
    total = c.agg(F.sum("k1").alias("n1"), F.sum("k0").alias("n0"))
    s = sums_before(c, [], p, ["k1", "k0"]).crossJoin(F.broadcast(total))
    below = (F.col("k0_before") + F.col("k0") / 2.0) / F.col("n0")
    above = 1 - (F.col("k1_before") + F.col("k1") / 2.0) / F.col("n1")
    told = s.select(p, below.alias("_b"), above.alias("_a"))
    return joined_by(have, told, [p]).withColumn(f"{p}_place", F.when(one, F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b")


def paired_auc(df: DataFrame, key: str, y: str, p_ref: str, p_new: str, replicates: int = 2000, mass: float = 0.94) -> DataFrame:
    """n, delta (AUC of p_new less that of p_ref), lo, hi and share_above of its bootstrap over rows.

    Replicates weigh rows by Poisson numbers; in each, the AUC is that of all rows plus the weighted means of both classes'
    placements about it - the bootstrap to first order, which needs one pass in place of a ranking for each replicate.
    """
    d = placements(placements(df, y, p_ref), y, p_new)
    d = d.select(F.xxhash64(key).alias("_k"), F.col(y).cast("double").alias("_y"), (F.col(f"{p_new}_place") - F.col(f"{p_ref}_place")).alias("_d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, replicates))
        plain = np.zeros(4)
        for m in batches:
            w = poisson_matrix(m["_k"].to_numpy().astype(np.uint64), replicates)
            y_, d_ = m["_y"].to_numpy() == 1, m["_d"].to_numpy(dtype=np.float64)
            total += [d_[y_] @ w[y_], w[y_].sum(0), d_[~y_] @ w[~y_], w[~y_].sum(0)]
            plain += [d_[y_].sum(), y_.sum(), d_[~y_].sum(), (~y_).sum()]
        yield pd.DataFrame(dict(zip(["r", "a", "b", "c", "d"], [np.arange(replicates + 1), *np.c_[total, plain]])))

    rows = d.mapInPandas(run, "r long, a double, b double, c double, d double").groupBy("r").agg(*[F.sum(c).alias(c) for c in "abcd"]).orderBy("r").collect()  # `replicates` rows and one
    s = np.array([[r[c] for c in "abcd"] for r in rows])
    whole = s[-1]
    base = (whole[0] / whole[1] + whole[2] / whole[3]) / 2
    ones, zeros = s[:-1, 0] / np.maximum(s[:-1, 1], 1), s[:-1, 2] / np.maximum(s[:-1, 3], 1)
    found = base + (ones - whole[0] / whole[1]) + (zeros - whole[2] / whole[3])
    lo, hi = np.percentile(found, [50 * (1 - mass), 50 * (1 + mass)])
    return df.sparkSession.createDataFrame([(int(whole[1] + whole[3]), float(base), float(lo), float(hi), float((found > 0).mean()))], "n long, delta double, lo double, hi double, share_above double")


def margin_verdict(lo: Column, hi: Column, margin: float) -> Column:
    """What an interval says about a margin: the raw data add, the latent ones do better, either suffices, or nothing."""
    return F.when(lo > margin, "raw-adds").when(hi < -margin, "latent-better").when((lo >= -margin) & (hi <= margin), "sufficient").otherwise("inconclusive")


def residualised(df: DataFrame, y: str, xs: dict[str, Column]) -> DataFrame:
    """df with {y}_res: y less its least-squares fit on a constant and the terms, from rows that have all of them; null elsewhere.

    A fit needs two more rows than it has terms; with fewer y stays as it is.
    """
    f = fit(df, y, xs)
    if f.n < len(f.terms) + 2:
        return df.withColumn(f"{y}_res", F.col(y).cast("double"))
    line = sum((F.lit(float(b)) * c for b, c in zip(f.coef[1:], xs.values())), F.lit(float(f.coef[0])))
    return df.withColumn(f"{y}_res", F.col(y) - line)


def spline(x: Column, knots: list[float], low: float, high: float, degree: int = 3) -> list[Column]:
    """The B-spline basis functions of x on [low, high], by the recursion of de Boor; x is held inside the range."""
    t = [low] * (degree + 1) + list(knots) + [high] * (degree + 1)
    v = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    last = max(k for k in range(len(t) - 1) if t[k] < t[k + 1])
    out = [((v >= t[k]) & ((v < t[k + 1]) | (F.lit(k == last) & (v <= t[k + 1])))).cast("double") for k in range(len(t) - 1)]
    for p in range(1, degree + 1):
        nxt = []
        for k in range(len(out) - 1):
            left = (v - t[k]) / (t[k + p] - t[k]) * out[k] if t[k + p] > t[k] else F.lit(0.0)
            right = (t[k + p + 1] - v) / (t[k + p + 1] - t[k + 1]) * out[k + 1] if t[k + p + 1] > t[k + 1] else F.lit(0.0)
            nxt.append(left + right)
        out = nxt
    return out


def worst_of(criteria: list[tuple[Column, float, float, bool]]) -> Column:
    """PASS, CONDITIONAL or FAIL: the worst of criteria (value, bound to pass, bound to be conditional, whether more is better)."""
    grades = [F.when(v >= a, 2).when(v >= b, 1).otherwise(0) if up else F.when(v < a, 2).when(v < b, 1).otherwise(0) for v, a, b, up in criteria]
    low = F.least(*grades)
    return F.when(low == 2, "PASS").when(low == 1, "CONDITIONAL").otherwise("FAIL")


def incremental_density(df: DataFrame, y: str, base: dict[str, Column], full: dict[str, Column], key: str, family: str = "bernoulli", weight: Column | None = None, ridge: float = 1.0) -> DataFrame:
    """n, d, se and verdict: the gain in left-out log density of the terms that `full` has beyond `base`."""
    from quillon.operators.metrics import incremental_verdict, paired_difference

    parts = [left_out(df, y, xs, fit(df, y, xs, family, weight, ridge), weight, [key]).withColumnRenamed("elpd", n) for xs, n in ((base, "e0"), (full, "e1"))]
    out = paired_difference(parts[0].join(parts[1], key), "e1", "e0")
    return out.withColumn("verdict", incremental_verdict(F.col("d"), F.col("se")))
