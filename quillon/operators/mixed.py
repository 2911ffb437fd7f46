"""Likelihoods of mixed items, priors of loadings and correlations, draws, and what items tell about axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import gammln
from quillon.operators.latent import _matrix


def bernoulli_loglik(y: Column, eta: Column) -> Column:
    """log p of a 0/1 outcome under log odds eta."""
    return y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))


def negative_binomial_loglik(y: Column, mu: Column, alpha: Column) -> Column:
    """log p of a count with mean mu and variance mu + mu^2 / alpha."""
    return gammln(y + alpha) - gammln(alpha) - gammln(y + 1.0) + alpha * F.log(alpha / (alpha + mu)) + y * F.log(mu / (alpha + mu))


def hurdle_loglik(y: Column, present: Column, mu: Column, alpha: Column) -> Column:
    """log p of a count that is 0 with log odds -present, and else a negative binomial without its 0."""
    none = alpha * F.log(alpha / (alpha + mu))
    some = negative_binomial_loglik(y, mu, alpha) - F.log(-F.expm1(none))
    return F.when(y == 0, bernoulli_loglik(F.lit(0.0), present)).otherwise(bernoulli_loglik(F.lit(1.0), present) + some)


def ordered_loglik(y: Column, eta: Column, cuts: list[float]) -> Column:
    """log p of a level 0 to len(cuts) under proportional odds: P(y <= k) = logistic(cut_k - eta)."""
    below = lambda c: 1 / (1 + F.exp(eta - c))
    out = F.when(y == 0, F.log(below(cuts[0])))
    for k in range(1, len(cuts)):
        out = out.when(y == k, F.log(below(cuts[k]) - below(cuts[k - 1])))
    return out.when(y == len(cuts), F.log(1 - below(cuts[-1])))


def vine_correlation(partial: np.ndarray) -> np.ndarray:
    """A correlation matrix from the canonical partial correlations below its diagonal, by a vine's recursion on a Cholesky factor."""
    d = len(partial)
    low = np.zeros((d, d))
    low[0, 0] = 1.0
    for i in range(1, d):
        left = 1.0
        for j in range(i):
            low[i, j] = partial[i, j] * np.sqrt(left)
            left -= low[i, j] ** 2
        low[i, i] = np.sqrt(max(left, 0.0))
    return low @ low.T


def beside_general(corr: np.ndarray) -> np.ndarray:
    """Correlations of a general axis, which is orthogonal to all others, and of these."""
    out = np.eye(len(corr) + 1)
    out[1:, 1:] = corr
    return out


def shrunk_scale(local: Column, overall: float, slab: float) -> Column:
    """Deviation of a cross loading under a regularised horseshoe: local times overall, held below the slab's."""
    l2 = local * local
    return overall * F.sqrt(slab * slab * l2 / (slab * slab + overall * overall * l2))


def conditional_draws(df: DataFrame, keys: list[str], items: list[str], loadings: np.ndarray, phi: np.ndarray, sigma: np.ndarray, factors: list[str], draws: int, seed: int = 0) -> DataFrame:
    """keys, draw and the factors: draws from the factors' joint posterior given the observed cells, coherent in a draw.

    Noise comes from hashes of the keys, the draw and the axis, so a row's draws do not depend on its batch or partition.
    A row without cells is drawn from the prior.
    """
    k = len(factors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = _matrix(rows, items)
            seen = ~np.isnan(x)
            mean, root = np.zeros((len(x), k)), np.empty((len(x), k, k))
            kinds, which = np.unique(seen, axis=0, return_inverse=True)
            for j, kind in enumerate(kinds):
                at, on = np.flatnonzero(which.reshape(-1) == j), np.flatnonzero(kind)
                lam = loadings[on] / sigma[on, None] ** 2
                cov = np.linalg.inv(np.linalg.inv(phi) + lam.T @ loadings[on])
                mean[at], root[at] = x[np.ix_(at, on)] @ lam @ cov, np.linalg.cholesky(cov)
            noise = _normals(rows["_h"].to_numpy().astype(np.uint64), draws, k, seed)
            f = mean[:, None] + np.einsum("nij,ndj->ndi", root, noise)
            out = {c: np.repeat(rows[c].to_numpy(), draws) for c in keys} | {"draw": np.tile(np.arange(draws), len(rows))}
            yield pd.DataFrame(out | {name: f[:, :, j].ravel() for j, name in enumerate(factors)})

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    return df.select(*keys, *items, F.xxhash64(*keys).alias("_h")).mapInPandas(run, ", ".join([*kept, "draw bigint", *[f"{f} double" for f in factors]]))


def _normals(keys: np.ndarray, draws: int, axes: int, seed: int) -> np.ndarray:
    """Standard normal numbers [key, draw, axis], by the polar form of two uniform hashes each."""
    u = np.uint64

    def uniform(turn: int) -> np.ndarray:
        n = np.arange(draws * axes, dtype=np.uint64) * u(2) + u(turn)
        h = keys[:, None] ^ ((n + u(1)) * u(0x9E3779B97F4A7C15) + u(seed) * u(0xD6E8FEB86659FD93))[None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> u(shift))) * u(factor)
        return ((h >> u(11)).astype(np.float64) + 0.5) / float(1 << 53)

    return (np.sqrt(-2 * np.log(uniform(0))) * np.cos(2 * np.pi * uniform(1))).reshape(len(keys), draws, axes)


def localization(loadings: np.ndarray, phi: np.ndarray, sigma: np.ndarray, order: list[int]) -> list[np.ndarray]:
    """Posterior covariances after the first 0, 1, ... items of an order: precisions add, whatever the answers."""
    precision = np.linalg.inv(phi)
    out = [np.linalg.inv(precision)]
    for j in order:
        precision = precision + np.outer(loadings[j], loadings[j]) / sigma[j] ** 2
        out.append(np.linalg.inv(precision))
    return out


def greedy_battery(loadings: np.ndarray, phi: np.ndarray, sigma: np.ndarray, most: int | None = None) -> list[tuple[int, float]]:
    """(item, mean reliability of all axes so far) in the order in which each next item adds most; the least index of equals."""
    left, order, out = list(range(len(loadings))), [], []
    prior = np.diag(phi)
    precision = np.linalg.inv(phi)
    while left and len(order) < (most or len(loadings)):
        gains = [float((1 - np.diag(np.linalg.inv(precision + np.outer(loadings[j], loadings[j]) / sigma[j] ** 2)) / prior).mean()) for j in left]
        k = int(np.argmax(np.round(gains, 12)))
        j = left.pop(k)
        precision = precision + np.outer(loadings[j], loadings[j]) / sigma[j] ** 2
        order.append(j)
        out.append((j, gains[k]))
    return out


def block_mass(df: DataFrame, contributions: dict[str, Column], blocks: dict[str, str]) -> DataFrame:
    """block, mass: the share of the summed absolute contributions that a block's columns make up."""
    cells = F.array(*[F.struct(F.lit(blocks[c]).alias("block"), F.abs(v).cast("double").alias("v")) for c, v in contributions.items()])
    by = df.select(F.explode(cells).alias("c")).groupBy("c.block").agg(F.sum("c.v").alias("v"))
    total = by.agg(F.sum("v").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("block", (F.col("v") / F.col("all")).alias("mass"))


def yeo_johnson(x: Column, power: Column) -> Column:
    """The power transform of values of either sign."""
    up = F.when(F.abs(power) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, power) - 1) / power)
    two = 2 - power
    down = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, two) - 1) / two)
    return F.when(x >= 0, up).otherwise(down)


def best_power(df: DataFrame, item: str, low: float = -2.0, high: float = 4.0, step: float = 0.05) -> DataFrame:
    """n, power, loglik: the power of the grid under which the transformed values are most likely normal; one pass for all."""
    grid = np.round(np.arange(low, high + step / 2, step), 10)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, s2, n, jac = np.zeros(len(grid)), np.zeros(len(grid)), 0, 0.0
        for b in batches:
            x = b["x"].to_numpy(dtype=np.float64)
            up, down = x[x >= 0], x[x < 0]
            for k, p in enumerate(grid):
                y = np.concatenate([np.log1p(up) if abs(p) < 1e-9 else ((up + 1) ** p - 1) / p, -np.log1p(-down) if abs(2 - p) < 1e-9 else -((1 - down) ** (2 - p) - 1) / (2 - p)])
                s[k] += y.sum()
                s2[k] += (y * y).sum()
            n += len(x)
            jac += float(np.log1p(up).sum() - np.log1p(-down).sum())
        yield pd.DataFrame({"power": grid, "s": s, "s2": s2, "n": n, "j": jac})

    rows = df.where(F.col(item).isNotNull()).select(F.col(item).cast("double").alias("x")).mapInPandas(run, "power double, s double, s2 double, n long, j double")
    t = rows.groupBy("power").agg(*[F.sum(c).alias(c) for c in ("s", "s2", "n", "j")])
    n = F.col("n").cast("double")
    ll = -n / 2 * F.log(F.col("s2") / n - (F.col("s") / n) ** 2) + (F.col("power") - 1) * F.col("j")
    return t.select("n", "power", ll.alias("loglik")).orderBy(F.desc("loglik"), "power").limit(1)


def convergence_gate(r_hat: Column, effective: Column, divergences: Column) -> Column:
    """clean, usable or fail, from the worst of R-hat, effective sample size and the number of divergent draws."""
    fail = (r_hat > 1.05) | (effective < 100) | (divergences > 2)
    return F.when(fail, "fail").when((r_hat > 1.01) | (effective < 400) | (divergences > 0), "usable").otherwise("clean")
