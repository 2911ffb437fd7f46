"""Latent scores and mixtures. Small dense algebra runs once per missingness pattern or per batch; sums are Spark's.

Parameters (loadings, axes, centres) are matrices whose size doesn't depend on the number of rows; they travel with the
functions. Iterations read a table written once and return partial sums of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import logsumexp


def _matrix(rows: pd.DataFrame, items: list[str]) -> np.ndarray:
    return rows[items].to_numpy(dtype=np.float64, na_value=np.nan)


def conditional_scores(df: DataFrame, keys: list[str], items: list[str], loadings: np.ndarray, phi: np.ndarray, sigma: np.ndarray, factors: list[str], hdi: float = 0.94) -> DataFrame:
    """keys and {factor}__mean, __sd, __hdi_lo, __hdi_hi, n_obs: factors given the observed cells of a Gaussian model.

    Regression and covariance depend on which cells are there only, so a batch decomposes each pattern once. A row
    without cells has mean 0 and the prior's deviation.
    """
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - (1 - hdi) / 2)
    names = [f"{f}__{s}" for f in factors for s in ("mean", "sd", "hdi_lo", "hdi_hi")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = _matrix(rows, items)
            seen = ~np.isnan(x)
            mean, sd = np.zeros((len(x), len(factors))), np.empty((len(x), len(factors)))
            kinds, which = np.unique(seen, axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                at, on = np.flatnonzero(which.reshape(-1) == k), np.flatnonzero(kind)
                lam = loadings[on]
                # precision form: F x F, whatever the number of items
                cov = np.linalg.inv(np.linalg.inv(phi) + (lam / sigma[on, None] ** 2).T @ lam)
                mean[at] = x[np.ix_(at, on)] @ (lam / sigma[on, None] ** 2) @ cov
                sd[at] = np.sqrt(np.clip(np.diag(cov), 0, None))
            cols = np.stack([mean, sd, mean - z * sd, mean + z * sd], axis=2).reshape(len(x), -1)
            yield pd.concat([rows[keys].reset_index(drop=True), pd.DataFrame(cols, columns=names), pd.DataFrame({"n_obs": seen.sum(1)})], axis=1)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    return df.select(*keys, *items).mapInPandas(run, ", ".join([*kept, *[f"{n} double" for n in names], "n_obs bigint"]))


def observed_loglik(df: DataFrame, keys: list[str], items: list[str], loadings: np.ndarray, phi: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """keys, loglik of the observed cells under the marginal Gaussian, through a factors x factors Cholesky factor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = np.linalg.cholesky(phi)
        for rows in batches:
            x = _matrix(rows, items)
            seen, out = ~np.isnan(x), np.zeros(len(x))
            kinds, which = np.unique(seen, axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                at, on = np.flatnonzero(which.reshape(-1) == k), np.flatnonzero(kind)
                l, psi = loadings[on] @ root, sigma[on] ** 2
                low = np.linalg.cholesky(np.eye(phi.shape[0]) + (l / psi[:, None]).T @ l)
                xo = x[np.ix_(at, on)]
                u = np.linalg.solve(low, ((xo / psi) @ l).T)
                out[at] = -0.5 * (len(on) * np.log(2 * np.pi) + np.log(psi).sum() + 2 * np.log(np.diag(low)).sum() + (xo**2 / psi).sum(1) - (u**2).sum(0))
            yield rows[keys].assign(loglik=out)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
    return df.select(*keys, *items).mapInPandas(run, ", ".join([*kept, "loglik double"]))


def simplex_weights(x: np.ndarray, z: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights w >= 0 that sum to 1 and minimise |x - w z|^2, by accelerated projection on the simplex."""
    gram, cross = z @ z.T, x @ z.T
    step = 1.0 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    w = y = np.full((len(x), len(z)), 1.0 / len(z))
    t = 1.0
    for _ in range(steps):
        v = y - step * (y @ gram - cross)
        u = -np.sort(-v, axis=1)
        c = (np.cumsum(u, axis=1) - 1) / np.arange(1, len(z) + 1)
        k = (u > c).sum(1)
        new = np.maximum(v - c[np.arange(len(v)), k - 1][:, None], 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def project_on_anchors(df: DataFrame, key: str, axes: list[str], anchors: np.ndarray) -> DataFrame:
    """key, weights, rss: each row as a mixture of fixed anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = _matrix(rows, axes)
            w = simplex_weights(x, anchors)
            yield pd.DataFrame({key: rows[key], "weights": list(w), "rss": ((x - w @ anchors) ** 2).sum(1)})

    return df.select(key, *axes).mapInPandas(run, f"{key} bigint, weights array<double>, rss double")


def _partials(df: DataFrame, columns: list[str], step, size: int) -> np.ndarray:
    """The sum over all rows of step(matrix) - a vector of `size` numbers a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for rows in batches:
            total += step(_matrix(rows, columns))
        yield pd.DataFrame({"k": np.arange(size), "v": total})

    rows = df.select(*columns).mapInPandas(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # `size` numbers
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def xd_mixture(df: DataFrame, axes: list[str], noise: list[str], start: np.ndarray, iterations: int = 50, tol: float = 1e-5, reg: float = 1e-4) -> dict:
    """Extreme deconvolution: x ~ sum of pi_k N(mu_k, V_k + S_row), S_row diagonal and known. Starts at the given centres.

    Each iteration is one pass that returns K x (1 + D + D^2) sums; the rest is done on the driver.
    """
    (k, d), n = start.shape, df.count()
    pi, mu, v = np.full(k, 1 / k), start.astype(float).copy(), np.stack([np.eye(d)] * k)
    prev, ll, it = -np.inf, -np.inf, 0
    for it in range(1, iterations + 1):

        def step(m: np.ndarray, pi=pi, mu=mu, v=v) -> np.ndarray:
            x, s = m[:, :d], m[:, d:] ** 2
            log, b, cov = np.empty((len(x), k)), np.empty((k, len(x), d)), np.empty((k, len(x), d, d))
            for j in range(k):
                t = np.linalg.inv(v[j][None] + np.einsum("nd,de->nde", s, np.eye(d)))
                diff = x - mu[j]
                log[:, j] = np.log(pi[j] + 1e-300) - 0.5 * (d * np.log(2 * np.pi) - np.linalg.slogdet(t)[1] + np.einsum("nd,nde,ne->n", diff, t, diff))
                g = v[j][None] @ t
                b[j] = mu[j] + np.einsum("nde,ne->nd", g, diff)
                cov[j] = v[j][None] - g @ v[j][None]
            top = log.max(1, keepdims=True)
            r = np.exp(log - top)
            z = r.sum(1, keepdims=True)
            r /= z
            second = [np.einsum("n,nde->de", r[:, j], cov[j] + np.einsum("nd,ne->nde", b[j], b[j])) for j in range(k)]
            return np.concatenate([[float((top + np.log(z)).sum())], r.sum(0), np.einsum("nk,knd->kd", r, b).ravel(), np.ravel(second)])

        total = _partials(df, axes + noise, step, 1 + k + k * d + k * d * d)
        ll, nk = total[0], total[1 : 1 + k] + 1e-12
        pi, mu = nk / n, total[1 + k : 1 + k + k * d].reshape(k, d) / nk[:, None]
        second = total[1 + k + k * d :].reshape(k, d, d) / nk[:, None, None]
        v = second - np.einsum("kd,ke->kde", mu, mu) + reg * np.eye(d)
        if ll - prev < tol * abs(prev):
            break
        prev = ll
    p = (k - 1) + k * d + k * d * (d + 1) // 2
    return {"pi": pi, "mu": mu, "V": v, "loglik": ll, "bic": -2 * ll + p * np.log(n), "n_iter": it}


def xd_fixed(df: DataFrame, axes: list[str], noise: list[str], label: str, iterations: int = 60, reg: float = 1e-4) -> dict:
    """Deconvolved normal components of a given partition: the mixture's likelihood with each row's component pinned to its label.

    A pass returns, for each label, sums of posterior means and second moments, as `xd_mixture` does. Labels are few.
    """
    stats = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(axes) for j, b in enumerate(axes)]).orderBy(label).collect()
    k, d = len(stats), len(axes)
    n = sum(r["n"] for r in stats)
    pi, mu = np.array([r["n"] / n for r in stats]), np.array([[r[f"m{i}"] for i in range(d)] for r in stats], dtype=float)
    v = np.stack([np.array([[r[f"c{i}_{j}"] for j in range(d)] for i in range(d)], dtype=float) + reg * np.eye(d) if r["n"] > d else np.eye(d) for r in stats])
    code = F.array_position(F.lit([r[label] for r in stats]), F.col(label)) - 1
    rows = df.select(*axes, *noise, code.cast("double").alias("_c"))
    ll = 0.0
    for _ in range(iterations):

        def step(m: np.ndarray, mu=mu, v=v) -> np.ndarray:
            x, s, c = m[:, :d], m[:, d : 2 * d] ** 2, m[:, -1].astype(int)
            log, first, second = np.empty((len(x), k)), np.zeros((k, d)), np.zeros((k, d, d))
            for j in range(k):
                t = np.linalg.inv(v[j][None] + np.einsum("nd,de->nde", s, np.eye(d)))
                diff = x - mu[j]
                log[:, j] = np.log(pi[j] + 1e-300) - 0.5 * (d * np.log(2 * np.pi) - np.linalg.slogdet(t)[1] + np.einsum("nd,nde,ne->n", diff, t, diff))
                own = c == j
                g = v[j][None] @ t[own]
                b = mu[j] + np.einsum("nde,ne->nd", g, diff[own])
                first[j] = b.sum(0)
                second[j] = (v[j][None] - g @ v[j][None]).sum(0) + b.T @ b
            top = log.max(1, keepdims=True)
            return np.concatenate([[float((top[:, 0] + np.log(np.exp(log - top).sum(1))).sum())], first.ravel(), second.ravel()])

        total = _partials(rows, [*axes, *noise, "_c"], step, 1 + k * d + k * d * d)
        ll, counts = total[0], pi * n
        mu = total[1 : 1 + k * d].reshape(k, d) / counts[:, None]
        v = total[1 + k * d :].reshape(k, d, d) / counts[:, None, None] - np.einsum("kd,ke->kde", mu, mu) + reg * np.eye(d)
    p = (k - 1) + k * d + k * d * (d + 1) // 2
    return {"labels": [r[label] for r in stats], "pi": pi, "mu": mu, "V": v, "loglik": ll, "bic": -2 * ll + p * np.log(n)}


def responsibilities(df: DataFrame, key: str, axes: list[str], noise: list[str], model: dict) -> DataFrame:
    """key, weights: each row's posterior shares of a mixture's components, under its own noise."""
    pi, mu, v = model["pi"], model["mu"], model["V"]
    k, d = mu.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, s = _matrix(rows, axes), _matrix(rows, noise) ** 2
            log = np.empty((len(x), k))
            for j in range(k):
                t = np.linalg.inv(v[j][None] + np.einsum("nd,de->nde", s, np.eye(d)))
                diff = x - mu[j]
                log[:, j] = np.log(pi[j] + 1e-300) + 0.5 * (np.linalg.slogdet(t)[1] - np.einsum("nd,nde,ne->n", diff, t, diff))
            w = np.exp(log - log.max(1, keepdims=True))
            yield pd.DataFrame({key: rows[key], "weights": list(w / w.sum(1, keepdims=True))})

    return df.select(key, *axes, *noise).mapInPandas(run, f"{key} bigint, weights array<double>")


def choose_groups(df: DataFrame, key: str, axes: list[str], noise: list[str], ks: range, seeds: tuple[int, ...] = (1, 2), iterations: int = 20) -> DataFrame:
    """k, bic, confident, seed_ari and chosen: the least k with half of the rows confident and partitions that agree between starts.

    Starts are rows in the order of digests of the key and the seed.
    """
    from quillon.operators.aggregate import adjusted_rand

    def started(k: int, seed: int) -> np.ndarray:
        picked = df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(k).select(*axes).collect()
        return np.array([[r[a] for a in axes] for r in picked], dtype=float)

    rows = []
    for k in ks:
        fits = [xd_mixture(df, axes, noise, started(k, s), iterations) for s in (0, *seeds)]
        parts = [responsibilities(df, key, axes, noise, f) for f in fits]
        label = lambda p: F.array_position(p, F.array_max(p))
        confident = parts[0].agg(F.avg((F.array_max("weights") > 0.5).cast("double")).alias("c")).first()["c"]
        base = parts[0].select(key, label(F.col("weights")).alias("a"))
        aris = [adjusted_rand(base.join(p.select(key, label(F.col("weights")).alias("b")), key), "a", "b").first()["ari"] for p in parts[1:]]
        rows.append((k, float(fits[0]["bic"]), float(confident), float(np.mean([1.0 if a is None else a for a in aris]))))
    good = [r for r in rows if r[2] >= 0.5 and r[3] >= 0.8]
    chosen = min(good)[0] if good else max(rows, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame([(*r, chosen) for r in rows], "k int, bic double, confident double, seed_ari double, chosen int")


def factor_em(df: DataFrame, items: list[str], factors: int, iterations: int = 30, seed: int = 0) -> dict:
    """Maximum-likelihood loadings and noise of standardised items with missing cells, by EM: the map without its posterior.

    A pass returns, for every item, sums over rows that have it: x^2, x E[f], E[f f'].
    """
    j, f = len(items), factors
    lam, psi = np.random.default_rng(seed).normal(0, 0.3, (j, f)), np.full(j, 0.5)
    ll = 0.0
    for _ in range(iterations):

        def step(x: np.ndarray, lam=lam, psi=psi) -> np.ndarray:
            seen = ~np.isnan(x)
            x2, xf, ff, n, total = np.zeros(j), np.zeros((j, f)), np.zeros((j, f, f)), np.zeros(j), 0.0
            kinds, which = np.unique(seen, axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                at, on = np.flatnonzero(which.reshape(-1) == k), np.flatnonzero(kind)
                if not len(on):
                    continue
                xo, lo = x[np.ix_(at, on)], lam[on]
                prec = np.eye(f) + (lo / psi[on, None]).T @ lo
                cov = np.linalg.inv(prec)
                mean = (xo / psi[on]) @ lo @ cov
                e = len(at) * cov + mean.T @ mean
                x2[on] += (xo**2).sum(0)
                xf[on] += xo.T @ mean
                ff[on] += e
                n[on] += len(at)
                total += -0.5 * (len(at) * (len(on) * np.log(2 * np.pi) + np.log(psi[on]).sum() + np.linalg.slogdet(prec)[1]) + (xo**2 / psi[on]).sum() - np.einsum("nf,fg,ng->", mean, prec, mean))
            return np.concatenate([[total], n, x2, xf.ravel(), ff.ravel()])

        t = _partials(df, items, step, 1 + 2 * j + j * f + j * f * f)
        ll, n, x2 = t[0], np.maximum(t[1 : 1 + j], 1), t[1 + j : 1 + 2 * j]
        xf, ff = t[1 + 2 * j : 1 + 2 * j + j * f].reshape(j, f), t[1 + 2 * j + j * f :].reshape(j, f, f)
        lam = np.stack([np.linalg.solve(ff[i] + 1e-9 * np.eye(f), xf[i]) for i in range(j)])
        psi = np.maximum((x2 - np.einsum("jf,jf->j", lam, xf)) / n, 1e-3)
    return {"loadings": lam, "psi": psi, "loglik": ll}


def nearest_neighbours(df: DataFrame, key: str, axes: list[str], variances: list[str], k: int, block: int = 2048) -> DataFrame:
    """key, rank, neighbour, d2: the k rows of least sum (a - b)^2 / (va + vb + 1e-3), itself not counted.

    Rows are cut into blocks of about `block`, as many as there are rows for; each pair of blocks is one group that keeps k
    of each row, and k of these are merged. Exact, so work is all pairs; no group grows with the table.
    """
    blocks = max(1, -(-df.count() // block))
    both = df.select(key, *axes, *variances).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    a = both.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_q", F.lit(1))
    b = both.withColumn("_w", F.col("_b")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_q", F.lit(0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows["_q"] == 1], rows[rows["_q"] == 0]
        out = []
        x, y, vx, vy = (_matrix(r, cols) for r, cols in ((q, axes), (c, axes), (q, variances), (c, variances)))
        qk, ck = q[key].to_numpy(), c[key].to_numpy()
        for s in range(0, len(x), 256):
            e = slice(s, s + 256)
            d2 = ((x[e, None] - y[None]) ** 2 / (vx[e, None] + vy[None] + 1e-3)).sum(2)
            d2[qk[e, None] == ck[None]] = np.inf
            order = np.lexsort((np.broadcast_to(ck, d2.shape), d2), axis=1)[:, :k]
            out.append(pd.DataFrame({key: np.repeat(qk[e], order.shape[1]), "neighbour": ck[order].ravel(), "d2": np.take_along_axis(d2, order, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({key: [], "neighbour": [], "d2": []})

    part = a.unionByName(b).groupBy("_b", "_w").applyInPandas(run, f"{key} bigint, neighbour bigint, d2 double").where(F.col("d2") < float("inf"))
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy("d2", "neighbour"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "neighbour", "d2")


def prior_grid(items: DataFrame, factors: list[str]) -> DataFrame:
    """item, factor, prior_type, prior_mean, prior_sd: every item's tier on every factor. items: item, home, window (or null)."""
    grid = items.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    tier = F.when(F.col("factor") == F.col("home"), "strong").when(F.col("factor") == factors[0], "general").when(F.col("factor") == F.col("window"), "window").otherwise("unlikely")
    value = lambda of: F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), tier)
    return grid.select("item", "factor", tier.alias("prior_type"), value({"strong": 0.7, "general": 0.4, "window": 0.2, "unlikely": 0.0}).alias("prior_mean"), value({"strong": 0.2, "general": 0.25, "window": 0.2, "unlikely": 0.05}).alias("prior_sd"))


def r_hat(draws: DataFrame, by: list[str], chain: str, value: str) -> DataFrame:
    """by, r_hat from chains of equal length: between- and within-chain variances of a long draws table."""
    c = draws.groupBy(*by, chain).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    g = c.groupBy(*by).agg(F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.avg("n").alias("n"))
    return g.select(*by, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("r_hat"))


def waic(loglik: DataFrame, row: str, value: str) -> DataFrame:
    """n, elpd, p_waic, waic, se of a long (draw, row, log-likelihood) table; sample variance over draws."""
    top = loglik.groupBy(row).agg(F.max(value).alias("_t"))
    p = loglik.join(top, row).groupBy(row).agg((logsumexp(F.col(value), F.col("_t")) - F.log(F.count("*"))).alias("lppd"), F.var_samp(value).alias("p"))
    p = p.withColumn("e", F.col("lppd") - F.col("p"))
    return p.agg(F.count("*").alias("n"), F.sum("e").alias("elpd"), F.sum("p").alias("p_waic"), (-2 * F.sum("e")).alias("waic"), (2 * F.sqrt(F.count("*") * F.var_pop("e"))).alias("se"))


def usefulness(df: DataFrame, weights: str, k: int, tau: float = 0.5) -> DataFrame:
    """One row over soft memberships: confident share, median normalised entropy, boundary share, perplexity."""
    from quillon.operators.ordered import median

    weights = F.col(weights)
    raw = F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.greatest(w, F.lit(1e-12)) * F.log(F.greatest(w, F.lit(1e-12))))
    top = F.array_max(weights)
    rows = df.select(raw.alias("h"), top.alias("top"))
    shares = rows.agg(F.avg((F.col("top") > tau).cast("double")).alias("confident"), F.avg((F.col("top") < 1 / k + 0.05).cast("double")).alias("boundary"), F.exp(F.avg("h")).alias("effective"))
    middle = median(rows, [], "h").select((F.col("h_median") / float(np.log(k))).alias("median_entropy"))
    return shares.crossJoin(F.broadcast(middle)).select("confident", "median_entropy", "boundary", "effective")
