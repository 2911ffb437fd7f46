"""Structure of the latent cloud, archetypes, components of variance, permutations, frozen maps, provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import normal_ppf
from quillon.operators.latent import _matrix, _partials, simplex_weights
from quillon.operators.ordered import quantiles, with_place


def structure_verdict(hopkins: Column, silhouette: Column, bic_falls: Column, gap_k: Column, dip_p: Column, clusters: Column, noise: Column) -> tuple[Column, Column]:
    """(signals of six, verdict): clustered only on converging evidence, continuum by default."""
    signals = [hopkins > 0.75, silhouette > 0.25, ~bic_falls, gap_k > 1, dip_p < 0.05, (clusters >= 2) & (noise < 0.5)]
    score = sum((s.cast("int") for s in signals), F.lit(0))
    return score, F.when((score >= 4) & (silhouette > 0.2), "clustered").when((score <= 2) | (silhouette < 0.15), "continuum").otherwise("weak/ambiguous (lean continuum)")


def hopkins(df: DataFrame, key: str, axes: list[str], sample: int = 150, repeats: int = 5) -> DataFrame:
    """hopkins: u / (u + w) of nearest-neighbour distances from uniform points and from sampled rows, the mean of `repeats`.

    The samples (in the order of digests of the key and the repeat) and the uniform points (inside the axes' ranges, from
    digests) are a stated number of points; they meet all rows in batches, and minima are taken map-side.
    """
    lo_hi = df.agg(*[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(a) for a in axes]).first()
    picked = [(k, r) for k in range(repeats) for r in df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(k)))), key).limit(sample).select(key, *axes).collect()]
    rows = np.array([[r[a] for a in axes] for _, r in picked], dtype=float)
    keys = np.array([r[key] for _, r in picked])
    turn, place = np.array([k for k, _ in picked]), [0] * len(picked)
    for i in range(1, len(picked)):
        place[i] = place[i - 1] + 1 if turn[i] == turn[i - 1] else 0
    unit = np.array([[int(hashlib.md5(f"{k}|{p}|{a}".encode()).hexdigest()[:12], 16) / 16**12 for a in axes] for k, p in zip(turn.tolist(), place)])
    box = np.array([[lo_hi[a]["lo"], lo_hi[a]["hi"]] for a in axes], dtype=float)
    points = box[:, 0] + unit * (box[:, 1] - box[:, 0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, w = np.full(len(rows), np.inf), np.full(len(rows), np.inf)
        for b in batches:
            x = _matrix(b, axes)
            dw = ((rows[:, None] - x[None]) ** 2).sum(2)
            dw[keys[:, None] == b[key].to_numpy()[None]] = np.inf
            w, u = np.minimum(w, dw.min(1, initial=np.inf)), np.minimum(u, ((points[:, None] - x[None]) ** 2).sum(2).min(1, initial=np.inf))
        yield pd.DataFrame({"k": np.arange(len(rows)), "turn": turn, "u": u, "w": w})

    near = df.select(key, *axes).mapInPandas(run, "k long, turn long, u double, w double").groupBy("k", "turn").agg(F.sqrt(F.min("u")).alias("u"), F.sqrt(F.min("w")).alias("w"))
    return near.groupBy("turn").agg((F.sum("u") / (F.sum("u") + F.sum("w"))).alias("h")).agg(F.avg("h").alias("hopkins"))


def archetypes(df: DataFrame, axes: list[str], start: np.ndarray, iterations: int = 20, inner: int = 150) -> dict:
    """Anchors z whose mixtures fit the rows best, and the explained variance; a pass a step returns A x A and A x D sums."""
    z, (a, d) = start.astype(float).copy(), start.shape
    ev = 0.0
    for _ in range(iterations):

        def step(x: np.ndarray, z=z) -> np.ndarray:
            w = simplex_weights(x, z, inner)
            return np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel(), [((x - w @ z) ** 2).sum(), (x**2).sum(), len(x)], x.sum(0)])

        t = _partials(df, axes, step, a * a + a * d + 3 + d)
        ww, wx = t[: a * a].reshape(a, a), t[a * a : a * a + a * d].reshape(a, d)
        rss, sq, n = t[a * a + a * d : a * a + a * d + 3]
        ev = 1 - rss / (sq - (t[-d:] ** 2).sum() / n)
        z = np.linalg.solve(ww + 1e-6 * np.eye(a), wx)
    return {"anchors": z, "explained": ev}


def trait_state(df: DataFrame, keys: list[str], value: str, noise_var: float, iterations: int = 60) -> dict:
    """Between and within variances of x ~ N(mu + u_entity, sw^2 + known noise), u ~ N(0, sb^2), by EM.

    Entities with as many visits have one posterior variance, so all that an iteration needs are sums by that number:
    one aggregation for the whole fit.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_k"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    rows = per.groupBy(F.col("_k").alias("k")).agg(F.count("*").alias("n"), F.sum("_m").alias("m"), F.sum(F.col("_m") ** 2).alias("m2"), F.sum("_v").alias("v")).collect()  # a row for each number of visits
    k, n, m, m2, v = (np.array([r[c] for r in rows], dtype=float) for c in ("k", "n", "m", "m2", "v"))
    mu = m.sum() / n.sum()
    between, within = max((m2.sum() / n.sum()) - mu**2, 1e-9), max(v.sum() / n.sum(), 1e-9)
    for _ in range(iterations):
        w = within + noise_var
        post = 1 / (1 / between + k / w)
        shrink = post * k / w  # E[u] = shrink (m - mu)
        u1, u2 = shrink * (m - n * mu), n * post + shrink**2 * (m2 - 2 * mu * m + n * mu**2)
        mu = (k * (m - u1)).sum() / (k * n).sum()
        between = u2.sum() / n.sum()
        cross = shrink * (m2 - 2 * mu * m + n * mu**2)
        ss = (k * (v + (m2 - 2 * mu * m + n * mu**2) - 2 * cross + u2)).sum()
        within = max(ss / (k * n).sum() - noise_var, 1e-9)
    return {"mu": float(mu), "between": float(between), "within": float(within), "icc": float(between / (between + within)), "verdict": "trait" if between / (between + within) >= 0.6 else "state" if between / (between + within) <= 0.4 else "mixed"}


def normality_k2(df: DataFrame, items: list[str]) -> DataFrame:
    """item, n, k2: the omnibus statistic of skewness and kurtosis (chi-square of 2), from one aggregation."""
    long = df.unpivot([], items, "item", "x").where("x is not null")
    s = long.groupBy("item").agg(F.count("*").cast("double").alias("n"), F.skewness("x").alias("s"), (F.kurtosis("x") + 3).alias("b"))
    n = F.col("n")
    y = F.col("s") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    x = (F.col("b") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    g = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / g * (2 / g + F.sqrt(1 + 4 / (g * g)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.cbrt(ratio)) / F.sqrt(2 / (9 * a))
    return s.select("item", n.cast("bigint").alias("n"), (z1 * z1 + z2 * z2).alias("k2"))


def copula_knots(df: DataFrame, item: str, knots: int = 21) -> DataFrame:
    """k, x, z: frozen knots of the rank-normal map, exact quantiles at even probabilities. `knots` rows."""
    p = [(k + 0.5) / knots for k in range(knots)]
    row = quantiles(df, [], item, p).withColumnRenamed("q", "x")
    out = row.select(F.posexplode("x").alias("k", "x"))
    return out.withColumn("z", normal_ppf((F.col("k") + 0.5) / knots))


def copula_forward(df: DataFrame, item: str, knots: DataFrame) -> DataFrame:
    """df with {item}_z: piecewise linear between the knots, clamped to their support; missing stays missing."""
    k = knots.agg(F.array_sort(F.collect_list(F.struct("k", "x", "z"))).alias("_k"))
    j, x = df.crossJoin(F.broadcast(k)), F.col(item)
    at = F.size(F.filter("_k", lambda s: s["x"] <= x))
    low, high = F.get("_k", at - 1), F.get("_k", at)
    inside = low["z"] + (high["z"] - low["z"]) * (x - low["x"]) / (high["x"] - low["x"])
    z = F.when(x.isNull(), None).when(at == 0, F.get("_k", F.lit(0))["z"]).when(at == F.size("_k"), F.element_at("_k", -1)["z"]).otherwise(inside)
    return j.withColumn(f"{item}_z", z).drop("_k")


def copula_inverse(df: DataFrame, z: str, knots: DataFrame, name: str) -> DataFrame:
    """df with `name`: the value whose forward map is z, piecewise linear between the knots, clamped to their support."""
    turned = knots.select("k", F.col("z").alias("x"), F.col("x").alias("z"))
    return copula_forward(df, z, turned).withColumnRenamed(f"{z}_z", name)


def incremental_r2(df: DataFrame, y: str, base: str, extra: str) -> DataFrame:
    """n, r2_base, r2_full, gain of y ~ base and y ~ base + extra, from one set of moments."""
    d = df.where(F.col(y).isNotNull() & F.col(base).isNotNull() & F.col(extra).isNotNull())
    c = d.agg(F.count("*").alias("n"), F.corr(y, base).alias("a"), F.corr(y, extra).alias("b"), F.corr(base, extra).alias("r"))
    a, b, r = F.col("a"), F.col("b"), F.col("r")
    full = (a * a + b * b - 2 * a * b * r) / (1 - r * r)
    return c.select("n", (a * a).alias("r2_base"), full.alias("r2_full"), (full - a * a).alias("gain"))


def permuted(df: DataFrame, key: str, column: str, repeat: int) -> DataFrame:
    """df with the column permuted over all rows: the value of the row at one digest's place goes to that at another's."""
    mine = with_place(df, [], key, f"{repeat}a", "_i")
    other = with_place(df.select(key, F.col(column).alias("_v")), [], key, f"{repeat}b", "_i").select("_i", "_v")
    return mine.drop(column).join(other, "_i").withColumnRenamed("_v", column).drop("_i")


def permutation_test(df: DataFrame, key: str, y: str, base: str, extra: str, replicates: int = 1000, lot: int = 8192) -> DataFrame:
    """n, gain, null_mean, null_p95 and p_value of the gain in R2 of y ~ base + extra over y ~ base, against permutations of extra.

    A gain needs means and cross products alone, and only those with the permuted column change. Rows are dealt into lots
    of about `lot` by a hash of the key, each is permuted in itself, and a pass returns a sum for each replicate: no sort,
    no join, whatever the number of replicates.
    """
    d = df.where(F.col(y).isNotNull() & F.col(base).isNotNull() & F.col(extra).isNotNull()).select(F.xxhash64(key).alias("_k"), *[F.col(c).cast("double").alias(n) for c, n in ((y, "_y"), (base, "_b"), (extra, "_e"))])
    m = d.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{s}") for c in ("_y", "_b", "_e") for s, f in (("m", F.avg), ("s", F.stddev_pop))], F.corr("_y", "_b").alias("r")).first()
    n = m["n"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_k", kind="stable")
        y_, b_, e_ = ((rows[c].to_numpy() - m[f"{c}m"]) / (m[f"{c}s"] or 1.0) for c in ("_y", "_b", "_e"))
        rng = np.random.default_rng([int(rows["_k"].iloc[0]) & (1 << 63) - 1, len(rows)])
        out = np.empty((replicates + 1, 2))
        out[0] = y_ @ e_, b_ @ e_
        for k in range(1, replicates + 1):
            p = rng.permutation(e_)
            out[k] = y_ @ p, b_ @ p
        return pd.DataFrame({"r": np.arange(replicates + 1), "ye": out[:, 0], "be": out[:, 1]})

    lots = max(1, n // lot)
    sums = d.withColumn("_lot", F.pmod("_k", F.lit(lots))).groupBy("_lot").applyInPandas(run, "r long, ye double, be double").groupBy("r").agg(F.sum("ye").alias("ye"), F.sum("be").alias("be")).collect()  # `replicates` rows and one
    s = np.zeros((replicates + 1, 2))
    for row in sums:
        s[row["r"]] = row["ye"] / n, row["be"] / n
    r = m["r"] or 0.0
    gain = (s[:, 0] - r * s[:, 1]) ** 2 / np.maximum(1 - s[:, 1] ** 2, 1e-300)
    null = gain[1:]
    return df.sparkSession.createDataFrame([(n, float(gain[0]), float(null.mean()), float(np.percentile(null, 95)), float((1 + (null >= gain[0]).sum()) / (1 + replicates)))], "n long, gain double, null_mean double, null_p95 double, p_value double")


def implied_correlation(loadings: np.ndarray, phi: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    c = loadings @ phi @ loadings.T + np.diag(sigma**2)
    s = np.sqrt(np.diag(c))
    return c / s[:, None] / s[None]


def srmr(pairs: DataFrame, items: list[str], implied: np.ndarray) -> DataFrame:
    """n_pairs, srmr of observed pairwise correlations (a, b, r) against the model's."""
    told = pairs.sparkSession.createDataFrame([(a, b, float(implied[i, j])) for i, a in enumerate(items) for j, b in enumerate(items) if i < j], "a string, b string, m double")
    d = F.col("r") - F.col("m")
    return pairs.join(F.broadcast(told), ["a", "b"]).agg(F.count("*").alias("n_pairs"), F.sqrt(F.avg(d * d)).alias("srmr"))  # items squared


def cache_key(*parts: object) -> str:
    """A digest of configuration, data fingerprints, code and stage, whatever the order of dictionaries."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def index_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, digest of the set of keys with multiplicities, without an order: sums of row digests, so no task gathers them."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(15,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), half(1), half(13)), 256).alias("digest"))


def gap_statistic(df: DataFrame, axes: list[str], most: int = 8, references: int = 5, seed: int = 1) -> DataFrame:
    """k, log_w, gap, s and k_best: k-means costs against those of uniform references of as many rows in the axes' box.

    The best k is the least whose gap reaches the next one's less its deviation. References come from hashes of the rows'
    numbers, so they are as large as the table and as widely spread.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = df.where(F.expr(" and ".join(f"{a} is not null" for a in axes))).select(*axes)
    box = data.agg(F.count("*").alias("n"), *[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")).alias(a) for a in axes]).first()
    spark = df.sparkSession

    def cost(x: DataFrame, k: int) -> float:
        return float(np.log(max(KMeans(k=k, seed=seed).fit(x).summary.trainingCost, 1e-12)))

    def costs(rows: DataFrame) -> list[float]:
        x = VectorAssembler(inputCols=axes, outputCol="features").transform(rows).select("features").persist()
        alone = rows.agg(*[F.var_pop(a).alias(a) for a in axes]).first()
        out = [float(np.log(max(box["n"] * sum(alone[a] for a in axes), 1e-12)))] + [cost(x, k) for k in range(2, most + 1)]
        x.unpersist()
        return out

    own = np.array(costs(data))
    unit = lambda a, b: F.pmod(F.xxhash64("id", F.lit(a), F.lit(b)), F.lit(1 << 40)) / float(1 << 40)
    refs = np.array([costs(spark.range(box["n"]).select(*[(box[a]["lo"] + (box[a]["hi"] - box[a]["lo"]) * unit(a, b)).alias(a) for a in axes])) for b in range(references)])
    gap, s = refs.mean(0) - own, refs.std(0) * np.sqrt(1 + 1 / references)
    best = next((k + 1 for k in range(most - 1) if gap[k] >= gap[k + 1] - s[k + 1]), most)
    return spark.createDataFrame([(k + 1, float(own[k]), float(gap[k]), float(s[k]), best) for k in range(most)], "k int, log_w double, gap double, s double, k_best int")


def coverage_artefact(df: DataFrame, key: str, label: str, counts: list[str], trees: int = 20, folds: int = 4, permutations: int = 20) -> DataFrame:
    """n, accuracy, majority, lift, balanced, macro_f1 and p: whether labels can be told from what was observed alone.

    A random forest predicts the labels from coverage counts, out of fold; p is the share of label permutations whose
    balanced accuracy reaches the real one's. Confusions are a row for each two labels.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from quillon.operators.metrics import stratified_folds

    levels = sorted(r[0] for r in df.select(label).distinct().where(F.col(label).isNotNull()).collect())  # a clustering's labels
    code = F.array_position(F.lit(levels), F.col(label)) - 1
    rows = stratified_folds(df.where(F.col(label).isNotNull()).withColumn("_y", code.cast("double")), key, [label], folds)
    x = VectorAssembler(inputCols=counts, outputCol="features").transform(rows).select(key, "_y", "fold", "features").persist()

    def confusion(d: DataFrame) -> np.ndarray:
        out = np.zeros((len(levels), len(levels)))
        for f in range(folds):
            model = RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=5, seed=1).fit(d.where(F.col("fold") != f))
            for r in model.transform(d.where(F.col("fold") == f)).groupBy("_y", "prediction").count().collect():
                out[int(r["_y"]), int(r["prediction"])] += r["count"]
        return out

    real = confusion(x)
    balanced = lambda c: float(np.mean(np.diag(c) / np.maximum(c.sum(1), 1)))
    null = [balanced(confusion(permuted(x, key, "_y", k).persist())) for k in range(permutations)]
    x.unpersist()
    n, hit = real.sum(), np.diag(real)
    f1 = float(np.mean(2 * hit / np.maximum(real.sum(0) + real.sum(1), 1)))
    share, top = float(hit.sum() / max(n, 1)), float(real.sum(1).max() / max(n, 1))
    p = float(np.mean([b >= balanced(real) for b in null])) if null else None
    return df.sparkSession.createDataFrame([(int(n), share, top, share - top, balanced(real), 1.0 / len(levels), f1, p)], "n long, accuracy double, majority double, lift double, balanced double, chance double, macro_f1 double, p double")


def cached_stage(spark, root: str, stage: str, key: str, build) -> DataFrame:
    """The table that `build` makes, written under root/stage/key; read again where a run with this key has ended.

    A run that broke off has not left the writer's mark of success, so its files are written over.
    """
    path = f"{root.rstrip('/')}/{stage}/{key}"
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def align(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each row of a the row of b that it is matched with, each once, at the least summed squared distance; exact.

    By subsets of b's rows, so for the few components of a model (some sixteen at most).
    """
    n = len(a)
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    best = {0: (0.0, ())}
    for i in range(n):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, taken) in best.items():
            for j in range(len(b)):
                if not used >> j & 1:
                    key, value = used | 1 << j, (total + cost[i, j], (*taken, j))
                    if key not in step or value < step[key]:
                        step[key] = value
        best = step
    return list(min(best.values())[1])


def mapper_graph(df: DataFrame, key: str, lens: str, inside: str, step: float, overlap: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, n; edges: a, b, n) of a cover of the lens by intervals of `step` that reach `overlap` into the next.

    In an interval rows are one node where the other axis falls in one cell; nodes are linked by the rows that they share.
    """
    from quillon.operators.aggregate import shared_members

    at = F.floor(F.col(lens) / step)
    near = F.when(F.col(lens) - at * step < overlap, F.array(at, at - 1)).otherwise(F.array(at))
    rows = df.where(F.col(lens).isNotNull() & F.col(inside).isNotNull()).select(key, F.explode(near).alias("i"), F.floor(F.col(inside) / cell).alias("j"))
    members = rows.select(key, F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string")).alias("node"))
    return members.groupBy("node").agg(F.count("*").alias("n")), shared_members(members, "node", key)


def archetype_robustness(df: DataFrame, key: str, axes: list[str], start: np.ndarray, repeats: int = 3, iterations: int = 6) -> DataFrame:
    """anchor, drift, explained: how far each anchor moves, on average, when it is fitted to halves of the rows, and the whole fit's share.

    Halves are picked by digests of the key; their anchors are matched with the whole fit's one to one.
    """
    whole = archetypes(df, axes, start, iterations)
    drift = np.zeros(len(start))
    for k in range(repeats):
        half = df.where(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(k)))), 1, 4), 16, 10).cast("int") % 2 == 0)
        found = archetypes(half, axes, start, iterations)["anchors"]
        drift += np.sqrt(((whole["anchors"] - found[align(whole["anchors"], found)]) ** 2).sum(1)) / repeats
    return df.sparkSession.createDataFrame([(k, float(v), float(whole["explained"])) for k, v in enumerate(drift)], "anchor int, drift double, explained double")
