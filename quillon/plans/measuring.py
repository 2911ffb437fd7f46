"""Queries of latent scores, mixtures, neighbours and model diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import latent as m
from quillon.plans.catalog import query
from quillon.sources.roles import LATENT_SQL, PANEL_SQL, latent, panel, table

LAM = np.array([[0.8, 0.1], [0.7, 0.0], [0.6, 0.3], [0.2, 0.7]])
PHI = np.array([[1.0, 0.3], [0.3, 1.0]])
SIGMA = np.array([0.6, 0.7, 0.7, 0.6])


def _cells(spark, d):
    """Standardised panel items with their missing cells."""
    p = panel(spark, d)
    items = ["mean_price", "max_price", "urgent_price", "low_price"]
    s = p.agg(*[F.avg(c).alias(f"{c}_m") for c in items], *[F.stddev_samp(c).alias(f"{c}_s") for c in items])
    z = p.crossJoin(F.broadcast(s))
    return z.select("patient", "visit_no", *[((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) for c in items]), items


_ITEMS = ("mean_price", "max_price", "urgent_price", "low_price")


def _of_cells(term: str) -> str:
    """SQL: the sum of a term over a row's observed items; {x} the standardised cell, {a}, {b}, {s} its loadings and deviation."""
    return " + ".join("coalesce(" + term.format(x=f"z{k}", a=f"{LAM[k, 0]}::DOUBLE", b=f"{LAM[k, 1]}::DOUBLE", s=f"{SIGMA[k]}::DOUBLE") + ", 0)" for k in range(4))


#: z-scores of the panel's items, the factors' posterior precision (pa, pb, pc) and weighted sums (ba, bb), from what a row has.
CELLS_SQL = f"""{PANEL_SQL}, mo AS (SELECT {", ".join(f"avg({c}) m{k}, stddev_samp({c}) s{k}" for k, c in enumerate(_ITEMS))} FROM panel), z AS (SELECT patient, visit_no, {", ".join(f"({c} - m{k}) / s{k} AS z{k}" for k, c in enumerate(_ITEMS))} FROM panel, mo),
 q AS (SELECT *, 1 / 0.91::DOUBLE + {_of_cells('{a} * {a} / ({s} * {s}) * CAST({x} IS NOT NULL AS INTEGER)')} AS pa, -0.3 / 0.91::DOUBLE + {_of_cells('{a} * {b} / ({s} * {s}) * CAST({x} IS NOT NULL AS INTEGER)')} AS pb, 1 / 0.91::DOUBLE + {_of_cells('{b} * {b} / ({s} * {s}) * CAST({x} IS NOT NULL AS INTEGER)')} AS pc,
 {_of_cells('{x} * {a} / ({s} * {s})')} AS ba, {_of_cells('{x} * {b} / ({s} * {s})')} AS bb, {_of_cells('{x} * {x} / ({s} * {s})')} AS xx, {_of_cells('ln({s} * {s}) * CAST({x} IS NOT NULL AS INTEGER)')} AS lp, {" + ".join(f"CAST(z{k} IS NOT NULL AS INTEGER)" for k in range(4))} AS n_obs FROM z), c AS (SELECT *, pa * pc - pb * pb AS det FROM q)"""
Z97 = 1.8807936081512509


@query("conditional_scores", f"""WITH {CELLS_SQL}, f AS (SELECT *, (pc * ba - pb * bb) / det AS mg, (pa * bb - pb * ba) / det AS ms, sqrt(pc / det) AS sg, sqrt(pa / det) AS ss FROM c)
SELECT patient, visit_no, round(mg, 6) AS g__mean, round(sg, 6) AS g__sd, round(mg - {Z97} * sg, 6) AS g__hdi_lo, round(mg + {Z97} * sg, 6) AS g__hdi_hi, round(ms, 6) AS s__mean, round(ss, 6) AS s__sd, round(ms - {Z97} * ss, 6) AS s__hdi_lo, round(ms + {Z97} * ss, 6) AS s__hdi_hi, CAST(n_obs AS BIGINT) AS n_obs FROM f""")
def _q1(spark, d):
    """Posterior mean, deviation and interval of two factors for every row, from what it has."""
    x, items = _cells(spark, d)
    out = m.conditional_scores(x, ["patient", "visit_no"], items, LAM, PHI, SIGMA, ["g", "s"])
    return out.select("patient", "visit_no", *[F.round(c, 6).alias(c) for c in out.columns[2:-1]], "n_obs")


@query("follow_up_scores", f"""WITH {CELLS_SQL.replace('FROM panel), z', "FROM panel WHERE visit = 'V0'), z").replace('FROM panel, mo)', "FROM panel, mo WHERE visit <> 'V0')")} SELECT patient, visit_no, round((pc * ba - pb * bb) / det, 6) AS g__mean, round(1 - pc / det, 6) AS g__reliability, CAST(n_obs AS BIGINT) AS n_obs FROM c""")
def _q1b(spark, d):
    """Later visits scored under the moments frozen at baseline and the fixed map; reliability 1 - posterior variance."""
    p = panel(spark, d)
    s = p.where("visit = 'V0'").agg(*[F.avg(c).alias(f"{c}_m") for c in _ITEMS], *[F.stddev_samp(c).alias(f"{c}_s") for c in _ITEMS])
    z = p.where("visit <> 'V0'").crossJoin(F.broadcast(s)).select("patient", "visit_no", *[((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) for c in _ITEMS])
    out = m.conditional_scores(z, ["patient", "visit_no"], list(_ITEMS), LAM, PHI, SIGMA, ["g", "s"])
    return out.select("patient", "visit_no", F.round("g__mean", 6).alias("g__mean"), F.round(1 - F.col("g__sd") ** 2, 6).alias("g__reliability"), "n_obs")


@query("observed_loglik", f"""WITH {CELLS_SQL} SELECT patient, visit_no, round(-0.5 * (n_obs * ln(2 * pi()) + lp + ln(0.91 * det) + xx - (ba * (pc * ba - pb * bb) + bb * (pa * bb - pb * ba)) / det), 5) AS loglik FROM c""")
def _q2(spark, d):
    """M4, M5, M6."""
    x, items = _cells(spark, d)
    return m.observed_loglik(x, ["patient", "visit_no"], items, LAM, PHI, SIGMA).withColumn("loglik", F.round("loglik", 5))


@query("simplex_projection")
def _q3(spark, d):
    """S12, S20."""
    anchors = np.array([[0.2, 0, 0], [0, 0.2, 0], [0, 0, 0.2], [-0.2, -0.2, -0.2]])
    return m.project_on_anchors(latent(spark, d, 3), "vec_id", ["x0", "x1", "x2"], anchors)


@query("xd_mixture")
def _q4(spark, d):
    """Two components of noisy coordinates."""
    x = latent(spark, d, 2).withColumns({"s0": F.lit(0.05), "s1": 0.05 + (F.col("vec_id") % 3) * 0.02}).cache()
    f = m.xd_mixture(x, ["x0", "x1"], ["s0", "s1"], np.array([[0.1, 0.1], [-0.1, -0.1]]), 15)
    x.unpersist()
    rows = [(k, float(f["pi"][k]), *map(float, f["mu"][k]), float(f["loglik"]), float(f["bic"])) for k in range(2)]
    return spark.createDataFrame(rows, "component int, weight double, mu0 double, mu1 double, loglik double, bic double")


@query("factor_em")
def _q5(spark, d):
    """M10 as maximum likelihood: loadings and noise with missing cells."""
    x, items = _cells(spark, d)
    x = x.cache()
    f = m.factor_em(x, items, 1, 8)
    x.unpersist()
    sign = 1.0 if f["loadings"][:, 0].sum() >= 0 else -1.0
    return spark.createDataFrame([(i, sign * float(f["loadings"][k, 0]), float(f["psi"][k])) for k, i in enumerate(items)], "item string, loading double, psi double")


@query("nearest_neighbours", f"""WITH {LATENT_SQL}, p AS (SELECT a.vec_id, b.vec_id AS neighbour, pow(a.x0-b.x0,2)/0.021 + pow(a.x1-b.x1,2)/0.021 + pow(a.x2-b.x2,2)/0.021 AS d2 FROM latent a JOIN latent b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour) AS INTEGER) AS rank, neighbour, round(d2, 7) AS d2 FROM p QUALIFY rank <= 5""")
def _q6(spark, d):
    """Uncertainty-weighted neighbours, a top-k report."""
    x = latent(spark, d, 3).withColumns({f"v{k}": F.lit(0.01) for k in range(3)})
    return m.nearest_neighbours(x, "vec_id", ["x0", "x1", "x2"], ["v0", "v1", "v2"], 5).withColumn("d2", F.round("d2", 7))


@query("prior_grid", """WITH f(factor) AS (VALUES ('G'), ('STANDARD'), ('PROMO'), ('ECONOMY')), g AS (SELECT p_partkey AS item, factor, CASE WHEN factor = p_type THEN 'strong' WHEN factor = 'G' THEN 'general' WHEN factor = CASE WHEN p_size > 25 THEN 'PROMO' END THEN 'window' ELSE 'unlikely' END AS prior_type FROM part, f)
SELECT item, factor, prior_type, CAST(CASE prior_type WHEN 'strong' THEN 0.7 WHEN 'general' THEN 0.4 WHEN 'window' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS prior_mean, CAST(CASE prior_type WHEN 'strong' THEN 0.2 WHEN 'general' THEN 0.25 WHEN 'window' THEN 0.2 ELSE 0.05 END AS DOUBLE) AS prior_sd FROM g""")
def _q7(spark, d):
    """M1, M2: items x factors with tiers."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("home"), F.when(F.col("p_size") > 25, "PROMO").alias("window"))
    return m.prior_grid(items, ["G", "STANDARD", "PROMO", "ECONOMY"])


@query("item_routing", f"""WITH {PANEL_SQL}, l AS (SELECT 'urgent_price' AS item, urgent_price AS v FROM panel UNION ALL SELECT 'n_orders', n_orders FROM panel UNION ALL SELECT 'flag', CAST(n_orders > 1 AS INTEGER) FROM panel), c AS (SELECT item, count(v) n, count(DISTINCT v) k FROM l GROUP BY 1)
SELECT item, n, k, CASE WHEN n < 1000 THEN 'excluded' WHEN k <= 2 THEN 'native' WHEN k >= 8 THEN 'gaussian' ELSE 'native' END AS route FROM c""")
def _q8(spark, d):
    """M3. Equal means are told by all their bits, so each has to be added in one order."""
    p = panel(spark, d, in_order=True).select("urgent_price", "n_orders", (F.col("n_orders") > 1).cast("double").alias("flag"))
    c = p.unpivot([], ["urgent_price", "n_orders", "flag"], "item", "v").groupBy("item").agg(F.count("v").alias("n"), F.count_distinct("v").alias("k"))
    return c.withColumn("route", F.when(F.col("n") < 1000, "excluded").when(F.col("k") <= 2, "native").when(F.col("k") >= 8, "gaussian").otherwise("native"))


DRAWS_SQL = "draws AS (SELECT l_linestatus || l_returnflag AS param, l_linenumber % 4 AS chain, l_quantity AS value FROM lineitem)"


@query("r_hat", f"""WITH {DRAWS_SQL}, c AS (SELECT param, chain, avg(value) m, var_samp(value) v, count(*) n FROM draws GROUP BY ALL), g AS (SELECT param, var_samp(m) b, avg(v) w, avg(n) n FROM c GROUP BY 1) SELECT param, round(sqrt(((n - 1) / n * w + b) / w), 8) AS r_hat FROM g""")
def _q9(spark, d):
    """M11."""
    li = table(spark, d, "lineitem")
    draws = li.select(F.concat("l_linestatus", "l_returnflag").alias("param"), (F.col("l_linenumber") % 4).alias("chain"), F.col("l_quantity").alias("value"))
    return m.r_hat(draws, ["param"], "chain", "value").withColumn("r_hat", F.round("r_hat", 8))


@query("waic", """WITH l AS (SELECT l_partkey % 200 AS row, -l_quantity / 10 AS ll FROM lineitem), t AS (SELECT row, max(ll) t FROM l GROUP BY 1), p AS (SELECT row, any_value(t) + ln(sum(exp(ll - t))) - ln(count(*)) AS lppd, var_samp(ll) AS p FROM l JOIN t USING (row) GROUP BY 1)
SELECT count(*) AS n, round(sum(lppd - p), 5) AS elpd, round(sum(p), 5) AS p_waic, round(-2 * sum(lppd - p), 5) AS waic, round(2 * sqrt(count(*) * var_pop(lppd - p)), 5) AS se FROM p""")
def _q10(spark, d):
    """Stable log of a mean of exponentials."""
    ll = table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("row"), (-F.col("l_quantity") / 10).alias("ll"))
    out = m.waic(ll, "row", "ll")
    return out.select("n", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


@query("assignment_usefulness", f"""WITH {LATENT_SQL}, s AS (SELECT x0*x0+x1*x1+x2*x2 AS t, * FROM latent), w AS (SELECT [greatest(x0*x0/t, 1e-12), greatest(x1*x1/t, 1e-12), greatest(x2*x2/t, 1e-12)] AS w FROM s), h AS (SELECT -list_sum(list_transform(w, lambda v: v * ln(v))) AS h, list_max(w) AS mx FROM w)
SELECT round(avg(CAST(mx > 0.5 AS INTEGER)), 8) AS confident, round(median(h / ln(3)), 8) AS median_entropy, round(avg(CAST(mx < 1/3.0 + 0.05 AS INTEGER)), 8) AS boundary, round(exp(avg(h)), 8) AS effective, CASE WHEN avg(CAST(mx > 0.5 AS INTEGER)) >= 0.5 AND median(h / ln(3)) <= 0.6 THEN 'PASS' WHEN avg(CAST(mx > 0.5 AS INTEGER)) < 0.3 THEN 'FAIL' ELSE 'CONDITIONAL' END AS gate FROM h""")
def _q11(spark, d):
    """S14, S18."""
    sq = [F.col(f"x{k}") * F.col(f"x{k}") for k in range(3)]
    w = latent(spark, d, 3).select(F.array(*[v / (sq[0] + sq[1] + sq[2]) for v in sq]).alias("w"))
    found = m.usefulness(w, "w", 3)
    out = found.select(*[F.round(c, 8).alias(c) for c in found.columns])
    return out.withColumn("gate", F.when((F.col("confident") >= 0.5) & (F.col("median_entropy") <= 0.6), "PASS").when(F.col("confident") < 0.3, "FAIL").otherwise("CONDITIONAL"))


@query("kmeans_silhouette")
def _q12(spark, d):
    """K-means for 2 to 12 groups, their silhouettes (squared Euclidean) and the best number."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(latent(spark, d, 3)).cache()
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=1).fit(x).transform(x)))) for k in range(2, 13)]
    x.unpersist()
    best = max(rows, key=lambda kv: kv[1])[0]
    return spark.createDataFrame([(*kv, best) for kv in rows], "k int, silhouette double, k_best int")


@query("gmm_bic")
def _q13(spark, d):
    """S3: BIC of full-covariance mixtures of 1 to 12 groups, the gain over one, the best number, whether it only falls."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(latent(spark, d, 2)).cache()
    n, rows = x.count(), []
    m1 = x.agg(F.var_pop("x0").alias("a"), F.var_pop("x1").alias("b"), F.covar_pop("x0", "x1").alias("c")).first()
    one = -n / 2 * (2 * np.log(2 * np.pi) + np.log(m1["a"] * m1["b"] - m1["c"] ** 2) + 2)  # a single normal, in closed form
    for k in range(1, 13):
        ll = one if k == 1 else GaussianMixture(k=k, seed=1, maxIter=40).fit(x).summary.logLikelihood
        rows.append((k, float(-2 * ll + ((k - 1) + k * 2 + k * 3) * np.log(n))))
    x.unpersist()
    bic = [b for _, b in rows]
    best, falls = rows[int(np.argmin(bic))][0], all(b < a for a, b in zip(bic, bic[1:]))
    return spark.createDataFrame([(k, b, bic[0] - b, best, falls) for k, b in rows], "k int, bic double, gain double, k_best int, falls boolean")


@query("density_grid", f"""WITH {LATENT_SQL} SELECT CAST(floor((x0 + 0.5) / 0.1) AS INTEGER) AS i, CAST(floor((x1 + 0.5) / 0.1) AS INTEGER) AS j, count(*) AS n FROM latent GROUP BY ALL""")
def _q14(spark, d):
    """A two-dimensional histogram."""
    cell = lambda c: F.floor((F.col(c) + 0.5) / 0.1).cast("int")
    return latent(spark, d, 2).groupBy(cell("x0").alias("i"), cell("x1").alias("j")).agg(F.count("*").alias("n"))


@query("item_information", "SELECT p_partkey, round((p_size / 50.0) * (p_size / 50.0) / (1 - 0.9 * (p_size / 50.0) * (p_size / 50.0) / 1.1), 8) AS information FROM part")
def _q15(spark, d):
    """Fisher information of a Gaussian item, loading squared over unique variance."""
    l = F.col("p_size") / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(l * l / (1 - 0.9 * l * l / 1.1), 8).alias("information"))
