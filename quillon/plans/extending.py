"""Queries of structure, archetypes, variance components, permutation and provenance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import aggregate, structure as s
from quillon.operators import latent as mixtures
from quillon.plans.catalog import query
from quillon.plans.harmonizing import PPF_SQL
from quillon.sources.roles import LATENT_SQL, PANEL_SQL, latent, panel, table


@query("structure_verdict", """WITH t AS (SELECT p_partkey, p_size / 50.0 AS h, p_size / 100.0 AS sil, p_size % 2 = 0 AS falls, p_size % 3 AS gk, p_size % 7 / 50.0 AS dp, p_size % 4 AS nc, p_size % 5 / 8.0 AS nz FROM part),
u AS (SELECT *, CAST(h > 0.75 AS INTEGER) + CAST(sil > 0.25 AS INTEGER) + CAST(NOT falls AS INTEGER) + CAST(gk > 1 AS INTEGER) + CAST(dp < 0.05 AS INTEGER) + CAST(nc >= 2 AND nz < 0.5 AS INTEGER) AS score FROM t)
SELECT p_partkey, score, CASE WHEN score >= 4 AND sil > 0.2 THEN 'clustered' WHEN score <= 2 OR sil < 0.15 THEN 'continuum' ELSE 'weak/ambiguous (lean continuum)' END AS verdict FROM u""")
def _q1(spark, d):
    """S8."""
    z = F.col("p_size")
    score, verdict = s.structure_verdict(z / 50.0, z / 100.0, z % 2 == 0, z % 3, z % 7 / 50.0, z % 4, z % 5 / 8.0)
    return table(spark, d, "part").select("p_partkey", score.alias("score"), verdict.alias("verdict"))


def _uniform(axis: int) -> str:
    return f"lo{axis} + (hi{axis} - lo{axis}) * CAST('0x' || substr(md5(turn || '|' || (place - 1) || '|x{axis}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("hopkins", f"""WITH {LATENT_SQL}, box AS (SELECT {", ".join(f"min(x{k}) lo{k}, max(x{k}) hi{k}" for k in range(3))} FROM latent), t AS (SELECT turn, vec_id, x0, x1, x2, row_number() OVER (PARTITION BY turn ORDER BY md5(vec_id || '|' || turn), vec_id) AS place FROM latent, range(5) r(turn) QUALIFY place <= 150),
u AS (SELECT turn, place, {", ".join(f"{_uniform(k)} AS u{k}" for k in range(3))} FROM t, box), nw AS (SELECT t.turn, t.place, sqrt(min(CASE WHEN l.vec_id <> t.vec_id THEN pow(l.x0-t.x0,2)+pow(l.x1-t.x1,2)+pow(l.x2-t.x2,2) END)) w FROM t, latent l GROUP BY ALL), nu AS (SELECT turn, place, sqrt(min(pow(x0-u0,2)+pow(x1-u1,2)+pow(x2-u2,2))) u FROM u, latent GROUP BY ALL),
h AS (SELECT turn, sum(u) / (sum(u) + sum(w)) h FROM nw JOIN nu USING (turn, place) GROUP BY turn) SELECT round(avg(h), 8) AS hopkins FROM h""")
def _q2(spark, d):
    """Five samples of 150."""
    return s.hopkins(latent(spark, d, 3), "vec_id", ["x0", "x1", "x2"]).withColumn("hopkins", F.round("hopkins", 8))


@query("archetypes")
def _q3(spark, d):
    """S11, S20."""
    x = latent(spark, d, 3).cache()
    f = s.archetypes(x, ["x0", "x1", "x2"], 0.2 * np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [-1, -1, -1]]), 6)
    x.unpersist()
    return spark.createDataFrame([(k, *map(float, row), float(f["explained"])) for k, row in enumerate(f["anchors"])], "anchor int, x0 double, x1 double, x2 double, explained double")


@query("trait_state")
def _q4(spark, d):
    """L11, by EM from sums by number of visits."""
    f = s.trait_state(panel(spark, d), ["cohort", "patient"], "n_orders", 0.0)
    return spark.createDataFrame([("n_orders", f["mu"], f["between"], f["within"], f["icc"], f["verdict"])], "axis string, mu double, between double, within double, icc double, verdict string")


@query("normality_k2", """WITH l AS (SELECT 'l_quantity' AS item, CAST(l_quantity AS DOUBLE) x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem), c AS (SELECT item, count(*) OVER (PARTITION BY item) n, x - avg(x) OVER (PARTITION BY item) AS e FROM l),
m AS (SELECT item, any_value(n)::DOUBLE n, avg(e*e) m2, avg(e*e*e) m3, avg(e*e*e*e) m4 FROM c GROUP BY 1), s AS (SELECT item, n, m3 / pow(m2, 1.5) * sqrt((n+1)*(n+3)/(6*(n-2))) y, m4 / (m2*m2) b, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) beta, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) g FROM m),
w AS (SELECT *, -1 + sqrt(2*(beta-1)) w2, (b - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) x, 6 + 8/g*(2/g + sqrt(1+4/(g*g))) a FROM s)
SELECT item, CAST(n AS BIGINT) AS n, round(pow(asinh(y / sqrt(2/(w2-1))) / sqrt(0.5*ln(w2)), 2) + pow((1 - 2/(9*a) - sign((1-2/a)/(1+x*sqrt(2/(a-4)))) * pow(abs((1-2/a)/(1+x*sqrt(2/(a-4)))), 1/3.0)) / sqrt(2/(9*a)), 2), 3) AS k2 FROM w""")
def _q5(spark, d):
    """A12."""
    return s.normality_k2(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("k2", F.round("k2", 3))


#: Knots (k, x, z) of the baseline's values at even probabilities, and the segments between them.
KNOTS_SQL = f"""p AS (SELECT k, (k + 0.5) / 21::DOUBLE AS p FROM range(21) t(k)), q AS (SELECT k, p, sqrt(-2*ln(p)) AS ql, sqrt(-2*ln(1-p)) AS qh, (p-0.5)*(p-0.5) AS r FROM p), zz AS (SELECT k, {PPF_SQL} AS z FROM q),
 v AS (SELECT mean_price, row_number() OVER (ORDER BY mean_price) - 1 AS i, count(*) OVER () AS n FROM panel WHERE visit = 'V0'), ats AS (SELECT k, p * (any_value(n) - 1) AS t FROM p, v GROUP BY k, p), kn AS (SELECT k, a.mean_price + (b.mean_price - a.mean_price) * (t - floor(t)) AS x, z FROM ats JOIN v a ON a.i = floor(t) JOIN v b ON b.i = ceil(t) JOIN zz USING (k)),
 sg AS (SELECT x AS x0, z AS z0, lead(x) OVER (ORDER BY k) AS x1, lead(z) OVER (ORDER BY k) AS z1 FROM kn)"""


@query("copula_map", f"""WITH {PANEL_SQL}, {KNOTS_SQL} SELECT patient, visit, round(CASE WHEN mean_price < (SELECT min(x) FROM kn) THEN (SELECT min(z) FROM kn) WHEN mean_price >= (SELECT max(x) FROM kn) THEN (SELECT max(z) FROM kn) ELSE z0 + (z1 - z0) * (mean_price - x0) / (x1 - x0) END, 6) AS mean_price_z FROM panel LEFT JOIN sg ON mean_price >= x0 AND mean_price < x1 WHERE visit <> 'V0'""")
def _q6(spark, d):
    """Knots of the baseline, applied to later visits."""
    p = panel(spark, d)
    knots = s.copula_knots(p.where("visit = 'V0'"), "mean_price")
    return s.copula_forward(p.where("visit <> 'V0'"), "mean_price", knots).select("patient", "visit", F.round("mean_price_z", 6).alias("mean_price_z"))


@query("copula_inverse", f"""WITH {PANEL_SQL}, {KNOTS_SQL}, g AS (SELECT k AS i, -2.5 + 0.05 * k AS z FROM range(101) t(k)) SELECT CAST(i AS INTEGER) AS i, round(CASE WHEN z < (SELECT min(z) FROM kn) THEN (SELECT min(x) FROM kn) WHEN z >= (SELECT max(z) FROM kn) THEN (SELECT max(x) FROM kn) ELSE x0 + (x1 - x0) * (z - z0) / (z1 - z0) END, 3) AS mean_price FROM g LEFT JOIN sg ON z >= z0 AND z < z1""")
def _q6b(spark, d):
    """Values of scores under the frozen map."""
    knots = s.copula_knots(panel(spark, d).where("visit = 'V0'"), "mean_price")
    grid = spark.range(101).select(F.col("id").cast("int").alias("i"), (-2.5 + 0.05 * F.col("id")).alias("z"))
    return s.copula_inverse(grid, "z", knots, "mean_price").select("i", F.round("mean_price", 3).alias("mean_price"))


@query("incremental_r2", f"""WITH {PANEL_SQL}, c AS (SELECT count(*) n, corr(urgent_price, n_orders) a, corr(urgent_price, max_price) b, corr(n_orders, max_price) r FROM panel WHERE urgent_price IS NOT NULL)
SELECT n, round(a*a, 8) AS r2_base, round((a*a + b*b - 2*a*b*r) / (1 - r*r), 8) AS r2_full, round((a*a + b*b - 2*a*b*r) / (1 - r*r) - a*a, 8) AS gain FROM c""")
def _q7(spark, d):
    """The statistic."""
    out = s.incremental_r2(panel(spark, d), "urgent_price", "n_orders", "max_price")
    return out.select("n", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query("permutation_null")
def _q8(spark, d):
    """The gain against 1,000 permutations of the added predictor."""
    p = panel(spark, d).withColumn("k", F.concat_ws("|", "patient", "visit"))
    return s.permutation_test(p, "k", "urgent_price", "n_orders", "max_price")


@query("residual_correlation", f"""WITH {PANEL_SQL}, r AS (SELECT corr(urgent_price, low_price) - 0.36 AS a, corr(urgent_price, mean_price) - 0.48 AS b, corr(low_price, mean_price) - 0.48 AS c FROM panel) SELECT CAST(3 AS BIGINT) AS n_pairs, round(sqrt((a*a + b*b + c*c) / 3), 8) AS srmr FROM r""")
def _q9(spark, d):
    """SRMR of a one-factor model."""
    items = ["urgent_price", "low_price", "mean_price"]
    pairs = aggregate.pairwise_correlation(panel(spark, d), items)
    lam = np.array([[0.6], [0.6], [0.8]])
    return s.srmr(pairs, items, s.implied_correlation(lam, np.eye(1), np.sqrt(1 - lam[:, 0] ** 2))).withColumn("srmr", F.round("srmr", 8))


@query("index_hash", """WITH h AS (SELECT md5(c_mktsegment || '|' || c_custkey) AS m FROM customer) SELECT count(*) AS n, sha256(count(*) || '|' || sum(CAST('0x' || substr(m, 1, 12) AS BIGINT)) || '|' || sum(CAST('0x' || substr(m, 13, 12) AS BIGINT))) AS digest FROM h""")
def _q10(spark, d):
    """A digest of a roster that doesn't depend on its order."""
    return s.index_hash(table(spark, d, "customer"), ["c_mktsegment", "c_custkey"])


@query("archetype_names", f"""WITH {LATENT_SQL}, c AS (SELECT label, avg(x0) * 40 a0, avg(x1) * 40 a1, avg(x2) * 40 a2 FROM latent GROUP BY 1), l AS (UNPIVOT c ON a0, a1, a2 INTO NAME axis VALUE z),
k AS (SELECT label, axis, z, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, axis) rn FROM l WHERE abs(z) >= 0.6) SELECT label, string_agg(CASE WHEN z > 0 THEN 'high ' ELSE 'low ' END || axis, ', ' ORDER BY rn) AS name FROM k WHERE rn <= 2 GROUP BY 1""")
def _q11(spark, d):
    """The two strongest axes of each group, from an array of three."""
    c = latent(spark, d, 3).groupBy("label").agg(*[(F.avg(f"x{k}") * 40).alias(f"a{k}") for k in range(3)])
    axes = F.array(*[F.struct((-F.abs(f"a{k}")).alias("o"), F.lit(f"a{k}").alias("axis"), F.col(f"a{k}").alias("z")) for k in range(3)])
    top = F.slice(F.array_sort(F.filter(axes, lambda a: F.abs(a["z"]) >= 0.6)), 1, 2)
    return c.select("label", F.array_join(F.transform(top, lambda a: F.concat(F.when(a["z"] > 0, "high ").otherwise("low "), a["axis"])), ", ").alias("name")).where("name <> ''")


@query("treatment_verdicts", """SELECT p_brand, CASE WHEN avg(p_size) - 2 * stddev_samp(p_size) / sqrt(count(*)) > 26 THEN 'moderates' WHEN 2.801585218112968 * stddev_samp(p_size) / sqrt(count(*)) < 5 THEN 'bounded null' ELSE 'underpowered' END AS verdict FROM part GROUP BY 1""")
def _q12(spark, d):
    """An effect, a null that the design could have seen, or neither."""
    from quillon.operators.metrics import minimum_detectable

    g = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("m"), (F.stddev_samp("p_size") / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return g.select("p_brand", F.when(F.col("m") - 2 * F.col("se") > 26, "moderates").when(minimum_detectable(F.col("se")) < 5, "bounded null").otherwise("underpowered").alias("verdict"))


@query("boosted_out_of_fold")
def _q13(spark, d):
    """Out-of-fold predictions of boosted trees; missing cells become a flag and a constant."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from quillon.operators.metrics import stratified_folds

    p = panel(spark, d).where("visit = 'V0'").select("patient", "cohort", "mean_price", F.col("n_orders").alias("a"), F.coalesce("low_price", F.lit(0.0)).alias("b"), F.col("low_price").isNull().cast("double").alias("b_missing"))
    x = VectorAssembler(inputCols=["a", "b", "b_missing"], outputCol="features").transform(stratified_folds(p, "patient", ["cohort"], 2)).cache()
    parts = [GBTRegressor(labelCol="mean_price", maxIter=3, maxDepth=2, seed=1).fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k)) for k in range(2)]
    return parts[0].union(parts[1]).select("patient", "fold", "mean_price", "prediction")


@query("gap_statistic")
def _q14(spark, d):
    """K-means costs against uniform references."""
    return s.gap_statistic(latent(spark, d, 3), ["x0", "x1", "x2"])


@query("xd_fixed_labels")
def _q15(spark, d):
    """The likelihood of a given partition under noise."""
    x = latent(spark, d, 2).withColumns({"s0": F.lit(0.05), "s1": 0.05 + (F.col("vec_id") % 3) * 0.02}).cache()
    f = mixtures.xd_fixed(x, ["x0", "x1"], ["s0", "s1"], "label")
    x.unpersist()
    return spark.createDataFrame([(str(l), float(f["pi"][k]), *map(float, f["mu"][k]), float(f["loglik"]), float(f["bic"])) for k, l in enumerate(f["labels"])], "label string, weight double, mu0 double, mu1 double, loglik double, bic double")


@query("choose_groups")
def _q16(spark, d):
    """The least number of groups that is confident and stable."""
    x = latent(spark, d, 2).withColumns({"s0": F.lit(0.02), "s1": F.lit(0.02)}).cache()
    out = mixtures.choose_groups(x, "vec_id", ["x0", "x1"], ["s0", "s1"], range(2, 5))
    x.unpersist()
    return out


@query("coverage_artefact")
def _q17(spark, d):
    """Whether a cohort can be told from how many cells its entities have."""
    p = panel(spark, d)
    seen = p.groupBy("cohort", "patient").agg(*[F.count(c).cast("double").alias(c) for c in ("urgent_price", "low_price", "mean_price")])
    return s.coverage_artefact(seen, "patient", "cohort", ["urgent_price", "low_price", "mean_price"], permutations=3)
