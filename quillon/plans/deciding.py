"""Queries of prediction metrics, comparison, weighting and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.expressions import e_value
from quillon.operators import metrics as m
from quillon.plans.catalog import query
from quillon.sources.roles import PANEL_SQL, panel, table


def _scored(spark, d):
    """Labels with a score from the document's length."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), "toxic").join(docs, "doc_id")


SCORED_SQL = "s AS (SELECT doc_id, quality AS y, toxic, n_chars / (n_chars + 1500.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id))"


@query("auc_brier", f"""WITH {SCORED_SQL}, r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s) SELECT count(*) AS n, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc, round(avg(pow(p - y, 2)), 8) AS brier FROM r""")
def _q1(spark, d):
    """P7."""
    return m.auc_brier(_scored(spark, d), "y", "p").select("n", F.round("auc", 8).alias("auc"), F.round("brier", 8).alias("brier"))


@query("net_benefit", f"""WITH {SCORED_SQL}, t(threshold) AS (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) SELECT threshold, round(count(*) FILTER (WHERE p >= threshold AND y = 1) / count(*)::DOUBLE - count(*) FILTER (WHERE p >= threshold AND y = 0) / count(*)::DOUBLE * threshold / (1 - threshold), 8) AS model, round(avg(y) - (1 - avg(y)) * threshold / (1 - threshold), 8) AS treat_all FROM s, t GROUP BY 1""")
def _q2(spark, d):
    """P7, B4."""
    return m.net_benefit(_scored(spark, d), "y", "p", [0.1, 0.3, 0.5]).select("threshold", F.round("model", 8).alias("model"), F.round("treat_all", 8).alias("treat_all"))


@query("log_loss", f"WITH {SCORED_SQL} SELECT round(-avg(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7))), 8) AS log_loss FROM s")
def _q3(spark, d):
    """B4."""
    return _scored(spark, d).agg(F.round(F.avg(m.log_loss(F.col("y"), F.col("p"))), 8).alias("log_loss"))


@query("crps_gaussian", """WITH a AS (SELECT c_custkey, c_nationkey * 100.0 + 500 AS sg, (c_acctbal - 4500) / (c_nationkey * 100.0 + 500) AS z FROM customer), b AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM a),
c AS (SELECT *, 1 - ((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t*exp(-z*z/2) AS e FROM b) SELECT c_custkey, round(sg * (z * (2 * CASE WHEN z >= 0 THEN 0.5*(1+e) ELSE 0.5*(1-e) END - 1) + 2 * exp(-z*z/2) / sqrt(2*pi()) - 1 / sqrt(pi())), 4) AS crps FROM c""")
def _q4(spark, d):
    """B4."""
    return table(spark, d, "customer").select("c_custkey", F.round(m.crps_gaussian(F.col("c_acctbal"), F.lit(4500.0), F.col("c_nationkey") * 100.0 + 500), 4).alias("crps"))


@query("crps_ensemble", """WITH e AS (SELECT c_custkey, c_acctbal y, [c_acctbal - 100.0, c_nationkey * 300.0, 4000.0] AS s FROM customer) SELECT c_custkey, round(list_sum(list_transform(s, lambda x: abs(x - y))) / 3 - 0.5 * (abs(s[1]-s[2]) + abs(s[1]-s[3]) + abs(s[2]-s[3])) * 2 / 9, 6) AS crps FROM e""")
def _q5(spark, d):
    """The energy form."""
    draws = F.array(F.col("c_acctbal") - 100.0, F.col("c_nationkey") * 300.0, F.lit(4000.0))
    return table(spark, d, "customer").select("c_custkey", F.round(m.crps_ensemble(F.col("c_acctbal"), draws), 6).alias("crps"))


LOO = """l AS (SELECT patient, visit, urgent_price y, mean_price x FROM panel WHERE urgent_price IS NOT NULL), s AS (SELECT count(*) n, avg(x) mx, avg(y) my, var_pop(x) vx, covar_pop(x, y) c, var_pop(y) vy FROM l),
 r AS (SELECT patient, visit, y - my - c / vx * (x - mx) AS res, 1.0 / n + (x - mx) * (x - mx) / (n * vx) AS h, n * (vy - c / vx * c) / (n - 2) AS s2 FROM l, s), e AS (SELECT patient, visit, -0.5 * (ln(2 * pi() * s2 / (1 - h)) + pow(res / (1 - h), 2) / (s2 / (1 - h))) AS elpd FROM r)"""


@query("gaussian_loo", f"WITH {PANEL_SQL}, {LOO} SELECT patient, visit, round(elpd, 6) AS elpd FROM e")
def _q6(spark, d):
    """Exact leave-one-out densities of a least-squares line."""
    return m.gaussian_loo(panel(spark, d), "urgent_price", "mean_price").select("patient", "visit", F.round("elpd", 6).alias("elpd"))


@query("delta_elpd_verdict", f"""WITH {PANEL_SQL}, {LOO}, d AS (SELECT count(*) n, sum(elpd - (-13.0)) d, sqrt(count(*)::DOUBLE) * stddev_samp(elpd - (-13.0)) se FROM e) SELECT n, round(d, 4) AS d, round(se, 6) AS se, CASE WHEN d - 2 * se > 0 THEN 'predictive' WHEN d + 2 * se < 0 THEN 'not-predictive' ELSE 'ambiguous' END AS verdict FROM d""")
def _q7(spark, d):
    """Paired differences and the strict bands."""
    e = m.gaussian_loo(panel(spark, d), "urgent_price", "mean_price").withColumn("ref", F.lit(-13.0))
    out = m.paired_difference(e, "elpd", "ref").withColumn("verdict", m.incremental_verdict(F.col("d"), F.col("se")))
    return out.select("n", F.round("d", 4).alias("d"), F.round("se", 6).alias("se"), "verdict")


@query("dominance_verdict", """SELECT p_partkey, CASE WHEN p_size > 30 AND NOT p_retailprice > 1000 THEN 'map' WHEN p_retailprice > 1000 AND NOT p_size > 30 THEN 'diagnosis' WHEN p_size > 30 THEN 'both' ELSE 'neither' END AS verdict FROM part""")
def _q8(spark, d):
    """P6."""
    p = table(spark, d, "part")
    return p.select("p_partkey", m.dominance(F.col("p_size").cast("double"), F.lit(15.0), F.col("p_retailprice"), F.lit(500.0)).alias("verdict"))


@query("stratified_folds", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|0'), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer")
def _q9(spark, d):
    """B2."""
    return m.stratified_folds(table(spark, d, "customer"), "c_custkey", ["c_mktsegment"], 5).select("c_custkey", "fold")


PS_SQL = "o AS (SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS treat, 0.05 + 0.9 * o_totalprice / 600000 AS ps FROM orders)"


def _treated(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("treat"), (0.05 + 0.9 * F.col("o_totalprice") / 600000).alias("ps"))


@query("propensity_overlap", f"""WITH {PS_SQL}, b AS (SELECT count(*) FILTER (WHERE treat=1) n1, count(*) FILTER (WHERE treat=0) n0, median(ps) FILTER (WHERE treat=1) m1, median(ps) FILTER (WHERE treat=0) m0, greatest(min(ps) FILTER (WHERE treat=1), min(ps) FILTER (WHERE treat=0)) lo, least(max(ps) FILTER (WHERE treat=1), max(ps) FILTER (WHERE treat=0)) hi FROM o)
SELECT n1 AS n_treated, n0 AS n_control, round(m1, 8) AS ps_treated_median, round(m0, 8) AS ps_control_median, round(lo, 8) AS common_lo, round(hi, 8) AS common_hi, round((SELECT avg(CAST(ps BETWEEN lo AND hi AS INTEGER)) FROM o), 8) AS frac_in_support FROM b""")
def _q10(spark, d):
    """T4, F12."""
    out = m.overlap(_treated(spark, d), "ps", "treat")
    return out.select("n_treated", "n_control", *[F.round(c, 8).alias(c) for c in out.columns[2:]])


@query("stabilized_weights", f"""WITH {PS_SQL}, b AS (SELECT greatest(min(ps) FILTER (WHERE treat=1), min(ps) FILTER (WHERE treat=0)) lo, least(max(ps) FILTER (WHERE treat=1), max(ps) FILTER (WHERE treat=0)) hi, avg(treat) pt FROM o)
SELECT o_orderkey, round(CASE WHEN treat = 1 THEN pt / least(greatest(ps, 0.01), 0.99) ELSE (1 - pt) / (1 - least(greatest(ps, 0.01), 0.99)) END, 7) AS weight, ps BETWEEN lo AND hi AS keep FROM o, b""")
def _q11(spark, d):
    """T4."""
    return m.stabilized_weights(_treated(spark, d), "ps", "treat").select("o_orderkey", F.round("weight", 7).alias("weight"), "keep")


@query("overlap_verdict", "SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_acctbal > 5000) < 30 OR count(*) FILTER (WHERE c_acctbal <= 5000) < 30 THEN 'fail' ELSE 'conditional' END AS verdict FROM customer GROUP BY 1")
def _q12(spark, d):
    """T6."""
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("n1"), F.count_if(F.col("c_acctbal") <= 5000).alias("n0"))
    return g.select("c_nationkey", m.overlap_verdict(F.col("n1"), F.col("n0"), F.lit(0.7), F.lit(0.2)).alias("verdict"))


@query("sensitivity_values", "SELECT p_partkey, round(exp(0.91 * p_size / 50.0) + sqrt(exp(0.91 * p_size / 50.0) * (exp(0.91 * p_size / 50.0) - 1)), 7) AS e_value, round(2.801585218112968::DOUBLE * p_size / 100, 7) AS mde, round(p_size / (2 * 1.8807936081512509::DOUBLE), 7) AS sd FROM part")
def _q13(spark, d):
    """E-value, minimum detectable effect, deviation from an interval."""
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(e_value(s / 50.0), 7).alias("e_value"), F.round(m.minimum_detectable(s / 100.0), 7).alias("mde"), F.round(m.sd_from_interval(-s / 2.0, s / 2.0), 7).alias("sd"))


@query("normal_equations", f"""WITH {PANEL_SQL} SELECT 'const' AS term, round(regr_intercept(urgent_price, n_orders), 2) AS coef FROM panel UNION ALL SELECT 'n_orders', round(regr_slope(urgent_price, n_orders), 2) FROM panel""")
def _q14(spark, d):
    """Least squares by cross products."""
    return m.normal_equations(panel(spark, d), "urgent_price", ["n_orders"]).withColumn("coef", F.round("coef", 2))


@query("confounder_matrix", """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 7) AS acctbal, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS building FROM customer""")
def _q15(spark, d):
    """T2."""
    c = table(spark, d, "customer")
    s = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return c.crossJoin(F.broadcast(s)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("s"), 7).alias("acctbal"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building"))
