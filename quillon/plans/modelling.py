"""Queries of regressions with covariates, likelihoods, priors, batteries and the judgements that stand on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions.expressions import normal_cdf, round_product
from quillon.operators import metrics, mixed as x, regress as r
from quillon.operators.ordered import with_rank
from quillon.plans.catalog import query
from quillon.sources.roles import LATENT_SQL, PANEL_SQL, latent, panel, table

#: Cross products of two predictors and an outcome, as population covariances.
TWO = "count(*) n, avg(y) my, avg(a) ma, avg(b) mb, var_pop(y) yy, var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab, covar_pop(a, y) ay, covar_pop(b, y) by_"
ROWS = f"{PANEL_SQL}, d AS (SELECT patient, visit, visit_no, cohort, urgent_price / 100000 AS y, n_orders AS a, max_price / 100000 AS b FROM panel WHERE urgent_price IS NOT NULL)"


def _rows(spark, d):
    p = panel(spark, d).where("urgent_price is not null")
    return p.select("patient", "visit", "visit_no", "cohort", (F.col("urgent_price") / 100000).alias("y"), F.col("n_orders").alias("a"), (F.col("max_price") / 100000).alias("b"))


def _round(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("glm_gaussian", f"""WITH {ROWS}, s AS (SELECT {TWO} FROM d), f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) b2 FROM s),
g AS (SELECT *, n * (yy - ba * ay - b2 * by_) / (n - 3) s2 FROM f)
SELECT 'a' AS term, round(ba, 6) AS coef, round(sqrt(s2 / (n * (aa - ab * ab / bb))), 6) AS se FROM g UNION ALL SELECT 'b', round(b2, 6), round(sqrt(s2 / (n * (bb - ab * ab / aa))), 6) FROM g UNION ALL
SELECT 'const', round(my - ba * ma - b2 * mb, 6), round(sqrt(s2 / n * (1 + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / (aa * bb - ab * ab))), 6) FROM g""")
def _q1(spark, d):
    """A Gaussian outcome on two predictors, from one pass."""
    out = r.fit(_rows(spark, d), "y", {"a": F.col("a"), "b": F.col("b")}).table(spark)
    return _round(out.select("term", "coef", "se"), 6, "coef", "se")


LOGIT = "l AS (SELECT CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y, (o_totalprice - 250000) / 100000 AS x, o_custkey % 3 + 1.0 AS w FROM orders)"


def _newton(ridge: float = 0.0, weight: str = "1.0", steps: int = 15) -> str:
    """Newton's method for y on a constant and x, in a recursive table it(k, a, b, ll, h00, h01, h11) over the rows of l."""
    return f"""it(k, a, b, ll, h00, h01, h11) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), ll, h00, h01, h11 FROM (SELECT k, any_value(a) a, any_value(b) b, sum(w * (y - p)) g0, sum(w * (y - p) * x) - {ridge} * any_value(b) g1,
 sum(w * p * (1 - p)) h00, sum(w * p * (1 - p) * x) h01, sum(w * p * (1 - p) * x * x) + {ridge} h11, sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) ll FROM (SELECT k, a, b, x, y, {weight} AS w, 1 / (1 + exp(-a - b * x)) p FROM it, l WHERE k < {steps}) GROUP BY k)), last AS (SELECT * FROM it WHERE k = {steps})"""


def _logit(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), ((F.col("o_totalprice") - 250000) / 100000).alias("x"), (F.col("o_custkey") % 3 + 1.0).alias("w"))


@query("glm_logistic", f"WITH RECURSIVE {LOGIT}, {_newton(1.0, 'w')} SELECT 'const' AS term, round(a, 6) AS coef, round(sqrt(h11 / (h00 * h11 - h01 * h01)), 6) AS se FROM last UNION ALL SELECT 'x', round(b, 6), round(sqrt(h00 / (h00 * h11 - h01 * h01)), 6) FROM last")
def _q2(spark, d):
    """A 0/1 outcome, weighted rows, a normal prior on the slope."""
    out = r.fit(_logit(spark, d), "y", {"x": F.col("x")}, "bernoulli", F.col("w"), 1.0).table(spark)
    return _round(out.select("term", "coef", "se"), 6, "coef", "se")


@query("likelihood_ratio", f"""WITH RECURSIVE {LOGIT}, {_newton()}, n AS (SELECT count(*) n, avg(y) m FROM l), s AS (SELECT 2 * (ll - n * (m * ln(m) + (1 - m) * ln(1 - m))) AS stat FROM last, n),
t AS (SELECT stat, sqrt(greatest(stat, 0)) z, 1 / (1 + 0.3275911 * sqrt(greatest(stat, 0)) / sqrt(2.0)) u FROM s)
SELECT round(stat, 4) AS stat, 1 AS df, round(((((1.061405429*u-1.453152027)*u+1.421413741)*u-0.284496736)*u+0.254829592)*u*exp(-z*z/2), 5) AS p FROM t""")
def _q3(spark, d):
    """Nested logits and the chi-square tail of twice their gain."""
    rows = _logit(spark, d)
    stat, df, p = r.likelihood_ratio(r.fit(rows, "y", {}, "bernoulli"), r.fit(rows, "y", {"x": F.col("x")}, "bernoulli"))
    return _round(spark.createDataFrame([(stat, df, p)], "stat double, df int, p double"), 4, "stat").withColumn("p", F.round("p", 5))


@query("glm_ordinal", """WITH l AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y FROM orders), c AS (SELECT k, avg(CAST(y <= k AS INTEGER)) p FROM l, range(4) t(k) GROUP BY k) SELECT 'cut' || k AS term, round(ln(p / (1 - p)), 6) AS coef FROM c""")
def _q4(spark, d):
    """Thresholds of an ordered outcome."""
    rows = table(spark, d, "orders").select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"))
    return _round(r.fit(rows, "y", {}, "ordinal").table(spark).select("term", "coef"), 6, "coef")


@query("propensity_model", f"""WITH RECURSIVE m AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders), l AS (SELECT CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y, (o_totalprice - m) / s AS x FROM orders, m), {_newton(1.0)}
SELECT 'const' AS term, round(a, 6) AS coef FROM last UNION ALL SELECT 'o_totalprice', round(b, 6) FROM last""")
def _q5(spark, d):
    """Logistic regression on standardised inputs with a penalty of half the squared slopes."""
    o = table(spark, d, "orders").withColumn("y", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    s = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s")).first()
    out = r.fit(o, "y", {"o_totalprice": (F.col("o_totalprice") - s["m"]) / s["s"]}, "bernoulli", ridge=1.0).table(spark)
    return _round(out.select("term", "coef"), 6, "coef")


@query("calibration_slope", f"""WITH RECURSIVE l AS (SELECT quality AS y, ln((n_chars / (n_chars + 1500.0)) / (1 - n_chars / (n_chars + 1500.0))) AS x FROM labels JOIN documents USING (doc_id)), {_newton(1e-6)} SELECT round(b, 5) AS slope FROM last""")
def _q6(spark, d):
    """The outcome on the log odds of a score."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    fit = r.calibration_slope(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id"), "y", "p")
    return spark.createDataFrame([(round(fit.of("slope")[0], 5),)], "slope double")


@query("confounder_survival", f"""WITH {ROWS}, s AS (SELECT {TWO} FROM d) SELECT 'a' AS axis, n, round(ay / aa, 6) AS beta_without, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) AS beta_with, round(100 * (1 - abs((ay * bb - by_ * ab) / (aa * bb - ab * ab)) / abs(ay / aa)), 3) AS attenuation_pct FROM s""")
def _q7(spark, d):
    """A slope without and with exposures."""
    out = r.survival(_rows(spark, d), "y", {"a": F.col("a")}, {}, {"b": F.col("b")}, ridge=0.0)
    return _round(out.select("axis", "n", "beta_without", "beta_with", "attenuation_pct"), 6, "beta_without", "beta_with").withColumn("attenuation_pct", F.round("attenuation_pct", 3))


@query("errors_in_predictors", f"""WITH {ROWS}, s AS (SELECT {TWO} FROM d) SELECT n, round(ay / aa, 6) AS naive, round(ay / (aa - 0.04), 6) AS corrected FROM s""")
def _q8(spark, d):
    """A slope under a predictor's known error (deviation 0.2), and without regard to it."""
    rows = _rows(spark, d)
    naive, corrected = r.fit(rows, "y", {"a": F.col("a")}), r.fit(rows, "y", {"a": F.col("a")}, errors={"a": F.lit(0.2)})
    return spark.createDataFrame([(naive.n, round(naive.of("a")[0], 6), round(corrected.of("a")[0], 6))], "n long, naive double, corrected double")


LADDER = """s AS (SELECT {two} FROM d{where}), f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) b2 FROM s), v AS (SELECT n, yy r0, yy - ay * ay / aa r1, yy - ba * ay - b2 * by_ r2, yy - by_ * by_ / bb rb FROM f)"""


@query("design_ladder", f"""WITH {ROWS}, {LADDER.format(two=TWO, where='')}, l AS (SELECT 'R0' AS rung, 1 AS terms, n, r0 v FROM v UNION ALL SELECT 'R1', 2, n, r1 FROM v UNION ALL SELECT 'R2', 3, n, r2 FROM v)
SELECT rung, terms, n, round(-n / 2.0 * (ln(2 * pi() * v) + 1), 3) AS loglik, round(1 - v / (SELECT r0 FROM v), 6) AS r2 FROM l""")
def _q9(spark, d):
    """Nested designs, each with one block more."""
    rows, out, base = _rows(spark, d), [], None
    for rung, names in (("R0", ""), ("R1", "a"), ("R2", "ab")):
        f = r.fit(rows, "y", {n: F.col(n) for n in names})
        base = f.loglik if base is None else base
        out.append((rung, len(f.terms), f.n, round(f.loglik, 3), round(1 - float(np.exp(2 * (base - f.loglik) / f.n)), 6)))
    return spark.createDataFrame(out, "rung string, terms int, n long, loglik double, r2 double")


@query("drop_one", f"""WITH {ROWS}, {LADDER.format(two=TWO, where='')} SELECT 'a' AS dropped, round((rb - r2) / r0, 6) AS loss FROM v UNION ALL SELECT 'b', round((r1 - r2) / r0, 6) FROM v""")
def _q10(spark, d):
    """P5: what the explained share loses without each block."""
    rows = _rows(spark, d)
    share = lambda names: 1 - float(np.exp(-2 * r.fit(rows, "y", {n: F.col(n) for n in names}).loglik / n0))
    whole = r.fit(rows, "y", {})
    n0 = whole.n
    unit = float(np.exp(-2 * whole.loglik / n0))
    full = share("ab")
    return spark.createDataFrame([(n, round((full - share("ab".replace(n, ""))) / unit, 6)) for n in "ab"], "dropped string, loss double")


@query("within_cohort_gain", f"""WITH {ROWS}, s AS (SELECT cohort, {TWO} FROM d GROUP BY cohort), f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) b2 FROM s)
SELECT cohort, n, round(ay * ay / (aa * yy), 6) AS r2_base, round((ba * ay + b2 * by_) / yy, 6) AS r2_full FROM f""")
def _q11(spark, d):
    """The incremental value cohort by cohort, all in one pass of moments."""
    c = _rows(spark, d).groupBy("cohort").agg(F.count("*").alias("n"), F.corr("y", "a").alias("ya"), F.corr("y", "b").alias("yb"), F.corr("a", "b").alias("ab"))
    full = (F.col("ya") ** 2 + F.col("yb") ** 2 - 2 * F.col("ya") * F.col("yb") * F.col("ab")) / (1 - F.col("ab") ** 2)
    return c.select("cohort", "n", F.round(F.col("ya") ** 2, 6).alias("r2_base"), F.round(full, 6).alias("r2_full"))


@query("leave_one_cohort_out", f"""WITH {ROWS}, c AS (SELECT DISTINCT cohort FROM d), f AS (SELECT c.cohort, regr_slope(y, a) slope, regr_intercept(y, a) icpt FROM c JOIN d ON d.cohort <> c.cohort GROUP BY 1) SELECT cohort, count(*) AS n, round(sqrt(avg(pow(y - icpt - slope * a, 2))), 6) AS rmse FROM d JOIN f USING (cohort) GROUP BY 1""")
def _q12(spark, d):
    """Each cohort predicted from all others; sums of all less its own, so rows are read once for the fits."""
    rows = _rows(spark, d)
    terms = {"n": F.lit(1.0), "sa": F.col("a"), "sy": F.col("y"), "saa": F.col("a") ** 2, "say": F.col("a") * F.col("y")}
    own = rows.groupBy("cohort").agg(*[F.sum(c).alias(n) for n, c in terms.items()])
    whole = own.agg(*[F.sum(n).alias(f"w{n}") for n in terms])
    left = own.crossJoin(F.broadcast(whole)).select("cohort", *[(F.col(f"w{n}") - F.col(n)).alias(n) for n in terms])
    slope = (F.col("n") * F.col("say") - F.col("sa") * F.col("sy")) / (F.col("n") * F.col("saa") - F.col("sa") ** 2)
    fits = left.select("cohort", slope.alias("slope"), ((F.col("sy") - slope * F.col("sa")) / F.col("n")).alias("icpt"))
    e = F.col("y") - F.col("icpt") - F.col("slope") * F.col("a")
    return rows.join(fits, "cohort").groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("moderation")
def _q13(spark, d):
    """A treatment's effect, and whether an axis moderates it, under weights."""
    rows = _rows(spark, d).withColumns({"treat": (F.col("b") > 2.5).cast("int"), "key": F.concat_ws("|", "patient", "visit")})
    return r.moderation(rows, "y", "treat", {"a": F.col("a") - 2.0}, {"visit": F.col("visit_no") - 3.0}, "key", weight=1 + F.col("visit_no") * 0.1)


def _folded(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("u"), (F.crc32(F.col("source")) % 5).alias("v"))
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return metrics.stratified_folds(rows, "doc_id", ["y"], 5)


@query("out_of_fold_logistic")
def _q14(spark, d):
    """Five folds' fits in shared passes."""
    return r.out_of_fold(_folded(spark, d), "y", {"u": F.col("u") - 6.5, "v": F.col("v")}, "fold", 5, keep=["doc_id"])


@query("paired_auc_gain")
def _q15(spark, d):
    """The gain in AUC of one more predictor, out of fold, and its bootstrap."""
    rows = _folded(spark, d)
    one, two = (r.out_of_fold(rows, "y", xs, "fold", 5, keep=["doc_id"]).select("doc_id", "y", F.col("p").alias(n)) for xs, n in (({"v": F.col("v")}, "p0"), ({"u": F.col("u") - 6.5, "v": F.col("v")}, "p1")))
    return r.paired_auc(one.join(two.select("doc_id", "p1"), "doc_id"), "doc_id", "y", "p0", "p1")


@query("placements", """WITH s AS (SELECT quality AS y, n_chars / (n_chars + 1500.0) AS p FROM labels JOIN documents USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, rank() OVER (PARTITION BY y ORDER BY p) + (count(*) OVER (PARTITION BY y, p) - 1) / 2.0 AS own, count(*) OVER (PARTITION BY y) AS n, count(*) OVER () AS m FROM s)
SELECT y, count(*) AS n, round(avg(CASE WHEN y = 1 THEN (r - own) / (m - n) ELSE 1 - (r - own) / (m - n) END), 8) AS auc FROM k GROUP BY y""")
def _q16(spark, d):
    """Each row's share of the other class on its right side; the mean over either class is the AUC."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return r.placements(rows, "y", "p").groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("p_place"), 8).alias("auc"))


@query("bootstrap_difference")
def _q17(spark, d):
    """A paired mean difference, its bootstrap interval, and what that says about a margin."""
    out = r.bootstrap_difference(_rows(spark, d).withColumn("key", F.concat_ws("|", "patient", "visit")), "key", "y", "b")
    return out.withColumn("verdict", r.margin_verdict(F.col("lo"), F.col("hi"), 0.1))


@query("derived_probability", """WITH z AS (SELECT c_custkey, (5000 - c_acctbal) / 900.0 AS x FROM customer), u AS (SELECT *, 1 / (1 + 0.3275911 * abs(x) / sqrt(2.0)) t FROM z), e AS (SELECT *, 1 - ((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t*exp(-x*x/2) AS e FROM u)
SELECT c_custkey, round(1 - CASE WHEN x >= 0 THEN 0.5*(1+e) ELSE 0.5*(1-e) END, 6) AS p FROM e""")
def _q18(spark, d):
    """The probability of an endpoint from a Gaussian prediction."""
    return table(spark, d, "customer").select("c_custkey", F.round(1 - normal_cdf((5000 - F.col("c_acctbal")) / 900.0), 6).alias("p"))


@query("margin_verdicts", """SELECT p_partkey, CASE WHEN p_size - 5 > 10 THEN 'raw-adds' WHEN p_size - 25 < -10 THEN 'latent-better' WHEN p_size - 5 >= -10 AND p_size - 25 <= 10 THEN 'sufficient' ELSE 'inconclusive' END AS verdict FROM part""")
def _q19(spark, d):
    """B5."""
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r.margin_verdict(s - 5, s - 25, 10).alias("verdict"))


@query("mixed_loglik", """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_quantity % 4 AS DOUBLE) AS y, l_discount * 20 - 1 AS eta, 0.5 + l_tax * 20 AS mu FROM lineitem),
h AS (SELECT *, 1.5 * ln(1.5 / (1.5 + mu)) AS none, lgamma(y + 1.5) - lgamma(1.5) - lgamma(y + 1) + 1.5 * ln(1.5 / (1.5 + mu)) + y * ln(mu / (1.5 + mu)) AS nb FROM l)
SELECT l_orderkey, l_linenumber, round(CAST(y > 1 AS INTEGER) * eta - ln(1 + exp(eta)), 6) AS bernoulli, round(nb, 6) AS negative_binomial, round(CASE WHEN y = 0 THEN -ln(1 + exp(eta)) ELSE eta - ln(1 + exp(eta)) + nb - ln(1 - exp(none)) END, 6) AS hurdle,
 round(CASE y WHEN 0 THEN ln(1 / (1 + exp(eta + 1))) WHEN 1 THEN ln(1 / (1 + exp(eta)) - 1 / (1 + exp(eta + 1))) WHEN 2 THEN ln(1 / (1 + exp(eta - 1)) - 1 / (1 + exp(eta))) ELSE ln(1 - 1 / (1 + exp(eta - 1))) END, 6) AS ordered FROM h""")
def _q20(spark, d):
    """M7: Bernoulli, negative binomial, hurdle and ordered-logistic cells."""
    y, eta, mu, one = F.col("l_quantity").cast("double") % 4, F.col("l_discount") * 20 - 1, 0.5 + F.col("l_tax") * 20, F.lit(1.5)
    cells = {"bernoulli": x.bernoulli_loglik((y > 1).cast("double"), eta), "negative_binomial": x.negative_binomial_loglik(y, mu, one), "hurdle": x.hurdle_loglik(y, eta, mu, one), "ordered": x.ordered_loglik(y, eta, [-1.0, 0.0, 1.0])}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in cells.items()])


@query("vine_correlation", "WITH p AS (SELECT 0.5::DOUBLE a, -0.3::DOUBLE b, 0.4::DOUBLE c) SELECT 'r21' AS pair, round(a, 8) AS r FROM p UNION ALL SELECT 'r31', round(b, 8) FROM p UNION ALL SELECT 'r32', round(a * b + c * sqrt((1 - a * a) * (1 - b * b)), 8) FROM p")
def _q21(spark, d):
    """M8: correlations from canonical partial correlations, beside an orthogonal general axis."""
    m = x.beside_general(x.vine_correlation(np.array([[0, 0, 0], [0.5, 0, 0], [-0.3, 0.4, 0]])))
    return spark.createDataFrame([(f"r{i}{j}", round(float(m[i, j]), 8)) for i, j in ((2, 1), (3, 1), (3, 2))], "pair string, r double")


@query("horseshoe_scale", "SELECT p_partkey, round(0.1 * sqrt(0.25 * l * l / (0.25 + 0.01 * l * l)), 8) AS sd FROM (SELECT p_partkey, p_size / 10.0 AS l FROM part)")
def _q22(spark, d):
    """M9."""
    return table(spark, d, "part").select("p_partkey", F.round(x.shrunk_scale(F.col("p_size") / 10.0, 0.1, 0.5), 8).alias("sd"))


@query("conditional_draws")
def _q23(spark, d):
    """Ten coherent draws of both factors for every row."""
    from quillon.plans.measuring import LAM, PHI, SIGMA, _cells

    cells, items = _cells(spark, d)
    return x.conditional_draws(cells, ["patient", "visit_no"], items, LAM, PHI, SIGMA, ["g", "s"], 10)


@query("localization", """WITH RECURSIVE i(k, l1, l2, s) AS (VALUES (1, 0.8::DOUBLE, 0.1::DOUBLE, 0.6::DOUBLE), (2, 0.7, 0.0, 0.7), (3, 0.6, 0.3, 0.7), (4, 0.2, 0.7, 0.6)), p(m, a, b, c) AS (SELECT 0, 1 / 0.91::DOUBLE, -0.3 / 0.91::DOUBLE, 1 / 0.91::DOUBLE UNION ALL SELECT m + 1, a + l1 * l1 / (s * s), b + l1 * l2 / (s * s), c + l2 * l2 / (s * s) FROM p JOIN i ON i.k = p.m + 1)
SELECT m AS items, round(sqrt(c / (a * c - b * b)), 6) AS sd_g, round(sqrt(a / (a * c - b * b)), 6) AS sd_s FROM p""")
def _q24(spark, d):
    """What is left to know of both factors after each item."""
    from quillon.plans.measuring import LAM, PHI, SIGMA

    covs = x.localization(LAM, PHI, SIGMA, [0, 1, 2, 3])
    return spark.createDataFrame([(k, *(round(float(v), 6) for v in np.sqrt(np.diag(c)))) for k, c in enumerate(covs)], "items int, sd_g double, sd_s double")


@query("greedy_battery", """WITH RECURSIVE i AS (SELECT p_partkey, p_size / 60.0 AS l FROM part ORDER BY p_size DESC, p_partkey LIMIT 12), o AS (SELECT *, row_number() OVER (ORDER BY round(l * l / (1 - l * l), 12) DESC, p_partkey) AS place, l * l / (1 - l * l) AS info FROM i)
SELECT CAST(place AS INTEGER) AS place, p_partkey, round(1 - 1 / (1 + sum(info) OVER (ORDER BY place)), 6) AS reliability FROM o""")
def _q25(spark, d):
    """The order in which items add most, and the reliability so far."""
    items = table(spark, d, "part").orderBy(F.desc("p_size"), "p_partkey").limit(12).orderBy("p_partkey").collect()  # a bank of twelve items
    l = np.array([[p["p_size"] / 60.0] for p in items])
    found = x.greedy_battery(l, np.eye(1), np.sqrt(1 - l[:, 0] ** 2))
    return spark.createDataFrame([(k + 1, items[j]["p_partkey"], round(v, 6)) for k, (j, v) in enumerate(found)], "place int, p_partkey long, reliability double")


@query("block_mass", """WITH m AS (SELECT avg(l_quantity) q, avg(l_extendedprice) e, avg(l_discount) s FROM lineitem), t AS (SELECT sum(abs(0.02 * (l_quantity - q))) a, sum(abs(0.00001 * (l_extendedprice - e))) b, sum(abs(3 * (l_discount - s))) c FROM lineitem, m)
SELECT 'amount' AS block, round((a + b) / (a + b + c), 8) AS mass FROM t UNION ALL SELECT 'terms', round(c / (a + b + c), 8) FROM t""")
def _q26(spark, d):
    """Shares of absolute contributions by block; here those of a linear score, slope times distance from the mean."""
    li = table(spark, d, "lineitem")
    m = li.agg(*[F.avg(c).alias(f"m_{c}") for c in ("l_quantity", "l_extendedprice", "l_discount")])
    parts = {c: b * (F.col(c) - F.col(f"m_{c}")) for c, b in (("l_quantity", 0.02), ("l_extendedprice", 0.00001), ("l_discount", 3.0))}
    return _round(x.block_mass(li.crossJoin(F.broadcast(m)), parts, {"l_quantity": "amount", "l_extendedprice": "amount", "l_discount": "terms"}), 8, "mass")


@query("best_power", """WITH v AS (SELECT (l_extendedprice - 20000) / 20000 AS x FROM lineitem), g AS (SELECT CAST(round(-2 + 0.05 * k, 10) AS DOUBLE) AS p FROM range(121) t(k)), y AS (SELECT p, x, CASE WHEN x >= 0 THEN CASE WHEN abs(p) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, p) - 1) / p END ELSE CASE WHEN abs(2 - p) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - p) - 1) / (2 - p) END END AS y FROM v, g)
SELECT count(*) AS n, round(p, 4) AS power FROM y GROUP BY p ORDER BY -count(*) / 2.0 * ln(var_pop(y)) + (p - 1) * sum(CASE WHEN x >= 0 THEN ln(1 + x) ELSE -ln(1 - x) END) DESC, p LIMIT 1""")
def _q27(spark, d):
    """The power transform's exponent, by its likelihood on a grid."""
    v = table(spark, d, "lineitem").select(((F.col("l_extendedprice") - 20000) / 20000).alias("x"))
    return x.best_power(v, "x").select("n", F.round("power", 4).alias("power"))


@query("power_transform", "SELECT c_custkey, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 7) AS y FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def _q28(spark, d):
    """A12."""
    return table(spark, d, "customer").select("c_custkey", F.round(x.yeo_johnson(F.col("c_acctbal") / 1000, F.lit(0.5)), 7).alias("y"))


@query("spearman_axes", f"""WITH {LATENT_SQL}, k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY x0) + (count(*) OVER (PARTITION BY label, x0) - 1) / 2.0 AS a, rank() OVER (PARTITION BY label ORDER BY x1) + (count(*) OVER (PARTITION BY label, x1) - 1) / 2.0 AS b FROM latent) SELECT label, round(corr(a, b), 7) AS rho FROM k GROUP BY 1""")
def _q29(spark, d):
    """Rank correlation of two columns, label by label."""
    ranked = with_rank(with_rank(latent(spark, d, 2), "x0", ["label"], "ra"), "x1", ["label"], "rb")
    return ranked.groupBy("label").agg(F.round(F.corr("ra", "rb"), 7).alias("rho"))


@query("item_overlap", f"""WITH {PANEL_SQL}, l AS (SELECT DISTINCT cohort, 'urgent_price' AS item FROM panel WHERE urgent_price > 400000 UNION ALL SELECT DISTINCT cohort, 'low_price' FROM panel WHERE low_price > 400000 UNION ALL SELECT DISTINCT cohort, 'n_orders' FROM panel WHERE n_orders > 3)
SELECT item, count(*) AS n_cohorts, count(*) = (SELECT count(DISTINCT cohort) FROM panel) AS shared FROM l GROUP BY 1""")
def _q30(spark, d):
    """U4: the union of cohorts' item sets, and which all share."""
    p = panel(spark, d)
    have = [F.when(c, n) for n, c in (("urgent_price", F.col("urgent_price") > 400000), ("low_price", F.col("low_price") > 400000), ("n_orders", F.col("n_orders") > 3))]
    sets = p.select("cohort", F.explode(F.array_compact(F.array(*have))).alias("item")).distinct()
    cohorts = p.agg(F.count_distinct("cohort").alias("all"))
    return sets.groupBy("item").agg(F.count("*").alias("n_cohorts")).crossJoin(F.broadcast(cohorts)).select("item", "n_cohorts", (F.col("n_cohorts") == F.col("all")).alias("shared"))


@query("residualise_design", f"""WITH {ROWS}, s AS (SELECT {TWO} FROM d), f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) b2 FROM s) SELECT patient, visit, round(y - my - ba * (a - ma) - b2 * (b - mb), 6) AS residual FROM d, f""")
def _q31(spark, d):
    """Residuals of a design of several covariates."""
    return r.residualised(_rows(spark, d), "y", {"a": F.col("a"), "b": F.col("b")}).select("patient", "visit", F.round("y_res", 6).alias("residual"))


@query("spline_basis", """WITH t AS (SELECT p_partkey, p_size / 51.0 AS u FROM part) SELECT p_partkey, round(pow(1 - u, 3), 8) AS s0, round(3 * u * pow(1 - u, 2), 8) AS s1, round(3 * u * u * (1 - u), 8) AS s2, round(pow(u, 3), 8) AS s3 FROM t""")
def _q32(spark, d):
    """A cubic spline's basis; without inner knots it is Bernstein's."""
    out = r.spline(F.col("p_size") / 51.0, [], 0.0, 1.0)
    return table(spark, d, "part").select("p_partkey", *[F.round(c, 8).alias(f"s{k}") for k, c in enumerate(out)])


@query("roster_reindex", """SELECT c_custkey, o.n AS n_orders, round(o.m, 4) AS mean_price, n_name AS city FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, avg(o_totalprice) m FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def _q33(spark, d):
    """Coordinates, site and covariates joined to the roster; who has none stays, with nulls."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    c = table(spark, d, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_orders", "mean_price", "city")


@query("confound_arms", f"""WITH {ROWS}, s AS (SELECT {TWO} FROM d) SELECT 'A0' AS arm, round(ay / aa, 6) AS slope FROM s UNION ALL SELECT 'A1', round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) FROM s""")
def _q34(spark, d):
    """A slope under covariate arms; covariates are joined on canonical ids ('123.0' is '123')."""
    rows = _rows(spark, d)
    side = rows.select(F.concat_ws("|", F.concat(F.col("patient").cast("string"), F.lit(".0")), "visit").alias("raw"), F.col("b").alias("covariate"))
    side = side.select(F.regexp_replace("raw", r"\.0(\||$)", "$1").alias("key"), "covariate")
    both = rows.withColumn("key", F.concat_ws("|", "patient", "visit")).join(side, "key")
    arms = {"A0": {"a": F.col("a")}, "A1": {"a": F.col("a"), "covariate": F.col("covariate")}}
    return spark.createDataFrame([(n, round(r.fit(both, "y", xs).of("a")[0], 6)) for n, xs in arms.items()], "arm string, slope double")


@query("membership_frame", f"""WITH {LATENT_SQL}, s AS (SELECT vec_id, x0*x0+x1*x1+x2*x2 AS t, x0, x1, x2 FROM latent), w AS (SELECT vec_id, x0*x0/t AS w0, x1*x1/t AS w1, x2*x2/t AS w2 FROM s)
SELECT vec_id, round(w0, 8) AS w0, round(w1, 8) AS w1, round(w2, 8) AS w2, CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END AS dominant, CASE WHEN greatest(w0, w1, w2) > 0.5 THEN 'confident' WHEN greatest(w0, w1, w2) < 1/3.0 + 0.05 THEN 'boundary' ELSE 'mixed' END AS tier FROM w""")
def _q35(spark, d):
    """Weights, the dominant one and its tier for every entity."""
    from quillon.functions.expressions import first_argmax

    sq = [F.col(f"x{k}") * F.col(f"x{k}") for k in range(3)]
    w = latent(spark, d, 3).select("vec_id", F.array(*[v / (sq[0] + sq[1] + sq[2]) for v in sq]).alias("w"))
    top = F.array_max("w")
    tier = F.when(top > 0.5, "confident").when(top < 1 / 3.0 + 0.05, "boundary").otherwise("mixed")
    return w.select("vec_id", *[F.round(F.get("w", F.lit(k)), 8).alias(f"w{k}") for k in range(3)], first_argmax(F.col("w")).alias("dominant"), tier.alias("tier"))


@query("usefulness_battery", """WITH t AS (SELECT p_partkey, p_size / 50.0 AS conf, p_size % 11 / 10.0 AS ari, p_size % 7 / 10.0 AS v, p_size % 5 / 10.0 AS eta, p_size % 3 / 10.0 AS cover FROM part), s AS (SELECT p_partkey, CASE WHEN conf >= 0.5 THEN 2 WHEN conf >= 0.3 THEN 1 ELSE 0 END a, CASE WHEN ari >= 0.8 THEN 2 WHEN ari >= 0.5 THEN 1 ELSE 0 END b, CASE WHEN v < 0.3 THEN 2 WHEN v < 0.5 THEN 1 ELSE 0 END c, CASE WHEN eta < 0.3 THEN 2 WHEN eta < 0.4 THEN 1 ELSE 0 END e, CASE WHEN cover < 0.1 THEN 2 WHEN cover < 0.2 THEN 1 ELSE 0 END f FROM t)
SELECT p_partkey, CASE least(a, b, c, e, f) WHEN 2 THEN 'PASS' WHEN 1 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict FROM s""")
def _q36(spark, d):
    """Five criteria (confidence, stability, not a diagnosis, not severity, not coverage), and the worst of them."""
    z = F.col("p_size")
    values = [(z / 50.0, 0.5, 0.3, True), (z % 11 / 10.0, 0.8, 0.5, True), (z % 7 / 10.0, 0.3, 0.5, False), (z % 5 / 10.0, 0.3, 0.4, False), (z % 3 / 10.0, 0.1, 0.2, False)]
    return table(spark, d, "part").select("p_partkey", r.worst_of(values).alias("verdict"))


@query("convergence_gate", """SELECT p_partkey, CASE WHEN 1 + p_size / 500.0 > 1.05 OR p_size * 20 < 100 OR p_size % 4 > 2 THEN 'fail' WHEN 1 + p_size / 500.0 > 1.01 OR p_size * 20 < 400 OR p_size % 4 > 0 THEN 'usable' ELSE 'clean' END AS gate FROM part""")
def _q37(spark, d):
    """Gates on R-hat, effective sample size and divergences."""
    z = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", x.convergence_gate(1 + z / 500.0, z * 20, z % 4).alias("gate"))


@query("robustness_sweep", f"""WITH {ROWS}, l AS (SELECT cohort, y, a, 1.0::DOUBLE AS w, 'plain' AS weighting FROM d UNION ALL SELECT cohort, y, a, 1 + visit_no, 'by visit' FROM d), s AS (SELECT cohort, weighting, count(*) n, sum(w) w, sum(w*a) wa, sum(w*y) wy, sum(w*a*a) waa, sum(w*a*y) way FROM l GROUP BY GROUPING SETS ((cohort, weighting), (weighting)))
SELECT coalesce(cohort, 'pooled') AS scope, weighting, n, round((w * way - wa * wy) / (w * waa - wa * wa), 6) AS slope FROM s""")
def _q38(spark, d):
    """A slope in each cohort and pooled, under each weighting, from one pass of sums."""
    rows = _rows(spark, d)
    cells = F.array(F.struct(F.lit("plain").alias("weighting"), F.lit(1.0).alias("w")), F.struct(F.lit("by visit").alias("weighting"), (1.0 + F.col("visit_no")).alias("w")))
    long = rows.select("cohort", "y", "a", F.explode(cells).alias("c")).select("cohort", "y", "a", "c.weighting", "c.w")
    w, a, y = F.col("w"), F.col("a"), F.col("y")
    s = long.groupingSets([["cohort", "weighting"], ["weighting"]], "cohort", "weighting").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * a).alias("wa"), F.sum(w * y).alias("wy"), F.sum(w * a * a).alias("waa"), F.sum(w * a * y).alias("way"))
    slope = (F.col("sw") * F.col("way") - F.col("wa") * F.col("wy")) / (F.col("sw") * F.col("waa") - F.col("wa") ** 2)
    return s.select(F.coalesce("cohort", F.lit("pooled")).alias("scope"), "weighting", "n", F.round(slope, 6).alias("slope"))


MAPPER = f"""{LATENT_SQL}, r AS (SELECT vec_id, CAST(floor(x0 / 0.1) AS BIGINT) AS i, CAST(floor(x1 / 0.2) AS BIGINT) AS j, x0 - floor(x0 / 0.1) * 0.1 AS off FROM latent), m AS (SELECT vec_id, i || '|' || j AS node FROM r UNION ALL SELECT vec_id, (i - 1) || '|' || j FROM r WHERE off < 0.03)"""


@query("mapper_nodes", f"WITH {MAPPER} SELECT node, count(*) AS n FROM m GROUP BY 1")
def _q39(spark, d):
    """Nodes of a cover with overlaps."""
    from quillon.operators.structure import mapper_graph

    return mapper_graph(latent(spark, d, 2), "vec_id", "x0", "x1", 0.1, 0.03, 0.2)[0]


@query("mapper_edges", f"WITH {MAPPER} SELECT a.node AS a, b.node AS b, count(*) AS n FROM m a JOIN m b ON a.vec_id = b.vec_id AND a.node < b.node GROUP BY ALL")
def _q40(spark, d):
    """Their edges, by shared members."""
    from quillon.operators.structure import mapper_graph

    return mapper_graph(latent(spark, d, 2), "vec_id", "x0", "x1", 0.1, 0.03, 0.2)[1]


@query("frozen_design", f"""WITH {PANEL_SQL}, f AS (SELECT avg(mean_price) m, stddev_pop(mean_price) s, avg(urgent_price) u FROM panel WHERE visit = 'V0') SELECT patient, visit, round((mean_price - m) / s, 6) AS z_price, round(coalesce(urgent_price, u) / 100000, 6) AS filled, CAST(cohort = 'BUILDING' AS INTEGER) AS building FROM panel, f WHERE visit <> 'V0'""")
def _q41(spark, d):
    """A covariate design frozen at baseline (means fill the design alone, never an item), applied to later visits.

    Prices whose last digit is 5 are halves here, so means are added in one order and rounded as the SQL's engine does.
    """
    p = panel(spark, d, in_order=True)
    f = p.where("visit = 'V0'").agg(F.avg("mean_price").alias("m"), F.stddev_pop("mean_price").alias("s"), F.avg("urgent_price").alias("u"))
    later = p.where("visit <> 'V0'").crossJoin(F.broadcast(f))
    return later.select("patient", "visit", round_product((F.col("mean_price") - F.col("m")) / F.col("s"), 6).alias("z_price"), round_product(F.coalesce("urgent_price", "u") / 100000, 6).alias("filled"), (F.col("cohort") == "BUILDING").cast("int").alias("building"))


@query("implied_correlation", """WITH l(i, a, b) AS (VALUES (0, 0.8::DOUBLE, 0.1::DOUBLE), (1, 0.7, 0.0), (2, 0.6, 0.3), (3, 0.2, 0.7)), s(i, v) AS (VALUES (0, 0.36::DOUBLE), (1, 0.49), (2, 0.49), (3, 0.36)), c AS (SELECT x.i, y.i AS j, x.a * y.a + 0.3 * (x.a * y.b + x.b * y.a) + x.b * y.b + CASE WHEN x.i = y.i THEN v ELSE 0 END AS c FROM l x, l y JOIN s ON s.i = y.i)
SELECT CAST(p.i AS INTEGER) AS i, CAST(p.j AS INTEGER) AS j, round(p.c / sqrt(q.c * r.c), 8) AS r FROM c p JOIN c q ON q.i = p.i AND q.j = p.i JOIN c r ON r.i = p.j AND r.j = p.j WHERE p.i < p.j""")
def _q42(spark, d):
    """Correlations that loadings, factor correlations and noise imply."""
    from quillon.operators.structure import implied_correlation
    from quillon.plans.measuring import LAM, PHI, SIGMA

    c = implied_correlation(LAM, PHI, SIGMA)
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 8)) for i in range(4) for j in range(i + 1, 4)], "i int, j int, r double")


@query("incremental_density")
def _q43(spark, d):
    """What an axis and its interactions with the cohort add to a 0/1 endpoint, in left-out density."""
    rows = _rows(spark, d).withColumns({"hit": (F.col("y") > 2.0).cast("int"), "key": F.concat_ws("|", "patient", "visit"), "building": (F.col("cohort") == "BUILDING").cast("double")})
    base = {"a": F.col("a") - 2.0, "building": F.col("building")}
    return r.incremental_density(rows, "hit", base, {**base, "b": F.col("b") - 2.5, "building:b": F.col("building") * (F.col("b") - 2.5)}, "key")


@query("archetype_robustness")
def _q44(spark, d):
    """Anchors under halves of the rows, matched one to one."""
    from quillon.operators.structure import archetype_robustness

    rows = latent(spark, d, 3).cache()
    out = archetype_robustness(rows, "vec_id", ["x0", "x1", "x2"], 0.2 * np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [-1, -1, -1]]))
    rows.unpersist()
    return out
