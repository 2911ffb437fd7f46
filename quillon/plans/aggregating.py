"""Queries of joins, aggregates, ranks, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.expressions import first_argmax, normalized_entropy, wilson
from quillon.operators import aggregate as a
from quillon.plans.catalog import query
from quillon.sources.roles import LATENT_SQL, PANEL_SQL, latent, panel, table

AXES = [f"x{k}" for k in range(8)]


def _orders(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("cohort"), "c_nationkey")
    return table(spark, d, "orders").withColumn("done", (F.col("o_orderstatus") == "F").cast("int")).join(c, F.col("o_custkey") == F.col("c_custkey"))


ORDERS_SQL = "o AS (SELECT orders.*, CAST(o_orderstatus = 'F' AS INTEGER) AS done, c_mktsegment AS cohort, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"
WILSON = "(k/n + 1.96*1.96/(2*n) {s} 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)"


def _r(*cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


@query("coverage_by_indicator", f"""WITH {PANEL_SQL}, l AS (SELECT cohort, 'urgent_price' AS item, urgent_price AS v FROM panel UNION ALL SELECT cohort, 'low_price', low_price FROM panel)
SELECT item, cohort, count(*) AS n_rows, count(v) AS n_obs, round(count(v) / CAST(count(*) AS DOUBLE), 8) AS fraction FROM l GROUP BY GROUPING SETS ((item), (item, cohort))""")
def _q1(spark, d):
    """A1."""
    return a.coverage_by_item(panel(spark, d), ["urgent_price", "low_price"], "cohort").withColumn("fraction", F.round("fraction", 8))


@query("cohort_counts", "SELECT c_mktsegment AS cohort, count(*) AS n FROM customer GROUP BY 1")
def _q2(spark, d):
    """A2."""
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(F.count("*").alias("n"))


@query("rate_table_wilson", f"""WITH {ORDERS_SQL}, t AS (SELECT cohort, CAST(count(*) AS DOUBLE) n, CAST(sum(done) AS DOUBLE) k FROM o GROUP BY 1)
SELECT cohort, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS rate, round(greatest(0.0, {WILSON.format(s='-')}), 6) AS lo, round(least(1.0, {WILSON.format(s='+')}), 6) AS hi FROM t""")
def _q3(spark, d):
    """A5, clipped."""
    return a.rate_table(_orders(spark, d), "done", ["cohort"]).select("cohort", "n", "k", *_r("rate", "lo", "hi"))


@query("endpoint_atlas", f"""WITH {ORDERS_SQL}, t AS (SELECT o_orderpriority AS stratum, cohort, CAST(count(*) AS DOUBLE) n, CAST(sum(done) AS DOUBLE) k FROM o GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, cohort)))
SELECT stratum, coalesce(cohort, 'all') AS cohort, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS rate, round({WILSON.format(s='-')}, 6) AS lo, round({WILSON.format(s='+')}, 6) AS hi FROM t WHERE cohort IS NULL OR n >= 30""")
def _q4(spark, d):
    """Pooled and by cohort in one pass of grouping sets, unclipped."""
    o = _orders(spark, d).withColumnRenamed("o_orderpriority", "stratum")
    return a.atlas(o, "done", "stratum", "cohort").select("stratum", "cohort", "n", "k", *_r("rate", "lo", "hi"))


@query("crosstab_site_cohort", """SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS furniture,
 count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS household, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery, count(*) AS total FROM customer GROUP BY 1""")
def _q5(spark, d):
    """A7."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return table(spark, d, "customer").groupBy("c_nationkey").agg(*[F.count_if(F.col("c_mktsegment") == n).alias(n.lower()) for n in names], F.count("*").alias("total"))


@query("unpivot_cells", f"WITH {PANEL_SQL} SELECT cohort, patient, visit, 'urgent_price' AS item, round(urgent_price, 4) AS value FROM panel WHERE urgent_price IS NOT NULL UNION ALL SELECT cohort, patient, visit, 'low_price', round(low_price, 4) FROM panel WHERE low_price IS NOT NULL")
def _q6(spark, d):
    """The table of observed cells."""
    return panel(spark, d).unpivot(["cohort", "patient", "visit"], ["urgent_price", "low_price"], "item", "value").where("value is not null").withColumn("value", F.round("value", 4))


@query("descriptives", f"""WITH {ORDERS_SQL} SELECT cohort, count(*) AS n, count(DISTINCT c_nationkey) AS n_sites, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
 round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(100.0 * avg(done), 4) AS pct_done FROM o GROUP BY GROUPING SETS ((), (cohort))""")
def _q7(spark, d):
    """A10: cohorts and overall in one pass."""
    p = F.col("o_totalprice")
    out = _orders(spark, d).groupingSets([[], ["cohort"]], "cohort").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("n_sites"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("sd"), F.percentile(p, F.lit(0.25)).alias("q1"), F.percentile(p, F.lit(0.5)).alias("median"), F.percentile(p, F.lit(0.75)).alias("q3"), (100 * F.avg("done")).alias("pct_done"))
    return out.select("cohort", "n", "n_sites", *_r("mean", "sd", "q1", "median", "q3", "pct_done", digits=4))


@query("distribution_profile", """WITH l AS (SELECT 'l_quantity' AS item, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
m AS (SELECT item, count(*) n, avg(CAST(v = 0 AS INTEGER)) z, min(v) lo, max(v) hi, avg(v) mean, stddev_pop(v) sd, median(v) med, kurtosis_pop(v) ku FROM l GROUP BY 1), s AS (SELECT item, avg(pow((v - mean) / sd, 3)) AS sk FROM l JOIN m USING (item) GROUP BY 1),
c AS (SELECT item, count(*) d, max(k) / CAST(sum(k) AS DOUBLE) mo FROM (SELECT item, v, count(*) k FROM l GROUP BY ALL) GROUP BY 1)
SELECT item, n, d AS n_distinct, round(mo, 6) AS modal_share, round(z, 6) AS zero_share, lo AS "min", hi AS "max", round(mean, 6) AS mean, round(sd, 6) AS sd, med AS median, round(sk, 5) AS skew, round(ku, 5) AS kurtosis,
 CASE WHEN d <= 2 THEN 'binary' WHEN z >= 0.3 THEN 'zero_inflated' WHEN d < 10 THEN 'discrete' WHEN abs(sk) > 1 THEN 'skewed' ELSE 'roughly_symmetric' END AS form FROM m JOIN s USING (item) JOIN c USING (item)""")
def _q8(spark, d):
    """A11."""
    out = a.profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return out.select("item", "n", "n_distinct", *_r("modal_share", "zero_share"), "min", "max", *_r("mean", "sd"), "median", *_r("skew", "kurtosis", digits=5), "form")


CHI = """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) r FROM c GROUP BY 1), k AS (SELECT b, sum(o) c FROM c GROUP BY 1),
 t AS (SELECT sum(o) n, sum(o) * (sum(o * o / (r * c)) - 1) AS chi2, count(DISTINCT a) nr, count(DISTINCT b) nc FROM c JOIN r USING (a) JOIN k USING (b))"""


@query("cramers_v", CHI + " SELECT CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, round(sqrt(chi2 / n / (least(nr, nc) - 1)), 8) AS v FROM t")
def _q9(spark, d):
    """A13, plain."""
    return a.cramers_v(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select("n", *_r("chi2"), F.round("v", 8).alias("v"))


@query("cramers_v_corrected", CHI + """ SELECT CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, round(sqrt(greatest(0.0, chi2 / n - (nr - 1) * (nc - 1) / (n - 1)) / (least(nr - (nr - 1) * (nr - 1) / (n - 1), nc - (nc - 1) * (nc - 1) / (n - 1)) - 1)), 8) AS v FROM t""")
def _q10(spark, d):
    """A13, bias-corrected."""
    return a.cramers_v(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", True).select("n", *_r("chi2"), F.round("v", 8).alias("v"))


@query("eta_squared", f"""WITH {LATENT_SQL}, l AS (UNPIVOT latent ON x0, x1, x2, x3, x4, x5, x6, x7 INTO NAME axis VALUE x), g AS (SELECT axis, label, count(*) n, avg(x) m FROM l GROUP BY ALL), t AS (SELECT axis, avg(x) mu, var_pop(x) * count(*) ss FROM l GROUP BY 1)
SELECT axis, round(sum(n * pow(m - mu, 2)) / any_value(ss), 8) AS eta2 FROM g JOIN t USING (axis) GROUP BY 1""")
def _q11(spark, d):
    """A14."""
    return a.eta_squared(latent(spark, d), AXES, "label").select("axis", F.round("eta2", 8).alias("eta2"))


@query("adjusted_rand_index", """WITH c AS (SELECT o_orderpriority a, o_orderstatus b, CAST(count(*) AS DOUBLE) n FROM orders GROUP BY ALL), x AS (SELECT sum(n*(n-1)/2) ab, sum(n) n FROM c), sa AS (SELECT sum(n*(n-1)/2) s FROM (SELECT sum(n) n FROM c GROUP BY a)), sb AS (SELECT sum(n*(n-1)/2) s FROM (SELECT sum(n) n FROM c GROUP BY b))
SELECT round((ab - sa.s*sb.s/(n*(n-1)/2)) / ((sa.s+sb.s)/2 - sa.s*sb.s/(n*(n-1)/2)), 8) AS ari FROM x, sa, sb""")
def _q12(spark, d):
    """A15."""
    return a.adjusted_rand(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("ari", 8).alias("ari"))


@query("pairwise_correlation", f"""WITH {PANEL_SQL}, p AS (SELECT 'urgent_price' a, 'low_price' b, count(*) n, corr(urgent_price, low_price) r FROM panel WHERE urgent_price IS NOT NULL AND low_price IS NOT NULL UNION ALL SELECT 'urgent_price', 'mean_price', count(*), corr(urgent_price, mean_price) FROM panel WHERE urgent_price IS NOT NULL AND mean_price IS NOT NULL
 UNION ALL SELECT 'low_price', 'mean_price', count(*), corr(low_price, mean_price) FROM panel WHERE low_price IS NOT NULL AND mean_price IS NOT NULL) SELECT a, b, n, round(r, 7) AS r FROM p""")
def _q13(spark, d):
    """Pairs skip their own missing cells."""
    return a.pairwise_correlation(panel(spark, d), ["urgent_price", "low_price", "mean_price"]).select("a", "b", "n", F.round("r", 7).alias("r"))


@query("ks_distance", """WITH c AS (SELECT l_returnflag, l_quantity, count(*) FILTER (WHERE l_linestatus = 'F') a, count(*) FILTER (WHERE l_linestatus <> 'F') b FROM lineitem GROUP BY ALL),
g AS (SELECT l_returnflag, abs(sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY l_returnflag) AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY l_returnflag) AS DOUBLE)) AS gap FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity ROWS UNBOUNDED PRECEDING)) SELECT l_returnflag, round(max(gap), 8) AS ks FROM g GROUP BY 1""")
def _q14(spark, d):
    """Windows over distinct values, not rows."""
    li = table(spark, d, "lineitem").withColumn("side", F.col("l_linestatus") == "F")
    return a.ks_distance(li, "l_quantity", "side", ["l_returnflag"]).select("l_returnflag", F.round("ks", 8).alias("ks"))


@query("weighted_smd", """WITH o AS (SELECT CAST(o_orderpriority = '1-URGENT' AS INTEGER) t, o_totalprice x, 1 + o_orderkey % 3 AS w FROM orders) SELECT 'o_totalprice' AS item, round(abs(sum(w*x) FILTER (WHERE t=1) / sum(w) FILTER (WHERE t=1) - sum(w*x) FILTER (WHERE t=0) / sum(w) FILTER (WHERE t=0)) / sqrt((var_pop(x) FILTER (WHERE t=1) + var_pop(x) FILTER (WHERE t=0)) / 2), 8) AS smd FROM o""")
def _q15(spark, d):
    """Weighted means, unweighted variances."""
    o = table(spark, d, "orders").withColumn("t", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return a.standardized_difference(o, ["o_totalprice"], "t", 1 + F.col("o_orderkey") % 3).select("item", F.round("smd", 8).alias("smd"))


@query("direct_standardisation", f"""WITH {ORDERS_SQL}, c AS (SELECT o_orderpriority AS stratum, cohort, avg(done) r, count(*) n FROM o GROUP BY ALL), m AS (SELECT cohort, count(*) mix FROM o GROUP BY 1)
SELECT stratum, round(sum(r*n)/sum(n), 8) AS crude, round(sum(r*mix)/sum(mix), 8) AS standardized FROM c JOIN m USING (cohort) GROUP BY 1""")
def _q16(spark, d):
    """A19."""
    o = _orders(spark, d).withColumnRenamed("o_orderpriority", "stratum")
    return a.direct_standardized(o, "done", "stratum", "cohort").select("stratum", *_r("crude", "standardized", digits=8))


@query("raw_icc", f"""WITH {PANEL_SQL}, l AS (SELECT cohort, patient, 'mean_price' AS axis, mean_price x FROM panel UNION ALL SELECT cohort, patient, 'n_orders', n_orders FROM panel), p AS (SELECT axis, cohort, patient, avg(x) m, var_pop(x) v FROM l GROUP BY ALL HAVING count(*) >= 2)
SELECT axis, count(*) AS n, round(var_pop(m) / (var_pop(m) + avg(v)), 7) AS icc FROM p GROUP BY 1""")
def _q17(spark, d):
    """A20."""
    return a.raw_icc(panel(spark, d), ["cohort", "patient"], ["mean_price", "n_orders"]).select("axis", "n", F.round("icc", 7).alias("icc"))


@query("missingness_patterns", f"WITH {PANEL_SQL} SELECT CASE WHEN mean_price IS NULL THEN '0' ELSE '1' END || CASE WHEN urgent_price IS NULL THEN '0' ELSE '1' END || CASE WHEN low_price IS NULL THEN '0' ELSE '1' END AS mask, count(*) AS n FROM panel GROUP BY 1")
def _q18(spark, d):
    """A21."""
    return a.patterns(panel(spark, d), ["mean_price", "urgent_price", "low_price"])


@query("reliability_tiers", f"WITH {PANEL_SQL}, t AS (SELECT patient, visit, CAST(urgent_price IS NOT NULL AS INTEGER) + CAST(low_price IS NOT NULL AS INTEGER) + CAST(n_orders > 2 AS INTEGER) AS n_obs FROM panel) SELECT patient, visit, n_obs, CASE WHEN n_obs >= 3 THEN 'well' WHEN n_obs >= 1 THEN 'partial' ELSE 'prior_dominated' END AS tier FROM t")
def _q19(spark, d):
    """A22."""
    p = panel(spark, d).withColumn("many", F.when(F.col("n_orders") > 2, 1))
    n, tier = a.reliability_tier(["urgent_price", "low_price", "many"])
    return p.select("patient", "visit", n.alias("n_obs"), tier.alias("tier"))


@query("best_of", f"WITH {PANEL_SQL} SELECT cohort, round(avg(n_orders), 6) AS mean_n, bool_or(n_orders >= 7) AS any_busy, max_by(visit, n_orders * 1000 - visit_no) AS top_visit FROM panel GROUP BY 1")
def _q20(spark, d):
    """Average, any, and the label of the best (the earliest of equals)."""
    return panel(spark, d).groupBy("cohort").agg(F.round(F.avg("n_orders"), 6).alias("mean_n"), F.bool_or(F.col("n_orders") >= 7).alias("any_busy"), F.max_by("visit", F.col("n_orders") * 1000 - F.col("visit_no")).alias("top_visit"))


@query("fingerprint", """WITH r AS (SELECT c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) AS HUGEINT) * CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM customer)
SELECT 'c_acctbal' AS item, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, sha256(CAST(sum(h) AS VARCHAR)) AS rank_hash FROM r""")
def _q21(spark, d):
    """Moments, and a digest of the order of keys: places times keys' digests, summed, so no task gathers the keys."""
    return a.order_digest(table(spark, d, "customer"), "c_custkey", "c_acctbal").select("item", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "rank_hash")


@query("prior_merge", """SELECT p_brand, p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_partkey) = 1""")
def _q22(spark, d):
    """One row of each item by an explicit order of tiers; a partial aggregate, not a window."""
    tier = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    best = table(spark, d, "part").groupBy("p_brand").agg(F.min(F.struct(tier.alias("t"), "p_partkey", "p_type")).alias("x"))
    return best.select("p_brand", "x.p_partkey", "x.p_type")


@query("consistency_audit", """SELECT 'ship_before_order' AS check_name, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'discount_without_quantity', count(*) FILTER (WHERE l_discount > 0 AND l_quantity < 2) FROM lineitem""")
def _q23(spark, d):
    """Named counts of contradictions, in one pass."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    row = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("ship_before_order"), F.count_if((F.col("l_discount") > 0) & (F.col("l_quantity") < 2)).alias("discount_without_quantity"))
    return row.unpivot([], ["ship_before_order", "discount_without_quantity"], "check_name", "n")


@query("left_join_frame", f"""WITH {PANEL_SQL}, a AS (SELECT * FROM panel WHERE visit = 'V0'), b AS (SELECT * FROM panel WHERE visit = 'V1') SELECT a.cohort, a.patient, round(a.mean_price, 4) AS v0, round(b.mean_price, 4) AS v1, c_nationkey AS site FROM a LEFT JOIN b USING (cohort, patient) LEFT JOIN customer ON a.patient = c_custkey""")
def _q24(spark, d):
    """Left joins on the two-column key from the roster."""
    p = panel(spark, d)
    v0, v1 = (p.where(F.col("visit") == v).select("cohort", "patient", F.round("mean_price", 4).alias(v.lower())) for v in ("V0", "V1"))
    return v0.join(v1, ["cohort", "patient"], "left").join(table(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("site")), "patient", "left").select("cohort", "patient", "v0", "v1", "site")


@query("inner_both_visits", f"WITH {PANEL_SQL} SELECT cohort, patient FROM panel WHERE visit IN ('V0', 'V2') GROUP BY ALL HAVING count(DISTINCT visit) = 2")
def _q25(spark, d):
    """Present at both visits, with one shuffle and no self-join."""
    p = panel(spark, d).where(F.col("visit").isin("V0", "V2")).groupBy("cohort", "patient").agg(F.bit_or(F.when(F.col("visit") == "V0", 1).otherwise(2)).alias("seen"))
    return p.where("seen = 3").select("cohort", "patient")


@query("complement_arms", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'exposed' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'comparator' END AS arm FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def _q26(spark, d):
    """The comparator is a predicate, not an anti-join."""
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return o.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "exposed").otherwise("comparator").alias("arm"))


@query("shared_member_edges", """WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 48) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM d x JOIN d y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL""")
def _q27(spark, d):
    """Graph edges as shared members."""
    return a.shared_members(table(spark, d, "lineitem").where("l_quantity >= 48"), "l_suppkey", "l_partkey")


@query("top_n_per_group", "SELECT p_brand, p_partkey, rn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1000) DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def _q28(spark, d):
    """A top-k report; Spark keeps k rows of a group before the shuffle."""
    w = Window.partitionBy("p_brand").orderBy(F.abs(F.col("p_retailprice") - 1000).desc(), "p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 3").select("p_brand", "p_partkey", "rn")


@query("cumulative_reliability", "SELECT p_brand, p_partkey, round(1 - 1 / (1 + sum(p_size / 10.0) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING)), 8) AS reliability FROM part")
def _q29(spark, d):
    """Items by information, running precision."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "part").select("p_brand", "p_partkey", F.round(1 - 1 / (1 + F.sum(F.col("p_size") / 10.0).over(w)), 8).alias("reliability"))


@query("argmax_entropy", f"""WITH {LATENT_SQL}, w AS (SELECT vec_id, [x0*x0, x1*x1, x2*x2, x3*x3] AS v, x0*x0+x1*x1+x2*x2+x3*x3 AS s FROM latent), p AS (SELECT vec_id, list_transform(v, lambda x: x / s) AS p FROM w)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS dominant, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)) / ln(4), 8) AS entropy FROM p""")
def _q30(spark, d):
    """The first of the largest weights, and their normalised entropy."""
    sq = [F.col(f"x{k}") * F.col(f"x{k}") for k in range(4)]
    w = latent(spark, d, 4).withColumn("w", F.transform(F.array(*sq), lambda x: x / sum(sq[1:], sq[0])))
    return w.select("vec_id", first_argmax(F.col("w")).alias("dominant"), F.round(normalized_entropy(F.col("w")), 8).alias("entropy"))


@query("medoid_share", f"""WITH {LATENT_SQL}, c AS (SELECT label, count(*) n, avg(x0) c0, avg(x1) c1 FROM latent GROUP BY 1), d AS (SELECT label, n, vec_id, round(pow(x0-c0, 2) + pow(x1-c1, 2), 9) AS d2 FROM latent JOIN c USING (label))
SELECT label, n, vec_id AS medoid, d2 FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY d2, vec_id) = 1""")
def _q31(spark, d):
    """W8."""
    return a.medoids(latent(spark, d, 2), "label", "vec_id", ["x0", "x1"])


@query("union_cohorts", "SELECT o_orderkey AS id, o_totalprice AS price, CAST(NULL AS VARCHAR) AS flag FROM orders UNION ALL SELECT l_orderkey, NULL, l_returnflag FROM lineitem")
def _q32(spark, d):
    """Columns united, missing ones null."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"))
    return o.unionByName(li, allowMissingColumns=True)


@query("wilson_bounds_small", "WITH t AS (SELECT l_linenumber AS g, CAST(count(*) AS DOUBLE) n, CAST(count(*) FILTER (WHERE l_quantity >= 50) AS DOUBLE) k FROM lineitem GROUP BY 1) SELECT g, round(" + WILSON.format(s="-") + ", 8) AS lo, round(" + WILSON.format(s="+") + ", 8) AS hi FROM t")
def _q33(spark, d):
    """A5, unclipped."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 50).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"), clip=False)
    return t.select("g", F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))
