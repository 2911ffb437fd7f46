"""Queries of completeness filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import select as s
from quillon.plans.catalog import query
from quillon.sources.roles import PANEL_SQL, panel, table

NUMERIC = ["mean_price", "max_price", "urgent_price", "low_price", "n_orders"]


@query("variable_completeness", f"""WITH {PANEL_SQL}, v AS (SELECT * FROM panel WHERE visit = 'V0') SELECT 'mean_price' AS variable, round(avg(CAST(mean_price IS NOT NULL AS INTEGER)), 8) AS completeness FROM v
 UNION ALL SELECT 'max_price', round(avg(CAST(max_price IS NOT NULL AS INTEGER)), 8) FROM v UNION ALL SELECT 'urgent_price', round(avg(CAST(urgent_price IS NOT NULL AS INTEGER)), 8) FROM v
 UNION ALL SELECT 'low_price', round(avg(CAST(low_price IS NOT NULL AS INTEGER)), 8) FROM v UNION ALL SELECT 'n_orders', round(avg(CAST(n_orders IS NOT NULL AS INTEGER)), 8) FROM v""")
def _q1(spark, d):
    """the report behind variable filtering."""
    return s.completeness(panel(spark, d).where("visit = 'V0'"), NUMERIC).select("variable", F.round("completeness", 8).alias("completeness"))


@query("filter_patients_anchor", f"""WITH {PANEL_SQL} SELECT cohort, patient, visit FROM panel SEMI JOIN (SELECT cohort, patient FROM panel WHERE visit = 'V0' AND CAST(urgent_price IS NOT NULL AS INTEGER) + CAST(low_price IS NOT NULL AS INTEGER) >= 1) a USING (cohort, patient)""")
def _q2(spark, d):
    """The decision at baseline carries to other visits, by semi-join on the two-column key."""
    return s.filter_entities(panel(spark, d), ["urgent_price", "low_price"], 0.5, ["cohort", "patient"], "V0").select("cohort", "patient", "visit")


@query("baseline_anchor", f"""WITH {PANEL_SQL}, c AS (SELECT avg(CAST(urgent_price IS NOT NULL AS INTEGER)) u, avg(CAST(low_price IS NOT NULL AS INTEGER)) l FROM panel WHERE visit = 'V0'),
r AS (SELECT cohort, patient FROM panel, c WHERE visit = 'V0' AND (2.0 + CASE WHEN u >= 0.3 THEN CAST(urgent_price IS NOT NULL AS INTEGER) ELSE 0 END + CASE WHEN l >= 0.3 THEN CAST(low_price IS NOT NULL AS INTEGER) ELSE 0 END) / (2 + CAST(u >= 0.3 AS INTEGER) + CAST(l >= 0.3 AS INTEGER)) >= 0.75)
SELECT cohort, patient, visit, round(mean_price, 4) AS mean_price FROM panel SEMI JOIN r USING (cohort, patient)""")
def _q3(spark, d):
    """variables, then entities, at baseline; projected on all visits."""
    p = panel(spark, d)
    a = s.anchor(p, ["mean_price", "n_orders", "urgent_price", "low_price"], ["cohort", "patient"], 0.3)
    return a.apply(p).select("cohort", "patient", "visit", F.round("mean_price", 4).alias("mean_price"))


@query("coverage_gate", f"""WITH {PANEL_SQL}, l AS (SELECT cohort, 'urgent_price' AS item FROM panel WHERE urgent_price IS NOT NULL UNION ALL SELECT cohort, 'low_price' FROM panel WHERE low_price IS NOT NULL UNION ALL SELECT cohort, 'mean_price' FROM panel WHERE mean_price IS NOT NULL)
SELECT item, count(*) AS n_obs, count(DISTINCT cohort) AS n_cohorts, count(*) >= 2500 AND count(DISTINCT cohort) >= 3 AS covered FROM l GROUP BY 1""")
def _q4(spark, d):
    """F5."""
    return s.coverage(panel(spark, d), ["urgent_price", "low_price", "mean_price"], "cohort", 2500, 3)


@query("gaussianizable_gate", """WITH l AS (SELECT 'l_quantity' AS item, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS DOUBLE) FROM lineitem),
c AS (SELECT item, value, count(*) n FROM l GROUP BY ALL) SELECT item, count(*) AS n_distinct, round(max(n) / CAST(sum(n) AS DOUBLE), 8) AS modal_share, count(*) >= 8 AND max(n) / CAST(sum(n) AS DOUBLE) < 0.5 AS gaussianizable FROM c GROUP BY 1""")
def _q5(spark, d):
    """F6."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", F.col("l_linenumber").cast("double").alias("l_linenumber"))
    return s.gaussianizable(li, ["l_quantity", "l_discount", "l_linenumber"]).withColumn("modal_share", F.round("modal_share", 8))


@query("complete_cases", f"WITH {PANEL_SQL} SELECT cohort, patient, visit FROM panel WHERE urgent_price IS NOT NULL AND low_price IS NOT NULL")
def _q6(spark, d):
    """F7, F8."""
    return panel(spark, d).dropna(subset=["urgent_price", "low_price"]).select("cohort", "patient", "visit")


@query("cohort_scope_mask", f"WITH {PANEL_SQL} SELECT cohort, patient, visit, CASE WHEN cohort IN ('BUILDING', 'MACHINERY') THEN n_orders END AS n_orders FROM panel")
def _q7(spark, d):
    """out of scope is missing."""
    return panel(spark, d).select("cohort", "patient", "visit", F.when(F.col("cohort").isin("BUILDING", "MACHINERY"), F.col("n_orders")).alias("n_orders"))


@query("site_hold_out", f"WITH {PANEL_SQL} SELECT cohort, patient, visit FROM panel JOIN customer ON patient = c_custkey WHERE c_nationkey <> 3")
def _q8(spark, d):
    """all rows of one site left out."""
    sites = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return panel(spark, d).join(sites, F.col("patient") == F.col("c_custkey")).where("c_nationkey <> 3").select("cohort", "patient", "visit")


@query("common_support", """WITH b AS (SELECT o_orderpriority = '1-URGENT' AS treat, min(o_totalprice) lo, max(o_totalprice) hi FROM orders GROUP BY 1), c AS (SELECT max(lo) lo, min(hi) hi FROM b)
SELECT o_orderkey FROM orders, c WHERE o_totalprice BETWEEN lo AND hi""")
def _q9(spark, d):
    """the range that both arms have."""
    o = table(spark, d, "orders")
    arms = o.groupBy((F.col("o_orderpriority") == "1-URGENT").alias("treat")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    both = arms.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return o.crossJoin(F.broadcast(both)).where("o_totalprice between lo and hi").select("o_orderkey")
