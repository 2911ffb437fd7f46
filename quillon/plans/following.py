"""Queries of longitudinal operators and endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import panel as p
from quillon.plans.catalog import query
from quillon.sources.roles import LATENT_SQL, PANEL_SQL, WIDE_SQL, latent, panel, table, wide

VISITS = ["V0", "V1", "V2", "V3", "V9"]
PAIR_SQL = """pair AS (SELECT cohort, patient, max(mean_price) FILTER (WHERE visit='V0') a, max(mean_price) FILTER (WHERE visit='V2') b, max(n_orders) FILTER (WHERE visit='V0') na, max(n_orders) FILTER (WHERE visit='V2') nb FROM panel WHERE visit IN ('V0','V2') GROUP BY ALL HAVING count(DISTINCT visit) = 2)"""
SCALED_SQL = "wide2 AS (SELECT *, " + ", ".join(f"mean_price_V{k} / 4000 AS e{k}, n_orders_V{k} AS g{k}" for k in range(3)) + " FROM wide)"


def _pairs(spark, d):
    x = panel(spark, d).select("cohort", "patient", "visit", "mean_price", F.lit(40000.0).alias("sd"), "n_orders", F.lit(1.0).alias("sn"))
    return p.at_both(x, ["cohort", "patient"], ["mean_price", "sd", "n_orders", "sn"], "V0", "V2")


@query("retention", f"""WITH {PANEL_SQL}, g AS (SELECT DISTINCT cohort, v.visit FROM panel, (VALUES ('V0'), ('V1'), ('V2'), ('V3'), ('V9')) v(visit)), s AS (SELECT cohort, visit, count(DISTINCT patient) n FROM panel GROUP BY ALL),
f AS (SELECT cohort, visit, coalesce(n, 0) AS n FROM g LEFT JOIN s USING (cohort, visit)) SELECT f.cohort, f.visit, CAST(f.n AS BIGINT) AS n, round(f.n / CAST(b.n AS DOUBLE), 8) AS fraction FROM f JOIN f b ON f.cohort = b.cohort AND b.visit = 'V0'""")
def _q1(spark, d):
    """A3: distinct entities by cohort and visit against baseline; visits nobody has count 0."""
    return p.retention(panel(spark, d), VISITS).select("cohort", "visit", F.col("n").cast("bigint").alias("n"), F.round("fraction", 8).alias("fraction"))


@query("patient_retention", f"""WITH {PANEL_SQL} SELECT cohort, patient, max(CAST(visit='V1' AS INTEGER)) AS "at_V1", max(CAST(visit='V2' AS INTEGER)) AS "at_V2", count(DISTINCT visit) AS n_visits, max_by(visit, visit_no) AS last_visit, max(visit) AS last_label FROM panel GROUP BY ALL HAVING bool_or(visit='V0')""")
def _q2(spark, d):
    """Entities without baseline are left out; the last visit by number, and by label."""
    return p.entity_retention(panel(spark, d), ["cohort", "patient"], ["V1", "V2"])


@query("reliable_change", f"""WITH {PANEL_SQL}, {PAIR_SQL}, l AS (SELECT 'mean_price' axis, b - a d, (b - a) / sqrt(2 * 40000.0 * 40000.0) r FROM pair UNION ALL SELECT 'n_orders', nb - na, (nb - na) / sqrt(2.0) FROM pair)
SELECT axis, count(*) AS n, round(avg(CAST(abs(r) >= 1.96 AS INTEGER)), 8) AS frac_reliable, round(avg(CAST(r <= -1.96 AS INTEGER)), 8) AS frac_decrease, round(avg(CAST(r >= 1.96 AS INTEGER)), 8) AS frac_increase, round(avg(abs(d)), 4) AS mean_abs_delta FROM l GROUP BY 1""")
def _q3(spark, d):
    """L6, J4."""
    out = p.reliable_change(_pairs(spark, d), [("mean_price", "sd"), ("n_orders", "sn")])
    return out.select("axis", "n", *[F.round(c, 8).alias(c) for c in ("frac_reliable", "frac_decrease", "frac_increase")], F.round("mean_abs_delta", 4).alias("mean_abs_delta"))


@query("spine_corner", f"""WITH {PANEL_SQL}, {PAIR_SQL}, t AS (SELECT pow(b - a, 2) / (2 * 40000.0 * 40000.0) > 3.5374 AS s, pow(nb - na, 2) / 2 > 3.5374 AS c FROM pair)
SELECT count(*) AS n, round(avg(CAST(s AS INTEGER)), 8) AS spine_rate, round(avg(CAST(c AS INTEGER)), 8) AS corner_rate, round(avg(CAST(s AND NOT c AS INTEGER)), 8) AS spine_not_corner, round(avg(CAST(NOT s AND c AS INTEGER)), 8) AS corner_not_spine, round(avg(CAST(s AND c AS INTEGER)), 8) AS both, round(avg(CAST(NOT s AND NOT c AS INTEGER)), 8) AS neither FROM t""")
def _q4(spark, d):
    """L7."""
    out = p.spine_corner(_pairs(spark, d), [("mean_price", "sd")], [("n_orders", "sn")], 3.5374, 3.5374)
    return out.select("n", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


WEIGHTS_SQL = """w AS (SELECT vec_id, label, [x0*x0/(x0*x0+x1*x1+x2*x2), x1*x1/(x0*x0+x1*x1+x2*x2), x2*x2/(x0*x0+x1*x1+x2*x2)] AS a, [x3*x3/(x3*x3+x4*x4+x5*x5), x4*x4/(x3*x3+x4*x4+x5*x5), x5*x5/(x3*x3+x4*x4+x5*x5)] AS b FROM latent)"""


def _weights(spark, d):
    sq = [F.col(f"x{k}") * F.col(f"x{k}") for k in range(6)]
    simplex = lambda x: F.array(*[v / (x[0] + x[1] + x[2]) for v in x])
    return latent(spark, d).select("vec_id", simplex(sq[:3]).alias("a"), simplex(sq[3:]).alias("b"))


@query("membership_transitions", f"""WITH {LATENT_SQL}, {WEIGHTS_SQL}, i AS (SELECT unnest([0, 1, 2]) AS f), j AS (SELECT unnest([0, 1, 2]) AS t), x AS (SELECT f, t, sum(a[f+1] * b[t+1]) AS s FROM w, i, j GROUP BY ALL)
SELECT CAST(f AS INTEGER) AS from_k, CAST(t AS INTEGER) AS to_k, round(s, 7) AS weight, round(s / sum(s) OVER (PARTITION BY f), 8) AS share FROM x""")
def _q5(spark, d):
    """The soft transition matrix."""
    return p.soft_transitions(_weights(spark, d), "a", "b").select("from_k", "to_k", F.round("weight", 7).alias("weight"), F.round("share", 8).alias("share"))


@query("dominant_agreement", f"""WITH {LATENT_SQL}, {WEIGHTS_SQL}, c AS (SELECT list_position(a, list_max(a)) da, list_position(b, list_max(b)) db, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cs FROM w),
m AS (SELECT count(*) n, avg(CAST(da = db AS INTEGER)) ag, median(cs) md, quantile_cont(cs, 0.1) q FROM c), e AS (SELECT sum(x.k * y.k) / CAST(pow((SELECT n FROM m), 2) AS DOUBLE) AS e FROM (SELECT da, count(*) k FROM c GROUP BY 1) x JOIN (SELECT db, count(*) k FROM c GROUP BY 1) y ON da = db)
SELECT n, round(ag, 8) AS agree, round((ag - e) / (1 - e), 8) AS kappa, round(md, 8) AS cos_median, round(q, 8) AS cos_q10 FROM m, e""")
def _q6(spark, d):
    """Agreement, kappa, cosines."""
    out = p.dominant_agreement(_weights(spark, d), "a", "b")
    return out.select("n", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query("trajectory_types", f"""WITH {PANEL_SQL}, {WIDE_SQL}, t AS (SELECT patient, (n_orders_V1 - n_orders_V0) / sqrt(2.0) r1, (n_orders_V2 - n_orders_V1) / sqrt(2.0) r2 FROM wide WHERE n_orders_V0 IS NOT NULL AND n_orders_V1 IS NOT NULL AND n_orders_V2 IS NOT NULL)
SELECT patient, CASE WHEN abs(r1) < 1.96 AND abs(r2) < 1.96 THEN 'stable' WHEN abs(r1) >= 1.96 AND abs(r2) >= 1.96 AND r1 * r2 < 0 THEN 'oscillating' ELSE 'drifting' END AS kind FROM t""")
def _q7(spark, d):
    """L9."""
    n = [F.col(f"n_orders_V{k}") for k in range(3)]
    one = F.lit(1.0)
    return wide(spark, d).select("patient", p.trajectory(*n, one, one, one).alias("kind")).where("kind is not null")


@query("tucker_congruence", f"""WITH {LATENT_SQL}, t AS (SELECT label, sum(x0 * (x0 + x1 / 4)) / sqrt(sum(x0 * x0) * sum(pow(x0 + x1 / 4, 2))) AS phi FROM latent GROUP BY 1) SELECT label, round(phi, 8) AS phi, CASE WHEN phi >= 0.95 THEN 'metric' WHEN phi >= 0.85 THEN 'partial' ELSE 'none' END AS licence FROM t""")
def _q8(spark, d):
    """L12, M15, M18."""
    x = latent(spark, d, 2).withColumn("y", F.col("x0") + F.col("x1") / 4)
    return p.tucker_congruence(x, "x0", "y", "label").select("label", F.round("phi", 8).alias("phi"), "licence")


@query("intercept_drift", f"""WITH {PANEL_SQL}, d AS (SELECT urgent_price y, mean_price x, CAST(visit <> 'V0' AS INTEGER) g FROM panel WHERE urgent_price IS NOT NULL), c AS (SELECT count(*) n, var_pop(x) xx, var_pop(g) gg, covar_pop(x, g) xg, covar_pop(x, y) xy, covar_pop(g, y) gy, stddev_pop(y) sd FROM d)
SELECT n, round((gy * xx - xy * xg) / (gg * xx - xg * xg), 3) AS shift, round((gy * xx - xy * xg) / (gg * xx - xg * xg) / sd, 6) AS shift_sd FROM c""")
def _q9(spark, d):
    """L13."""
    return p.intercept_drift(panel(spark, d), "urgent_price", "mean_price", F.col("visit") != "V0").select("n", F.round("shift", 3).alias("shift"), F.round("shift_sd", 6).alias("shift_sd"))


@query("native_outcomes", f"""WITH {PANEL_SQL}, {WIDE_SQL} SELECT patient, CASE WHEN cohort = 'BUILDING' THEN round("mean_price_V0", 4) END AS "price__V0", CASE WHEN cohort = 'BUILDING' THEN round("mean_price_V2", 4) END AS "price__V2", CAST(NULL AS DOUBLE) AS "absent__V0" FROM wide WHERE n_orders_V0 IS NOT NULL""")
def _q10(spark, d):
    """L1: scope-masked outcome columns on the baseline roster; an absent variable is all missing."""
    w = wide(spark, d).where("n_orders_V0 is not null")
    mine = F.col("cohort") == "BUILDING"
    return w.select("patient", *[F.when(mine, F.round(f"mean_price_{v}", 4)).alias(f"price__{v}") for v in ("V0", "V2")], F.lit(None).cast("double").alias("absent__V0"))


@query("threshold_response", f"""WITH {PANEL_SQL}, {WIDE_SQL} SELECT patient, CAST(n_orders_V2 >= 3 AS INTEGER) AS busy, CAST(n_orders_V0 - n_orders_V2 >= 2 AS INTEGER) AS fell, CASE WHEN mean_price_V0 <> 0 THEN CAST((mean_price_V0 - mean_price_V2) / mean_price_V0 >= 0.5 AS INTEGER) END AS halved FROM wide""")
def _q11(spark, d):
    """L2."""
    w = wide(spark, d)
    return w.select("patient", p.threshold(F.col("n_orders_V2"), ">=", 3).alias("busy"), p.response(F.col("n_orders_V0"), F.col("n_orders_V2"), "drop>=", 2).alias("fell"), p.response(F.col("mean_price_V0"), F.col("mean_price_V2"), "pct_drop>=", 0.5).alias("halved"))


@query("functioning_endpoints", f"""WITH {PANEL_SQL}, {WIDE_SQL}, {SCALED_SQL} SELECT patient, CASE WHEN e0 IS NOT NULL AND e2 IS NOT NULL THEN CAST(e2 >= 71 AS INTEGER) END AS remission, CASE WHEN e0 < 61 AND e2 IS NOT NULL THEN CAST(e2 >= 71 AS INTEGER) END AS recovery,
 CASE WHEN e0 IS NOT NULL AND e2 IS NOT NULL THEN CAST(e0 - e2 >= 10 AS INTEGER) END AS deterioration, CASE WHEN e0 IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL THEN CAST(e1 < 61 AND e2 < 61 AS INTEGER) END AS sustained_impairment,
 CASE WHEN g0 IS NOT NULL AND g2 IS NOT NULL THEN CAST(g2 <= 2 AS INTEGER) END AS severity_remission, CASE WHEN g0 IS NOT NULL AND g2 IS NOT NULL THEN CAST(g2 >= g0 + 2 AS INTEGER) END AS relapse, CASE WHEN g0 IS NOT NULL AND g1 IS NOT NULL AND g2 IS NOT NULL THEN CAST(g1 >= 4 AND g2 >= 4 AS INTEGER) END AS sustained_severe FROM wide2""")
def _q12(spark, d):
    """L3, L4."""
    w = wide(spark, d)
    w = w.select("patient", *[(F.col(f"mean_price_V{k}") / 4000).alias(f"e_V{k}") for k in range(3)], *[F.col(f"n_orders_V{k}").alias(f"g_V{k}") for k in range(3)])
    return w.select("patient", *[c.alias(n) for n, c in p.functioning_endpoints("e", "g").items()])


@query("treatment_endpoints", """WITH t AS (SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 7 THEN p_size END AS i, CASE WHEN p_size % 10 BETWEEN 1 AND 7 THEN p_size % 10 END AS s, p_size % 11 AS m, p_brand FROM part)
SELECT p_partkey, CAST(i <= 2 AS INTEGER) AS response, CAST(i >= 3 AND s >= 4 AS INTEGER) AS resistance, CASE WHEN p_brand <> 'Brand#3' THEN CAST(m <= 5 AS INTEGER) END AS nonadherence FROM t""")
def _q13(spark, d):
    """Invalid ratings are missing; one scale isn't range-checked, and is blanked in one cohort."""
    size = F.col("p_size")
    i, s = p.in_range(size, 1, 7), p.in_range(size % 10, 1, 7)
    return table(spark, d, "part").select("p_partkey", p.threshold(i, "<=", 2).alias("response"), ((i >= 3) & (s >= 4)).cast("int").alias("resistance"), F.when(F.col("p_brand") != "Brand#3", p.threshold(size % 11, "<=", 5)).alias("nonadherence"))


@query("age_at_visit", f"WITH {PANEL_SQL} SELECT patient, visit, 30 + patient % 40 + visit_no AS age FROM panel WHERE visit_no <= 2")
def _q14(spark, d):
    """Baseline age and nominal offset."""
    return panel(spark, d).where(p.visit_number(F.col("visit")) <= 2).select("patient", "visit", (30 + F.col("patient") % 40 + p.visit_number(F.col("visit"))).alias("age"))


@query("attrition_weights", f"""WITH {PANEL_SQL}, {WIDE_SQL}, r AS (SELECT patient, cohort, CAST(n_orders_V2 IS NOT NULL AS INTEGER) kept FROM wide WHERE n_orders_V0 IS NOT NULL), p AS (SELECT cohort, least(greatest(avg(kept), 0.001), 0.999) pr FROM r GROUP BY 1)
SELECT patient, round(CASE WHEN kept = 1 THEN (SELECT avg(kept) FROM r) / pr ELSE 0.0 END, 8) AS weight FROM r JOIN p USING (cohort)""")
def _q15(spark, d):
    """L14 with the saturated cohort model, whose fit is each cohort's rate; dropouts weigh 0, not null."""
    r = wide(spark, d).where("n_orders_V0 is not null").select("patient", "cohort", F.col("n_orders_V2").isNotNull().cast("int").alias("kept"))
    by = r.groupBy("cohort").agg(F.least(F.greatest(F.avg("kept"), F.lit(0.001)), F.lit(0.999)).alias("pr"))
    j = r.join(F.broadcast(by), "cohort").crossJoin(F.broadcast(r.agg(F.avg("kept").alias("mean"))))
    return j.select("patient", F.round(F.when(F.col("kept") == 1, F.col("mean") / F.col("pr")).otherwise(0.0), 8).alias("weight"))
