"""Longitudinal operators: retention, change, persistence, trajectories, invariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import first_argmax
from quillon.operators.ordered import quantiles


def visit_number(visit: Column) -> Column:
    """The number in a visit's label; null without one."""
    return F.regexp_extract(visit, r"([0-9]+)", 1).try_cast("int")


def retention(df: DataFrame, visits: list[str], cohort: str = "cohort", entity: str = "patient", visit: str = "visit", baseline: str = "V0") -> DataFrame:
    """cohort, visit, n, fraction of baseline, with a row for every cohort and visit of the window."""
    seen = df.where(F.col(visit).isin(*visits)).groupBy(cohort, visit).agg(F.count_distinct(entity).alias("n"))
    grid = df.select(cohort).distinct().select(cohort, F.explode(F.array(*map(F.lit, visits))).alias(visit))
    full = grid.join(seen, [cohort, visit], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = full.where(F.col(visit) == baseline).select(cohort, F.col("n").alias("_b"))
    return full.join(F.broadcast(base), cohort).select(cohort, visit, "n", F.when(F.col("_b") > 0, F.col("n") / F.col("_b")).alias("fraction"))  # a row for each cohort


def entity_retention(df: DataFrame, keys: list[str], visits: list[str], visit: str = "visit", baseline: str = "V0") -> DataFrame:
    """A row for each entity seen at baseline: flags of visits, number of visits, the last by number and by label."""
    flags = [F.max((F.col(visit) == v).cast("int")).alias(f"at_{v}") for v in visits]
    out = df.groupBy(*keys).agg(*flags, F.count_distinct(visit).alias("n_visits"), F.max_by(visit, visit_number(F.col(visit))).alias("last_visit"), F.max(visit).alias("last_label"), F.max((F.col(visit) == baseline).cast("int")).alias("_b"))
    return out.where("_b = 1").drop("_b")


def at_both(df: DataFrame, keys: list[str], values: list[str], first: str, last: str, visit: str = "visit") -> DataFrame:
    """keys, {value}_a, {value}_b of entities seen at both visits: one shuffle, no self-join."""
    pick = lambda v, c: F.first(F.when(F.col(visit) == v, F.col(c)), ignorenulls=True)
    have = F.bit_or(F.when(F.col(visit) == first, 1).otherwise(2)).alias("_seen")
    out = df.where(F.col(visit).isin(first, last)).groupBy(*keys).agg(have, *[pick(v, c).alias(f"{c}_{s}") for c in values for v, s in ((first, "a"), (last, "b"))])
    return out.where("_seen = 3").drop("_seen")


def reliable_change(pairs: DataFrame, axes: list[tuple[str, str]], z: float = 1.96) -> DataFrame:
    """axis, n, shares of reliable change, decrease and increase, mean absolute change. axes: (mean, sd) column stems."""
    cell = [F.struct(F.lit(m).alias("axis"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("d"), F.sqrt(F.col(f"{s}_a") ** 2 + F.col(f"{s}_b") ** 2).alias("se")) for m, s in axes]
    long = pairs.select(F.explode(F.array(*cell)).alias("c")).select("c.axis", "c.d", (F.col("c.d") / F.col("c.se")).alias("r")).where("d is not null")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    r = F.col("r")
    return long.groupBy("axis").agg(F.count("*").alias("n"), share(F.abs(r) >= z).alias("frac_reliable"), share(r <= -z).alias("frac_decrease"), share(r >= z).alias("frac_increase"), F.avg(F.abs("d")).alias("mean_abs_delta"))


def spine_corner(pairs: DataFrame, spine: list[tuple[str, str]], corner: list[tuple[str, str]], spine_limit: float, corner_limit: float) -> DataFrame:
    """n and the 2 x 2 of reliable movement on the spine and on the corner; limits are chi-square quantiles."""
    d2 = lambda axes: sum(((F.col(f"{m}_b") - F.col(f"{m}_a")) ** 2 / (F.col(f"{s}_a") ** 2 + F.col(f"{s}_b") ** 2) for m, s in axes), F.lit(0.0))
    s, c = d2(spine) > spine_limit, d2(corner) > corner_limit
    share = lambda x: F.avg(x.cast("double"))
    return pairs.agg(F.count("*").alias("n"), share(s).alias("spine_rate"), share(c).alias("corner_rate"), share(s & ~c).alias("spine_not_corner"), share(~s & c).alias("corner_not_spine"), share(s & c).alias("both"), share(~s & ~c).alias("neither"))


def soft_transitions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """from_k, to_k, weight, share: summed outer products of weight arrays, rows normalised."""
    x = pairs.select(F.posexplode(a).alias("from_k", "wa"), F.col(b).alias("_b")).select("from_k", "wa", F.posexplode("_b").alias("to_k", "wb"))
    t = x.groupBy("from_k", "to_k").agg(F.sum(F.col("wa") * F.col("wb")).alias("weight"))
    rows = t.groupBy("from_k").agg(F.greatest(F.sum("weight"), F.lit(1e-12)).alias("_s"))
    return t.join(F.broadcast(rows), "from_k").select("from_k", "to_k", "weight", (F.col("weight") / F.col("_s")).alias("share"))  # components squared


def dominant_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement of the dominant components, Cohen's kappa, median and tenth percentile of the weights' cosine."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cos = dot(F.col(a), F.col(b)) / F.greatest(F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))), F.lit(1e-12))
    d = pairs.select(first_argmax(F.col(a)).alias("da"), first_argmax(F.col(b)).alias("db"), cos.alias("cos"))
    base = d.agg(F.count("*").alias("n"), F.avg((F.col("da") == F.col("db")).cast("double")).alias("agree"))
    cells = d.groupBy("da", "db").agg(F.count("*").alias("k"))
    ra, rb = cells.groupBy(F.col("da").alias("c")).agg(F.sum("k").alias("ka")), cells.groupBy(F.col("db").alias("c")).agg(F.sum("k").alias("kb"))
    chance = ra.join(rb, "c").agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0)).alias("_e"))
    e = F.col("_e") / (F.col("n") * F.col("n"))
    q = quantiles(d, [], "cos", [0.5, 0.1]).select(F.col("q")[0].alias("cos_median"), F.col("q")[1].alias("cos_q10"))
    return base.crossJoin(F.broadcast(chance)).crossJoin(F.broadcast(q)).select("n", "agree", ((F.col("agree") - e) / (1 - e)).alias("kappa"), "cos_median", "cos_q10")


def trajectory(v0: Column, v1: Column, v2: Column, s0: Column, s1: Column, s2: Column, z: float = 1.96) -> Column:
    """stable (no reliable leg), oscillating (two of opposite sign), drifting (any other)."""
    r1, r2 = (v1 - v0) / F.sqrt(s0**2 + s1**2), (v2 - v1) / F.sqrt(s1**2 + s2**2)
    m1, m2 = F.abs(r1) >= z, F.abs(r2) >= z
    return F.when(r1.isNull() | r2.isNull(), None).when(~m1 & ~m2, "stable").when(m1 & m2 & (r1 * r2 < 0), "oscillating").otherwise("drifting")


def tucker_congruence(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """by, phi, licence of two loading columns."""
    out = df.groupBy(by).agg((F.sum(F.col(a) * F.col(b)) / F.sqrt(F.sum(F.col(a) ** 2) * F.sum(F.col(b) ** 2))).alias("phi"))
    return out.withColumn("licence", F.when(F.col("phi") >= 0.95, "metric").when(F.col("phi") >= 0.85, "partial").otherwise("none"))


def intercept_drift(df: DataFrame, y: str, latent: str, later: Column, least: int = 20) -> DataFrame:
    """n, shift, shift_sd: coefficient of `later` (0/1) in y ~ 1 + latent + later, by normal equations in one pass."""
    d = df.where(F.col(y).isNotNull() & F.col(latent).isNotNull()).select(F.col(y).alias("y"), F.col(latent).alias("x"), later.cast("double").alias("g"))
    c = d.agg(F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.var_pop("g").alias("gg"), F.covar_pop("x", "g").alias("xg"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("g", "y").alias("gy"), F.stddev_pop("y").alias("sd"))
    shift = (F.col("gy") * F.col("xx") - F.col("xy") * F.col("xg")) / (F.col("gg") * F.col("xx") - F.col("xg") * F.col("xg"))
    return c.where(F.col("n") >= least).select("n", shift.alias("shift"), (shift / F.col("sd")).alias("shift_sd"))


def threshold(x: Column, op: str, value: float) -> Column:
    """1 or 0 of x against a value; missing stays missing. Operators other than >= and <= are refused."""
    if op not in (">=", "<="):
        raise ValueError(op)
    return ((x >= value) if op == ">=" else (x <= value)).cast("int")


def response(first: Column, last: Column, op: str, value: float) -> Column:
    """1 or 0 of a fall from first to last: drop>= in units, pct_drop>= in shares of a first value that isn't 0."""
    if op == "drop>=":
        return (first - last >= value).cast("int")
    if op == "pct_drop>=":
        return F.when(first != 0, ((first - last) / first >= value).cast("int"))
    raise ValueError(op)


def functioning_endpoints(s: str, c: str) -> dict[str, Column]:
    """The seven endpoints of a functioning score {s}_V0.. and a severity score {c}_V0..; each is missing if a visit it needs is."""
    e, g = (lambda k: F.col(f"{s}_V{k}")), (lambda k: F.col(f"{c}_V{k}"))
    all_ = lambda *x: sum((v.isNull().cast("int") for v in x), F.lit(0)) == 0
    if_ = lambda cond, needed: F.when(all_(*needed), cond.cast("int"))
    return {
        "remission": if_(e(2) >= 71, [e(0), e(2)]),
        "recovery": F.when(e(0) < 61, if_(e(2) >= 71, [e(0), e(2)])),
        "deterioration": if_(e(0) - e(2) >= 10, [e(0), e(2)]),
        "sustained_impairment": if_((e(1) < 61) & (e(2) < 61), [e(0), e(1), e(2)]),
        "severity_remission": if_(g(2) <= 2, [g(0), g(2)]),
        "relapse": if_(g(2) >= g(0) + 2, [g(0), g(2)]),
        "sustained_severe": if_((g(1) >= 4) & (g(2) >= 4), [g(0), g(1), g(2)]),
    }


def in_range(x: Column, low: float, high: float) -> Column:
    """x where it is a valid rating; 0 and out-of-range codes are missing."""
    return F.when((x >= low) & (x <= high), x)
