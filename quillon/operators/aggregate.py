"""Aggregates over cohorts: profiles, rates, association, correlation, two-level decompositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import wilson
from quillon.operators.ordered import joined_by, median, sums_before


def coverage_by_item(df: DataFrame, items: list[str], cohort: str) -> DataFrame:
    """item, cohort (null: all), n_rows, n_obs, fraction."""
    long = df.unpivot([cohort], items, "item", "value")
    out = long.groupingSets([["item"], ["item", cohort]], "item", cohort).agg(F.count("*").alias("n_rows"), F.count("value").alias("n_obs"))
    return out.withColumn("fraction", F.col("n_obs") / F.col("n_rows"))


def rate_table(df: DataFrame, endpoint: str, by: list[str], clip: bool = True) -> DataFrame:
    """n, k, rate and Wilson bounds of a 0/1 endpoint by group, over rows that have it."""
    out = df.where(F.col(endpoint).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(endpoint).cast("bigint")).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"), clip)
    return out.withColumns({"rate": F.col("k") / F.col("n"), "lo": lo, "hi": hi})


def atlas(df: DataFrame, endpoint: str, stratum: str, cohort: str, least: int = 30) -> DataFrame:
    """The rate table of each stratum, pooled (cohort 'all') and by cohorts that have at least `least` rows in it."""
    have = df.where(F.col(endpoint).isNotNull() & F.col(cohort).isNotNull())
    out = have.groupingSets([[stratum], [stratum, cohort]], stratum, cohort).agg(F.count("*").alias("n"), F.sum(F.col(endpoint).cast("bigint")).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"), clip=False)
    return out.where(F.col(cohort).isNull() | (F.col("n") >= least)).select(stratum, F.coalesce(cohort, F.lit("all")).alias(cohort), "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def profile(df: DataFrame, items: list[str]) -> DataFrame:
    """item, n, n_distinct, modal and zero share, min, max, mean, sd (population), median, skew, excess kurtosis, form."""
    long = df.unpivot([], items, "item", "value").where("value is not null")
    counts = long.groupBy("item", "value").agg(F.count("*").alias("n")).groupBy("item").agg(F.count("*").alias("n_distinct"), (F.max("n") / F.sum("n")).alias("modal_share"))
    v = F.col("value")
    stats = long.groupBy("item").agg(F.count("*").alias("n"), F.avg((v == 0).cast("double")).alias("zero_share"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))
    form = F.when(F.col("n_distinct") <= 2, "binary").when(F.col("zero_share") >= 0.3, "zero_inflated").when(F.col("n_distinct") < 10, "discrete").when(F.abs(F.col("skew")) > 1, "skewed").otherwise("roughly_symmetric")
    middle = median(long, ["item"], "value").withColumnRenamed("value_median", "median")
    return stats.join(counts, "item").join(middle, "item").withColumn("form", form)


def cramers_v(df: DataFrame, a: str, b: str, corrected: bool = False) -> DataFrame:
    """n, chi2, v of two columns, from their contingency table; both nulls left out."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    # sum of o^2 / (r c): empty cells add nothing, so the table need not be completed
    part = cells.join(rows, a).join(cols, b).agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c")).cast("double")).alias("q"), F.count_distinct(a).alias("kr"), F.count_distinct(b).alias("kc"))
    n, r, c = F.col("n").cast("double"), F.col("kr"), F.col("kc")
    chi2 = n * (F.col("q") - 1)
    phi2 = chi2 / n
    if not corrected:
        return part.select("n", chi2.alias("chi2"), F.sqrt(phi2 / (F.least(r, c) - 1)).alias("v"))
    shrunk = F.greatest(F.lit(0.0), phi2 - (r - 1) * (c - 1) / (n - 1))
    rr, cc = r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)
    return part.select("n", chi2.alias("chi2"), F.sqrt(shrunk / (F.least(rr, cc) - 1)).alias("v"))


def eta_squared(df: DataFrame, values: list[str], group: str) -> DataFrame:
    """axis, eta2: share of the variance between groups."""
    long = df.where(F.col(group).isNotNull()).unpivot([group], values, "axis", "x").where("x is not null")
    by = long.groupBy("axis", group).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, m = F.col("n"), F.col("m")
    t = by.groupBy("axis").agg(F.sum(n).alias("N"), F.sum(n * m).alias("s"), F.sum(n * m * m).alias("s2"), F.sum(n * F.col("v")).alias("w"))
    between = F.col("s2") - F.col("s") * F.col("s") / F.col("N")
    return t.select("axis", (between / (between + F.col("w"))).alias("eta2"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from pair counts."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    of = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    t = both.crossJoin(F.broadcast(of(a, "sa"))).crossJoin(F.broadcast(of(b, "sb")))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return t.select(((F.col("ab") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))


def pairwise_correlation(df: DataFrame, items: list[str]) -> DataFrame:
    """a, b, n, r for every pair of items over rows that have both, all in one pass."""
    pairs = [(a, b) for i, a in enumerate(items) for b in items[i + 1 :]]
    have = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(*[F.struct(F.count_if(have(a, b)).alias("n"), F.corr(F.when(have(a, b), F.col(a)), F.when(have(a, b), F.col(b))).alias("r")).alias(f"{a}|{b}") for a, b in pairs])
    out = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "x")
    part = F.split("pair", r"\|")
    return out.select(part[0].alias("a"), part[1].alias("b"), "x.n", "x.r")


def ks_distance(df: DataFrame, value: str, side: str, by: list[str]) -> DataFrame:
    """Largest gap of the two sides' distribution functions (side is boolean), by group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    total = counts.groupBy(*by).agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    upto = joined_by(sums_before(counts, by, value, ["a", "b"]), total, by)
    gap = F.abs((F.col("a_before") + F.col("a")) / F.col("_a") - (F.col("b_before") + F.col("b")) / F.col("_b"))
    return upto.select(*by, gap.alias("gap")).groupBy(*by).agg(F.max("gap").alias("ks"))


def standardized_difference(df: DataFrame, items: list[str], treat: str, weight: Column) -> DataFrame:
    """item, smd (absolute): weighted means, unweighted population variances of the arms; by 1 where both are constant."""
    t, one = F.col(treat), F.lit(1.0)
    long = df.withColumn("_w", weight * one).unpivot([treat, "_w"], items, "item", "x").where("x is not null")
    w, x = F.col("_w"), F.col("x")
    arm = lambda v: F.when(t == v, x)
    mean = lambda v: F.sum(F.when(t == v, w * x)) / F.sum(F.when(t == v, w))
    s = long.groupBy("item").agg((mean(1) - mean(0)).alias("d"), F.sqrt((F.var_pop(arm(1)) + F.var_pop(arm(0))) / 2).alias("sd"))
    return s.select("item", F.abs(F.col("d") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("smd"))


def direct_standardized(df: DataFrame, endpoint: str, stratum: str, cohort: str) -> DataFrame:
    """stratum, crude and standardized rate: cell rates mixed by the overall shares of cohorts that the stratum has."""
    have = df.where(F.col(endpoint).isNotNull())
    cells = have.groupBy(stratum, cohort).agg(F.avg(endpoint).alias("rate"), F.count("*").alias("n"))
    mix = have.groupBy(cohort).agg(F.count("*").alias("mix"))
    j = cells.join(F.broadcast(mix), cohort)  # a row for each cohort
    return j.groupBy(stratum).agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("crude"), (F.sum(F.col("rate") * F.col("mix")) / F.sum("mix")).alias("standardized"))


def raw_icc(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """axis, n, between, within, icc over entities of two or more visits: two-level aggregation."""
    long = df.unpivot(keys, axes, "axis", "x").where("x is not null")
    per = long.groupBy("axis", *keys).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("k")).where("k >= 2")
    out = per.groupBy("axis").agg(F.count("*").alias("n"), F.var_pop("m").alias("between"), F.avg("v").alias("within"))
    return out.withColumn("icc", F.col("between") / (F.col("between") + F.col("within")))


def patterns(df: DataFrame, items: list[str]) -> DataFrame:
    """mask, n: rows by the set of items that they have; each pattern's rows need one decomposition."""
    return df.groupBy(F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in items]).alias("mask")).agg(F.count("*").alias("n"))


def reliability_tier(items: list[str], well: int = 3, partial: int = 1) -> tuple[Column, Column]:
    """(observed home indicators, tier)."""
    n = sum((F.col(c).isNotNull().cast("int") for c in items), F.lit(0))
    return n, F.when(n >= well, "well").when(n >= partial, "partial").otherwise("prior_dominated")


def medoids(df: DataFrame, group: str, key: str, axes: list[str]) -> DataFrame:
    """group, n, medoid: the row closest to its group's centroid (the least key of equals), and the distance."""
    centre = df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c_{a}") for a in axes])
    d2 = sum(((F.col(a) - F.col(f"c_{a}")) * (F.col(a) - F.col(f"c_{a}")) for a in axes), F.lit(0.0))
    near = df.join(centre, group).withColumn("d2", d2)
    return near.groupBy(group).agg(F.first("n").alias("n"), F.min(F.struct(F.round("d2", 9).alias("d2"), key)).alias("x")).select(group, "n", F.col(f"x.{key}").alias("medoid"), F.col("x.d2").alias("d2"))


def shared_members(df: DataFrame, node: str, member: str) -> DataFrame:
    """a, b, n: pairs of nodes with n common members, each pair once.

    Members of the same nodes count as one with a weight: the pairs made are those of distinct sets of nodes, however many
    members a cover has. A member's nodes are few (a cover's overlaps), and make one array.
    """
    sets = df.groupBy(member).agg(F.array_sort(F.collect_set(node)).alias("_nodes")).where(F.size("_nodes") > 1).groupBy("_nodes").agg(F.count("*").alias("_k"))
    one = sets.select("_nodes", "_k", F.posexplode("_nodes").alias("_at", "a"))
    return one.select("a", "_k", F.explode(F.slice("_nodes", F.col("_at") + 2, F.size("_nodes"))).alias("b")).groupBy("a", "b").agg(F.sum("_k").alias("n"))


def order_digest(df: DataFrame, key: str, value: str) -> DataFrame:
    """item, n, mean, sd (sample) and rank_hash: a digest of the order of the keys by value, then by key.

    Each key's place times 48 bits of its digest, summed: two orders of the same keys give different sums but by chance,
    and no task gathers the keys.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1))
    placed = sums_before(rows, [], value, ["_one"], [value, key])
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("decimal(15,0)")
    place = (F.col("_one_before") + 1).cast("decimal(18,0)")
    out = placed.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sum((place * digest).cast("decimal(28,0)")).alias("_h"))
    return out.select(F.lit(value).alias("item"), "n", "mean", "sd", F.sha2(F.col("_h").cast("string"), 256).alias("rank_hash"))
