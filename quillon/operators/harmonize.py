"""Rules that bring cohorts' columns to one meaning. Each takes Columns and gives a Column; missing stays missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import normal_ppf
from quillon.operators.ordered import joined_by, quantiles, with_place, with_rank
from quillon.runtime import cut

Rule = Callable[[Column, Column], Column]
_RULES: dict[str, Rule] = {}

#: Spellings of yes and no.
YES, NO = ("Oui", "Yes", "Y", "1", "True"), ("Non", "No", "N", "0", "False")


def register(name: str) -> Callable[[Rule], Rule]:
    """Enter a rule of (value, cohort) under a canonical name."""

    def enter(f: Rule) -> Rule:
        _RULES[name] = f
        return f

    return enter


def apply_rules(df: DataFrame, columns: dict[str, str], cohort: str = "cohort") -> DataFrame:
    """One projection of all canonical columns: {canonical: source}; those without a rule pass as they are."""
    return df.select("*", *[_RULES.get(c, lambda x, _: x)(F.col(s), F.col(cohort)).alias(c) for c, s in columns.items()])


def cast_binary(x: Column) -> Column:
    """1 or 0 for the spellings of yes and no, null for all else."""
    t = F.trim(x.cast("string"))
    return F.when(t.isin(*YES), 1).when(t.isin(*NO), 0)


def cast_ordinal(x: Column) -> Column:
    """A number rounded half to even, null where it is none."""
    return F.bround(x.try_cast("double"), 0).cast("int")


def recode(x: Column, codes: dict[str, int], numeric: dict[int, int] | None = None) -> Column:
    """Exact text, then trimmed text, then a number without its decimals, remapped where told to; else null."""
    t = F.trim(x)
    by_text = F.create_map(*[v for k, c in codes.items() for v in (F.lit(k), F.lit(c))])
    number = F.when(t.try_cast("double").isNotNull(), F.when(t.try_cast("double") >= 0, F.floor(t.try_cast("double"))).otherwise(F.ceil(t.try_cast("double"))).cast("int"))
    if numeric:
        again = F.create_map(*[F.lit(v) for kv in numeric.items() for v in kv])
        number = F.coalesce(F.try_element_at(again, number), number)
    return F.coalesce(F.try_element_at(by_text, x), F.try_element_at(by_text, t), number)


def for_cohort(x: Column, cohort: Column, name: str, changed: Column) -> Column:
    """`changed` in one cohort, x in all others."""
    return F.when(cohort == name, changed).otherwise(x)


def scaled_if(x: Column, above: float | None = None, below: float | None = None, factor: float = 1.0) -> Column:
    """x times the factor where it lies beyond the threshold: another unit."""
    beyond = x > above if above is not None else x < below
    return F.when(beyond, x * factor).otherwise(x)


def capped_count(x: Column) -> Column:
    """A number after inequality signs, with a decimal comma or point; null where there is none."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), ",", "."), "^[><=≥≤ ]+", "").try_cast("double")


def duration(x: Column) -> Column:
    """The middle of 'entre a et b', 0.5 for '<1', else the first number."""
    t = F.regexp_replace(F.lower(x), ",", ".")
    pair = r"entre *([0-9.]+) *et *([0-9.]+)"
    a, b = (F.regexp_extract(t, pair, k).try_cast("double") for k in (1, 2))
    return F.when(t.rlike(pair), (a + b) / 2).when(t.rlike("^ *< *1"), 0.5).otherwise(F.regexp_extract(t, r"([0-9]+\.?[0-9]*)", 1).try_cast("double"))


def site_from_id(ident: Column, raw: Column) -> Column:
    """The one or two digits before the last eight of an id, else the site as recorded."""
    return F.coalesce(F.regexp_extract(ident, r"^([0-9]{1,2})[0-9]{8}$", 1).try_cast("int"), raw)


def within(x: Column, low: float | None, high: float | None) -> Column:
    """x inside its bounds, null outside."""
    ok = F.lit(True)
    ok = ok & (x >= low) if low is not None else ok
    return F.when(ok & (x <= high) if high is not None else ok, x)


def decode_gates(df: DataFrame, rules: list[tuple[str, float, str, float]]) -> DataFrame:
    """Fill a missing dependent where its gate proves the value; rules (gate, value, dependent, fill) in order, cascading."""
    for gate, value, dependent, fill in rules:
        df = df.withColumn(dependent, F.when((F.col(gate) == value) & F.col(dependent).isNull(), F.lit(fill)).otherwise(F.col(dependent)))
    return df


def gate_report(df: DataFrame, rules: list[tuple[str, float, str, float]]) -> DataFrame:
    """gate, dependent, n_filled of every rule in order."""
    parts = []
    for k, (gate, value, dependent, _) in enumerate(rules):
        before = decode_gates(df, rules[:k])
        parts.append(before.agg(F.count_if((F.col(gate) == value) & F.col(dependent).isNull()).alias("n_filled")).select(F.lit(gate).alias("gate"), F.lit(dependent).alias("dependent"), "n_filled"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def normalized(df: DataFrame, items: list[str]) -> DataFrame:
    """Items of at most ten values to [-1, 1] by range; others winsorised, by robust z, to five deviations; constants 0."""
    long = df.unpivot([], items, "item", "value").where("value is not null")
    # all that follows needs values and how often they occur; written, as a mean worked out again may differ in its last bit
    counts = cut(long.groupBy("item", "value").agg(F.count("*").alias("k")), "counts")
    extent = counts.groupBy("item").agg(F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ends = quantiles(counts, ["item"], "value", [0.01, 0.99], "k").select("item", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q99"))
    clipped = joined_by(counts, ends, ["item"]).select("item", "k", F.least(F.greatest("value", "q1"), "q99").alias("w"))
    mid = quantiles(clipped, ["item"], "w", [0.5], "k").select("item", F.col("q")[0].alias("m"))
    n = F.sum("k")
    spread = clipped.groupBy("item").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("k") * F.col("w") * F.col("w")) / n - (F.sum(F.col("k") * F.col("w")) / n) ** 2)).alias("s"))
    away = joined_by(clipped, mid, ["item"]).select("item", "k", F.abs(F.col("w") - F.col("m")).alias("a"))
    mad = quantiles(away, ["item"], "a", [0.5], "k").select("item", F.col("q")[0].alias("a"))
    told = extent.join(ends, "item").join(mid, "item").join(spread, "item").join(mad, "item")
    one = told.agg(*[F.max(F.when(F.col("item") == c, F.col(n))).alias(f"{c}__{n}") for c in items for n in ("d", "lo", "hi", "q1", "q99", "m", "s", "a")])
    full = df.crossJoin(F.broadcast(one))  # one row of statistics
    full = full.withColumns({f"{c}__w": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}__q1")), F.col(f"{c}__q99"))) for c in items})

    def scaled(c: str) -> Column:
        span = F.col(f"{c}__hi") - F.col(f"{c}__lo")
        spread = F.when(F.col(f"{c}__a") > 0, 1.4826 * F.col(f"{c}__a")).otherwise(F.col(f"{c}__s"))
        z = F.when(spread > 0, F.least(F.greatest((F.col(f"{c}__w") - F.col(f"{c}__m")) / spread, F.lit(-5.0)), F.lit(5.0)) / 5).otherwise(0.0)
        ranged = F.when(span > 0, 2 * (F.col(c) - F.col(f"{c}__lo")) / span - 1).otherwise(0.0)
        return F.when(F.col(c).isNull(), None).when(F.col(f"{c}__d") <= 10, ranged).otherwise(z)

    return full.select(*[x for x in df.columns if x not in items], *[scaled(c).alias(c) for c in items])


def rank_normal(df: DataFrame, x: str, by: list[str], name: str = "z") -> DataFrame:
    """df with the normal quantile of x's rank (ties averaged) over n + 1, in its group; null for null."""
    ranked = with_rank(df, x, by, "_rank", "_n")
    return ranked.withColumn(name, normal_ppf(F.col("_rank") / (F.col("_n") + 1.0))).drop("_rank", "_n")


def moments(df: DataFrame, items: list[str], by: list[str] | None = None) -> DataFrame:
    """item, mean, sd (sample), n of observed cells: what is frozen at baseline."""
    long = df.unpivot(by or [], items, "item", "value").where("value is not null")
    return long.groupBy(*(by or []), "item").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))


def standardized(df: DataFrame, frozen: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """keys, item, z of the observed cells under frozen moments; items without moments are all missing."""
    long = df.unpivot(keys, items, "item", "value").where("value is not null")
    return long.join(frozen.select("item", "mean", "sd"), "item").select(*keys, "item", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


def residuals(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """df with {y}_res: y minus its least-squares line on x among complete rows of the group; missing stays missing."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = df.where(both).groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(fit, by, "left").withColumn(f"{y}_res", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def cohort_weights(df: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Rows weighted so that every cohort counts the same and all weights sum to the number of rows."""
    sizes = df.groupBy(cohort).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = sizes.crossJoin(F.broadcast(total)).select(cohort, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(weights, cohort)


def balanced(df: DataFrame, n: int, key: str, cohort: str, cohorts: int) -> DataFrame:
    """About n rows, as many of each cohort as it has, picked in the order of the key's digest."""
    return with_place(df, [cohort], key, None, "_r").where(F.col("_r") < n // cohorts).drop("_r")


def token_flags(text: Column, prefixes: list[tuple[str, str]], classes: list[str]) -> list[Column]:
    """0/1 flags of the classes that the tokens of "['A1','B2']" fall in, by the first prefix that fits; null for null."""
    tokens = F.filter(F.transform(F.split(F.regexp_replace(text, r"[\[\]'\" ]", ""), ","), F.upper), lambda t: t != "")

    def of(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, c in reversed(prefixes):
            out = F.when(t.startswith(p), c).otherwise(out)
        return out

    found = F.transform(tokens, of)
    return [F.when(text.isNotNull(), F.array_contains(F.filter(found, lambda c: c.isNotNull()), c).cast("int")).alias(f"on_{c}") for c in classes]


def reason_class(text: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first class one of whose fragments the text (lower case, without accents) holds; other; null for empty."""
    plain = F.translate(F.lower(F.trim(text)), "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")
    out = F.lit("other")
    for name, parts in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | plain.contains(p)
        out = F.when(hit, name).otherwise(out)
    return F.when(plain != "", out)
