"""Ranks, running sums and quantiles of whole columns, without a task that sees them all.

Values are cut into BINS bins of about equal numbers, at limits from a bounded sketch; sums by bin are a few rows for each
group, and running sums are taken inside bins alone. So a column of distinct values is spread over as many tasks as a
sorted file would be, and no aggregate buffers it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.expressions import passed
from quillon.runtime import cut

BINS = 256


def joined_by(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on the columns `by`, where null equals null; b's are dropped. Without columns, b is one row."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    b = b.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return a.join(b, on, how).drop(*[f"_of_{c}" for c in by])


def binned(df: DataFrame, by: list[str], place: str) -> DataFrame:
    """df with _bin, a number that doesn't fall as the number `place` grows inside a group; null and NaN are in the last."""
    shares = [k / BINS for k in range(1, BINS)]
    limits = df.groupBy(*by).agg(F.percentile_approx(place, shares, 10 * BINS).alias("_limits"))
    if by:  # written, as every part of a plan that uses the limits has to see the same ones
        return joined_by(df, cut(limits, "limits"), by).withColumn("_bin", passed(F.col("_limits"), F.col(place), BINS - 1)).drop("_limits")
    told = limits.first()["_limits"] or []  # BINS numbers
    return df.withColumn("_bin", passed(F.lit([float(x) for x in told]), F.col(place).cast("double"), BINS - 1) if told else F.lit(0))


def sums_before(df: DataFrame, by: list[str], place: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """df with {c}_before of each column: its sum over the group's rows that come before. `order` (or place) tells rows apart.

    place: a number that doesn't fall along the order.
    """
    rows = binned(df, by, place)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    whole = before(Window.partitionBy(*by).orderBy("_bin"))  # BINS rows at most in each group
    base = per.select(*by, "_bin", *[F.coalesce(F.sum(f"_{c}").over(whole), F.lit(0)).alias(f"_base_{c}") for c in columns])
    inside = before(Window.partitionBy(*by, "_bin").orderBy(*(order or [place])))
    rows = rows.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    both = joined_by(rows, base, [*by, "_bin"])
    return both.withColumns({f"{c}_before": F.col(f"_base_{c}") + F.col(f"_in_{c}") for c in columns}).drop("_bin", *[f"{p}{c}" for p in ("_in_", "_base_") for c in columns])


def value_counts(df: DataFrame, by: list[str], x: str, weight: str | None = None) -> DataFrame:
    """by, x, k, k_before and n: each distinct value that isn't null, how often it occurs, how many are less, and all.

    weight: a column that says how often a row counts.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg((F.sum(weight) if weight else F.count("*")).alias("k"))
    total = counts.groupBy(*by).agg(F.sum("k").alias("n"))
    return joined_by(sums_before(counts, by, x, ["k"]), total, by)


def quantiles(df: DataFrame, by: list[str], x: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """by and q, an array of the exact quantiles of x at the shares, interpolated between neighbours; null without values."""
    c = value_counts(df, by, x, weight)
    parts = []
    for k, share in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(float(share))
        holds = lambda i: (F.col("k_before") <= i) & (i < F.col("k_before") + F.col("k"))
        parts += [F.max(F.when(holds(F.floor(at)), F.col(x))).alias(f"_lo{k}"), F.max(F.when(holds(F.ceil(at)), F.col(x))).alias(f"_hi{k}"), F.max(at - F.floor(at)).alias(f"_f{k}")]
    found = c.groupBy(*by).agg(*parts)
    return found.select(*by, F.array(*[F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_f{k}") for k in range(len(shares))]).alias("q"))


def with_rank(df: DataFrame, x: str, by: list[str], name: str = "rank", total: str | None = None) -> DataFrame:
    """df with the rank of x among the group's values that aren't null, ties averaged; null for null. total: also their number."""
    c = value_counts(df, by, x)
    told = c.select(*by, x, (F.col("k_before") + (F.col("k") + 1) / 2.0).alias(name), *([F.col("n").alias(total)] if total else []))
    return joined_by(df, told, [*by, x], "left")


def with_place(df: DataFrame, by: list[str], key: str, salt: str | None = "0", name: str = "place") -> DataFrame:
    """df with the place (from 0) of each row of a group in the order of a digest of the key and a salt, if there is one."""
    told = F.col(key).cast("string")
    digest = F.md5(told if salt is None else F.concat_ws("|", told, F.lit(salt)))
    rows = df.withColumn("_digest", digest).withColumn("_at", F.conv(F.substring("_digest", 1, 12), 16, 10).cast("bigint")).withColumn("_one", F.lit(1))
    return sums_before(rows, by, "_at", ["_one"], ["_digest", key]).withColumnRenamed("_one_before", name).drop("_digest", "_at", "_one")


def median(df: DataFrame, by: list[str], x: str) -> DataFrame:
    return quantiles(df, by, x, [0.5]).select(*by, F.col("q")[0].alias(f"{x}_median"))

