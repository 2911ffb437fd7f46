"""Completeness filters and coverage gates. Decisions are small aggregates; frames are filtered by projection and semi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, items: list[str]) -> DataFrame:
    """variable, completeness (share of rows where it is there), in one pass; all 0 for no rows."""
    row = df.agg(*[F.coalesce(F.avg(F.col(c).isNotNull().cast("double")), F.lit(0.0)).alias(c) for c in items])
    return row.unpivot([], items, "variable", "completeness")


def filter_variables(df: DataFrame, items: list[str], threshold: float, visit: str | None = None, visit_col: str = "visit") -> list[str]:
    """The items at least as complete as the threshold at a visit (in all rows, for none)."""
    part = df if visit is None else df.where(F.col(visit_col) == visit)
    kept = {r["variable"] for r in completeness(part, items).where(F.col("completeness") >= threshold).collect()}  # one row per item
    return [c for c in items if c in kept]


def row_completeness(items: list[str]) -> Column:
    """Share of the items that a row has; 1 for no items."""
    return sum((F.col(c).isNotNull().cast("int") for c in items), F.lit(0)) / len(items) if items else F.lit(1.0)


def filter_entities(df: DataFrame, items: list[str], threshold: float, keys: list[str], visit: str | None = None, keep_other_visits: bool = True, visit_col: str = "visit") -> DataFrame:
    """Rows of entities complete enough at the visit, at all visits if asked; row by row without a visit."""
    enough = row_completeness(items) >= threshold
    if visit is None:
        return df.where(enough)
    anchor = df.where((F.col(visit_col) == visit) & enough)
    return df.join(anchor.select(*keys).distinct(), keys, "left_semi") if keep_other_visits else anchor


@dataclass(frozen=True)
class Anchor:
    """A selection made at baseline and projected on any frame."""

    items: tuple[str, ...]
    roster: DataFrame
    keys: tuple[str, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows of the roster, with the selected items that the frame has."""
        others = [c for c in df.columns if c in self.keys or c == "visit"]
        return df.join(self.roster, list(self.keys), "left_semi").select(*others, *[c for c in self.items if c in df.columns])


def anchor(df: DataFrame, items: list[str], keys: list[str], variable_threshold: float = 0.75, entity_threshold: float = 0.75, visit: str = "V0") -> Anchor:
    """Variables first, then entities by these variables, both at baseline."""
    kept = filter_variables(df, items, variable_threshold, visit)
    roster = filter_entities(df, kept, entity_threshold, keys, visit, keep_other_visits=False).select(*keys).distinct()
    return Anchor(tuple(kept), roster, tuple(keys))


def coverage(df: DataFrame, items: list[str], cohort: str, least: int, cohorts: int) -> DataFrame:
    """item, n_obs, n_cohorts, covered: enough cells in enough cohorts. From the table of observed cells."""
    long = df.unpivot([cohort], items, "item", "value").where("value is not null")
    out = long.groupBy("item").agg(F.count("*").alias("n_obs"), F.count_distinct(cohort).alias("n_cohorts"))
    return out.withColumn("covered", (F.col("n_obs") >= least) & (F.col("n_cohorts") >= cohorts))


def gaussianizable(df: DataFrame, items: list[str], distinct: int = 8, modal: float = 0.5) -> DataFrame:
    """item, n_distinct, modal_share, gaussianizable: enough values, none of them in half of the cells."""
    counts = df.unpivot([], items, "item", "value").where("value is not null").groupBy("item", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("item").agg(F.count("*").alias("n_distinct"), (F.max("n") / F.sum("n")).alias("modal_share"))
    return out.withColumn("gaussianizable", (F.col("n_distinct") >= distinct) & (F.col("modal_share") < modal))
