"""Cohort roles bound to the sample tables: entities x visits with indicators, their missing cells left missing.

Entity: customer within market segment (cohort). Visit: order year from 1995 on, V0 to V6. Indicators: aggregates of the
entity's orders of that year; some exist for some orders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ITEMS = ("mean_price", "max_price", "urgent_price", "low_price", "n_orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """cohort, patient, visit, visit_no and the ITEMS, a row for each customer and year with orders.

    in_order: means add prices in the order of the orders' keys, so that their last bits don't depend on how rows are dealt.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", (F.year("o_orderdate") - 1995).alias("visit_no"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("cohort"))
    price = F.col("o_totalprice")
    of = {"mean": price, "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", price), "low": F.when(F.col("o_orderpriority") == "5-LOW", price)}
    means = {k: F.avg(x) for k, x in of.items()}
    if in_order:
        so_far = Window.partitionBy("o_custkey", "visit_no").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        orders = orders.withColumns({f"_{k}": F.sum(x).over(so_far) for k, x in of.items()})
        means = {k: F.try_divide(F.max_by(f"_{k}", "o_orderkey"), F.count(x)) for k, x in of.items()}
    return (
        orders.groupBy("o_custkey", "visit_no")
        .agg(
            means["mean"].alias("mean_price"),
            F.max(price).alias("max_price"),
            means["urgent"].alias("urgent_price"),
            means["low"].alias("low_price"),
            F.count("*").cast("double").alias("n_orders"),
        )
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("cohort", F.col("o_custkey").alias("patient"), F.concat(F.lit("V"), F.col("visit_no").cast("string")).alias("visit"), "visit_no", *ITEMS)
    )


PANEL_SQL = """panel AS (SELECT c_mktsegment AS cohort, o_custkey AS patient, 'V' || CAST(year(o_orderdate) - 1995 AS VARCHAR) AS visit, CAST(year(o_orderdate) - 1995 AS INTEGER) AS visit_no,
 avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_price,
 avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS low_price, CAST(count(*) AS DOUBLE) AS n_orders
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def wide(spark: SparkSession, sf_dir: str, items: tuple[str, ...] = ("mean_price", "n_orders"), visits: tuple[str, ...] = ("V0", "V1", "V2")) -> DataFrame:
    """cohort, patient and {item}_{visit}, a row for each entity with any of the visits."""
    return panel(spark, sf_dir).where(F.col("visit").isin(*visits)).groupBy("cohort", "patient").pivot("visit", list(visits)).agg(*[F.first(i, ignorenulls=True).alias(i) for i in items]).select("cohort", "patient", *[F.col(f"{v}_{i}").alias(f"{i}_{v}") for i in items for v in visits])


WIDE_SQL = "wide AS (SELECT cohort, patient, " + ", ".join(f"max({i}) FILTER (WHERE visit = '{v}') AS {i}_{v}" for i in ("mean_price", "n_orders") for v in ("V0", "V1", "V2")) + " FROM panel WHERE visit IN ('V0', 'V1', 'V2') GROUP BY cohort, patient)"


def latent(spark: SparkSession, sf_dir: str, axes: int = 8) -> DataFrame:
    """vec_id, label and the first `axes` embedding coordinates as doubles x0, x1, ..."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(axes)])


LATENT_SQL = "latent AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}" for k in range(8)) + " FROM embeddings)"
