"""Queries against their SQL on small tables made to hold what larger ones do."""

import datetime
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillon.plans import catalog
from quillon.runtime import cut, forget

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def made(folder, orders):
    """Tables orders, of (key, customer, year, price, priority) in the rows' order, and customer, as files of the folder."""
    key, customer, year, price, priority = zip(*orders)
    dates = pa.array([datetime.datetime(y, 3, 1) for y in year], pa.timestamp("us"))
    pq.write_table(pa.table({"o_orderkey": pa.array(key, pa.int64()), "o_custkey": pa.array(customer, pa.int64()), "o_totalprice": pa.array(price, pa.float64()), "o_orderdate": dates, "o_orderpriority": list(priority)}), folder / "orders.parquet")
    known = sorted(set(customer))
    pq.write_table(pa.table({"c_custkey": pa.array(known, pa.int64()), "c_mktsegment": ["BUILDING" if c % 2 else "MACHINERY" for c in known]}), folder / "customer.parquet")
    return str(folder)


def told(folder, name):
    """What the SQL gives on the folder's tables, read in the order of the keys by one thread."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create table orders as select * from '{folder}/orders.parquet' order by o_orderkey")
    con.execute(f"create view customer as select * from '{folder}/customer.parquet'")
    return con.sql(SQL[name]).df()


def equal(spark, folder, name, keys):
    found, want = QUERIES[name](spark, folder).toPandas(), told(folder, name)
    found, want = (df[list(want.columns)].sort_values(keys).reset_index(drop=True) for df in (found, want))
    assert len(found) == len(want)
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(found[c].astype(float), want[c], rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert list(found[c]) == list(want[c]), c


def test_scaling_of_more_than_ten_numbers_of_orders(spark, tmp_path):
    orders, rng = [], np.random.default_rng(1)
    for customer in range(30):
        for k in range(customer % 11 + 1):
            orders.append((len(orders), customer, 1996, float(np.round(rng.uniform(1e3, 5e5), 2)), "1-URGENT" if k % 2 else "5-LOW"))
    equal(spark, made(tmp_path, orders), "type_aware_scaling", ["patient", "visit"])


def test_distinct_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    prices = [0.1, 0.2, 0.3]  # 0.6000000000000001 from the left, 0.6 from the right
    orders = [(10 * customer + k, customer, 1996, p, "1-URGENT") for customer in range(4) for k, p in enumerate(prices)]
    equal(spark, made(tmp_path, orders[:6] + orders[:5:-1]), "item_routing", ["item"])


def test_halves_are_rounded_as_the_sql_does(spark, tmp_path):
    orders = []
    for customer in range(400):  # 16166.15 / 100000 is one bit below the half, its product with a million is the half
        orders += [(2 * customer, customer, 1995, 1000.0 + customer, "2-HIGH"), (2 * customer + 1, customer, 1996, round(16000.05 + customer * 997.1 + 0.1 * (customer % 7), 2), "1-URGENT")]
    equal(spark, made(tmp_path, orders), "frozen_design", ["patient", "visit"])


def test_a_write_leaves_no_shuffle_files(spark):
    def files():
        return set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")) - {""}

    before = files()
    out = cut(spark.range(1000).groupBy((F.col("id") % 10).alias("g")).count())
    until = time.time() + 5
    while files() - before and time.time() < until:  # they are deleted by a thread of their own
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 10
    forget(out)
