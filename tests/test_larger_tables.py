"""Queries agree with their SQL on what larger tables hold."""

import datetime
import math
import os

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tallyframe.functions import kernels as k
from tallyframe.llm import line_dedup
from tallyframe.operators import longform
from tallyframe.queries import QUERIES, SQL

from duck import plain, rows_of


def sql_rows(sql, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = con.sql(sql)
    names = list(got.columns)
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def agrees(spark, folder, name, *tables):
    assert rows_of(QUERIES[name](spark, str(folder))) == sql_rows(SQL[name], folder, *tables)


def customers(spark, folder, balances):
    rows = [(i, f"Customer#{i:09d}", i % 25, float(b), "BUILDING") for i, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{folder}/customer.parquet")


def test_compound_keys_with_few_distinct_balances(spark, tmp_path):
    customers(spark, tmp_path, [i % 5 for i in range(20)])
    agrees(spark, tmp_path, "compound_keys", "customer")


def orders(spark, folder, prices):
    rows = [(i, i % 7, "F", float(p), datetime.datetime(1995, 1, 1 + i % 28), "1-URGENT") for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")


def test_float_text_is_that_of_python(spark):
    numbers = [0.0, -0.0, 1.0, 0.001, 3.33e-4, 1e-4, -1.2345e-4, 5.6e-5, 9.999999e6, 1e7, 12345678.9, -1.5e10, 123456789012345.6, 1e15, 1e16, 1e22, -1.5e300, 1.2e-7, 4e-100, math.nan, math.inf, -math.inf]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", k.float_text(F.col("x")).alias("s"), k.float_text((F.col("x") > 1).cast("string")).alias("other")).collect()
    assert [r.s for r in got] == [repr(r.x) for r in got]
    assert {r.other for r in got} == {"true", "false"}


def test_metrics_of_small_shares(spark, tmp_path):
    orders(spark, tmp_path, [100 + i / 4 for i in range(100_100)])  # one distinct flag: 0.000999 %
    agrees(spark, tmp_path, "profile_metrics", "orders")


def test_large_doubles_are_numbers(spark, tmp_path):
    """Prices of ten million and more, written plainly, count as numbers."""
    orders(spark, tmp_path, [1e7 + i for i in range(40)])
    agrees(spark, tmp_path, "top_values", "orders")
    agrees(spark, tmp_path, "exact_quantiles", "orders")
    assert QUERIES["histogram"](spark, str(tmp_path)).where("col = 'o_totalprice'").count() == 10


def test_rows_of_a_folder_count_by_file_name(spark, tmp_path):
    """The second file is the larger one, so Spark reads it first."""
    parts = [range(3), range(100, 3100), range(50, 55)]
    for i, ids in enumerate(parts):
        spark.createDataFrame([(x,) for x in ids], "x long").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        os.makedirs(tmp_path / "t.parquet", exist_ok=True)
        part = next(f for f in os.listdir(tmp_path / str(i)) if f.endswith(".parquet"))
        os.rename(tmp_path / str(i) / part, tmp_path / "t.parquet" / f"part-{i}.parquet")
    got = longform.in_file_order(spark, f"{tmp_path}/t.parquet")
    assert [r.x for r in got.orderBy("_row_id").collect()] == [x for ids in parts for x in ids]
    top = longform.top_values(longform.frequencies(longform.to_long(got)), 4)
    assert [r.value for r in top.orderBy("rank").collect()] == ["0", "1", "2", "100"]


def test_formula_guard_of_rare_balances(spark, tmp_path):
    customers(spark, tmp_path, [-0.0, 0.0, -0.01, 12345678.9, -1e7, 0.00025, math.inf, -math.inf, math.nan])
    agrees(spark, tmp_path, "formula_guard", "customer")


def test_frames_are_dealt_once_for_a_line_over_batches():
    """A common line's frames leave a task once, not once a batch, and all of its parts' frames are there."""
    batches = [pa.RecordBatch.from_arrays([pa.array(["the same line\nand \U0001f600 another"] * 5)], ["text"]) for _ in range(4)]
    out = list(line_dedup._framed(8)(iter(batches)))
    rows = np.concatenate([np.frombuffer(x.as_buffer(), line_dedup.FRAME) for b in out for x in b.column("rows")])
    assert len(rows) == len(np.unique(rows)) == 2 * 2 * line_dedup.SEGMENTS
    assert all((np.frombuffer(x.as_buffer(), line_dedup.FRAME)["frame"] % 8 == k).all() for b in out for k, x in zip(b.column("bucket").to_pylist(), b.column("rows")))
