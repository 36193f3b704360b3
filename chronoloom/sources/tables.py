"""Canonical temporal-edge views over the driver tables, and the same views as DuckDB CTEs for the oracles.

An edge row is (src, dst, t, event_type, label, ..., id): t in unix seconds, id a unique tie-break. Windows always order
by (t, id), as equal times occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def line_id():
    """Unique: order and line number alone don't tell lines apart in these tables."""
    return ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_003 + F.col("l_partkey")) * 10_007 + F.col("l_suppkey")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unix(col: str):
    """Seconds since the epoch of a timestamp without time zone; the session's zone is UTC."""
    return F.unix_seconds(F.col(col).cast("timestamp"))


def events_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("bigint").alias("dst"), unix("ts").alias("t"), "event_type",
        F.when(F.col("event_type") == "error", "error").otherwise("normal").alias("label"), "value", F.col("event_id").alias("id"),
    )


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A homogeneous graph: suppliers and part numbers modulo 100 share an id space."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), F.pmod("l_partkey", F.lit(100)).alias("dst"), unix("l_shipdate").alias("t"), F.col("l_linestatus").alias("event_type"), line_id().alias("id"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier, a bipartite graph with attributes. Both sides are facts, so they are joined on the order key."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), unix("o_orderdate").alias("t"), F.col("o_orderpriority").alias("event_type"),
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("normal").alias("label"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        line_id().alias("id"),
    )


EV = """ev as (select user_id src, (props->>'$.k')::bigint dst, epoch_us(ts)//1000000 t, event_type,
  case when event_type = 'error' then 'error' else 'normal' end as label, value, event_id id from events)"""
SP = "sp as (select l_suppkey src, l_partkey % 100 dst, epoch_us(l_shipdate)//1000000 t, l_linestatus event_type, ((l_orderkey*8+l_linenumber)*1000003+l_partkey)*10007+l_suppkey id from lineitem)"
OE = """oe as (select o_custkey src, l_suppkey dst, epoch_us(o_orderdate)//1000000 t, o_orderpriority event_type,
  case when l_returnflag = 'R' then 'returned' else 'normal' end as label, l_extendedprice amount, l_quantity quantity, l_discount discount, ((l_orderkey*8+l_linenumber)*1000003+l_partkey)*10007+l_suppkey id
  from lineitem join orders on l_orderkey = o_orderkey)"""
