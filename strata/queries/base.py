"""Frames that queries start from, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_CUT, EVENTS_CUT = "1998-01-01", "2024-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_orderdate").alias("_load_ts"), F.lit("tpch/orders").alias("_source"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("_batch_id"))


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").alias("_source_ts"), F.col("ts").alias("_load_ts"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("_batch_id"), op.alias("_op"))


BRONZE_ORDERS = "bronze_orders as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate as _load_ts, 'tpch/orders' as _source, lpad(cast(o_orderkey as varchar), 10, '0') as _batch_id from orders)"
BRONZE_EVENTS = "bronze_events as (select event_id, user_id, event_type, value, ts as _source_ts, ts as _load_ts, lpad(cast(event_id as varchar), 10, '0') as _batch_id, case event_type when 'error' then 'd' when 'signup' then 'c' else 'u' end as _op from events)"


def key_sql(*columns: str) -> str:
    """DuckDB form of a hash key."""
    return "sha1(" + " || '||' || ".join(f"coalesce(upper(trim(cast({c} as varchar), ' ')), '')" for c in columns) + ")"


def diff_sql(*columns: str) -> str:
    return "sha1(rtrim(" + " || '||' || ".join(f"coalesce(trim(cast({c} as varchar), ' '), '')" for c in columns) + ", '|'))"
