"""The driver's tables as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import Series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user; times are unique within a user."""
    return Series(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ("event_type", "value")).frame()


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user with times cut to the hour: ties, told apart by the event's number."""
    return Series(table(spark, sf_dir, "events"), "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz"), "event_id", ("event_type", "value")).frame()


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer; some share a day."""
    return Series(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", ("o_orderstatus", "o_totalprice")).frame()


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by part and shipping day, numbered from 0 within a day."""
    rows = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_partkey", "l_shipdate").orderBy(*LINE_ORDER)) - 1
    return Series(rows.withColumn("place", place.cast("long")), "l_partkey", "l_shipdate", "place", ("l_orderkey", "l_quantity")).frame()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by conversation, without a sequence."""
    return Series(table(spark, sf_dir, "conversations"), "conv_id", "turn", None, ("role",)).frame()


EVENTS = "(SELECT user_id AS symbol, ts AS time, event_id AS seq, event_type, value FROM events)"
HOURLY = "(SELECT user_id AS symbol, date_trunc('hour', ts) AS time, event_id AS seq, event_type, value FROM events)"
ORDERS = "(SELECT o_custkey AS symbol, o_orderdate AS time, o_orderkey AS seq, o_orderstatus, o_totalprice FROM orders)"
LINES = f"(SELECT l_partkey AS symbol, l_shipdate AS time, row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY {', '.join(LINE_ORDER)}) - 1 AS seq, l_orderkey, l_quantity FROM lineitem)"
TURNS = "(SELECT conv_id AS symbol, turn AS time, CAST(0 AS BIGINT) AS seq, role FROM conversations)"
