"""Per-symbol facts: newest and oldest time, count, widths; one symbol, a list, or all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbol_info(frame: DataFrame, symbol=None) -> DataFrame:
    """min_time, max_time and record_count of each symbol (or of one); one exchange of partial results."""
    rows = frame if symbol is None else frame.where(F.col("symbol") == F.lit(symbol))
    return rows.groupBy("symbol").agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count(F.lit(1)).alias("record_count"))


def max_time(frame: DataFrame, symbol) -> DataFrame:
    """The newest time; no row for an unknown or empty symbol."""
    return symbol_info(frame, symbol).select("symbol", "max_time")


def min_time(frame: DataFrame, symbol) -> DataFrame:
    """The oldest time; no row for an unknown or empty symbol."""
    return symbol_info(frame, symbol).select("symbol", "min_time")


def count(frame: DataFrame, symbol) -> DataFrame:
    """The number of records; 0 for an unknown symbol."""
    return frame.where(F.col("symbol") == F.lit(symbol)).agg(F.count(F.lit(1)).alias("record_count"))


def max_times(frame: DataFrame, watched: DataFrame) -> DataFrame:
    """The newest time of each watched row (idx, symbol), in its place; 0 (or null for times that aren't numbers) if there is none."""
    kind = frame.schema["time"].dataType.simpleString()
    newest = frame.join(watched.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.max("time").alias("max_time"))
    none = F.lit(0).cast(kind) if kind.startswith(("bigint", "int", "decimal")) else F.lit(None).cast(kind)
    return watched.join(newest, "symbol", "left").withColumn("max_time", F.coalesce("max_time", none))


def list_symbols(frame: DataFrame) -> DataFrame:
    return frame.select("symbol").distinct()


def new_since(frame: DataFrame, seen: DataFrame) -> DataFrame:
    """Records after the last time seen (symbol, last_time) of their symbol; all of symbols not seen yet."""
    return frame.join(seen.select("symbol", "last_time"), "symbol", "left").where(F.col("last_time").isNull() | (F.col("time") > F.col("last_time"))).drop("last_time")
