"""Merged replay of many series in the order of time, sequence, symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidError
from .scan import bounded

ORDER = ("time", "seq", "symbol")


def watchlist(spark: SparkSession, symbols: list, kind) -> DataFrame:
    """A list of symbols as a table, repeated ones as often as they are listed."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(symbols)], f"idx long, symbol {kind.simpleString()}")


def scan_multi(frame: DataFrame, symbols: list | DataFrame, low=None, high=None, reverse: bool = False) -> DataFrame:
    """All records of the listed symbols in the range, in merged order.

    A symbol listed twice comes twice; unknown ones are skipped; an empty list gives
    nothing. The list may be a table with a symbol column. Merges only go forward.
    """
    if symbols is None:
        raise InvalidError("no list of symbols")
    if reverse:
        raise InvalidError("a merged scan only goes forward")
    rows = bounded(frame, None, low, high)
    if not isinstance(symbols, DataFrame):
        # The filter reaches the files; the join then gives repeated symbols again.
        rows = rows.where(F.col("symbol").isin(sorted(set(symbols)))) if symbols else rows.limit(0)
        symbols = watchlist(frame.sparkSession, symbols, frame.schema["symbol"].dataType)
    return rows.join(symbols.select("symbol"), "symbol").select(*frame.columns).orderBy(*ORDER)


def merge_page(frame: DataFrame, symbols: list, size: int, last: tuple | None = None, low=None, high=None) -> DataFrame:
    """The next ``size`` records strictly after ``last`` = (time, seq, symbol) of a merged scan without repeated symbols."""
    rows = bounded(frame, None, low, high).where(F.col("symbol").isin(sorted(set(symbols))))
    if last is not None:
        t, q, s = (F.lit(x) for x in last)
        time, seq, symbol = F.col("time"), F.col("seq"), F.col("symbol")
        rows = rows.where((time > t) | ((time == t) & ((seq > q) | ((seq == q) & (symbol > s)))))
    return rows.orderBy(*ORDER).limit(size)
