"""Range scans of one series, in either direction, whole or from a position on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CapacityError, InvalidError
from ..functions.series import check_range, payload_of


def bounded(frame: DataFrame, symbol=None, low=None, high=None) -> DataFrame:
    """Records of a symbol with ``low`` <= time <= ``high``; every sequence of those times."""
    check_range(low, high)
    if symbol is not None:
        frame = frame.where(F.col("symbol") == F.lit(symbol))
    if low is not None:
        frame = frame.where(F.col("time") >= F.lit(low))
    if high is not None:
        frame = frame.where(F.col("time") <= F.lit(high))
    return frame


def scan(frame: DataFrame, symbol, low=None, high=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """An inclusive range in key order (or from newest to oldest); an unknown symbol is empty."""
    rows = bounded(frame, symbol, low, high)
    rows = rows.orderBy(F.desc("time"), F.desc("seq")) if reverse else rows.orderBy("time", "seq")
    return rows if limit is None else rows.limit(limit)


def numbered(rows: DataFrame, *order: str | Column, name: str = "pos", bucket: Column | None = None, reverse: bool = False) -> DataFrame:
    """Rows with their position (from 1) over all of them.

    ``bucket`` is a value that rises (``reverse``: falls) with the order: rows are ranked
    within their bucket, and only the buckets' counts are summed up in one task. Without
    it all rows are, which is for results of one page or a short range.
    """
    if bucket is None:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    rows = rows.withColumn("_bucket", bucket)
    before = Window.orderBy(F.desc("_bucket") if reverse else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return ranked.join(counts, "_bucket").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_bucket", "_before")


def after(time, seq, reverse: bool = False) -> Column:
    """Strictly beyond a key in the direction of the walk."""
    beyond = F.col("time") < F.lit(time) if reverse else F.col("time") > F.lit(time)
    tie = F.col("seq") < F.lit(seq) if reverse else F.col("seq") > F.lit(seq)
    return beyond | ((F.col("time") == F.lit(time)) & tie)


def seek(frame: DataFrame, symbol, time, seq: int = 0, low=None, high=None, reverse: bool = False) -> DataFrame:
    """The rest of a scan from the first key at or beyond a target on, within the scan's bounds."""
    at = (F.col("time") == F.lit(time)) & (F.col("seq") == F.lit(seq))
    return scan(bounded(frame, symbol, low, high).where(at | after(time, seq, reverse)), symbol, reverse=reverse)


def page(frame: DataFrame, symbol, size: int, last: tuple | None = None, low=None, high=None, reverse: bool = False) -> DataFrame:
    """The next ``size`` records strictly after the key ``last``: a keyset page, planned as a top-k."""
    rows = bounded(frame, symbol, low, high)
    if last is not None:
        rows = rows.where(after(*last, reverse))
    return scan(rows, symbol, reverse=reverse, limit=size)


def chunked(rows: DataFrame, size: int, *order: str | Column, bucket: Column | None = None) -> DataFrame:
    """Positions and the chunk (from 0) that each row comes in."""
    if size < 1:
        raise InvalidError("a chunk has one row at least")
    return numbered(rows, *order, bucket=bucket).withColumn("chunk", F.floor((F.col("pos") - 1) / size).cast("long"))


def read_range(frame: DataFrame, symbol, low=None, high=None, cap: int | None = None) -> DataFrame:
    """Payloads of a range, in order. More than ``cap`` records are an error that carries the first ``cap``."""
    rows = scan(frame, symbol, low, high).select(*payload_of(frame))
    if cap is None:
        return rows
    if rows.limit(cap + 1).count() > cap:
        raise CapacityError(f"the range has more than {cap} records", rows=rows.limit(cap))
    return rows.limit(cap)


def range_count(frame: DataFrame, symbol, low=None, high=None) -> DataFrame:
    """How many records a range has; no payload is read."""
    return bounded(frame, symbol, low, high).agg(F.count(F.lit(1)).alias("n"))


def last_n(frame: DataFrame, n: int, reverse: bool = True) -> DataFrame:
    """The newest (or oldest) ``n`` records of every symbol, with their rank."""
    order = [F.desc("time"), F.desc("seq")] if reverse else ["time", "seq"]
    # The rank is bounded, so Spark keeps only n rows of a symbol before the exchange (WindowGroupLimit).
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)).cast("long")).where(F.col("rank") <= n)
