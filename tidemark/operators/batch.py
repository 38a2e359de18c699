"""Atomic batches of put, upsert and del, as queries over operations and base records.

Operations: op, symbol, time, seq, payload columns, idx (order of submission). The
operations on one key apply in that order, from whether the key is in the base: a put on
a present key fails the whole batch, an upsert puts or replaces, a del of an absent
key does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import payload_of
from .scan import bounded

KEY = ["symbol", "time", "seq"]


def violations(base: DataFrame, ops: DataFrame, widths: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Operations that break a rule: key, idx and rule ('width' before 'duplicate').

    ``widths`` (symbol, record_size) has the symbols whose values have a fixed width.
    The first to report is the first by (symbol, time, seq, idx).
    """
    before = F.lag("op").over(Window.partitionBy(*KEY).orderBy("idx"))
    in_base = base.join(ops.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, F.lit(True).alias("_there"))
    rows = ops.withColumn("_before", before).join(in_base, KEY, "left")
    present = F.when(F.col("_before").isNull(), F.coalesce("_there", F.lit(False))).otherwise(F.col("_before") != "del")
    duplicate = (F.col("op") == "put") & present
    width = F.lit(False)
    if widths is not None:
        rows = rows.join(widths.where("record_size > 0").select("symbol", "record_size"), "symbol", "left")
        width = (F.col("op") != "del") & F.col("record_size").isNotNull() & (F.octet_length(value) != F.col("record_size"))
    return rows.withColumn("rule", F.when(width, "width").when(duplicate, "duplicate")).where("rule IS NOT NULL").select(*KEY, "idx", "rule")


def net(ops: DataFrame) -> DataFrame:
    """The last operation on each key: it alone makes the result of a batch without violations."""
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("idx")))
    return ops.withColumn("_n", last).where("_n = 1").drop("_n", "idx")


def apply_batch(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Base records after a batch without violations."""
    final = net(ops)
    kept = base.join(final.select(*KEY), KEY, "left_anti")
    return kept.select(*base.columns).unionByName(final.where("op <> 'del'").select(*KEY, *payload_of(base)).select(*base.columns))


def created(ops: DataFrame) -> DataFrame:
    """Symbols that a batch makes: those of any put or upsert, later deleted or not."""
    return ops.where("op <> 'del'").select("symbol").distinct()


def delete_range(base: DataFrame, symbol, low=None, high=None) -> DataFrame:
    """Without the symbol's records of an inclusive range, every sequence."""
    bounded(base, symbol, low, high)  # refuses a reversed range
    gone = F.col("symbol") == F.lit(symbol)
    if low is not None:
        gone &= F.col("time") >= F.lit(low)
    if high is not None:
        gone &= F.col("time") <= F.lit(high)
    return base.where(~gone)


def truncate_before(base: DataFrame, symbol, cutoff) -> DataFrame:
    """Without the symbol's records before ``cutoff``, exactly."""
    return base.where(~((F.col("symbol") == F.lit(symbol)) & (F.col("time") < F.lit(cutoff))))


def symbol_drop(base: DataFrame, symbol) -> DataFrame:
    return base.where(F.col("symbol") != F.lit(symbol))


def verify(frame: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One row of counts: records, symbols (of records or catalog), keys that repeat, and symbols whose facts disagree with a catalog."""
    keys = frame.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    facts = keys.groupBy("symbol").agg(F.sum("n").cast("long").alias("record_count"), F.sum((F.col("n") > 1).cast("long")).alias("repeated"), F.min("time").alias("min_time"), F.max("time").alias("max_time"))
    if catalog is not None:
        claimed = catalog.select("symbol", F.col("record_count").alias("_c"), F.col("min_time").alias("_lo"), F.col("max_time").alias("_hi"))
        facts = facts.join(claimed, "symbol", "full")
        agree = F.coalesce("record_count", F.lit(0)).eqNullSafe(F.coalesce("_c", F.lit(-1))) & F.col("min_time").eqNullSafe(F.col("_lo")) & F.col("max_time").eqNullSafe(F.col("_hi"))
        facts = facts.withColumn("_bad", (~agree).cast("long"))
    else:
        facts = facts.withColumn("_bad", F.lit(0).cast("long"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return facts.agg(whole("record_count").alias("records"), F.count("symbol").alias("symbols"), whole("repeated").alias("repeated_keys"), whole("_bad").alias("bad_symbols"), whole((F.col("min_time") > F.col("max_time")).cast("long")).alias("bad_order"))
