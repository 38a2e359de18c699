"""Point lookups: exact, as-of (at or before) and ceiling (at or after), one key or many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidError
from ..functions.series import payload_of

UNBOUNDED = Window.unboundedPreceding


def get(frame: DataFrame, symbol, time, seq: int = 0) -> DataFrame:
    """The record with exactly this key; the plain form asks for sequence 0."""
    return frame.where((F.col("symbol") == F.lit(symbol)) & (F.col("time") == F.lit(time)) & (F.col("seq") == F.lit(seq)))


def get_le(frame: DataFrame, symbol, time) -> DataFrame:
    """The last record at or before ``time``; at a tie the highest sequence."""
    return frame.where((F.col("symbol") == F.lit(symbol)) & (F.col("time") <= F.lit(time))).orderBy(F.desc("time"), F.desc("seq")).limit(1)


def get_ge(frame: DataFrame, symbol, time) -> DataFrame:
    """The first record at or after ``time``; at a tie the lowest sequence."""
    return frame.where((F.col("symbol") == F.lit(symbol)) & (F.col("time") >= F.lit(time))).orderBy("time", "seq").limit(1)


def get_many(probes: DataFrame, frame: DataFrame) -> DataFrame:
    """Exact lookup of each probe (symbol, time and, if it has one, seq; else 0); misses stay, with nulls."""
    keys = ["symbol", "time", "seq"]
    asked = probes if "seq" in probes.columns else probes.withColumn("seq", F.lit(0).cast("long"))
    return asked.join(frame.select(*keys, F.lit(True).alias("found"), *payload_of(frame)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def asof_join(probes: DataFrame, frame: DataFrame, direction: str = "le", bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each probe (symbol, time, others) with ``found``: the record get_le or get_ge would give.

    ``found`` is a struct of time, seq and the payload, null if there is none. Probes and
    records are merged in one sort by symbol instead of being joined, so the work
    doesn't grow with records times probes. ``bucket`` maps a time to a bucket that
    rises with it: the sort is then by (symbol, bucket), which spreads a symbol that
    holds a large share of all rows; what a bucket lacks comes from the nearest one that
    has records, of which only one row each is carried over.
    """
    if direction not in ("le", "ge"):
        raise InvalidError(f"direction {direction!r} is neither 'le' nor 'ge'")
    le, rest = direction == "le", [c for c in probes.columns if c not in ("symbol", "time")]
    record = F.struct("time", "seq", *payload_of(frame))
    in_bucket = bucket(F.col("time")) if bucket else F.lit(0)
    # At equal times a record counts as before its probe (le) or after it (ge).
    ours = frame.select("symbol", "time", F.col("seq").alias("_seq"), record.alias("_rec"), F.lit(0 if le else 1).alias("_side"), F.lit(None).cast(probes.select(F.struct(*rest, F.lit(1).alias("_")) if rest else F.struct(F.lit(1).alias("_"))).schema[0].dataType).alias("_probe"))
    theirs = probes.select("symbol", "time", F.lit(None).cast(frame.schema["seq"].dataType).alias("_seq"), F.lit(None).cast(ours.schema["_rec"].dataType).alias("_rec"), F.lit(1 if le else 0).alias("_side"), F.struct(*rest, F.lit(1).alias("_")).alias("_probe"))
    both = ours.unionByName(theirs).withColumn("_bucket", in_bucket)
    keys = ["symbol", "_bucket"]
    if le:
        w = Window.partitionBy(*keys).orderBy("time", "_side", "_seq").rowsBetween(UNBOUNDED, 0)
        near = F.last("_rec", ignorenulls=True).over(w)
    else:
        # The frame that follows a row, as a running frame of the reversed order.
        w = Window.partitionBy(*keys).orderBy(F.desc("time"), F.desc("_side"), F.desc("_seq")).rowsBetween(UNBOUNDED, 0)
        near = F.last("_rec", ignorenulls=True).over(w)
    out = both.withColumn("found", near).where("_probe IS NOT NULL")
    if bucket:
        order = F.struct("time", "seq")
        edge = frame.withColumn("_bucket", in_bucket).groupBy(*keys).agg((F.max_by if le else F.min_by)(record, order).alias("_edge"))
        need = out.where("found IS NULL").select(*keys).distinct()
        asked = need.withColumn("_edge", F.lit(None).cast(edge.schema["_edge"].dataType)).withColumn("_asked", F.lit(1)).unionByName(edge.withColumn("_asked", F.lit(0)))
        ordered = Window.partitionBy("symbol").orderBy(F.asc("_bucket") if le else F.desc("_bucket"), F.desc("_asked")).rowsBetween(UNBOUNDED, 0)
        # A bucket's own edge is on the wrong side of a probe without a record in the bucket: asked rows come first.
        carried = asked.withColumn("_edge", F.last("_edge", ignorenulls=True).over(ordered)).where("_asked = 1").drop("_asked")
        out = out.join(carried, keys, "left").withColumn("found", F.coalesce("found", "_edge"))
    return out.select("symbol", "time", *(F.col(f"_probe.{c}").alias(c) for c in rest), "found")
