"""The series a table holds: which columns are symbol, time, sequence and payload.

Two key profiles: ``signed`` (bigint, 0 to 2^63 - 1) and ``u64`` (decimal(20,0), 0 to
2^64 - 1). Operators only compare keys, so that any ordered type does for ``time``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidError

MAX_SEQ = 4_294_967_295
MAX_VALUE = 65_000
MAX_RECORD = 16_384
PROFILES = {"signed": (T.LongType(), (1 << 63) - 1), "u64": (T.DecimalType(20, 0), (1 << 64) - 1)}


@dataclass(frozen=True)
class Series:
    """``frame()`` shows a table as symbol, time, seq and the payload columns, lazily."""

    table: DataFrame
    symbol: str | Column = "symbol"
    time: str | Column = "time"
    seq: str | Column | None = "seq"
    payload: tuple[str, ...] = field(default=("value",))

    def frame(self) -> DataFrame:
        column = lambda c: F.col(c) if isinstance(c, str) else c
        seq = F.lit(0).cast("long") if self.seq is None else column(self.seq)
        return self.table.select(column(self.symbol).alias("symbol"), column(self.time).alias("time"), seq.alias("seq"), *self.payload)


def payload_of(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in ("symbol", "time", "seq")]


def check_range(low, high) -> None:
    """A reversed range is an error, never an empty result."""
    if low is not None and high is not None and low > high:
        raise InvalidError(f"range is reversed: {low} > {high}")


def check_key(profile: str, symbol: int, time: int, seq: int) -> None:
    most = PROFILES[profile][1]
    if not (0 <= symbol <= most and 0 <= time <= most and 0 <= seq <= MAX_SEQ):
        raise InvalidError(f"key ({symbol}, {time}, {seq}) is outside the {profile} profile")


def record_schema(profile: str) -> T.StructType:
    key = PROFILES[profile][0]
    return T.StructType([T.StructField("symbol", key), T.StructField("time", key), T.StructField("seq", T.LongType()), T.StructField("value", T.BinaryType())])


def bad_keys(frame: DataFrame, profile: str) -> Column:
    """Rows whose key or value is outside the limits."""
    most = F.lit(PROFILES[profile][1]).cast(PROFILES[profile][0])
    inside = F.col("symbol").between(0, most) & F.col("time").between(0, most) & F.col("seq").between(0, MAX_SEQ)
    return ~F.coalesce(inside, F.lit(False))
