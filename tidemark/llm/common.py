"""Shared helpers: scratch folder, Arrow access, byte-level words, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_dir

#: Bytes of text that a vectorised kernel looks at together; bounds its temporaries.
SLICE_BYTES = 1 << 20
#: Bytes of keys that may be broadcast, 64 of overhead for each counted in; more are joined by an exchange.
BROADCAST_BYTES = 32 << 20
#: Lets go of an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_phases: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the
    lineage, and a lost executor costs nothing that was written. The shuffle files of
    the execution go when it ends; the table stays until ``dropped``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # the setting counts where a frame is made
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _phases:
        _phases[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written and that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            jvm_path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def phase() -> Iterator[list[DataFrame]]:
    """Collects the tables that are stored within, so that they can be dropped together."""
    _phases.append([])
    try:
        yield _phases[-1]
    finally:
        _phases.pop()


def is_small(keys: DataFrame) -> bool:
    """Whether the rows of ``keys`` (narrow, stored) may be broadcast, by their bytes."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns]
    total = keys.agg(F.coalesce(F.sum(sum(sizes, F.lit(64)).cast("long")), F.lit(0))).first()[0]
    return total <= BROADCAST_BYTES


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each row, null as empty, one at a time."""
    data, at = column_bytes(column)
    view = memoryview(data)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(view[lo:hi])


def byte_table(separators: Iterable[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words ``[^\x20\x09-\x0D]+``.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: (prime, base) of the two polynomials whose values are a word's hash.
_FIELDS = ((2147483647, 1190494759), (2147483629, 1598971123))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(prime: int, base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006  one table a process
    """base^0, base^1, ... modulo ``prime``."""
    have = cache.get((prime, base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint32)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, (have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)).astype(np.uint32)])
        if len(have) <= 1 << 21:  # of very long texts: use, but don't keep
            cache[prime, base] = have
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once, A-Z lower-cased.

    ``data`` holds the texts, ``offsets`` (from 0) their bounds. Returns a 64-bit hash
    (of values in two prime fields; equal hashes are no proof of equal words), first byte and end byte of each word, and the bounds of each text's words.
    """
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    lo, hi = cuts[:-1], cuts[1:]
    keep = inside[lo] if n else np.zeros(0, bool)
    lo, hi = lo[keep], hi[keep]
    value = np.zeros(len(lo), np.uint64)
    lower = _LOWER[data].astype(np.uint64) + np.uint64(1)
    for prime, base in _FIELDS:
        p, total = np.uint64(prime), np.zeros(n + 1, np.uint64)
        terms = lower * powers(prime, base, n)
        np.cumsum(terms if n < 1 << 24 else terms % p, out=total[1:])  # sums stay under 2^64
        value = value << np.uint64(32) | (total[hi] - total[lo]) % p * powers(prime, pow(base, -1, prime), n + 1)[lo] % p
    return mix(value), lo, hi, np.searchsorted(lo, offsets)


def shingles(value: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on, for all positions that have so many."""
    out = np.zeros(max(0, len(value) - k + 1), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + value[j : len(value) - k + 1 + j])
    return out


def unsigned_crc32(column) -> "F.Column":
    """CRC-32 of a string column's UTF-8; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))
