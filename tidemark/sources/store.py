"""A transactional store of records (symbol, time, seq, value).

Layout below the root: ``data/<id>`` (immutable Parquet, sorted by key, files with
disjoint key ranges within a commit), ``catalog/<id>`` (one row for each symbol, also
for symbols without records) and ``versions/<txn>.json``, the manifest of a commit:
its files with their row counts, key ranges and checksums, the catalog and the user
metadata. A commit writes its files first and then publishes its manifest under the
next number, which only one writer can do. Readers take the newest readable manifest;
they hold no lock and keep what they have read. A manifest that can't be read takes up
its number and nothing else: readers pass it over, the next commit goes behind it.
"""

from __future__ import annotations

import base64
import json
import time
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from decimal import Decimal
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CapacityError, CorruptError, InvalidError, NotFound, StoreError
from ..functions.series import MAX_RECORD, MAX_VALUE, PROFILES, bad_keys, check_key, check_range, record_schema
from ..operators import batch as batches
from ..operators import merge, point, scan
from .files import Files

FORMAT, VERSION = 1, 100
META_BYTES = 4096
KEY = ["symbol", "time", "seq"]


@dataclass
class Batch:
    """Operations and metadata that are written together; writing doesn't clear it.

    A large batch can bring its operations as a DataFrame (op, symbol, time, seq, value,
    idx); those come before the ones queued one by one.
    """

    ops: list[tuple] = field(default_factory=list)
    meta: dict[str, bytes] = field(default_factory=dict)
    frame: DataFrame | None = None

    def _add(self, op: str, symbol: int, time_: int, seq: int, value: bytes | None) -> "Batch":
        if value is not None and len(value) > MAX_VALUE:
            raise InvalidError(f"a value has {MAX_VALUE} bytes at most")
        check_key("u64", symbol, time_, seq)
        self.ops.append((op, symbol, time_, seq, value))
        return self

    def put(self, symbol: int, time: int, value: bytes, seq: int = 0, overwrite: bool = False) -> "Batch":
        return self._add("upsert" if overwrite else "put", symbol, time, seq, bytes(value))

    def upsert(self, symbol: int, time: int, value: bytes, seq: int = 0) -> "Batch":
        return self.put(symbol, time, value, seq, overwrite=True)

    def delete(self, symbol: int, time: int, seq: int = 0) -> "Batch":
        return self._add("del", symbol, time, seq, None)

    def put_meta(self, key: str, value: bytes) -> "Batch":
        """Metadata of the same commit: the last value queued for a key wins, an empty one erases it."""
        if not 1 <= len(key.encode()) <= 255 or "\0" in key or len(value) > META_BYTES:
            raise InvalidError("a metadata key has 1 to 255 bytes, its value 4096 at most")
        self.meta[key] = bytes(value)
        return self

    def clear(self) -> None:
        self.ops, self.meta, self.frame = [], {}, None

    def __len__(self) -> int:
        return len(self.ops) + len(self.meta) + (self.frame.count() if self.frame is not None else 0)


def _number(x):
    return int(x) if isinstance(x, Decimal) else x


class Snapshot:
    """The state of one commit; unaffected by later ones."""

    def __init__(self, store: "Store", manifest: dict):
        self.store, self.manifest, self.txn = store, manifest, manifest["txn"]

    def files(self, low: tuple | None = None, high: tuple | None = None) -> list[dict]:
        """Files whose key range meets [low, high]; the bounds are (leading parts of) keys."""
        return [f for f in self.manifest["files"] if (low is None or tuple(f["max"][: len(low)]) >= low) and (high is None or tuple(f["min"][: len(high)]) <= high)]

    def files_of(self, symbols: list[int], low: int = 0, high: int | None = None) -> list[dict]:
        """Files whose key range meets [low, high] of any of the symbols."""
        high = self.store.most if high is None else high
        listed, out = sorted(set(symbols)), []
        for f in self.manifest["files"]:
            # Symbols strictly inside the file's range are met whole; those at its ends by their times.
            first, last = bisect_left(listed, f["min"][0]), bisect_right(listed, f["max"][0])
            if any((f["min"][0] < s or f["min"][1] <= high) and (f["max"][0] > s or f["max"][1] >= low) for s in {*listed[first : min(first + 2, last)], *listed[max(first, last - 2) : last]}):
                out.append(f)
        return out

    def files_near(self, spans: DataFrame) -> list[dict]:
        """Files whose key range meets any of the spans (symbol, low, high); only paths reach the driver."""
        files = self.manifest["files"]
        if not files:
            return []
        key = PROFILES[self.store.profile][0].simpleString()
        of = Decimal if self.store.profile == "u64" else int
        ranges = self.store.spark.createDataFrame([(i, *(of(f[e][k]) for e in ("min", "max") for k in (0, 1))) for i, f in enumerate(files)], f"file int, s0 {key}, t0 {key}, s1 {key}, t1 {key}")
        meets = F.expr("s0 <= symbol AND symbol <= s1 AND (s0 < symbol OR t0 <= high) AND (symbol < s1 OR low <= t1)")
        hit = {r["file"] for r in ranges.join(F.broadcast(spans), meets, "left_semi").select("file").collect()}
        return [f for i, f in enumerate(files) if i in hit]

    def frame(self, files: list[dict] | None = None) -> DataFrame:
        files = self.manifest["files"] if files is None else files
        schema = record_schema(self.store.profile)
        if not files:
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.schema(schema).parquet(*(self.store.files.at(f["path"]) for f in files))

    def catalog(self) -> DataFrame:
        schema = self.store.catalog_schema
        if not self.manifest["catalog"]:
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.schema(schema).parquet(self.store.files.at(self.manifest["catalog"]))

    def known(self, symbol: int) -> T.Row | None:
        return self.catalog().where(F.col("symbol") == F.lit(symbol)).first()

    def _range(self, symbol: int, low: int, high: int) -> DataFrame:
        return self.frame(self.files((symbol, low), (symbol, high)))

    def get(self, symbol: int, time: int, seq: int = 0) -> bytes | None:
        row = point.get(self._range(symbol, time, time), symbol, time, seq).first()
        return None if row is None else bytes(row["value"])

    def get_le(self, symbol: int, time: int) -> T.Row | None:
        return point.get_le(self._range(symbol, 0, time), symbol, time).first()

    def get_ge(self, symbol: int, time: int) -> T.Row | None:
        return point.get_ge(self._range(symbol, time, self.store.most), symbol, time).first()

    def scan(self, symbol: int, low: int = 0, high: int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        high = self.store.most if high is None else high
        check_range(low, high)
        return scan.scan(self._range(symbol, low, high), symbol, low, high, reverse, limit)

    def scan_multi(self, symbols: list[int], low: int = 0, high: int | None = None, reverse: bool = False) -> DataFrame:
        high = self.store.most if high is None else high
        check_range(low, high)
        if not symbols:
            return merge.scan_multi(self.frame([]), symbols, low, high, reverse)
        return merge.scan_multi(self.frame(self.files_of(symbols, low, high)), symbols, low, high, reverse)

    def read_range(self, symbol: int, low: int = 0, high: int | None = None, cap: int | None = None) -> DataFrame:
        """Values of a symbol of fixed width."""
        high = self.store.most if high is None else high
        check_range(low, high)
        row = self.known(symbol)
        if row is None:
            raise NotFound(f"symbol {symbol} is unknown")
        if not row["record_size"]:
            raise InvalidError(f"symbol {symbol} has values of any width")
        return scan.read_range(self._range(symbol, low, high), symbol, low, high, cap)

    def count(self, symbol: int) -> int:
        row = self.known(symbol)
        return row["record_count"] if row else 0

    def _time(self, symbol: int, which: str) -> int:
        row = self.known(symbol)
        if row is None or not row["record_count"]:
            raise NotFound(f"symbol {symbol} has no records")
        return _number(row[which])

    def max_time(self, symbol: int) -> int:
        return self._time(symbol, "max_time")

    def min_time(self, symbol: int) -> int:
        return self._time(symbol, "min_time")

    def symbol_info(self, symbol: int) -> dict:
        row = self.known(symbol)
        if row is None:
            raise NotFound(f"symbol {symbol} is unknown")
        return {"min_time": _number(row["min_time"] or 0), "max_time": _number(row["max_time"] or 0), "record_count": row["record_count"], "record_size": row["record_size"], "files": len(self.files((symbol,), (symbol,)))}

    def max_times(self, symbols: list[int]) -> list[int]:
        """The newest time of each listed symbol, in the list's order; 0 if it has none."""
        found = {_number(r["symbol"]): _number(r["max_time"]) for r in self.catalog().where(F.col("symbol").isin(sorted(set(symbols)))).collect()} if symbols else {}
        return [found.get(s) or 0 for s in symbols]

    def list_symbols(self, cap: int | None = None) -> tuple[list[int], int]:
        """Up to ``cap`` symbols, also those without records, and how many there are."""
        rows = self.catalog().select("symbol").orderBy("symbol")
        return [_number(r["symbol"]) for r in (rows if cap is None else rows.limit(cap)).collect()], rows.count()

    def get_meta(self, key: str) -> bytes:
        if not key:
            raise InvalidError("a metadata key isn't empty")
        if key not in self.manifest["meta"]:
            raise NotFound(f"no metadata {key!r}")
        return base64.b64decode(self.manifest["meta"][key])

    def prefetch(self, symbol: int, low: int = 0, high: int | None = None) -> DataFrame:
        """The range, read once and kept (in memory, what doesn't fit there on disk) until ``unpersist``."""
        rows = self.scan(symbol, low, high).persist(StorageLevel.MEMORY_AND_DISK)
        rows.count()
        return rows


class Store:
    """An open store; ``with`` closes it. Reads go through ``snapshot()``."""

    def __init__(self, spark: SparkSession, root: str, mode: str, profile: str):
        self.spark, self.mode, self.files = spark, mode, Files(spark, root)
        self.closed = False
        names = [n for n in self.files.names() if not n.startswith(".")]
        if not self._versions():
            if mode == "r" or names:
                if mode == "r" and not names:
                    raise StoreError(f"{root} has no store")
                raise CorruptError(f"{root} holds other files, or no version of a store")
            self.profile = profile
            self.files.make("versions")
            self.files.publish(self._name(1), json.dumps({"format": FORMAT, "profile": profile, "txn": 1, "parent": 0, "files": [], "catalog": "", "meta": {}}))
        self.profile = self._newest()["profile"]
        self.most = PROFILES[self.profile][1]
        key = PROFILES[self.profile][0]
        self.catalog_schema = T.StructType([T.StructField("symbol", key), T.StructField("record_size", T.LongType()), T.StructField("record_count", T.LongType()), T.StructField("min_time", key), T.StructField("max_time", key)])

    @classmethod
    def open(cls, spark: SparkSession, root: str, mode: str = "rw", profile: str = "signed") -> "Store":
        """Opens a store; "rw" makes one where nothing is, "r" never writes."""
        if mode not in ("r", "rw") or profile not in PROFILES:
            raise InvalidError(f"mode {mode!r} or profile {profile!r} is unknown")
        return cls(spark, root, mode, profile)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> "Store":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @staticmethod
    def _name(txn: int) -> str:
        return f"versions/{txn:020d}.json"

    def _versions(self) -> list[int]:
        return [int(n[:20]) for n in self.files.names("versions") if n.endswith(".json") and n[:20].isdigit()]

    def _newest(self) -> dict:
        """The newest manifest that can be read; a damaged one falls back to the one before."""
        for txn in sorted(self._versions(), reverse=True):
            try:
                manifest = json.loads(self.files.read(self._name(txn)))
                if manifest["format"] == FORMAT and manifest["txn"] == txn:
                    return manifest
            except (ValueError, KeyError, TypeError):
                continue
        raise CorruptError(f"{self.files.root} has no readable version")

    def _readable(self, txn: int) -> bool:
        try:
            manifest = json.loads(self.files.read(self._name(txn)))
            return manifest["format"] == FORMAT and manifest["txn"] == txn
        except (ValueError, KeyError, TypeError):
            return False

    def snapshot(self) -> Snapshot:
        if self.closed:
            raise StoreError("the store is closed")
        return Snapshot(self, self._newest())

    def txn_id(self) -> int:
        return self.snapshot().txn

    def wait_for_txn(self, last: int, timeout: float) -> int:
        """The commit counter once it differs from ``last``; NotFound (with it) after ``timeout`` seconds."""
        end, pause = time.monotonic() + timeout, 0.001
        seen, now = None, last
        while True:
            versions = self._versions()
            if versions != seen:  # only then is there anything to read
                seen, now = versions, self._newest()["txn"]
            if now != last:
                break
            if time.monotonic() >= end:
                raise NotFound("no commit in time", txn=now)
            time.sleep(min(pause, max(0.0, end - time.monotonic())))
            pause = min(pause * 2, 0.064)
        return now

    # Writing

    def _writable(self) -> Snapshot:
        if self.mode == "r":
            raise StoreError("the store is open for reading only")
        return self.snapshot()

    def _facts(self, rows: DataFrame) -> dict[str, T.Row]:
        """By file: how many records, the key range, and a checksum over all records, read as a stream."""
        key = F.struct(*KEY)
        total = F.sum(F.xxhash64(*KEY, "value").cast("decimal(38,0)"))
        facts = rows.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"), total.cast("string").alias("sum"))
        return {unquote(r["file"].rsplit("/data/", 1)[1]): r for r in facts.collect()}  # one row for each file

    def _stored(self, rows: DataFrame, to: Files | None = None) -> list[dict]:
        """Writes records as sorted files of disjoint key ranges; their entries for a manifest."""
        path = (to or self.files).at(name := f"data/{uuid.uuid4().hex}")
        rows.select(*KEY, "value").repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(path)
        facts = self._facts(self.spark.read.schema(record_schema(self.profile)).parquet(path))
        out = [{"path": f"data/{file}", "rows": r["rows"], "sum": r["sum"], "min": [_number(x) for x in r["low"]], "max": [_number(x) for x in r["high"]]} for file, r in facts.items()]
        assert all(f["path"].startswith(name) for f in out)
        return sorted(out, key=lambda f: f["min"])

    def _catalog(self, before: Snapshot, files: list[dict], touched: DataFrame, dropped: int | None = None) -> str:
        """Writes the catalog after a change of the ``touched`` symbols; their facts are taken anew, from files that may hold them."""
        after = Snapshot(self, before.manifest | {"files": files})
        touched = touched.select(F.col("symbol").cast(PROFILES[self.profile][0]).alias("symbol")).distinct()
        held = after.frame(after.files_near(touched.withColumn("low", F.lit(0)).withColumn("high", F.lit(str(self.most)).cast(PROFILES[self.profile][0]))))
        facts = held.join(touched, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("record_count"), F.min("time").alias("min_time"), F.max("time").alias("max_time"))
        old = before.catalog()
        rows = touched.join(old.select("symbol", "record_size"), "symbol", "left").join(facts, "symbol", "left")
        rows = rows.select("symbol", F.coalesce("record_size", F.lit(0)).cast("long").alias("record_size"), F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"), "min_time", "max_time")
        rows = old.join(touched, "symbol", "left_anti").unionByName(rows)
        return self._write_catalog(rows if dropped is None else rows.where(F.col("symbol") != F.lit(dropped)))

    def _write_catalog(self, rows: DataFrame, to: Files | None = None) -> str:
        path = f"catalog/{uuid.uuid4().hex}"
        rows.select(*self.catalog_schema.names).repartitionByRange("symbol").sortWithinPartitions("symbol").write.parquet((to or self.files).at(path))
        return path

    def _publish(self, before: Snapshot, sync: bool = True, **changes) -> int:
        txn = before.txn + 1
        while not self.files.publish(self._name(txn), json.dumps(before.manifest | changes | {"txn": txn, "parent": before.txn}), sync):
            if self._readable(txn):
                raise StoreError("another writer committed first; read again and retry", txn=before.txn)
            txn += 1  # a damaged manifest has this number
        return txn

    def _meta(self, before: Snapshot, changes: dict[str, bytes]) -> dict[str, str]:
        meta = {k: base64.b64decode(v) for k, v in before.manifest["meta"].items()} | changes
        meta = {k: v for k, v in meta.items() if v}
        if sum(4 + len(k.encode()) + len(v) for k, v in meta.items()) > META_BYTES:
            raise CapacityError("metadata is full")
        return {k: base64.b64encode(v).decode() for k, v in meta.items()}

    def _ops(self, batch: Batch) -> DataFrame:
        schema = T.StructType([T.StructField("op", T.StringType()), *record_schema(self.profile).fields, T.StructField("idx", T.LongType())])
        of = (lambda x: Decimal(x)) if self.profile == "u64" else int
        for _, s, t, q, _v in batch.ops:
            check_key(self.profile, s, t, q)
        queued = self.spark.createDataFrame([(op, of(s), of(t), q, v, i) for i, (op, s, t, q, v) in enumerate(batch.ops)], schema)
        if batch.frame is None:
            return queued
        brought = batch.frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        if not brought.where(bad_keys(brought, self.profile) | (F.octet_length("value") > MAX_VALUE) | ~F.col("op").isin("put", "upsert", "del")).isEmpty():
            raise InvalidError("an operation's key, value or kind is outside the limits")
        return brought.unionByName(queued.withColumn("idx", F.col("idx") + F.lit(1 << 62)))

    def write(self, batch: Batch, sync: bool = True) -> int:
        """Commits a batch, all of it or nothing; the commit counter afterwards (as before for an empty batch)."""
        before = self._writable()
        if not batch.ops and not batch.meta and batch.frame is None:
            return before.txn
        if not batch.ops and batch.frame is None:
            return self._publish(before, sync, meta=self._meta(before, batch.meta))
        ops = self._ops(batch).persist()
        try:
            spans = ops.groupBy("symbol").agg(F.min("time").alias("low"), F.max("time").alias("high"))
            if spans.isEmpty():
                return self._publish(before, sync, meta=self._meta(before, batch.meta)) if batch.meta else before.txn
            near = before.files_near(spans)
            base = before.frame(near)
            bad = batches.violations(base, ops, before.catalog().select("symbol", "record_size")).orderBy(*KEY, "idx").first()
            if bad:
                raise InvalidError(f"{bad['rule']} at key ({bad['symbol']}, {bad['time']}, {bad['seq']})", rule=bad["rule"], idx=bad["idx"])
            meta = self._meta(before, batch.meta)
            final = batches.net(ops)
            hit = base.select(*KEY, F.input_file_name().alias("file")).join(final.select(*KEY), KEY, "left_semi").select("file").distinct()
            # Only files that hold a key of the batch are written again; a batch of new keys only adds files.
            names = {unquote(r["file"].rsplit("/data/", 1)[1]) for r in hit.collect()} if near else set()
            old = [f for f in near if f["path"].removeprefix("data/") in names]
            again = {f["path"] for f in old}
            kept = [f for f in before.manifest["files"] if f["path"] not in again]
            new = batches.apply_batch(before.frame(old), ops)
            files = sorted([*kept, *self._stored(new)], key=lambda f: f["min"])
            created = batches.created(ops)
            touched = ops.select("symbol").distinct().join(before.catalog().select("symbol").union(created).distinct(), "symbol", "left_semi")
            return self._publish(before, sync, files=files, catalog=self._catalog(before, files, touched), meta=meta)
        finally:
            ops.unpersist()

    def symbol_define(self, symbol: int, record_size: int) -> int:
        """Declares a width before any record exists; the same again commits, another fails."""
        before = self._writable()
        if not 1 <= record_size <= MAX_RECORD:
            raise InvalidError(f"a record has 1 to {MAX_RECORD} bytes")
        check_key(self.profile, symbol, 0, 0)
        row = before.known(symbol)
        if row and row["record_size"] != record_size and (row["record_size"] or row["record_count"]):
            raise InvalidError(f"symbol {symbol} has records or another width")
        rows, size = before.catalog(), F.lit(record_size).cast("long")
        if row:  # facts stay as they are: no record is read
            rows = rows.withColumn("record_size", F.when(F.col("symbol") == F.lit(symbol), size).otherwise(F.col("record_size")))
        else:
            rows = rows.unionByName(self._one(symbol).withColumn("record_size", size).withColumn("record_count", F.lit(0).cast("long")), allowMissingColumns=True)
        return self._publish(before, catalog=self._write_catalog(rows))

    def _one(self, symbol: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(symbol).cast(PROFILES[self.profile][0]).alias("symbol"))

    def _remove(self, before: Snapshot, symbol: int, low: int, high: int) -> list[dict]:
        """Files without a symbol's records of a range: whole files go by their key range, others are written again."""
        near = before.files((symbol, low), (symbol, high))
        whole = [f for f in near if f["min"][0] == f["max"][0] == symbol and f["min"][1] >= low and f["max"][1] <= high]
        gone, known = {f["path"] for f in near}, {f["path"] for f in whole}
        part = [f for f in near if f["path"] not in known]
        new = self._stored(batches.delete_range(before.frame(part), symbol, low, high)) if part else []
        return sorted([*(f for f in before.manifest["files"] if f["path"] not in gone), *new], key=lambda f: f["min"])

    def delete_range(self, symbol: int, low: int, high: int) -> int:
        before = self._writable()
        check_range(low, high)
        if before.known(symbol) is None:
            return before.txn
        files = self._remove(before, symbol, low, high)
        return self._publish(before, files=files, catalog=self._catalog(before, files, self._one(symbol)))

    def truncate_before(self, symbol: int, cutoff: int) -> int:
        """Removes the symbol's records before ``cutoff``."""
        before = self._writable()
        if before.known(symbol) is None:
            return before.txn
        files = self._remove(before, symbol, 0, cutoff - 1) if cutoff > 0 else before.manifest["files"]
        return self._publish(before, files=files, catalog=self._catalog(before, files, self._one(symbol)))

    def symbol_drop(self, symbol: int) -> int:
        before = self._writable()
        if before.known(symbol) is None:
            raise NotFound(f"symbol {symbol} is unknown")
        files = self._remove(before, symbol, 0, self.most)
        return self._publish(before, files=files, catalog=self._catalog(before, files, self._one(symbol), dropped=symbol))

    # Operations

    def compact(self) -> int:
        """Writes all records again as files of even size, in one commit."""
        before = self._writable()
        return self._publish(before, files=self._stored(before.frame()) if before.manifest["files"] else [])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last ``keep``, and the files that no version left names; how many folders went."""
        self._writable()
        versions = sorted(self._versions())
        readable = [txn for txn in versions if self._readable(txn)]
        if not readable:
            raise CorruptError(f"{self.files.root} has no readable version")
        kept = readable[-keep:]
        for txn in versions:
            if txn < kept[0]:
                self.files.delete(self._name(txn))
        named = set()
        for txn in kept:
            manifest = json.loads(self.files.read(self._name(txn)))
            named |= {"/".join(f["path"].split("/")[:2]) for f in manifest["files"]} | {manifest["catalog"]}
        gone = [f"{top}/{n}" for top in ("data", "catalog") for n in self.files.names(top) if f"{top}/{n}" not in named]
        for path in gone:
            self.files.delete(path)
        return len(gone)

    def backup(self, to: str) -> int:
        """A copy of the newest version at ``to``, replacing a store there; the store itself is refused."""
        now, other = self.snapshot(), Files(self.spark, to)
        if other.root == self.files.root or other.root.startswith(self.files.root + "/") or self.files.root.startswith(other.root + "/"):
            raise InvalidError("a store can't be copied onto itself")
        if other.names() and not other.names("versions"):
            raise CorruptError(f"{to} holds other files")
        # Written beside it by tasks, and put in its place when it is whole: there is a whole copy at any time.
        copy = Files(self.spark, f"{other.root}.{uuid.uuid4().hex}.new")
        files = self._stored(now.frame(), copy) if now.manifest["files"] else []
        catalog = self._write_catalog(now.catalog(), copy) if now.manifest["catalog"] else ""
        copy.make("versions")
        copy.publish(self._name(now.txn), json.dumps(now.manifest | {"files": files, "catalog": catalog}))
        old = Files(self.spark, f"{other.root}.{uuid.uuid4().hex}.old")
        had = other.exists()
        if had:
            other.move(old)
        copy.move(other)
        if had:
            old.delete("")
        return now.txn

    def sync(self) -> int:
        """Makes commits that were written without ``sync`` durable; the commit counter."""
        now = self._writable()
        self.files.sync([self._name(now.txn), *(f["path"] for f in now.manifest["files"]), *([now.manifest["catalog"]] if now.manifest["catalog"] else [])])
        return now.txn

    def verify(self) -> dict:
        """Checks checksums, counts, key ranges, uniqueness, widths and the catalog; CorruptError (with the report) if any fails."""
        now = self.snapshot()
        report = {"txn": now.txn, "files": len(now.manifest["files"]), "errors": []}
        if now.manifest["files"]:
            try:
                found = self._facts(now.frame())
                for f in now.manifest["files"]:
                    r = found.get(f["path"].removeprefix("data/"))
                    if r is None or (r["rows"], [_number(x) for x in r["low"]], [_number(x) for x in r["high"]]) != (f["rows"], f["min"], f["max"]):
                        report["errors"].append(f"{f['path']}: rows or keys differ from the manifest")
                    elif r["sum"] != f["sum"]:
                        report["errors"].append(f"{f['path']}: checksum differs")
            except Exception as e:  # noqa: BLE001  a damaged file fails in many ways
                raise CorruptError("a file can't be read", report=report | {"errors": [*report["errors"], str(e)[:300]]}) from e
        counts = batches.verify(now.frame(), now.catalog()).first().asDict()
        wide = now.frame().join(now.catalog().where("record_size > 0").select("symbol", "record_size"), "symbol").where("octet_length(value) <> record_size").count()
        report |= counts | {"symbols": now.catalog().count()}
        report["errors"] += [f"{n} {what}" for what, n in (("repeated keys", counts["repeated_keys"]), ("symbols that disagree with the catalog", counts["bad_symbols"]), ("values of another width", wide)) if n]
        if report["errors"]:
            raise CorruptError(report["errors"][0], report=report)
        return report

    def stats(self) -> dict:
        now = self.snapshot()
        files = now.manifest["files"]
        return {
            "txn": now.txn, "files": len(files), "records": sum(f["rows"] for f in files), "symbols": now.catalog().count(), "versions": len(self._versions()), "format": FORMAT, "version": VERSION,
            "data_bytes": self.files.size(*{f["path"].rsplit("/", 1)[0] for f in files}), "store_bytes": self.files.size(""), "meta_bytes": sum(4 + len(k.encode()) + len(base64.b64decode(v)) for k, v in now.manifest["meta"].items()),
            "largest_file_rows": max((f["rows"] for f in files), default=0), "kept_tables": self.spark.sparkContext._jsc.sc().getPersistentRDDs().size(),
        }
