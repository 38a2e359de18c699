"""The store: commits, unknown symbols, cursors, damage, streams."""

import json
import os
import random

import pytest

from tidemark.errors import CapacityError, CorruptError, InvalidError, NotFound, Status, StoreError, last_error, strerror
from tidemark.sources.cursor import Cursor
from tidemark.sources.store import Batch, Store


def rows(df):
    return [(int(r["symbol"]), int(r["time"]), r["seq"], bytes(r["value"])) for r in df.collect()]


def test_commits_and_reads(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "a"))
    assert store.txn_id() == 1 and store.write(Batch()) == 1
    b = Batch()
    for t in range(10):
        b.put(3, t, b"v")
    b.put(21, 5, b"", seq=7).put_meta("cursor", b"10").put_meta("cursor", b"11").delete(99, 1)
    assert store.write(b) == 2
    now = store.snapshot()
    assert now.get(21, 5) is None and now.get(21, 5, 7) == b"" and now.get_meta("cursor") == b"11"
    assert now.list_symbols() == ([3, 21], 2) and now.list_symbols(1) == ([3], 2)
    with pytest.raises(InvalidError):
        store.write(Batch().put(3, 200, b"new").put(3, 5, b"again").put_meta("cursor", b"99"))
    assert store.txn_id() == 2 and store.snapshot().count(3) == 10 and store.snapshot().get_meta("cursor") == b"11"
    store.write(Batch().upsert(3, 1, b"a").upsert(3, 1, b"b").upsert(3, 99, b"c").put(40, 1, b"x").delete(40, 1).put_meta("cursor", b""))
    later = store.snapshot()
    assert later.get(3, 1) == b"b" and later.count(3) == 11 and later.max_time(3) == 99 and later.count(40) == 0
    assert now.get(3, 1) == b"v" and now.count(3) == 10  # an old snapshot stays as it was
    assert 40 in later.list_symbols()[0]
    with pytest.raises(NotFound):
        later.get_meta("cursor")
    with pytest.raises(NotFound):
        later.max_time(40)
    assert later.symbol_info(40)["record_count"] == 0 and later.max_times([3, 40, 7, 3]) == [99, 0, 0, 99]
    with pytest.raises(NotFound):
        later.read_range(7, 0, 1)
    with pytest.raises(InvalidError):
        later.read_range(3, 0, 1)
    assert later.get_le(3, 50)["time"] == 9 and later.get_ge(3, 10)["time"] == 99 and later.get_le(7, 5) is None
    txn = store.txn_id()
    assert store.delete_range(7, 0, 5) == store.truncate_before(7, 5) == txn
    with pytest.raises(NotFound):
        store.symbol_drop(7)
    assert store.truncate_before(3, 5) == txn + 1 and store.snapshot().min_time(3) == 5
    assert store.delete_range(3, 6, 8) == txn + 2 and rows(store.snapshot().scan(3)) == [(3, 5, 0, b"v"), (3, 9, 0, b"v"), (3, 99, 0, b"c")]
    assert store.symbol_drop(21) == txn + 3 and store.snapshot().list_symbols()[0] == [3, 40]
    assert store.verify()["records"] == 3
    assert store.wait_for_txn(0, 0.1) == txn + 3
    with pytest.raises(NotFound) as e:
        store.wait_for_txn(txn + 3, 0.02)
    assert e.value.details["txn"] == txn + 3
    # Copy, compaction, reading only.
    with pytest.raises(InvalidError):
        store.backup(str(tmp_path / "a"))
    store.backup(str(tmp_path / "b"))
    copy = Store.open(spark, str(tmp_path / "b"), "r")
    assert rows(copy.snapshot().scan(3)) == rows(store.snapshot().scan(3))
    for call in (lambda: copy.write(Batch().put(1, 1, b"")), lambda: copy.truncate_before(3, 1), lambda: copy.symbol_define(1, 4)):
        with pytest.raises(StoreError):
            call()
    store.compact()
    assert store.vacuum() > 0 and store.stats()["versions"] == 1 and store.verify()["records"] == 3
    # A damaged manifest falls back to the one before; a damaged file is found.
    newest = max((tmp_path / "a" / "versions").glob("*.json"))
    torn = newest.with_name(f"{store.txn_id() + 1:020d}.json")
    torn.write_text(newest.read_text()[:50])
    assert Store.open(spark, str(tmp_path / "a")).txn_id() == store.txn_id()
    file = tmp_path / "b" / copy.snapshot().manifest["files"][0]["path"]
    os.remove(file.with_name(f".{file.name}.crc")) if file.with_name(f".{file.name}.crc").exists() else None
    file.write_bytes(file.read_bytes()[:-40] + bytes(40))
    with pytest.raises(CorruptError):
        copy.verify()


def test_widths_limits_and_modes(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(CorruptError):
        Store.open(spark, str(tmp_path / "other"))
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "none"), "r")
    assert not (tmp_path / "none" / "versions").exists()
    store = Store.open(spark, str(tmp_path / "w"))
    assert store.symbol_define(70, 4) == 2 and store.symbol_define(70, 4) == 3
    for size in (32, 0, 16_385):
        with pytest.raises(InvalidError):
            store.symbol_define(70, size)
    with pytest.raises(InvalidError):
        store.write(Batch().put(70, 1, b"12345678").delete(70, 1))
    store.write(Batch().put(70, 60, b"0060").put(70, 120, b"0120").put(70, 180, b"0180"))
    now = store.snapshot()
    assert [bytes(r["value"]) for r in now.read_range(70, 61, 180).collect()] == [b"0120", b"0180"]
    with pytest.raises(CapacityError):
        now.read_range(70, 0, 200, cap=2)
    with pytest.raises(InvalidError):
        now.scan(70, 5, 1)
    with pytest.raises(InvalidError):
        Batch().put(1, 1, bytes(65_001))
    with pytest.raises(InvalidError):
        Batch().put_meta("", b"x")
    with pytest.raises(CapacityError):
        store.write(Batch().put_meta("a", bytes(4000)).put_meta("b", bytes(200)))
    with pytest.raises(InvalidError):
        store.write(Batch().put(1 << 63, 1, b""))
    # Two writers from one version: the second loses.
    before = store.snapshot()
    assert store._publish(before) == before.txn + 1
    with pytest.raises(StoreError):
        store._publish(before)


def test_unsigned_keys(spark, tmp_path):
    most = (1 << 64) - 1
    store = Store.open(spark, str(tmp_path / "u"), profile="u64")
    store.write(Batch().put(0, 0, b"a").put(0, 5, b"b", seq=4_294_967_295).put(0, 7, b"").put(0, most, b"d"))
    now = store.snapshot()
    assert now.count(0) == 4 and now.max_time(0) == most and now.get(0, 7) == b""
    assert len(rows(now.scan(0, 7, 7))) == 1 and rows(now.scan(0, 1, 4)) == [] and now.get_le(0, 6)["time"] == 5


def test_cursors(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "c"))
    b = Batch()
    for t in range(60):
        b.put(30, t, b"x")
        b.put(31, t, b"y")
    store.write(b)
    live, fixed, merged = Cursor(store, 30, live=True, chunk=20), Cursor(store, 30, chunk=50), Cursor(store, [30, 31], live=True, chunk=30)
    first = [live.next()["time"] for _ in range(10)]
    assert first == list(range(10)) and fixed.next()["time"] == 0 and len(merged.next_batch(100)) == 30
    b = Batch().delete(30, 40).upsert(30, 5, b"late").put(30, 100, b"z")
    store.write(b)
    assert [r["time"] for r in live] == [*range(10, 40), *range(41, 60), 100] and live.next() is None
    assert [r["time"] for r in fixed] == list(range(1, 60))
    rest = [(r["time"], r["seq"], r["symbol"]) for r in merged]
    assert rest == sorted(rest) and len(rest) == 120 - 30 - 1 + 1
    seek = Cursor(store, 30, 10, 50, reverse=True)
    seek.seek(20)
    assert [seek.next()["time"] for _ in range(2)] == [20, 19]
    seek.seek(5000)
    assert seek.next()["time"] == 50  # within the bounds
    with pytest.raises(InvalidError):
        merged.seek(1)
    with pytest.raises(InvalidError):
        Cursor(store, [30], reverse=True)
    assert list(Cursor(store, [])) == []


def test_model(spark, tmp_path):
    """A seeded stream of commits against a dict."""
    rng, store, held = random.Random(3), Store.open(spark, str(tmp_path / "m")), {}
    for _ in range(4):
        b, new = Batch(), dict(held)
        for _ in range(25):
            k = (rng.randrange(3), rng.randrange(12), rng.randrange(2))
            if rng.random() < 0.3:
                b.delete(*k)
                new.pop(k, None)
            else:
                v = bytes([rng.randrange(256)])
                b.upsert(k[0], k[1], v, seq=k[2])
                new[k] = v
        store.write(b)
        held = new
        assert {x[:3]: x[3] for x in rows(store.snapshot().frame())} == held
    assert store.verify()["records"] == len(held)


def test_stream(spark, tmp_path):
    from tidemark.streaming.ingest import ingest, tail

    store = Store.open(spark, str(tmp_path / "s"))
    source = str(tmp_path / "in")
    schema = "symbol long, time long, seq long, value binary"
    spark.createDataFrame([(1, t, 0, b"a") for t in range(5)], schema).write.parquet(source)
    ingest(spark.readStream.schema(schema).parquet(source), store, "q", str(tmp_path / "ck")).awaitTermination(60)
    assert store.snapshot().count(1) == 5 and store.snapshot().get_meta("stream:q") == b"0"
    txn = store.txn_id()
    spark.createDataFrame([(1, 2, 0, b"b"), (1, 9, 0, b"c")], schema).write.mode("append").parquet(source)
    ingest(spark.readStream.schema(schema).parquet(source), store, "q", str(tmp_path / "ck")).awaitTermination(60)
    assert store.snapshot().count(1) == 6 and store.snapshot().get(1, 2) == b"b"
    seen = []
    assert tail(store, txn, lambda df, n: seen.append((n, df.count())), 0.05, commits=1) == txn + 1 and seen[0][1] >= 2
    manifest = json.loads(store.files.read(store._name(store.txn_id())))
    assert manifest["parent"] == store.txn_id() - 1


def test_writing_goes_on_after_a_torn_manifest(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "t"))
    store.write(Batch().put(1, 1, b"a"))
    torn = tmp_path / "t" / store._name(3)
    torn.write_text('{"format": 1, "txn"')
    assert store.txn_id() == 2 and store.wait_for_txn(1, 0.1) == 2
    with pytest.raises(NotFound) as e:
        store.wait_for_txn(2, 0.02)  # the damaged one is no commit
    assert e.value.details["txn"] == 2
    before = store.snapshot()
    assert store.write(Batch().put(1, 2, b"b")) == 4 and store.wait_for_txn(2, 0.1) == 4
    assert json.loads(store.files.read(store._name(4)))["parent"] == 2
    assert rows(store.snapshot().scan(1)) == [(1, 1, 0, b"a"), (1, 2, 0, b"b")]
    with pytest.raises(StoreError):  # still only one writer may go on from a version
        store._publish(before)
    assert store.write(Batch().put(1, 3, b"c")) == 5 and store.vacuum() >= 0 and store.txn_id() == 5 and store.verify()["records"] == 3


def test_a_fault_while_publishing_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "f"))
    store.write(Batch().put(1, 1, b"a"))
    publish = type(store.files).publish

    def fail(self, name, text, sync=True):
        raise OSError("no space left")

    monkeypatch.setattr(type(store.files), "publish", fail)
    with pytest.raises(OSError):
        store.write(Batch().put(1, 2, b"b"))
    monkeypatch.setattr(type(store.files), "publish", publish)
    assert store.txn_id() == 2 and store.snapshot().count(1) == 1
    assert store.write(Batch().put(1, 2, b"b"), sync=False) == 3 and store.sync() == 3 and store.snapshot().count(1) == 2
    # A backup that fails half way leaves the copy before it.
    store.backup(str(tmp_path / "copy"))
    store.write(Batch().put(1, 9, b"z"))
    monkeypatch.setattr(type(store.files), "publish", fail)
    with pytest.raises(OSError):
        store.backup(str(tmp_path / "copy"))
    monkeypatch.setattr(type(store.files), "publish", publish)
    assert Store.open(spark, str(tmp_path / "copy"), "r").snapshot().count(1) == 2
    store.backup(str(tmp_path / "copy"))
    copy = Store.open(spark, str(tmp_path / "copy"), "r")
    assert copy.txn_id() == store.txn_id() and copy.verify()["records"] == 3 and copy.snapshot().max_time(1) == 9


def test_commits_and_pages_read_only_files_near_them(spark, tmp_path, monkeypatch):
    from tidemark.sources.store import Snapshot

    store = Store.open(spark, str(tmp_path / "p"))
    for s in range(1, 6):
        b = Batch()
        for t in range(0, 40, 2):
            b.put(s, t, b"x")
        store.write(b)
    read, frame = set(), Snapshot.frame

    def watched(self, files=None):
        read.update(f["path"] for f in (self.manifest["files"] if files is None else files))
        return frame(self, files)

    of = lambda s: {f["path"] for f in store.snapshot().files((s,), (s,))}
    monkeypatch.setattr(Snapshot, "frame", watched)
    mine, other = of(3), of(1) | of(2) | of(4) | of(5)
    store.write(Batch().put(3, 41, b"y"))
    assert not read & other
    read.clear()
    store.write(Batch().put(2, 41, b"y").put(4, 41, b"y"))
    assert not read & (of(1) | mine | of(5))
    read.clear()
    assert store.symbol_define(9, 4) and not read
    assert len(list(Cursor(store, 5, 0, 9, chunk=2))) == 5 and read <= of(5)
    read.clear()
    assert rows(store.snapshot().scan_multi([1, 5], 2, 2)) == [(1, 2, 0, b"x"), (5, 2, 0, b"x")] and read <= of(1) | of(5)
    now = store.snapshot()
    for symbols in ([1], [1, 5], [2, 3, 4], [7], [0, 9]):
        for low, high in ((0, 100), (41, 50), (50, 60)):
            met = {f["path"] for s in symbols for f in now.files((s, low), (s, high))}
            assert {f["path"] for f in now.files_of(symbols, low, high)} == met


def test_status_sync_stats_and_close(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "o")) as store:
        store.write(Batch().put(1, 1, b"a").put_meta("k", b"v"), sync=False)
        assert store.sync() == 2
        with Cursor(store, 1) as cursor:
            assert cursor.next()["time"] == 1 and cursor.status == Status.OK
            assert cursor.next() is None and cursor.status == Status.NOT_FOUND
        with pytest.raises(InvalidError):
            cursor.next()
        assert cursor.status == Status.INVAL and last_error() == "the cursor is closed" and strerror(Status.INVAL) == "invalid argument" and "unknown" in strerror(7)
        stats = store.stats()
        assert stats["records"] == 1 and 0 < stats["data_bytes"] < stats["store_bytes"] and stats["meta_bytes"] == 6 and stats["largest_file_rows"] == 1
        kept = store.snapshot().prefetch(1)
        assert kept.count() == 1 and kept.is_cached
        kept.unpersist()
    with pytest.raises(StoreError):
        store.snapshot()


def test_order_in_a_stream_and_rewritten_files(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tidemark.streaming.ingest import ingest, tail

    store, source, schema = Store.open(spark, str(tmp_path / "s")), str(tmp_path / "in"), "symbol long, time long, seq long, value binary, n long"
    store.write(Batch().put(1, 1, b"old").put(1, 2, b"old"))
    spark.createDataFrame([(1, 3, 0, b"zz", 1), (1, 3, 0, b"aa", 2), (1, 2, 0, b"new", 1)], schema).coalesce(1).write.parquet(source)
    since = store.txn_id()
    with pytest.raises(StreamingQueryException):
        ingest(spark.readStream.schema(schema).parquet(source), store, "q", str(tmp_path / "c1")).awaitTermination(60)
    assert store.txn_id() == since
    seen = []
    at_since = store.snapshot()
    ingest(spark.readStream.schema(schema).parquet(source), store, "q", str(tmp_path / "c2"), order="n").awaitTermination(60)
    assert rows(store.snapshot().scan(1)) == [(1, 1, 0, b"old"), (1, 2, 0, b"new"), (1, 3, 0, b"aa")]
    # What a commit brought, without the old records of files that it wrote again.
    real, calls = store.snapshot, []
    store.snapshot = lambda: (calls.append(1), at_since if len(calls) == 1 else real())[1]
    tail(store, since, lambda df, n: seen.extend(rows(df)), 0.05, commits=1)
    assert sorted(seen) == [(1, 2, 0, b"new"), (1, 3, 0, b"aa")]
