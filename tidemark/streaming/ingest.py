"""Streams of records into a store, each micro-batch once, and a store's commits as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidError, NotFound
from ..sources.store import Batch, Store


def ingest(stream: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True, order: str | None = None) -> StreamingQuery:
    """Upserts the stream's records (symbol, time, seq, value), however late, into ``store``.

    The number of the last micro-batch is committed together with its records, so that a
    micro-batch which Spark repeats after a failure is passed over. Of records of one key
    in a micro-batch the last by the column ``order`` wins; without such a column, or
    with equal ones, different values of one key are an error, as their order is unknown.
    """

    def take(rows: DataFrame, number: int) -> None:
        try:
            if int(store.snapshot().get_meta(f"stream:{name}")) >= number:
                return
        except NotFound:
            pass
        keys, at = ["symbol", "time", "seq"], F.col(order) if order else F.lit(0)
        one = rows.groupBy(*keys, at.alias("at")).agg(F.min("value").alias("value"), F.max("value").alias("other"))
        one = one.groupBy(*keys).agg(F.max_by(F.struct("value", "other"), "at").alias("last")).select(*keys, "last.*").persist()
        try:
            tie = one.where(~F.col("value").eqNullSafe(F.col("other"))).first()
            if tie:
                raise InvalidError(f"several values of key ({tie['symbol']}, {tie['time']}, {tie['seq']}) without an order")
            write(one, number)
        finally:
            one.unpersist()

    def write(one: DataFrame, number: int) -> None:
        batch = Batch(frame=one.select(F.lit("upsert").alias("op"), "symbol", "time", "seq", "value", F.lit(0).cast("long").alias("idx")))
        batch.put_meta(f"stream:{name}", str(number).encode())
        store.write(batch)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tail(store: Store, since: int, act: Callable[[DataFrame, int], None], timeout: float, commits: int | None = None) -> int:
    """Calls ``act`` with the records that commits after ``since`` brought, and their number.

    Records of files that the commit before did not have, without those that it had in
    files which were written again; at first all records, unless ``since`` is the newest
    commit. Ends after ``timeout`` seconds without a commit (or ``commits`` commits); the
    last number seen.
    """
    now = store.snapshot()
    seen, before, done = since, now if since == now.txn else None, 0
    while commits is None or done < commits:
        try:
            store.wait_for_txn(seen, timeout)
        except NotFound:
            break
        now = store.snapshot()
        known, kept = {f["path"] for f in before.manifest["files"]} if before else set(), {f["path"] for f in now.manifest["files"]}
        rows = now.frame([f for f in now.manifest["files"] if f["path"] not in known])
        if before and (gone := [f for f in before.manifest["files"] if f["path"] not in kept]):
            rows = rows.join(before.frame(gone), ["symbol", "time", "seq", "value"], "left_anti")
        act(rows, now.txn)
        seen, before, done = now.txn, now, done + 1
    return seen


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Records by symbol and window of their (timestamp) time, with a watermark."""
    return stream.withWatermark("time", late).groupBy(F.window("time", width), "symbol").agg(F.count(F.lit(1)).alias("n"))
