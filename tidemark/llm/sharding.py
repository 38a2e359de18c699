"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in the order of their key by a range exchange of narrow rows. The
driver sees one (bytes, rows) total for each partition, makes prefix sums of
those, and each partition then places its own rows: a row goes to the shard in
which the middle of its byte span falls, so a shard's size differs from the
target by less than its largest row.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_dir


def balanced_shards(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1), ``slot`` and ``start`` (bytes before the row).

    ``order``: columns that fix the order; rows that agree in all of them may come in
    either order (nulls first). ``size``: non-negative long column, null counts as 0.
    A table without rows gives none; where all sizes are 0 every row goes to shard 0.
    A row larger than a whole target leaves the shards it covers empty.
    Columns of ``rows`` named shard, slot or start are replaced.
    """
    rows = rows.drop("shard", "slot", "start")
    scratch_dir(rows.sparkSession)
    # The boundaries of a range exchange come from a sample and differ from run to
    # run; the checkpoint fixes them for the passes below.
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    totals = {r.pid: (r.bytes or 0, r.n) for r in ranged.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    pids = range(max(totals, default=-1) + 1)
    bytes_before = [0, *accumulate(totals.get(p, (0, 0))[0] for p in pids)]
    rows_before = [0, *accumulate(totals.get(p, (0, 0))[1] for p in pids)]
    whole = max(1, bytes_before[-1])

    def starts(batches):
        """(first byte, shard, position) of each batch's rows."""
        pid = TaskContext.get().partitionId()
        at, row = (bytes_before[pid], rows_before[pid]) if pid < len(pids) else (0, 0)
        for batch in batches:
            each = batch.column(batch.schema.get_field_index(size)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = at + np.cumsum(each) - each
            # Exact in integers: (2 * start + size) * shards stays below 2^63 up to 50 PB in 80 shards.
            shard = np.minimum(shards - 1, (2 * start + each) * shards // (2 * whole))
            yield batch, start, shard, row + np.arange(len(each))
            at, row = at + int(each.sum()), row + len(each)

    def counts(batches):
        seen = np.zeros(shards, np.int64)
        for _, _, shard, _ in starts(batches):
            seen += np.bincount(shard, minlength=shards)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["shard", "n"])

    held = {r.shard: r.n for r in ranged.select(size).mapInArrow(counts, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    first = np.array([0, *accumulate(held.get(s, 0) for s in range(shards))], np.int64)
    schema = T.StructType([*ranged.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("start", T.LongType())])
    names = [f.name for f in schema.fields]

    def place(batches):
        for batch, start, shard, row in starts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(row - first[shard]), pa.array(start)], names)

    return ranged.mapInArrow(place, schema)
