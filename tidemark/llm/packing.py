"""Best-fit packing of texts into bins, under conflicts.

Texts are taken by falling size. Bins are held in the order of their residuals, and
carry bitmaps of the sources and duplicate clusters in them. A text goes to the tightest
bin into which it fits and that has neither its source nor its cluster: the search
begins at the first residual that is large enough and goes on to its successors until
a bin is compatible, or opens a bin.

Rows are dealt evenly into groups of a bounded number of rows, and each group is packed
by itself; only narrow rows (key, size, source, cluster) move.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a group, about: enough for tight bins, small enough for one task.
GROUP_ROWS = 8192
_SCAN = 256


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each text; sizes are 0 to ``capacity``; None conflicts with nothing."""
    n = len(sizes)
    source_bit = {s: i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    often = Counter(c for c in clusters if c is not None)
    cluster_bit = {c: i for i, c in enumerate(c for c, k in often.items() if k > 1)}  # others can't conflict
    in_bin = np.zeros((n, (len(source_bit) + 63) // 64 + 1), np.uint64)
    of_cluster = np.zeros((n, (len(cluster_bit) + 63) // 64 + 1), np.uint64)
    residual, bins = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # by residual, then bin
    opened, filled, out = 0, [0] * n, [(0, 0)] * n
    for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        s, c = source_bit.get(sources[i]), cluster_bit.get(clusters[i])
        at, found = int(np.searchsorted(residual[:opened], size)), -1
        while at < opened and found < 0:
            near = bins[at : min(opened, at + _SCAN)]
            clash = np.zeros(len(near), bool)
            if s is not None:
                clash |= (in_bin[near, s >> 6] & np.uint64(1 << (s & 63))) != 0
            if c is not None:
                clash |= (of_cluster[near, c >> 6] & np.uint64(1 << (c & 63))) != 0
            free = int(np.argmin(clash))
            if not clash[free]:
                found = at + free
            at += _SCAN
        if found < 0:
            b, left = opened, capacity - size
            opened += 1
            found = opened - 1
        else:
            b, left = int(bins[found]), int(residual[found]) - size
        # The bin moves down to the place of its new residual.
        to = int(np.searchsorted(residual[:found], left))
        to += int(np.searchsorted(bins[to : int(np.searchsorted(residual[:found], left, side="right"))], b))
        residual[to + 1 : found + 1] = residual[to:found].copy()
        bins[to + 1 : found + 1] = bins[to:found].copy()
        residual[to], bins[to] = left, b
        if s is not None:
            in_bin[b, s >> 6] |= np.uint64(1 << (s & 63))
        if c is not None:
            of_cluster[b, c >> 6] |= np.uint64(1 << (c & 63))
        out[i] = (b, filled[b])
        filled[b] += 1
    return out


def pack(rows: DataFrame, key: str, size: str, source: str, cluster: str, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``key``, size, n_full, group, bin, place, rest: where each row's text is packed.

    A text of more than ``capacity`` fills ``n_full`` bins of its own; the rest (1 to
    capacity, 0 for an empty text) is packed into ``bin`` of its group.
    No bin holds two rests of one source or one cluster; null sources and clusters don't
    conflict. Null sizes count as 0. One row for each row, repeated ones too; an empty
    table gives no rows; equal rests go by key, cluster and source. Rows are dealt round
    robin, so a key, source or cluster that many rows share is spread over all groups;
    which rows make a group depends on how the table is split. Other columns are not
    read, whatever their names.
    """
    narrow = rows.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n"), F.col(source).cast("string").alias("s"), F.col(cluster).cast("string").alias("c"))
    groups = max(1, -(-rows.count() // group_rows))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *(T.StructField(f, T.LongType()) for f in ("size", "n_full", "group", "bin", "place", "rest"))])

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        size = table["n"].to_numpy()
        # Rows come in any order; by size and key the packing is the same each time.
        rest = size % capacity
        rest[(size > 0) & (rest == 0)] = capacity
        full = (size - rest) // capacity
        table = table.append_column("rest", pa.array(rest)).append_column("full", pa.array(full))
        table = table.sort_by([("rest", "descending"), ("k", "ascending"), ("c", "ascending"), ("s", "ascending")])
        placed = best_fit(table["rest"].to_pylist(), table["s"].to_pylist(), table["c"].to_pylist(), capacity)
        group = TaskContext.get().partitionId()
        columns = [table["k"].combine_chunks(), table["n"].combine_chunks(), table["full"].combine_chunks(), pa.array(np.full(len(placed), group)), pa.array([b for b, _ in placed], pa.int64()), pa.array([p for _, p in placed], pa.int64()), table["rest"].combine_chunks()]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema.names)

    # Dealt round robin, so that no key, source or cluster can make a group large.
    return narrow.repartition(groups).mapInArrow(run, schema)
