"""Benchmark passages in documents by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item; a shorter item is one
window. A window's set are its shingles of ``shingle`` words. As all of them have to
occur, the necessary prefix of the set, in order of rarity over all documents, is its
one rarest shingle. Only this is joined; the place of the shingle in the window then
fixes where the window would begin (positional bound) and end (length bound) in the
document. There the window's words are compared, by their hashes and then by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, column_bytes, shingles, slices, stored, words

#: Benchmark text that is joined (and sent to each executor) at a time; larger
#: benchmarks take several passes over the documents.
BLOCK_BYTES = 4 << 20


def _numbered(number: np.ndarray, k: int) -> np.ndarray:
    """Exact numbers of the runs of ``k`` words from each position on, by numbers of the words."""
    run = number
    for i in range(1, k):
        run = np.unique(run[: len(number) - i] << 32 | number[i:], return_inverse=True)[1] if len(number) > i else run[:0]
    return run


class Windows:
    """The distinct windows of a block of benchmark items, as arrays.

    ``start`` and ``size`` say where a window lies in the block's words (``value``: hashes;
    ``first`` and ``end``: bytes of ``raw``); ``owner`` has the items of window w from
    ``owned[w]`` to ``owned[w + 1]``.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.items: list[str] = [name for name, _ in items]
        raw = b"".join(x.lower() for _, x in items)
        self.raw, offsets = raw, np.cumsum([0, *(len(x) for _, x in items)])
        self.value, self.first, self.end, bounds = words(np.frombuffer(raw, np.uint8), offsets, ALNUM)
        lengths = np.diff(bounds)
        item = np.repeat(np.arange(len(items)), lengths)
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(self.first.tolist(), self.end.tolist())], np.int64)
        starts, sizes, owners, owned = [], [], [], [0]
        for k in sorted({min(window, int(n)) for n in lengths.tolist()} - {0}):
            run = _numbered(number, k)
            at = np.arange(len(run))
            own = item[at]
            # Inside one item; an item of fewer words than a window is one itself.
            fits = (item[at + k - 1] == own) & ((lengths[own] == k) if k < window else (lengths[own] >= k))
            pairs = np.unique(np.stack([run[fits], own[fits]], axis=1), axis=0) if fits.any() else np.zeros((0, 2), np.int64)
            same, place = np.unique(run[fits], return_index=True)
            starts.append(at[fits][place])
            sizes.append(np.full(len(same), k, np.int64))
            owners.append(pairs[:, 1])
            owned.extend((owned[-1] + np.searchsorted(pairs[:, 0], same, side="right")).tolist())
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.start, self.size, self.owner, self.owned = join(starts), join(sizes), join(owners), np.array(owned, np.int64)
        #: Shingle lengths in use: shorter windows are one shingle.
        self.lengths = sorted({min(shingle, int(n)) for n in set(self.size.tolist())})
        self.grams = {k: np.unique(np.concatenate([shingles(self.value, k)[at : at + n - k + 1] for at, n in self._of(k)] or [np.zeros(0, np.uint64)])) if k < shingle else np.unique(shingles(self.value, k)) for k in self.lengths}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _of(self, k: int) -> list[tuple[int, int]]:
        mine = np.flatnonzero(np.minimum(self.size, self.shingle) == k)
        return list(zip(self.start[mine].tolist(), self.size[mine].tolist()))

    def order_by(self, counts: dict[int, np.ndarray]) -> None:
        """Take each window's rarest shingle (ties: smaller hash, then first place) as its prefix."""
        for k in self.lengths:
            grams = shingles(self.value, k)
            known = self.grams[k]
            index = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            # A number for each shingle in the order of rarity, then hash: known is sorted.
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(counts[k], kind="stable")] = np.arange(len(known))
            rank = rank[index]
            chosen = []
            for n in set(self.size[np.minimum(self.size, self.shingle) == k].tolist()):
                w = np.flatnonzero(self.size == n)
                place = np.lib.stride_tricks.sliding_window_view(rank, n - k + 1)[self.start[w]].argmin(axis=1)
                chosen.append((grams[self.start[w] + place], w, place))
            gram, w, place = (np.concatenate([x[i] for x in chosen]) for i in range(3))
            order = np.lexsort((place, w, gram))
            self.prefix[k] = gram[order], w[order], place[order]

    def bytes_of(self, w: int) -> list[bytes]:
        a = int(self.start[w])
        return [self.raw[x:y] for x, y in zip(self.first[a : a + self.size[w]].tolist(), self.end[a : a + self.size[w]].tolist())]


def _documents(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(first row, end row, words, bounds of each row's words, bytes, the words' first and end bytes) of slices of a text column."""
    data, at = column_bytes(column)
    for lo, hi in slices(at):
        part = data[at[lo] : at[hi]]
        value, first, end, bounds = words(part, at[lo : hi + 1] - at[lo], ALNUM)
        yield lo, hi, value, bounds, part, first, end


def _within(known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``value`` that hold a known (sorted) hash, and its index."""
    if not len(known) or not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A table of 20 hashed bits lets nearly all others out before the binary search.
    there = np.zeros(1 << 20, bool)
    there[(known >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(there[(value >> np.uint64(44)).astype(np.int64)])
    index = np.minimum(np.searchsorted(known, value[at]), len(known) - 1)
    same = known[index] == value[at]
    return at[same], index[same]


def _corpus_counts(documents: DataFrame, text: str, block: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(block.grams)

    def count(batches):
        grams = shared.value
        seen = {k: np.zeros(len(g), np.int64) for k, g in grams.items()}
        for batch in batches:
            for _, _, value, *_ in _documents(batch.column(0)):
                for k, known in grams.items():
                    seen[k] += np.bincount(_within(known, shingles(value, k))[1], minlength=len(known))
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    counts = {k: np.zeros(len(g), np.int64) for k, g in block.grams.items()}
    # One row for each shingle of the block at most.
    for r in documents.select(text).mapInArrow(count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"]][r["at"]] = r["n"]
    return counts


def _blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    held, size = [], 0
    for r in items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t")).orderBy("i", "t").toLocalIterator():
        held.append((r["i"], bytes(r["t"])))
        size += len(held[-1][1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_passages(documents: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit``, ``hit_items`` and ``hit_spans``.

    n_words: words of the whole text (null: 0). n_hit: words inside any occurrence of a
    window. hit_items: distinct ids, as strings in order, of the items whose windows
    occur (a null id is "null"). hit_spans: the hit words as disjoint ranges of
    word positions. One row for each row, repeated and empty ones too; items without
    words match nothing, repeated items count once by their id; an empty benchmark hits
    nothing, an empty table gives no rows. Columns of these four names are replaced.
    """
    documents = documents.drop("n_words", "n_hit", "hit_items", "hit_spans")
    out, passes = None, 0
    for block in _blocks(items, item, item_text, block_bytes):
        windows = Windows(block, window, shingle)
        if not len(windows.size):
            continue
        windows.order_by(_corpus_counts(documents, text, windows))
        out = _mark(stored(out, "passages") if passes else documents, text, windows, bool(passes))
        passes += 1
    return out if passes else _mark(documents, text, Windows([], window, shingle), False)


def _mark(documents: DataFrame, text: str, block: Windows, again: bool) -> DataFrame:
    """One pass: adds what the block's windows hit (``again``: to what others have hit)."""
    shared = documents.sparkSession.sparkContext.broadcast(block)
    fields = [f for f in documents.schema.fields if f.name not in ("n_words", "n_hit", "hit_items", "hit_spans")]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", _SPANS)])
    names, at_text = schema.names, [f.name for f in fields].index(text)

    def run(batches):
        block = shared.value
        known_bytes: dict[int, list[bytes]] = {}
        for batch in batches:
            n_words, n_hit, hit_items, hit_spans = [], [], [], []
            for lo, hi, value, bounds, raw, begin, end in _documents(batch.column(at_text)):
                cover = np.zeros(len(value) + 1, np.int32)
                found: dict[int, set[str]] = {}
                for k, (known, window, place) in block.prefix.items():
                    at, _ = _within(known, grams := shingles(value, k))
                    first, last = np.searchsorted(known, grams[at]), np.searchsorted(known, grams[at], side="right")
                    n = last - first
                    at, entry = np.repeat(at, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    w = window[entry]
                    start, size = at - place[entry], block.size[w]
                    row = np.searchsorted(bounds, at, side="right") - 1
                    fits = (start >= bounds[row]) & (start + size <= bounds[row + 1])
                    w, start, size, row = w[fits], start[fits], size[fits], row[fits]
                    same = np.ones(len(w), bool)
                    for j in range(block.window):
                        same &= (j >= size) | (value[np.minimum(start + j, len(value) - 1)] == block.value[np.minimum(block.start[w] + j, len(block.value) - 1)])
                    for i in np.flatnonzero(same).tolist():  # equal hashes are no proof
                        x, y, a = int(start[i]), int(w[i]), int(size[i])
                        if y not in known_bytes:
                            known_bytes[y] = block.bytes_of(y)
                        same[i] = known_bytes[y] == [raw[p:q].tobytes().lower() for p, q in zip(begin[x : x + a].tolist(), end[x : x + a].tolist())]
                    w, start, size, row = w[same], start[same], size[same], row[same]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + size, -1)
                    for r, x in zip(row.tolist(), w.tolist()):
                        found.setdefault(r, set()).update(block.items[i] for i in block.owner[block.owned[x] : block.owned[x + 1]].tolist())
                hit = np.cumsum(cover[:-1]) > 0
                for r in range(hi - lo):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    own = hit[a:b]
                    items = found.get(r, set())
                    if again:
                        for s in batch.column(names.index("hit_spans"))[lo + r].as_py():
                            own[s["start"] : s["end"]] = True
                        items = items.union(batch.column(names.index("hit_items"))[lo + r].as_py())
                    n_words.append(b - a)
                    hit_items.append(sorted(items))
                    if items:
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist()
                        hit_spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])])
                        n_hit.append(int(own.sum()))
                    else:
                        hit_spans.append([])
                        n_hit.append(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hit_items, pa.list_(pa.string())), pa.array(hit_spans, _SPANS_ARROW)], names)

    return documents.mapInArrow(run, schema)


def is_contaminated(n_hit, n_words):
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
