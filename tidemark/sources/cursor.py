"""Pull cursors over a store: stable ones of one version, and read-committed ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import InvalidError, Status, StoreError
from ..functions.series import check_range
from ..operators import merge, scan
from .store import Snapshot, Store

#: Records that a read-committed cursor takes at a time.
CHUNK = 1024


class Cursor:
    """Walks one series (or several, merged) in pages, each a bounded top-k of the store.

    ``live``: each page is read from the newest commit, strictly after the last record
    handed out, so nothing repeats and the walk never goes back; a finished walk stays
    finished. Otherwise all pages are of the version at the start. A page only reads files
    that may hold what comes after the last key. ``status`` tells how the last call ended;
    a closed cursor (``close``, or the end of a ``with``) hands out nothing.
    """

    def __init__(self, store: Store, symbols: int | list[int], low: int = 0, high: int | None = None, reverse: bool = False, live: bool = False, chunk: int = CHUNK):
        self.merged = isinstance(symbols, list)
        if symbols is None:
            raise InvalidError("no symbols")
        if self.merged and reverse:
            raise InvalidError("a merged cursor only goes forward")
        self.store, self.symbols, self.low, self.high = store, symbols, low, store.most if high is None else high
        check_range(self.low, self.high)
        self.reverse, self.live, self.chunk = reverse, live, chunk
        self.at: Snapshot = store.snapshot()
        self.held: list[T.Row] = []
        self.last: tuple | None = None  # the last key handed out
        self.target: tuple | None = None  # where to begin after a seek
        self.done, self.closed, self.status = False, False, Status.OK

    def close(self) -> None:
        self.closed, self.held = True, []

    def __enter__(self) -> "Cursor":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _files(self) -> DataFrame:
        """Records from where the walk stands on: files by their key ranges."""
        low, high = self.low, self.high
        at = self.target or self.last
        if at is not None:
            low, high = (low, min(high, at[0])) if self.reverse else (max(low, at[0]), high)
        if low > high:
            return self.at.frame([])
        return self.at.frame(self.at.files_of(self.symbols if self.merged else [self.symbols], int(low), int(high)))

    def _fill(self) -> None:
        if self.done:
            return
        if self.live:
            self.at = self.store.snapshot()
        if self.merged:
            rows = merge.merge_page(self._files(), self.symbols, self.chunk, self.last, self.low, self.high) if self.symbols else self.at.frame([])
        elif self.target is not None:
            rows = scan.seek(self._files(), self.symbols, *self.target, self.low, self.high, self.reverse).limit(self.chunk)
        else:
            rows = scan.page(self._files(), self.symbols, self.chunk, self.last, self.low, self.high, self.reverse)
        self.held = rows.collect()  # at most one chunk
        self.done = not self.held

    def next(self) -> T.Row | None:
        if self.closed:
            self.status = Status.INVAL
            raise InvalidError("the cursor is closed")
        if not self.held:
            try:
                self._fill()
            except StoreError as e:
                self.status = e.status
                raise
        if not self.held:
            self.status = Status.NOT_FOUND
            return None
        self.status = Status.OK
        row = self.held.pop(0)
        self.target = None
        self.last = (row["time"], row["seq"], row["symbol"]) if self.merged else (row["time"], row["seq"])
        return row

    def next_batch(self, most: int) -> list[T.Row]:
        """Up to ``most`` records; fewer at the end of a chunk, none at the end of the walk."""
        out = []
        while len(out) < most and (not out or self.held) and (row := self.next()) is not None:
            out.append(row)
        return out

    def seek(self, time: int, seq: int = 0) -> None:
        """Go to the first key at or beyond a target, in the cursor's direction and within its bounds."""
        if self.merged:
            raise InvalidError("a merged cursor can't seek")
        self.held, self.last, self.target, self.done = [], None, (time, seq), False

    def __iter__(self) -> Iterator[T.Row]:
        while (row := self.next()) is not None:
            yield row
