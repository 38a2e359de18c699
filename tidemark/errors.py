"""Outcomes other than success, as exceptions; ``Status`` has their numbers."""

from __future__ import annotations

import threading
from enum import IntEnum


class Status(IntEnum):
    OK = 0
    NOT_FOUND = -1
    ERROR = -2
    FULL = -3
    CORRUPT = -4
    INVAL = -5


#: What each status means.
MEANINGS = {Status.OK: "success", Status.NOT_FOUND: "not found", Status.ERROR: "input or output failed, or reading only", Status.FULL: "no room", Status.CORRUPT: "damaged", Status.INVAL: "invalid argument"}
_last = threading.local()


def strerror(status: int) -> str:
    return MEANINGS[Status(status)] if status in set(Status) else f"unknown status {status}"


def last_error() -> str:
    """The message of the last error of this thread; empty if there was none."""
    return getattr(_last, "message", "")


class StoreError(Exception):
    """Input or output failed, or the store is open for reading only."""

    status = Status.ERROR

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details
        _last.message = message


class NotFound(StoreError):
    status = Status.NOT_FOUND


class CapacityError(StoreError):
    status = Status.FULL


class CorruptError(StoreError):
    status = Status.CORRUPT


class InvalidError(StoreError, ValueError):
    status = Status.INVAL
