"""Conversations as training windows of a token budget.

Prefix sums of the turns' tokens choose spans that begin and end with whole turns.
Each window begins with the conversation's system turn, then repeats some of the last
turns before its span as history; only what a window adds is a target, so that each
assistant text is under the loss mask once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles one backslash
is put between ``<`` (with any backslashes after it) and ``|``, so that no control
string can come from a text; taking one out again restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """As ``escape``; a role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window, as they were."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


def count_bytes(text: str) -> int:
    """Tokens, taken as four bytes each."""
    return -(-len(text.encode()) // 4)


def token_counter(path: str | None) -> Callable[[str], int]:
    """Tokens by a public tokenizer file of the ``tokenizers`` library; None: ``count_bytes``."""
    if path is None:
        return count_bytes
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


class Windows:
    """Windows of one conversation whose turns are fed one by one; holds two windows' turns at most."""

    def __init__(self, count: Callable[[str], int], budget: int, history_turns: int, history_tokens: int):
        self.count, self.budget, self.history_turns, self.history_tokens = count, budget, history_turns, history_tokens
        self.system: tuple | None = None
        self.repeat: list[tuple] = []  # turns that begin the window, seen before
        self.new: list[tuple] = []
        self.sum = 0  # tokens of both
        self.turns = self.number = 0

    def feed(self, role: str, text: str) -> dict | None:
        """Takes a turn; gives a window if the turn doesn't fit into it any more."""
        shown = f"{START}{escape_role(role)}\n{escape(text)}{END}\n"
        turn = (role, shown, self.count(shown))
        out = None
        if self.new and self.sum + turn[2] > self.budget:
            out = self.window()
            past = [t for t in [*self.repeat, *self.new] if t is not self.system]
            self.repeat, room = [], min(self.history_tokens, self.budget - turn[2] - (self.system[2] if self.system else 0))
            for t in reversed(past[-self.history_turns :] if self.history_turns else []):
                room -= t[2]
                if room < 0:
                    break
                self.repeat.insert(0, t)
            if self.system:
                self.repeat.insert(0, self.system)
            self.new, self.sum = [], sum(t[2] for t in self.repeat)
        if self.turns == 0 and role == "system":
            self.system = turn
        self.turns += 1
        self.new.append(turn)
        self.sum += turn[2]
        return out

    def window(self) -> dict | None:
        """The window so far: its text, how many turns at its begin are repeated, and the spans under the loss mask."""
        if not self.new:
            return None
        parts, spans, at = [], [], 0
        for i, (role, shown, _) in enumerate([*self.repeat, *self.new]):
            if role == "assistant" and i >= len(self.repeat):
                spans.append({"start": at + shown.index("\n") + 1, "end": at + len(shown) - len(END) - 1})
            parts.append(shown)
            at += len(shown)
        self.number += 1
        return {"window": self.number - 1, "formatted": "".join(parts), "repeated": len(self.repeat), "tokens": self.sum, "loss_spans": spans}


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _ordered(batches) -> Iterator[tuple]:
    """Rows of the batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows; ends one once its strings reach ``most`` characters, then yields."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str)) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 2048, history_turns: int = 2, history_tokens: int = 512, tokenizer: str | None = None) -> DataFrame:
    """Windows: ``conversation``, window, formatted, repeated, tokens, loss_spans (code points of formatted).

    Rows are taken by turn, ties by role, then text; null texts and roles are empty, rows
    without a conversation are one conversation, a table without rows has no windows. A
    turn longer than the budget has a window of its own (beside the system turn): no
    text is cut. One exchange by conversation; a conversation is streamed, so that one
    which holds a third of all rows needs no more memory than others.
    """
    fields = [turns.schema[conversation]]
    schema = T.StructType([T.StructField(conversation, fields[0].dataType), T.StructField("window", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("repeated", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("loss_spans", _SPANS)])
    rows = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def windows(batches):
        count = token_counter(tokenizer)
        now, state = object(), None
        fields = ("window", "formatted", "repeated", "tokens", "loss_spans")
        for c, r, x in _ordered(batches):
            if c != now or state is None:
                if state and (w := state.window()):
                    yield now, *(w[f] for f in fields)
                now, state = c, Windows(count, budget, history_turns, history_tokens)
            if w := state.feed(r, x):
                yield now, *(w[f] for f in fields)
        if state and (w := state.window()):
            yield now, *(w[f] for f in fields)

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = pa.schema([(conversation, first.schema.field(0).type), ("window", pa.int64()), ("formatted", pa.string()), ("repeated", pa.int32()), ("tokens", pa.int64()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        yield from _emit(windows(iter_with(first, batches)), kinds)

    return rows.mapInArrow(run, schema)


def iter_with(first, rest):
    yield first
    yield from rest


def conversation_digests(windows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the windows of each conversation hold, read back from their formatted text.

    ``windows`` as ``format_conversations`` gives them: the windows of a conversation
    stand together and in order, so they are streamed without another exchange.
    """
    schema = T.StructType([windows.schema[conversation], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_windows", T.LongType())])

    def rows(batches):
        now, state = object(), None
        for c, formatted, repeated, spans in _ordered(batches):
            if c != now or state is None:
                if state:
                    yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]
                now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse(formatted)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for s in spans:
                text = unescape(formatted[s["start"] : s["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += 1
        if state:
            yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = pa.schema([(conversation, first.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        yield from _emit(rows(iter_with(first, batches)), kinds)

    return windows.select(conversation, "formatted", "repeated", "loss_spans").mapInArrow(run, schema)
