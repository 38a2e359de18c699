"""Secrets in texts by one deterministic automaton for all rules.

The rules' expressions, reversed, are compiled to one smallest automaton. It goes over the
bytes of a line once, from the end, and marks for all rules at once where a match begins
(forwards the same expressions need 16,000 states, backwards 421). From the leftmost begin
a rule's match is followed to its longest end; begins that lead nowhere are never
followed, so the time is linear in the line. Lines can be looked at one by one because a
line feed puts the automaton back to its start, which is checked when it is compiled.

Counted runs side by side would multiply the automaton's states. An expression therefore
has plain runs (``+``); their lengths are checked on the match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton
from .common import texts


@dataclass(frozen=True)
class Rule:
    """An expression, and the lengths that a match must have.

    ``least``: bytes of the value at least. ``parts``: bytes at least of the match's parts
    between dots. ``most``: bytes at most; a longer match ends there. After a match that is
    too short the search goes on behind it, with ``again`` at the next byte that may begin
    a match with other lengths. ``runs`` is the expression for the automaton, where it
    differs: counted runs are plain ones there.
    """

    kind: str
    pattern: str
    fold: bool = False
    least: int = 0
    head: str = ""  # what stands before the value; empty: the whole match is the value
    parts: tuple[int, ...] = ()
    most: int | None = None
    again: bool = False
    runs: str = ""


_KEYWORD = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
#: What stands before the value of an assignment.
ASSIGN_HEAD = _KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?"
BASE_RULES = (
    Rule("assign", ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", least=6, head=ASSIGN_HEAD),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]+", least=24, runs="[0-9a-f]{24,}"),  # of runs only the long ones: the one count in the automaton
)
#: Spans that this method adds to the base ones.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}", least=40, again=True, runs="gh[opsur]_[A-Za-z0-9]+"),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}", least=15, again=True, runs="xox[abeprs]-[A-Za-z0-9-]+"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}", least=39, most=39, again=True, runs="AIza[A-Za-z0-9_-]+"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", parts=(11, 11, 8), again=True, runs="eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]{16,}", least=24, again=True, runs="[rs]k_(live|test)_[A-Za-z0-9]+"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([(r.runs or r.pattern, r.fold) for r in rules], search=True, backward=True)
        # The same table with rows that hold rows, and nothing after an accepting state.
        self.rows: list[list] = [[] for _ in self.all.table]
        for row, out in zip(self.rows, self.all.table[: self.all.accepting]):
            row.extend(self.rows[t] for t in out)
        if 0x0A not in self.all.resets():
            raise ValueError("a rule's match may span a line feed")
        self.each = [Automaton([(r.runs or r.pattern, r.fold)], search=False) for r in rules]
        self.heads = [Automaton([(r.head, r.fold)], search=False) if r.head else None for r in rules]

    def matches(self, line: bytes) -> bool:
        """Whether any rule matches in a reversed line (of classes): one array access for a byte."""
        row = self.rows[0]
        try:
            for c in line:
                row = row[c]
        except IndexError:  # an accepting row is empty
            return True
        return not row

    def lines(self, text: bytes) -> list[tuple[int, int]]:
        """(begin, end) of the lines with a match."""
        out, at, classes = [], 0, self.all.classes
        for line in text.split(b"\n"):
            if self.matches(line.translate(classes)[::-1]):
                out.append((at, at + len(line)))
            at += len(line) + 1
        return out

    def begins(self, line: bytes) -> dict[int, list[int]]:
        """Of each rule the rising places in a line where a match begins."""
        table, accepting, accepts, s = self.all.table, self.all.accepting, self.all.accepts, 0
        out: dict[int, list[int]] = {}
        data = line.translate(self.all.classes)
        for i in range(len(data) - 1, -1, -1):
            s = table[s][data[i]]
            if s >= accepting:
                for r in accepts[s]:
                    out.setdefault(r, []).append(i)
        return {r: places[::-1] for r, places in out.items()}

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, rule) in bytes, by begin, then rule; leftmost first and not overlapping within a rule."""
        out = []
        for lo, hi in self.lines(text):
            line = text[lo:hi]
            for r, places in self.begins(line).items():
                rule, own = self.rules[r], self.each[r]
                data, at = line.translate(own.classes), 0
                for i in places:
                    if i < at:
                        continue
                    end = own.longest(data, i, rule.most)
                    short = self.short(r, line, i, end)
                    if short < 0:
                        out.append((lo + i, lo + end, r))
                    at = end if short < 0 or not rule.again else max(short, i + 1)
        out.sort(key=lambda x: (x[0], x[2]))
        return out

    def short(self, r: int, line: bytes, at: int, end: int) -> int:
        """-1 for a match with the rule's lengths, else where what is too short begins: no begin before it has other lengths, if it isn't the match's own."""
        rule = self.rules[r]
        if self.value_length(r, line, at, end) < rule.least:
            return at
        for part, least in zip(line[at:end].split(b"."), rule.parts):
            if len(part) < least:
                return at
            at += len(part) + 1
        return -1

    def value_length(self, r: int, line: bytes, at: int, end: int) -> int:
        if self.heads[r] is None:
            return end - at
        head = self.heads[r]
        # The head ends before the value at the latest place from which only value bytes follow; '=' may be in both.
        data, s, first = line[at:end].translate(head.classes), 0, -1
        for i, c in enumerate(data):
            s = head.table[s][c]
            if s == head.dead:
                break
            if s >= head.accepting:
                first = i + 1
        return end - at - first


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def code_points(text: bytes, at: list[int]) -> list[int]:
    """Code points before each of some rising byte places."""
    if text.isascii():
        return at
    out, last, n = [], 0, 0
    for x in at:
        n += len(text[last:x].decode("utf-8", "replace"))
        out.append(n)
        last = x
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, redact: str | None = None) -> DataFrame:
    """``documents`` with ``secret_spans``: kind, start and end (exclusive) in code points of the whole text.

    By start, then in the order of ``rules``. A null text has none. With ``redact`` the
    text's secret parts (spans that overlap as one; a private key to its end) are replaced by it. Rows are
    independent: no exchange. A column named secret_spans is replaced.
    """
    documents = documents.drop("secret_spans")
    schema = T.StructType([*documents.schema.fields, T.StructField("secret_spans", _SPANS)])
    at_text = documents.columns.index(text)

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            spans, changed = [], {}
            for row, x in enumerate(texts(batch.column(at_text))):
                found = scan.spans(x)
                if not found:
                    spans.append([])
                    continue
                places = sorted({p for a, b, _ in found for p in (a, b)})
                point = dict(zip(places, code_points(x, places)))
                spans.append([{"kind": rules[r].kind, "start": point[a], "end": point[b]} for a, b, r in found])
                if redact is not None:
                    changed[row] = redacted(x, [(a, b) for a, b, _ in found], redact)
            columns = list(batch.columns)
            if changed:
                old = columns[at_text].to_pylist()
                columns[at_text] = pa.array([changed.get(i, t) for i, t in enumerate(old)], columns[at_text].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPANS_ARROW)], schema.names)

    return documents.mapInArrow(run, schema)


#: A private key from its header (the span of the pem rule) to its end line, before any other header; without one, to the end of the base64 block.
_KEY_HEADER = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----\Z")
_NEXT_HEADER = re.compile(rb"-----BEGIN ")
_KEY_END = re.compile(rb"-----END [A-Z ]*PRIVATE KEY-----")
_KEY_LINES = re.compile(rb"(?:[ \t>]*+(?:[A-Z][A-Za-z-]*+: [^\r\n]*+)?\r?\n)*+[ \t>]*+[A-Za-z0-9+/]{16,}+={0,2}+(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/]{16,}+={0,2}+(?=[ \t]*+(?:\r?\n|\Z)))*+(?:[ \t]*+\r?\n[ \t>]*+[A-Za-z0-9+/]{1,15}+={0,2}+(?=[ \t]*+(?:\r?\n|\Z)))?+")


def key_end(text: bytes, a: int, b: int) -> int:
    """Where the private key ends whose header is text[a:b]; b for other spans."""
    if not _KEY_HEADER.match(text, a, b):
        return b
    other = _NEXT_HEADER.search(text, b)
    end = _KEY_END.search(text, b, other.start() if other else len(text)) or _KEY_LINES.match(text, b)
    return end.end() if end else b


def redacted(text: bytes, spans: list[tuple[int, int]], put: str) -> str:
    """``text`` with ``put`` for its spans; that of a private key's header goes on to the key's end."""
    out, last = [], 0
    for a, b in sorted(spans):
        b = key_end(text, a, b)
        if a >= last:
            out += [text[last:a], put.encode()]
        last = max(last, b)
    return b"".join([*out, text[last:]]).decode("utf-8", "replace")


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans (of ``kinds`` only), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
