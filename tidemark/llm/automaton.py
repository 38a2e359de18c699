"""Regular expressions compiled to one deterministic automaton over bytes.

Supported: literals, ``.``, classes, ``( )``, ``|``, ``? * + {m} {m,} {m,n}``, ``\\xHH``
and ``\\d \\w \\s`` (ASCII). Subset construction makes one automaton for all rules,
Hopcroft-style refinement its smallest form, whose transitions are arrays indexed by
byte class.
"""

from __future__ import annotations


EVERY = frozenset(range(256)) - {0x0A}
_NAMED = {"d": frozenset(range(0x30, 0x3A)), "s": frozenset(b" \t\n\r\f\v"), "w": frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | {0x5F}, "n": frozenset(b"\n"), "r": frozenset(b"\r"), "t": frozenset(b"\t")}


class _Parser:
    """Recursive descent into a tree of tuples."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def parse(self):
        tree = self.union()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} in {self.p!r}")
        return tree

    def union(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("and", parts)

    def repeat(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                lo, hi = int(low), (int(high) if high else None) if comma else int(low)
            else:
                lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("repeat", tree, lo, hi)
        return tree

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.union()
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", EVERY)
        if c == "\\":
            return ("set", self.folded(self.escape()))
        return ("and", [("set", self.folded(frozenset({b}))) for b in c.encode()])

    def escape(self) -> frozenset:
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset({int(self.p[self.i - 2 : self.i], 16)})
        return _NAMED.get(c) or frozenset(c.encode())

    def members(self) -> frozenset:
        negated = self.peek() == "^"
        self.i += negated
        out: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            if self.peek() == "\\":
                self.i += 1
                low = self.escape()
            else:
                low = frozenset({ord(self.peek())})
                self.i += 1
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]" and len(low) == 1:
                self.i += 1
                if self.peek() == "\\":
                    self.i += 1
                    high = self.escape()
                else:
                    high = frozenset({ord(self.peek())})
                    self.i += 1
                out.update(range(min(low), max(high) + 1))
            else:
                out |= low
        self.i += 1
        return frozenset(range(256)) - self.folded(frozenset(out)) if negated else self.folded(frozenset(out))

    def folded(self, members: frozenset) -> frozenset:
        return members | {b ^ 0x20 for b in members if chr(b & ~0x20) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and b < 128} if self.fold else members


class Automaton:
    """Smallest automaton of ``rules`` (pattern, letters match in either case).

    ``search``: a match may begin at any byte. ``backward``: of the reversed matches, to
    be fed from a text's end; where one ends, a match begins. ``table[state][class]`` is the next
    state, ``classes`` maps bytes to classes, ``accepts[state]`` the set of rules of
    which a match ends here. State 0 is the start; ``accepting`` is the first of the
    accepting states, which come last. ``dead`` is the state from which nothing can be
    accepted (-1: none).
    """

    def __init__(self, rules: list[tuple[str, bool]], search: bool, backward: bool = False):
        edges: list[list[tuple[frozenset, int]]] = []
        empties: list[list[int]] = []
        final: dict[int, int] = {}

        def state() -> int:
            edges.append([])
            empties.append([])
            return len(edges) - 1

        def build(tree, a: int) -> int:
            """Adds the tree from state a on and returns its end."""
            kind = tree[0]
            if kind == "set":
                b = state()
                edges[a].append((tree[1], b))
                return b
            if kind == "and":
                for x in reversed(tree[1]) if backward else tree[1]:
                    a = build(x, a)
                return a
            if kind == "or":
                end = state()
                for x in tree[1]:
                    begin = state()
                    empties[a].append(begin)
                    empties[build(x, begin)].append(end)
                return end
            _, x, lo, hi = tree
            for _ in range(lo):
                a = build(x, a)
            if hi is None:
                loop = state()
                empties[a].append(loop)
                empties[build(x, loop)].append(loop)
                return loop
            end = state()
            empties[a].append(end)
            for _ in range(hi - lo):
                a = build(x, a)
                empties[a].append(end)
            return end

        start = state()
        for rule, (pattern, fold) in enumerate(rules):
            begin = state()
            empties[start].append(begin)
            final[build(_Parser(pattern, fold).parse(), begin)] = rule
        # Bytes that all sets treat alike form a class.
        sets = sorted({s for out in edges for s, _ in out}, key=sorted)
        marks = [tuple(b in s for s in sets) for b in range(256)]
        numbers = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        self.classes = bytes(numbers[m] for m in marks)
        sample = [self.classes.index(i) for i in range(len(numbers))]

        def closure(states) -> frozenset:
            out, todo = set(states), list(states)
            while todo:
                for x in empties[todo.pop()]:
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            return frozenset(out)

        begin = closure({start})
        known, table, todo = {begin: 0}, [], [begin]
        for now in todo:
            row = []
            for byte in sample:
                to = closure({t for s in now for members, t in edges[s] if byte in members} | ({start} if search else set()))
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append(known[to])
            table.append(row)
        accepts = [frozenset(final[s] for s in now if s in final) for now in known]
        self._minimise(table, accepts)

    def _minimise(self, table: list[list[int]], accepts: list[frozenset]) -> None:
        kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
        block = [kinds[a] for a in accepts]
        while True:
            signs: dict[tuple, int] = {}
            new = [signs.setdefault((block[s], *(block[t] for t in row)), len(signs)) for s, row in enumerate(table)]
            if len(signs) == len(set(block)):
                break
            block = new
        one = {b: s for s, b in reversed(list(enumerate(block)))}
        order = sorted(one, key=lambda b: (bool(accepts[one[b]]), b != block[0], one[b]))
        number = {b: i for i, b in enumerate(order)}
        if number[block[0]]:
            raise ValueError("a rule matches the empty string")
        self.table = [tuple(number[block[t]] for t in table[one[b]]) for b in order]
        self.accepts = [accepts[one[b]] for b in order]
        self.accepting = next((i for i, a in enumerate(self.accepts) if a), len(order))
        self.dead = next((i for i, row in enumerate(self.table) if not self.accepts[i] and set(row) == {i}), -1)

    def __len__(self) -> int:
        return len(self.table)

    def resets(self) -> set[int]:
        """Bytes after which the automaton is at its start from any state."""
        columns = [i for i in range(len(self.table[0])) if all(row[i] == 0 for row in self.table)]
        return {b for b in range(256) if self.classes[b] in columns}

    def longest(self, data: bytes, at: int, most: int | None = None) -> int:
        """End of the longest match (of ``most`` bytes at most) that begins at ``at`` (of classes, not of bytes), or -1."""
        table, accepting, dead, s, end = self.table, self.accepting, self.dead, 0, -1
        for i in range(at, len(data) if most is None else min(len(data), at + most)):
            s = table[s][data[i]]
            if s >= accepting:
                end = i + 1
            elif s == dead:
                break
        return end
