"""Whether a pattern can take exponential time: an automaton of its characters, and that automaton's product with itself.

A backtracking engine runs away where one text can be read in two ways between two visits of the same place.  The pattern is
parsed into places (its character classes) and, for each place, the places that may follow; every way in which one may follow the other counts.  Within
a loop the product of the places with themselves is searched for a path that leaves the diagonal and comes back, on
characters that both places take.  A loop whose body may be empty is refused at once.

A counted repetition is written out up to UNROLLED turns and taken for a loop beyond, since its turns multiply in the same way.  What stands in an atomic group or a possessive
repetition is never read again, so its own loop is left out.  Look-around, anchors and references are taken to hold
anywhere.  So a pattern that passes never takes exponential time by its loops, and few that are refused would not.
"""

from __future__ import annotations

import re._compiler as compiler
import re._constants as C
import re._parser as parser
from collections import defaultdict

#: Characters by which classes are held against each other: ASCII and one of each wider kind.
_SAMPLE = [chr(c) for c in range(128)] + list("éßÀ中д٣  ſK€😀")


#: Turns of a counted repetition that are written out.
UNROLLED = 10


def _apart(pattern: str) -> str:
    """The pattern with an empty look-ahead on both sides of each bar, so that the parser neither merges alternatives nor takes out what they begin with."""
    out, i, start = [], 0, None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if start is None and c == "[":
            start = i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1
        elif start is not None and c == "]" and i > start:
            start = None
        out.append("(?=)|(?=)" if c == "|" and start is None else c)
        i += 1
    return "".join(out)


class _Part:
    """First and last places of a part of the pattern, and whether it may be empty."""

    def __init__(self, first=(), last=(), empty=True) -> None:
        self.first, self.last, self.empty = list(first), list(last), empty


class _Automaton:
    def __init__(self, pattern: str) -> None:
        self.takes: list[frozenset[str]] = []
        self.follow: dict[int, list[int]] = defaultdict(list)
        self.hollow = False  # a loop whose body may be empty
        tree = parser.parse(_apart(pattern))
        self.build(tree, tree.state.flags)

    def place(self, item, flags: int) -> _Part:
        """One character: which of the samples it takes, as the engine itself says."""
        one = parser.SubPattern(parser.State(), [item])
        takes = _compiled(one, flags).fullmatch
        self.takes.append(frozenset(c for c in _SAMPLE if takes(c)))
        n = len(self.takes) - 1
        return _Part([n], [n], False)

    def link(self, last, first) -> None:
        for p in last:
            self.follow[p] += first

    def sequence(self, parts: list[_Part]) -> _Part:
        out = _Part()
        for part in parts:
            self.link(out.last, part.first)
            out = _Part(out.first + part.first if out.empty else out.first, part.last + out.last if part.empty else part.last, out.empty and part.empty)
        return out

    def loop(self, part: _Part) -> None:
        self.hollow |= part.empty
        self.link(part.last, part.first)

    def build(self, items, flags: int, cut: bool = False) -> _Part:
        parts = []
        for op, value in items:
            if op is C.SUBPATTERN:
                _, add, drop, body = value
                parts.append(self.build(body, (flags | add) & ~drop))
            elif op is C.ATOMIC_GROUP:
                parts.append(self.build(value, flags, True))
            elif op is C.BRANCH:
                ways = [self.build(w, flags, cut) for w in value[1]]
                parts.append(_Part([x for w in ways for x in w.first], [x for w in ways for x in w.last], any(w.empty for w in ways)))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, body = value
                own = op is C.POSSESSIVE_REPEAT or cut
                if 1 < high <= UNROLLED and not own:
                    turns = [self.build(body, flags) for _ in range(high)]
                    parts += [_Part(t.first, t.last, t.empty or i >= low) for i, t in enumerate(turns)]
                    continue
                part = self.build(body, flags, own)
                if high > 1 and not own:
                    self.loop(part)
                parts.append(_Part(part.first, part.last, part.empty or low == 0))
            elif op in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
                parts.append(self.place((op, value), flags))
            elif op is C.GROUPREF_EXISTS:
                ways = [self.build(w or [], flags, cut) for w in value[1:]]
                parts.append(_Part([x for w in ways for x in w.first], [x for w in ways for x in w.last], any(w.empty for w in ways)))
            else:  # anchors, look-around and references hold anywhere
                parts.append(_Part())
        return self.sequence(parts)

    def loops(self) -> list[set[int]]:
        """Strongly connected places with a way back to themselves."""
        def reach(start: int, edges: dict[int, set[int]]) -> set[int]:
            seen, stack = set(), [start]
            while stack:
                for q in edges[stack.pop()]:
                    if q not in seen:
                        seen.add(q)
                        stack.append(q)
            return seen

        ahead, back = defaultdict(set), defaultdict(set)
        for p, qs in self.follow.items():
            for q in qs:
                ahead[p].add(q)
                back[q].add(p)
        out, done = [], set()
        for p in range(len(self.takes)):
            if p not in done:
                group = reach(p, ahead) & reach(p, back)
                if p in group:
                    out.append(group)
                    done |= group
        return out


def _compiled(tree, flags: int):
    """The engine's own reading of a single character class."""
    tree.state.flags = flags
    code = compiler._code(tree, flags)
    return compiler._sre.compile("", flags, code, 0, {}, ())


def ambiguous(pattern: str) -> str | None:
    """Why the pattern may take exponential time, or None."""
    machine = _Automaton(pattern)
    if machine.hollow:
        return "a repeated part may be empty"
    for group in machine.loops():
        ahead: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        back: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        inside = {p: [q for q in machine.follow[p] if q in group] for p in group}
        for p, qs in inside.items():
            if len(qs) != len(set(qs)):
                return "a repeated part can be read in two ways"

        # from each place twice: can the two readings part and meet again?
        start = [(p, p) for p in group]
        seen, stack = set(start), list(start)
        while stack:
            a, b = stack.pop()
            for x in inside[a]:
                for y in inside[b]:
                    if machine.takes[x] & machine.takes[y]:
                        ahead[a, b].add((x, y))
                        back[x, y].add((a, b))
                        if (x, y) not in seen:
                            seen.add((x, y))
                            stack.append((x, y))
        # pairs off the diagonal from which the diagonal is reached again
        home, stack = set(start), list(start)
        while stack:
            for pair in back[stack.pop()]:
                if pair not in home:
                    home.add(pair)
                    stack.append(pair)
        if any(a != b for a, b in home & seen):
            return "a repeated part can be read in two ways"
    return None
