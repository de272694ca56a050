"""The patterns that stored answers may use, and what text a match must hold.

Accepted is what Java's, RE2's and Python's expressions read alike on one line of text: literals, ``.``, classes of
characters and ranges, groups without a name, ``|``, the quantifiers ``* + ? {m,n}`` and their lazy forms, ``^ $ \\b \\d \\w \\s``
and escaped punctuation.  Not accepted are look-around, back references, flags, named groups, possessive quantifiers,
sets within sets and ``\\p``.
"""

from __future__ import annotations

import re

#: A place where anything may stand.
GAP = None
MOST_WAYS, MOST_TIMES = 16, 1000
#: What ``\s`` matches besides the blank.
WHITE = "\t\n\x0b\f\r"
_SETS, _PUNCTUATION = "dDwWsS", set("\\.()[]{}|*+?^$/-'\"&<>=!:,;#@%~_` ")
_TIMES = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


class Refused(ValueError):
    """The pattern is outside of what is accepted."""


class _Reader:
    """Ways to match, each a list of characters that follow one another and gaps."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def next(self) -> str:
        return self.text[self.at:self.at + 1]

    def ways(self, inner: bool) -> list[list]:
        out = self.row()
        while self.next() == "|":
            self.at += 1
            out = out + self.row()
        if (self.next() == ")") != inner:
            raise Refused("brackets")
        return out

    def row(self) -> list[list]:
        out: list[list] = [[]]
        while (c := self.next()) and c not in "|)":
            self.at += 1
            width, ways = self.atom(c)
            ways = self.repeated(width, ways)
            joined = [a + b for a in out for b in ways]
            out = joined if len(joined) <= MOST_WAYS else [a + [GAP] for a in out]
        return out

    def atom(self, c: str) -> tuple[bool, list[list]]:
        """Whether it takes up room, and its ways."""
        if c in "^$":
            return False, [[]]
        if c == ".":
            return True, [[GAP]]
        if c == "[":
            self.set_of()
            return True, [[GAP]]
        if c == "(":
            if self.next() == "?":
                if self.text[self.at:self.at + 2] != "?:":
                    raise Refused("group")
                self.at += 2
            ways = self.ways(True)
            self.at += 1
            return True, ways if len(ways) <= MOST_WAYS else [[GAP]]
        if c == "\\":
            return self.escaped()
        if c in "*+?{}]" or ord(c) < 32:
            raise Refused(c)
        return True, [[c]]

    def escaped(self) -> tuple[bool, list[list]]:
        c = self.next()
        self.at += 1
        if c == "b":
            return False, [[]]
        if c == "s":
            return True, [[" "]]
        if c and c in _SETS:
            return True, [[GAP]]
        if c not in _PUNCTUATION:
            raise Refused("escape")
        return True, [[c]]

    def set_of(self) -> None:
        self.at += self.next() == "^"
        items = 0
        while (c := self.next()) != "]":
            ends = []
            for _ in range(2):
                c = self.next()
                self.at += 1
                if c == "\\":
                    c = self.next()
                    self.at += 1
                    if not c or c not in _PUNCTUATION and c not in _SETS:
                        raise Refused("set")
                    c = "" if c in _SETS else c
                elif not c or c in "[]&~-^|" or ord(c) < 32:
                    raise Refused("set")
                ends.append(c)
                if len(ends) == 2 or self.next() != "-":
                    break
                self.at += 1
            if len(ends) == 2 and not (ends[0] and ends[1] and ends[0] <= ends[1]):
                raise Refused("range")
            items += 1
        if not items:
            raise Refused("empty set")
        self.at += 1

    def repeated(self, width: bool, ways: list[list]) -> list[list]:
        c = self.next()
        times = _TIMES.match(self.text, self.at)
        if not c or c not in "*+?{":
            return ways
        if not width or c == "{" and not times:
            raise Refused("quantifier")
        least = {"*": 0, "+": 1, "?": 0}.get(c)
        if times:
            least, most = int(times[1]), int(times[3] or times[1])
            if max(least, most) > MOST_TIMES or most < least:
                raise Refused("quantifier")
        self.at += len(times[0]) if times else 1
        self.at += self.next() == "?"
        if self.next() and self.next() in "*+?{":
            raise Refused("quantifier")
        return [w + [GAP] for w in ways] if least else [[GAP]]


def needs(pattern: str | None, size: int = 3) -> list[list[str]] | None:
    """Per way to match, pieces of at most ``size`` characters that a match holds all of; None where it is refused.

    A blank in a piece stands for any white space (``WHITE``).
    """
    try:
        if pattern is None:
            raise Refused("null")
        ways = _Reader(pattern).ways(False)
        re.compile(pattern)
    except (Refused, re.error, RecursionError, OverflowError):
        return None
    out = []
    for way in ways:
        runs, run = [], ""
        for c in [*way, GAP]:
            if c is GAP:
                runs.append(run)
                run = ""
            else:
                run += c
        # Shorter runs in their own length; a single character is in many keys and of no use beside longer ones.
        least = min(2, max(map(len, runs)))
        cut = [(r, min(size, len(r))) for r in runs if len(r) >= least]
        out.append(sorted({r[i:i + n] for r, n in cut for i in range(len(r) - n + 1)}))
    return out
