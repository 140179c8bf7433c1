"""Anchors of a pattern: lower-case literals of which every match holds at least one, worked out from its syntax tree.

A node of the tree has the set of all strings it can match, where that set is small and made of plain characters (``exact``), and a set of
literals one of which is in each of its matches (``some``). Sequences multiply the former and choose the best of the latter; branches unite both. A
literal serves if it has no white space and no letter beyond ASCII, so that it is found whatever the case and spacing of the text: :mod:`anchors`
looks at texts in lower case with white space shrunk, and marks texts that hold one of the few letters that fold into ASCII.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre, _parser as parser

#: Strings that a node may stand for, and literals that a pattern may have.
MOST_EXACT, MOST_ANCHORS = 32, 64
#: Characters that an anchor must have.
LEAST = 3


@dataclass
class Known:
    """``exact``: all strings that a node can match, in lower case, or None. ``some``: literals of which each match holds one, or None."""

    exact: frozenset[str] | None = None
    some: frozenset[str] | None = None


NOTHING = Known(frozenset([""]))
ANYTHING = Known()


def _usable(text: str) -> list[str]:
    """The parts of a string that a text in lower case, with white space shrunk, holds wherever it holds the string."""
    return re.findall(r"[!-~]+", text)


def _literals(known: Known) -> frozenset[str] | None:
    """The literals of a node: those it is known to have, or the longest parts of the strings it can match; the better of both."""
    out = [known.some] if known.some else []
    if known.exact is not None:
        parts = [max(_usable(text), key=len, default="") for text in known.exact]
        if parts and all(parts):
            out.append(frozenset(parts))
    return _best(out)


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest literal is longest; of equals, the smallest set."""
    return max((s for s in sets if s and len(s) <= MOST_ANCHORS), key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)


def _lower(char: int) -> str | None:
    """A character as it stands in a lower-case text; None if that depends on its neighbours or is more than one character."""
    return chr(char).lower() if char < 128 else None


def _class(items: list) -> Known:
    chars: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found = [value]
        elif kind is sre.RANGE and value[1] - value[0] < MOST_EXACT:
            found = list(range(value[0], value[1] + 1))
        else:  # categories, long ranges, negation
            return ANYTHING
        for char in found:
            if (low := _lower(char)) is None:
                return ANYTHING
            chars.add(low)
    return Known(frozenset(chars)) if len(chars) <= MOST_EXACT else ANYTHING


def _sequence(parts: list[Known]) -> Known:
    sets: list[frozenset[str]] = []
    whole, exact = True, frozenset([""])

    def close() -> None:
        if found := _literals(Known(exact)):
            sets.append(found)

    for part in parts:
        if part.some:
            sets.append(part.some)
        if part.exact is None:
            close()
            whole, exact = False, frozenset([""])
            continue
        product = frozenset(a + b for a in exact for b in part.exact) if len(exact) * len(part.exact) <= MOST_EXACT else None
        if product is None:
            close()
            whole, product = False, part.exact
        exact = product
    close()
    return Known(exact if whole else None, _best(sets))


def _repeat(low: int, high, inner: Known) -> Known:
    if low == 0:
        optional = inner.exact is not None and high == 1 and len(inner.exact) < MOST_EXACT
        return Known(inner.exact | {""}) if optional else ANYTHING
    if high == low and inner.exact is not None and len(inner.exact) ** min(low, 9) <= MOST_EXACT and low * max(map(len, inner.exact), default=0) <= 64:
        return _sequence([inner] * low)
    ahead = _sequence([inner] * min(low, 4))
    return Known(None, _literals(ahead))


def _branches(options: list[Known]) -> Known:
    exact = frozenset().union(*[o.exact for o in options]) if all(o.exact is not None for o in options) else None
    found = [_literals(o) for o in options]
    some = frozenset().union(*found) if all(found) else None
    return Known(exact if exact is not None and len(exact) <= MOST_EXACT else None, some if some and len(some) <= MOST_ANCHORS else None)


def _node(kind, value) -> Known:
    if kind is sre.LITERAL:
        low = _lower(value)
        return Known(frozenset([low])) if low is not None else ANYTHING
    if kind is sre.IN:
        return _class(value)
    if kind is sre.BRANCH:
        return _branches([_tree(option) for option in value[1]])
    if kind is sre.SUBPATTERN:
        return _tree(value[3])
    if kind is sre.ATOMIC_GROUP:
        return _tree(value)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        return _repeat(value[0], value[1], _tree(value[2]))
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return NOTHING
    return ANYTHING  # any character, negated ones, back references, conditions


def _tree(items) -> Known:
    return _sequence([_node(kind, value) for kind, value in items])


def anchors_of(pattern: str, least: int = LEAST) -> list[str] | None:
    """The anchors of a Python pattern, or None if it has no such set: then nothing can be said before the pattern has run.

    Patterns in verbose spelling have none, because Java reads their classes differently.
    """
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None
    try:
        found = _literals(_tree(parser.parse(pattern)))
    except (re.error, RecursionError, OverflowError):
        return None
    if not found or min(map(len, found)) < least:
        return None
    return sorted(a for a in found if not any(b != a and b in a for b in found))
