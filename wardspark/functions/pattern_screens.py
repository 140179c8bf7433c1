"""A screen of a pattern: an expression without look-around and back references that matches wherever the pattern does, worked out from its syntax tree.

A screen may match more than its pattern, never less. Arrow's functions run it in time linear in the text, whatever the pattern, so that the pattern itself only
runs where it is all but sure to match. Places (``^``, ``\\b``), look-around and the upper bounds of long repeats are left out; under the flag that ignores case,
and in classes such as ``\\w``, every character beyond ASCII counts as a match.
"""

from __future__ import annotations

import re
from re import _constants as sre, _parser as parser

import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a screen, and repeats that are written out in it.
MOST_CHARS, MOST_REPEATS = 2000, 8

_ANY = "(?s:.)"
_BEYOND = r"\x{80}-\x{10FFFF}"
_CATEGORIES = {
    sre.CATEGORY_DIGIT: "0-9" + _BEYOND, sre.CATEGORY_SPACE: r"\x{9}-\x{D}\x{1C}-\x{20}" + _BEYOND, sre.CATEGORY_WORD: "0-9A-Z_a-z" + _BEYOND,
}


class _Unknown(Exception):
    """A part of a pattern that cannot be told."""


def _char(code: int) -> str:
    if 0xD800 <= code <= 0xDFFF:
        raise _Unknown
    return f"\\x{{{code:X}}}"


def _chars(first: int, last: int, ignore_case: bool) -> str | None:
    """The inside of a class for a range of characters; None if it can be any character."""
    if not ignore_case:
        return f"{_char(first)}-{_char(last)}"
    if last >= 128:
        return None
    codes = {ord(c) for code in range(first, last + 1) for c in (chr(code).lower(), chr(code).upper())}
    return "".join(_char(code) for code in sorted(codes)) + _BEYOND


def _class(items: list, ignore_case: bool) -> str:
    parts = []
    for kind, value in items:
        if kind is sre.LITERAL:
            part = _chars(value, value, ignore_case)
        elif kind is sre.RANGE:
            part = _chars(*value, ignore_case)
        else:  # negation, and categories of what is left
            part = _CATEGORIES.get(value) if kind is sre.CATEGORY else None
        if part is None:
            return _ANY
        parts.append(part)
    return f"[{''.join(parts)}]"


def _repeat(low: int, high, inner: str) -> str:
    least, most = min(low, MOST_REPEATS), "" if high > MOST_REPEATS else high
    return f"(?:{inner}){{{least},{most}}}"


def _node(kind, value, ignore_case: bool) -> str:
    if kind is sre.LITERAL:
        return _class([(kind, value)], ignore_case)
    if kind is sre.IN:
        return _class(value, ignore_case)
    if kind in (sre.ANY, sre.NOT_LITERAL):
        return _ANY
    if kind is sre.BRANCH:
        return "(?:" + "|".join(_tree(option, ignore_case) for option in value[1]) + ")"
    if kind is sre.SUBPATTERN:
        _, added, dropped, inner = value
        return "(?:" + _tree(inner, bool(added & re.IGNORECASE) or ignore_case and not dropped & re.IGNORECASE) + ")"
    if kind is sre.ATOMIC_GROUP:
        return "(?:" + _tree(value, ignore_case) + ")"
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        return _repeat(value[0], value[1], _tree(value[2], ignore_case))
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return ""
    if kind in (sre.GROUPREF, sre.GROUPREF_EXISTS):
        return f"{_ANY}*"
    raise _Unknown


def _tree(items, ignore_case: bool) -> str:
    return "".join(_node(kind, value, ignore_case) for kind, value in items)


def screen_of(pattern: str) -> str | None:
    """The screen of a Python pattern, or None if it has none that is short enough. Patterns in verbose spelling have none, because Java reads their classes differently."""
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None
    try:
        tree = parser.parse(pattern)
        screen = _tree(tree, bool(tree.state.flags & re.IGNORECASE))
        if len(screen) > MOST_CHARS:
            return None
        pc.match_substring_regex(pa.array([""]), screen)
    except (re.error, RecursionError, OverflowError, _Unknown, pa.ArrowInvalid):
        return None
    return screen
