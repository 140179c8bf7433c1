"""Which rules can match a text at all, as bit masks.

Every rule lists anchors: lower-case phrases at least one of which each of its matches contains. One pass over the
text finds all anchors, and only the patterns whose bit is set need to run. A blank in a phrase stands for any run of
whitespace, even an empty one.
"""

import sys
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from wardspark.functions.code_facts import FACTS, facts_array
from wardspark.functions.slices import looks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Groups in one mask: the bits of a bigint without its sign.
_WIDTH = 63

# Screens that are tried as one before they are tried one by one.
_TOGETHER = 32

# Characters that lower-casing leaves behind for letters that a case-insensitive pattern treats as ASCII i, s or k.
FOLDING = ["ı", "ſ", "̇"]


def _spellings(phrase: str) -> list[str]:
    """The phrase with each blank kept or dropped; texts are compared with whitespace runs shrunk to one blank."""
    words = phrase.split(" ")
    return [words[0] + "".join(gap + word for gap, word in zip(gaps, words[1:])) for gaps in product((" ", ""), repeat=len(words) - 1)]


def _bits(groups: list[list[str]]) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, phrases in enumerate(groups):
        for phrase in list(phrases) + FOLDING:
            for spelling in _spellings(phrase):
                bits[spelling] = bits.get(spelling, 0) | (1 << i)
    return bits


def _screened(texts: pa.Array, masks: np.ndarray, groups: list[list[str]], screens: dict[int, str]) -> None:
    """Takes back the bits of groups whose screen does not match the text; for groups without anchors all texts are tried, first with many screens as one."""
    def matching(rows: np.ndarray, screen: str) -> np.ndarray:
        tried = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
        return rows[pc.fill_null(pc.match_substring_regex(tried, screen), False).to_numpy(zero_copy_only=False)]

    free = [i for i in screens if not groups[i]]
    maybe = {}
    for at in range(0, len(free), _TOGETHER):
        some = free[at : at + _TOGETHER]
        try:
            rows = matching(np.arange(len(texts)), "|".join(screens[i] for i in some))
        except pa.ArrowInvalid:  # too large as one
            rows = np.arange(len(texts))
        maybe |= dict.fromkeys(some, rows)
    for i, screen in screens.items():
        word, bit = i // _WIDTH, np.int64(1 << i % _WIDTH)
        rows = maybe[i] if i in maybe else np.flatnonzero(masks[:, word] & bit)
        masks[:, word] &= ~bit
        if len(rows):
            masks[matching(rows, screen), word] |= bit


def text_facts(text: Column, groups: list[list[str]], screens: dict[int, str] | None = None, code: tuple[Column, int] | None = None) -> Column:
    """What one look at a text tells: ``struct<mask: array<bigint>, n_lines: int, plain: boolean>``.

    Bit ``i % 63`` of element ``i // 63`` of the mask is set if the text may contain an anchor of ``groups[i]`` and, where ``screens`` has one for ``i``, the screen
    matches; a group that has a screen may be without anchors. Lines end as in ``split_lines``; ``plain``
    texts have no line ends but ``\\n``. For null no bit is set and there are no lines.

    ``code`` tells which texts are Python sources, and the bit without which no rule over code can fire: then there is a field ``facts`` as well, null for other texts.
    It is the same look, so that a task holds one Python process and one batch of texts; results leave it slice by slice.
    """
    bits, words, screens = _bits(groups), max(1, -(-len(groups) // _WIDTH)), screens or {}
    sources, code_bit = code or (None, None)

    def look(automaton, texts: pa.Array, are_sources: pa.Array | None) -> pa.StructArray:
        masks, lines, plain = np.zeros((len(texts), words), np.int64), np.zeros(len(texts), np.int32), np.ones(len(texts), bool)
        values = texts.to_pylist()
        for i, value in enumerate(values):
            if not value:
                continue
            lines[i], last = len(value.splitlines()), value[-1]
            plain[i] = "\r" not in value and lines[i] == value.count("\n") + (last != "\n") and (last == "\n" or len((last + ".").splitlines()) == 1)
            found = 0
            for _, bit in automaton.iter(" ".join(value.lower().split())) if automaton else ():
                found |= bit
            if found:
                masks[i] = [found >> _WIDTH * word & (1 << _WIDTH) - 1 for word in range(words)]
        _screened(texts, masks, groups, screens)
        ends = pa.array(np.arange(0, masks.size + 1, words, dtype=np.int32))
        fields = {"mask": pa.ListArray.from_arrays(ends, pa.array(masks.ravel())), "n_lines": pa.array(lines), "plain": pa.array(plain)}
        if are_sources is not None:  # Python folds wide letters into ASCII names
            named = masks[:, code_bit // _WIDTH] & np.int64(1 << code_bit % _WIDTH) != 0
            fields["facts"] = facts_array(v if v and s and (n or not v.isascii()) else None for v, s, n in zip(values, are_sources.to_pylist(), named))
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    def told(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for spelling, value in bits.items():
            automaton.add_word(spelling, value)
        automaton.make_automaton()
        for texts, *flags in batches:
            start = 0
            for part in looks(texts):
                yield look(automaton if bits else None, part, flags[0].slice(start, len(part)) if flags else None)
                start += len(part)

    if sources is None:
        @arrow_udf(StructType.fromDDL("mask array<bigint>, n_lines int, plain boolean"))
        def facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from told((texts,) for texts in batches)

        return facts(text)

    @arrow_udf(StructType.fromDDL(f"mask array<bigint>, n_lines int, plain boolean, facts {FACTS}"))
    def facts_with_code(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from told(batches)

    return facts_with_code(text, sources)


def anchor_mask(text: Column, groups: list[list[str]]) -> Column:
    """The mask of :func:`text_facts`."""
    return text_facts(text, groups)["mask"]


def in_own_words(groups: list[list[str]]) -> list[list[str]]:
    """The groups, filled up so that groups added behind them have words of the mask to themselves."""
    return groups + [[]] * (-len(groups) % _WIDTH)


def has_bit(mask: Column, index: int) -> Column:
    return F.get(mask, F.lit(index // _WIDTH)).bitwiseAND(F.lit(1 << index % _WIDTH).cast("bigint")) != 0


def word_at(index: int) -> int:
    """The word of the mask that a bit is in."""
    return index // _WIDTH


def any_of_word(mask: Column, word: int) -> Column:
    return F.get(mask, F.lit(word)) != 0


def any_bit(mask: Column, groups: int | None = None) -> Column:
    """Whether any bit is set, or any of the words that the first ``groups`` groups are in."""
    return F.exists(mask if groups is None else F.slice(mask, 1, max(1, -(-groups // _WIDTH))), lambda word: word != 0)
