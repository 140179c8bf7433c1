"""Regular expressions as column expressions."""

import re

from pyspark.sql import Column, functions as F

# One code point that no rule pattern treats specially; stands in for a mark already in the text.
MARK, STAND_IN = "\u0001", "�"

def java_pattern(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """The pattern with Unicode classes, ``\\n`` as the only line end, and the wanted flags."""
    return f"(?dU{'iu' if ignore_case else ''}{'s' if dotall else ''}){pattern}"


def find_all(text: Column, pattern: str) -> Column:
    """All non-overlapping matches, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def any_contains(text: Column, words: list[str]) -> Column:
    """Whether the text contains at least one of the words."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def marked(text: Column, pattern: str) -> Column:
    """The text with a mark put before every match; marks already present are replaced first."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    return F.regexp_replace(clean, pattern, MARK + "$0")


def places(marked_text: Column, matches: Column) -> Column:
    """``array<struct<ordinal, line, col, text>>`` of matches, given the marked text and the matches themselves."""
    lines = F.transform(F.split(marked_text, "\n", -1), lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))
    hits = F.filter(lines, lambda x: F.contains(x["text"], F.lit(MARK)))

    def starts(hit: Column) -> Column:
        return F.transform(_starts(hit["text"]), lambda offset: F.struct(hit["line"].alias("line"), (offset + 1).alias("col")))

    return F.transform(
        F.arrays_zip(F.flatten(F.transform(hits, starts)).alias("place"), matches.alias("text")),
        lambda m, i: F.struct(i.alias("ordinal"), m["place"]["line"].alias("line"), m["place"]["col"].alias("col"), m["text"].alias("text")),
    )


def _starts(marked_text: Column) -> Column:
    """Offsets, marks not counted, at which the marks stand."""
    pieces = F.split(marked_text, MARK, -1)
    widths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))
    return F.aggregate(
        widths,
        F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts")),
        lambda acc, w: F.struct((acc["next"] + w).alias("next"), F.array_append(acc["starts"], acc["next"] + w).alias("starts")),
        lambda acc: acc["starts"],
    )


def match_positions(text: Column, pattern: str) -> Column:
    """``array<struct<ordinal, line, col, text>>`` of all matches; line and column count from 1, lines end at ``\\n``."""
    return places(marked(text, pattern), find_all(text, pattern))


def match_places(text: Column, pattern: str) -> Column:
    """``array<struct<offset, line, col, text>>`` of all matches, in one pass over the text."""
    mark = marked(text, pattern)
    both = F.arrays_zip(_starts(mark).alias("offset"), places(mark, find_all(text, pattern)).alias("place"))
    return F.transform(both, lambda m: F.struct(m["offset"].alias("offset"), m["place"]["line"].alias("line"), m["place"]["col"].alias("col"), m["place"]["text"].alias("text")))


def match_offsets(text: Column, pattern: str) -> Column:
    """Start offsets of all matches, counted from 0."""
    return _starts(marked(text, pattern))


def line_of(text: Column, offset: Column) -> Column:
    """The line an offset falls on: newlines before it plus one."""
    prefix = F.substring(text, F.lit(1), offset)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """The column of an offset, from 1, on its ``\\n`` line."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1
