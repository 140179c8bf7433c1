"""Decoding, lines and snippets."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the line ends recognised when a text is cut into lines.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
_KEPT = "﷐"  # a noncharacter that shields U+FFFD typed by the author while bad bytes are dropped


def decode_text(content: Column) -> Column:
    """UTF-8 text of a binary column; bytes that are not UTF-8 are dropped."""
    text = content.cast("string")
    shielded = F.make_valid_utf8(F.replace(text, F.lit("�"), F.lit(_KEPT)))
    cleaned = F.replace(F.replace(shielded, F.lit("�"), F.lit("")), F.lit(_KEPT), F.lit("�"))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def split_lines(text: Column, plain: Column | None = None) -> Column:
    """The lines of a text; a line end at the very end adds no empty line. Where ``plain`` tells that the text has no line ends but ``\\n``, it is split without a pattern."""
    whole = lambda parts: F.slice(parts, F.lit(1), F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))
    parts = F.split(text, LINE_ENDS, -1)
    if plain is not None:
        parts = F.when(plain, F.split(text, "\n", -1)).otherwise(parts)
    return F.get(F.transform(F.array(parts), whole), 0)  # the text is split once


@pandas_udf(IntegerType())
def count_lines(text: pd.Series) -> pd.Series:
    """``size(split_lines(text))`` without building the lines; 0 for null. Counted over Arrow batches, several times
    faster here than a pattern with this many line ends."""
    return text.map(lambda value: len(value.splitlines()) if value else 0)


def snippet(lines: Column, line_number: Column, context: int = 2) -> Column:
    """A line with its neighbours, numbered; the line itself carries a pointer. Empty if there is no such line."""
    first = F.greatest(F.lit(1), line_number - context)
    shown = F.slice(lines, first, F.least(F.size(lines), line_number + context) - first + 1)
    inside = (line_number >= 1) & (line_number <= F.size(lines))
    return F.when(inside, numbered_lines(shown, first, line_number)).otherwise(F.lit(""))


def numbered_lines(shown: Column, first: Column, pointed: Column) -> Column:
    """Lines one below the other with their numbers from ``first`` on, and a pointer at one of them."""
    numbered = F.transform(
        shown,
        lambda line, i: F.concat(
            F.format_string("%4d", first + i),
            F.when(first + i == pointed, F.lit(" > ")).otherwise(F.lit("   ")),
            line,
        ),
    )
    return F.array_join(numbered, "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last ``.ext`` of the file name; names such as ``.env`` or ``a.`` have none."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
