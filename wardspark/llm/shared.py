"""Helpers the corpus operators share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardspark.plans.storage import written

__all__ = ["let", "read", "slices", "text_key", "word_array", "word_line", "written"]

#: Characters that stand between words: everything in ASCII but digits and letters.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def word_line(text: Column) -> Column:
    """The words of a text with A-Z lowered, joined by one space; null counts as empty."""
    spaced = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), NO_WORD, " "), F.lit(" "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(line: Column) -> Column:
    """The words of a :func:`word_line`; none if it is empty."""
    return F.filter(F.split(line, " "), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that Python holds few decoded texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_key(text: Column) -> Column:
    """Tells rows with the same id apart by what they say."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
