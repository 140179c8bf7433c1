"""The in-row form of a finding: an element of an artifact's ``hits`` array."""

from pyspark.sql import Column, functions as F

from wardspark.catalog.patterns import DETECTORS

HIT = (
    "struct<detector:string,detector_ord:int,seq:array<int>,rule_id:string,line:int,col:int,"
    "match:string,attrs:map<string,string>,snippet:string>"
)
HITS = f"array<{HIT}>"


def no_hits() -> Column:
    return F.array().cast(HITS)


def hit(detector: str, rule_id, line, col, seq: list, match=None, attrs: dict | None = None, snippet=None) -> Column:
    """One hit; ``seq`` is its place in the detector's own order, ``attrs`` override catalogue fields."""
    lit = lambda value, kind: (value if isinstance(value, Column) else F.lit(value)).cast(kind)
    fields = [x for name, value in (attrs or {}).items() for x in (F.lit(name), lit(value, "string"))]
    return F.struct(
        F.lit(detector).alias("detector"),
        F.lit(DETECTORS.index(detector)).alias("detector_ord"),
        F.array(*[lit(s, "int") for s in seq]).alias("seq"),
        lit(rule_id, "string").alias("rule_id"),
        lit(line, "int").alias("line"),
        lit(col, "int").alias("col"),
        lit(match, "string").alias("match"),
        (F.create_map(*fields) if fields else F.lit(None)).cast("map<string,string>").alias("attrs"),
        lit(snippet, "string").alias("snippet"),
    )


def join_arrays(arrays: list[Column]) -> Column:
    """One array out of arrays of the same type, any of which may be null."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def only_if(condition: Column, hits: Column) -> Column:
    return F.when(condition, hits.cast(HITS)).otherwise(no_hits())
