"""Detectors of the user's own that are functions of a table.

A detector takes the table of artifacts (``path, target, content`` and whatever else it finds there) and returns the same rows with a column ``found``. It may use anything that
keeps a row a row: expressions, ``mapInArrow``, a join with a small table. What it found lies in the row, so it is de-duplicated together with the built-in
detectors' hits, after them and in the order of registration, and it works on streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.catalog import patterns as cat

#: What a detector found: attributes are columns of findings (``title``, ``severity``, ``description``, ...) that override the catalogue's.
FOUND = "array<struct<rule_id:string,line:int,col:int,match:string,attrs:map<string,string>>>"


class Detectors:
    """Named detectors in the order in which they were registered."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, function: Callable[[DataFrame], DataFrame] | None = None):
        """Adds a detector; also a decorator. Names are those of no other detector."""
        if function is None:
            return lambda f: self.register(name, f)
        if name in cat.DETECTORS or name in self._by_name:
            raise ValueError(f"there is a detector {name} already")
        self._by_name[name] = function
        return function

    def __iter__(self) -> Iterator[str]:
        return iter(self._by_name)

    def column(self, name: str) -> str:
        return f"_found_{name}"

    def applied(self, artifacts: DataFrame) -> DataFrame:
        """The artifacts with what every detector found, in a column each."""
        for name, function in self._by_name.items():
            result = function(artifacts)
            missing = [c for c in artifacts.columns if c not in result.columns]
            if missing or "found" not in result.columns:
                raise TypeError(f"detector {name} must return its rows with a column found; missing: {', '.join(missing or ['found'])}")
            if (kind := result.schema["found"].dataType.simpleString()) != FOUND:
                raise TypeError(f"detector {name}: found is {kind}, not {FOUND}")
            artifacts = result.select(*artifacts.columns, F.col("found").alias(self.column(name)))
        return artifacts

    def hits(self) -> list[Column]:
        """What was found, as hits; rows of ``found`` keep their order."""
        return [self._hits_of(name, len(cat.DETECTORS) + i) for i, name in enumerate(self._by_name)]

    def _hits_of(self, name: str, order: int) -> Column:
        found = F.coalesce(F.col(self.column(name)), F.array().cast(FOUND))
        return F.transform(found, lambda x, i: F.struct(
            F.lit(name).alias("detector"), F.lit(order).alias("detector_ord"), F.array(i).alias("seq"), x["rule_id"].alias("rule_id"), x["line"].alias("line"), F.coalesce(x["col"], F.lit(1)).alias("col"),
            x["match"].alias("match"), x["attrs"].alias("attrs"), F.lit(None).cast("string").alias("snippet")))
