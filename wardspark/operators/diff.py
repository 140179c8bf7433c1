"""Comparing two scans."""

from pyspark.sql import DataFrame, functions as F

from wardspark.functions.identifiers import diff_fingerprint
from wardspark.functions.text import basename
from wardspark.operators.findings import severity_weight


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", diff_fingerprint(F.col("finding_id"), basename(F.col("file_path")), F.col("line_number")))


def _one_per_fingerprint(findings: DataFrame, by: list[str]) -> DataFrame:
    """Of findings that share a fingerprint, the last in report order stands for all."""
    keyed = with_fingerprint(findings)
    rest = [c for c in findings.columns if c not in by]
    place = F.struct(-severity_weight(F.col("severity")), "file_path", "line_number", "detector_ord", "seq")
    return keyed.groupBy(*by, "fingerprint").agg(F.max_by(F.struct(*rest), place).alias("row"))


def diff_findings(baseline: DataFrame, current: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """Findings with ``status`` new, fixed or persisting; a persisting finding shows its current row.

    Fingerprints are compared within ``by``. Both sides are reduced to one row per fingerprint before the join, so no
    key is joined with more than one row.
    """
    keys = [*by, "fingerprint"]
    old = _one_per_fingerprint(baseline, list(by)).withColumnRenamed("row", "old")
    new = _one_per_fingerprint(current, list(by)).withColumnRenamed("row", "new")
    joined = old.join(new, keys, "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "fixed").otherwise("persisting")
    columns = [c for c in current.columns if c not in by]
    return joined.select(
        status.alias("status"), "fingerprint", *by, F.coalesce("new", "old").alias("row")
    ).select("status", "fingerprint", *by, *[F.col(f"row.{c}").alias(c) for c in columns])


def persisting_only(findings: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    """``diff_findings`` of findings with themselves, in which every fingerprint persists, without a join."""
    keys = [*by, "fingerprint"]
    rows = _one_per_fingerprint(findings, list(by))
    known = F.lit(True)
    for key in keys:
        known &= F.col(key).isNotNull()
    status = F.explode(F.when(known, F.array(F.lit("persisting"))).otherwise(F.array(F.lit("new"), F.lit("fixed"))))  # a key that is not known equals none
    return rows.select(status.alias("status"), "fingerprint", *by, *[F.col(f"row.{c}").alias(c) for c in findings.columns if c not in by])


def new_findings(baseline: DataFrame, current: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    return _unpacked(_one_per_fingerprint(current, list(by)).join(with_fingerprint(baseline), [*by, "fingerprint"], "left_anti"), current, by)


def fixed_findings(baseline: DataFrame, current: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    return new_findings(current, baseline, by)


def persisting_findings(baseline: DataFrame, current: DataFrame, by: tuple[str, ...] = ("target",)) -> DataFrame:
    return _unpacked(_one_per_fingerprint(current, list(by)).join(with_fingerprint(baseline), [*by, "fingerprint"], "left_semi"), current, by)


def _unpacked(rows: DataFrame, like: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.select("fingerprint", *by, *[F.col(f"row.{c}").alias(c) for c in like.columns if c not in by])


def fingerprint_sets(baseline: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fingerprints that are new, fixed and persisting, as set operations."""
    old, new = with_fingerprint(baseline).select("target", "fingerprint"), with_fingerprint(current).select("target", "fingerprint")
    return new.subtract(old), old.subtract(new), new.intersect(old)


def order_diff(diff: DataFrame) -> DataFrame:
    return diff.orderBy("status", "fingerprint", "target")


def diff_summary(diff: DataFrame, *by: str) -> DataFrame:
    """Counts per status and whether anything new turned up."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "fixed", "persisting")]
    return diff.groupBy(*by).agg(*counts).withColumn("has_regressions", F.col("new") > 0)
