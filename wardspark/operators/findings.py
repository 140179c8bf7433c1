"""What is done with findings: de-duplication, filters, order, scores and gates."""

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardspark.catalog.severity import PENALTIES, SEVERITY_NAMES, WEIGHTS
from wardspark.functions.regex import any_contains


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0)
    for name, value in WEIGHTS.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def dedup_findings(findings: DataFrame, by: str = "family") -> DataFrame:
    """The first finding per artifact, line and rule family (or rule, with ``by="rule_id"``).

    First means detector order, then the detector's own order. For tables of findings from anywhere; a scan drops its
    duplicates inside the row, without this shuffle (``scan.dedup_hits``).
    """
    keys = ["target", "file_path", "line_number", by]
    rest = [c for c in findings.columns if c not in keys]
    kept = findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("detector_ord", "seq")).alias("kept"))
    return kept.select(*keys, "kept.*").select(findings.columns)


def severity_filter(findings: DataFrame, severity: str, mode: str = "equal") -> DataFrame:
    """Findings of one severity, or of that severity and above with ``mode="at_least"``; apply after de-duplication."""
    if mode == "at_least":
        return findings.where(severity_weight(F.col("severity")) >= WEIGHTS[severity.upper()])
    return findings.where(F.col("severity") == severity.upper())


def search_findings(findings: DataFrame, query: str = "", severity: str | None = None) -> DataFrame:
    """Findings whose title, id, path, CWE or OWASP id contains the query, case aside."""
    if severity:
        findings = findings.where(F.col("severity") == severity.upper())
    words = query.lower().strip()
    if not words:
        return findings
    fields = ("title", "finding_id", "file_path", "cwe_id", "owasp_id")
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(any_contains(F.lower(field), [words]), F.lit(False))
    return findings.where(found)


def order_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then by path and line."""
    return findings.orderBy(severity_weight(F.col("severity")).desc(), "file_path", "line_number", "detector_ord", "seq")


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*(keys or ("target",))).agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_NAMES], F.count("*").alias("total")
    )


def security_score() -> Column:
    """100 minus the penalties of the counted findings, never below 0."""
    penalty = F.lit(0.0)
    for name in SEVERITY_NAMES:
        penalty = penalty + F.coalesce(F.col(name.lower()), F.lit(0)) * F.lit(PENALTIES[name])
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - penalty), 1)


def scan_totals(scanned: DataFrame) -> DataFrame:
    """Artifacts and lines per target."""
    return scanned.groupBy("target").agg(F.count("*").alias("files"), F.sum(F.col("n_lines").cast("bigint")).alias("lines"))


def scan_summary(scanned: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per target, clean targets included: totals, counts and score.

    Both sides are aggregated to one row per target before they meet.
    """
    joined = scan_totals(scanned).join(severity_counts(findings), "target", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [s.lower() for s in SEVERITY_NAMES] + ["total"]]
    return joined.select("target", "files", "lines", *counts).withColumn("security_score", security_score())


def policy_gate(summary: DataFrame, fail_on: str | None = None) -> DataFrame:
    """Status per target: 3 if any finding reaches ``fail_on``, else 2 with critical, 1 with high findings, 0 otherwise."""
    bound = WEIGHTS.get(fail_on.upper()) if fail_on else None
    if fail_on and bound is None:
        warnings.warn(f"unknown severity {fail_on!r}: the gate looks at critical and high findings only", stacklevel=2)
    reached = [F.col(s.lower()) for s in SEVERITY_NAMES if bound is not None and WEIGHTS[s] >= bound]
    violations = sum(reached[1:], reached[0]) if reached else F.lit(0)
    status = F.when(violations > 0, 3).when(F.col("critical") > 0, 2).when(F.col("high") > 0, 1).otherwise(0)
    return summary.select("target", violations.cast("bigint").alias("violations"), status.alias("status"))


def filter_rules(rules: DataFrame, severity=None, category=None, tag=None, keyword=None) -> DataFrame:
    """Catalogue rules that meet all given conditions."""
    if severity:
        rules = rules.where(F.col("severity") == severity.upper())
    if category:
        rules = rules.where(F.col("category") == category)
    if tag:
        rules = rules.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    if keyword:
        found = F.lit(False)
        for field in ("rule_id", "title", "description", "cwe_id", "owasp_id"):
            found = found | any_contains(F.lower(field), [keyword.lower()])
        rules = rules.where(found)
    return rules


def get_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("rule_id") == rule_id)


def register_rules(rules: DataFrame, added: DataFrame) -> DataFrame:
    """The catalogue with rules added; a rule of the same id replaces the earlier one."""
    both = rules.withColumn("_age", F.lit(0)).unionByName(added.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy("rule_id").orderBy(F.desc("_age"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_age")
