"""End-to-end runs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wardspark.operators.compliance import compliance_summary, domain_status
from wardspark.operators.diff import diff_findings, diff_summary
from wardspark.operators.findings import policy_gate, scan_summary, severity_filter
from wardspark.operators.scan import dedup_hits, resolve_findings, scan_artifacts
from wardspark.plans.storage import written


@dataclass
class ScanRun:
    """What one scan gives: per-artifact hits without duplicates, the findings table and a row per target."""

    scanned: DataFrame
    findings: DataFrame
    summary: DataFrame


def run_scan(
    artifacts: DataFrame,
    custom_rules: list[dict] | None = None,
    detectors: list[str] | None = None,
    advisories: DataFrame | None = None,
    severity: str | None = None,
    store: bool = True,
    signature_rules: list[dict] | None = None,
    **more,
) -> ScanRun:
    """Scans artifacts and scores their targets.

    Duplicates go inside each artifact's row, so no shuffle by path is needed. With ``store`` the narrow per-artifact result
    and the findings are written to the shared folder: contents are read and parsed once and findings put together once,
    however many reports follow, and a lost executor costs only its own tasks. ``more`` are further arguments of ``scan_artifacts``: secret rules,
    detectors of the caller's own.
    """
    scanned = scan_artifacts(artifacts, custom_rules, detectors, signature_rules=signature_rules, **more)
    scanned = scanned.withColumn("hits", dedup_hits(F.col("hits")))
    if store:
        scanned = written(scanned, "scanned")
    findings = resolve_findings(scanned, advisories)
    if store:
        findings = written(findings, "findings")
    if severity:
        findings = severity_filter(findings, severity)
    return ScanRun(scanned, findings, scan_summary(scanned, findings))


def run_evidence(run: ScanRun, framework: str = "soc2") -> tuple[DataFrame, DataFrame]:
    """Compliance headline and domain rows of a scan."""
    return compliance_summary(run.findings, run.summary, framework), domain_status(run.findings, run.summary, framework)


def run_regression(baseline: DataFrame, run: ScanRun, fail_on: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Differences to a baseline, their counts per target, and the gate."""
    diff = diff_findings(baseline, run.findings)
    return diff, diff_summary(diff, "target"), policy_gate(run.summary, fail_on)
