"""JSON and CSV reports."""

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.operators.findings import severity_weight
from wardspark.schemas import VERSION
from wardspark.sinks.parts import MAX_BYTES, MAX_ROWS, in_parts, with_parts

METRICS = ["critical", "high", "medium", "low", "info"]


def place() -> Column:
    """Report order: severity, path, line, detector."""
    return F.struct((-severity_weight(F.col("severity"))).alias("w"), "file_path", "line_number", "detector_ord", "seq", "finding_id")


def report_finding() -> Column:
    return F.struct(
        F.col("finding_id").alias("id"), "title", "category", "severity", "description", "file_path", "line_number", "column_number",
        "code_snippet", "remediation", "cwe_id", "owasp_id", "confidence", "metadata",
    )


def _timestamp(timestamp: str | None) -> Column:
    return F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def report_documents(findings: DataFrame, summary: DataFrame, timestamp: str | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``target, part, parts, document``: the report envelope with its findings in report order, through all parts of a target."""
    grouped = in_parts(findings, place(), report_finding(), max_rows, max_bytes)
    metrics = F.struct(
        F.col("files").alias("total_files_scanned"), F.col("lines").alias("total_lines_scanned"),
        *[F.col(m).alias(f"{m}_count") for m in METRICS], "security_score",
    )
    document = F.struct(
        F.col("target").alias("target_path"), _timestamp(timestamp).alias("timestamp"), F.lit(VERSION).alias("scanner_version"),
        metrics.alias("metrics"), F.col("total").alias("findings_count"),
        F.coalesce("items", F.array()).alias("findings"),
    )
    return with_parts(summary, grouped).join(grouped, ["target", "part"], "left").select("target", "part", "parts", F.to_json(document).alias("document"))


def write_findings_json(findings: DataFrame, summary: DataFrame, path: str, timestamp: str | None = None) -> None:
    """Report documents as JSON lines, in a directory per target."""
    report_documents(findings, summary, timestamp).select("target", F.col("document").alias("value")).write.mode("overwrite").partitionBy("target").text(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.col("finding_id").alias("ID"), F.col("title").alias("Title"), F.col("severity").alias("Severity"), F.col("category").alias("Category"),
        F.col("file_path").alias("File"), F.col("line_number").alias("Line"), F.col("cwe_id").alias("CWE"), F.col("owasp_id").alias("OWASP"),
        F.col("description").alias("Description"), F.col("remediation").alias("Remediation"),
    )


def write_findings_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
