"""The append-only audit trail: JSON lines in a directory per day."""

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.schemas import VERSION


def _time(timestamp: Column | None) -> Column:
    when = F.current_timestamp() if timestamp is None else timestamp
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def scan_events(summary: DataFrame, timestamp: Column | None = None, duration: Column | None = None, command: str = "scan") -> DataFrame:
    """One event per target of a scan summary."""
    findings = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("total", "critical", "high", "medium", "low", "info")])
    return summary.select(
        F.lit("scan").alias("event"), _time(timestamp).alias("timestamp"), F.lit(command).alias("command"), "target",
        F.lit(VERSION).alias("scanner_version"), F.col("files").alias("files_scanned"), F.col("lines").alias("lines_scanned"),
        (F.lit(None) if duration is None else duration).cast("double").alias("scan_duration_seconds"), "security_score", findings.alias("findings"),
    )


def prompt_events(scored: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """One event per scored prompt."""
    return scored.select(
        F.lit("prompt_analysis").alias("event"), _time(timestamp).alias("timestamp"), "threat_score", "threat_level",
        F.col("threat_types").alias("attack_vectors"),
    )


def append_audit(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(path)


def append_audit_scan(summary: DataFrame, path: str, duration: Column | None = None) -> None:
    append_audit(scan_events(summary, duration=duration), path)


def append_audit_prompt(scored: DataFrame, path: str) -> None:
    append_audit(prompt_events(scored), path)
