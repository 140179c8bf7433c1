"""SARIF 2.1.0."""

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.catalog.severity import SARIF_LEVELS, SARIF_SCORES
from wardspark.functions.identifiers import fingerprint_sha, rule_base
from wardspark.schemas import TOOL, VERSION
from wardspark.sinks.parts import MAX_BYTES, MAX_ROWS, in_parts, with_parts
from wardspark.sinks.reports import place

_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
# The tags every run carries.
_TAGS = ["ai-security", "llm-security", "owasp-llm-top10", "sast"]


def sarif_rule_id() -> Column:
    return F.coalesce(F.try_element_at("metadata", F.lit("rule_id")), rule_base(F.col("finding_id")))


def _by_severity(values: dict, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("severity")), F.lit(default))


def sarif_rules(findings: DataFrame, *by: str) -> DataFrame:
    """One row per rule (and ``by`` column), described by its first finding in report order."""
    keyed = findings.withColumn("rule", sarif_rule_id())
    or_else = lambda value, default: F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(value)
    described = F.struct(
        F.col("rule").alias("id"), F.replace("title", F.lit(" "), F.lit("")).alias("name"), F.col("title").alias("short_description"),
        F.col("description").alias("full_description"), F.col("remediation").alias("help"),
        F.array(or_else(F.split_part("owasp_id", F.lit(":"), F.lit(1)), "AI-Security"), or_else(F.col("cwe_id"), "CWE-Unknown"),
                F.lit("ai-security"), F.lit("llm-security")).alias("tags"),
        F.lower("severity").alias("problem_severity"), _by_severity(SARIF_SCORES, "5.0").alias("security_severity"),
        _by_severity(SARIF_LEVELS, "warning").alias("level"),
    )
    return keyed.groupBy(*by, "rule").agg(F.min_by(described, place()).alias("r")).select(*by, "r.*")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result row per finding."""
    rule = sarif_rule_id()
    return findings.select(
        "target", "finding_id", "severity", "file_path", "line_number", "detector_ord", "seq",
        rule.alias("rule_id"), _by_severity(SARIF_LEVELS, "warning").alias("level"), F.col("description").alias("message"),
        F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri"),
        F.greatest(F.lit(1), F.col("line_number")).alias("start_line"), F.greatest(F.lit(1), F.col("column_number")).alias("start_column"),
        F.col("title").alias("logical_name"), fingerprint_sha(rule, F.col("file_path"), F.col("line_number")).alias("fingerprint"),
        F.col("cwe_id").alias("cwe"), F.col("owasp_id").alias("owasp"), "confidence", "remediation",
    )


def _text(column: str) -> Column:
    return F.struct(F.col(column).alias("text"))


def sarif_documents(findings: DataFrame, summary: DataFrame, timestamp: str | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``target, part, parts, document``; results are in report order through all parts, and every part names all rules of its target, whose number the catalogue bounds."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", _text("message").alias("message"),
        F.array(F.struct(
            F.struct(
                F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")).alias("region"),
            ).alias("physicalLocation"),
            F.array(F.struct(F.col("logical_name").alias("name"), F.lit("function").alias("kind"))).alias("logicalLocations"),
        )).alias("locations"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash/v1")).alias("partialFingerprints"),
        F.struct("cwe", "owasp", "confidence", "remediation").alias("properties"),
    )
    results = in_parts(sarif_results(findings), place(), result, max_rows, max_bytes)
    rule = F.struct(
        "id", "name", _text("short_description").alias("shortDescription"), _text("full_description").alias("fullDescription"),
        _text("help").alias("help"),
        F.struct("tags", F.lit("high").alias("precision"), F.col("problem_severity").alias("problem.severity"),
                 F.col("security_severity").alias("security-severity")).alias("properties"),
        F.struct("level").alias("defaultConfiguration"),
    )
    rules = sarif_rules(findings, "target").groupBy("target").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    run = F.struct(
        F.struct(F.struct(
            F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), F.coalesce("rules", F.array()).alias("rules"),
            F.struct(F.array(*[F.lit(t) for t in _TAGS]).alias("tags")).alias("properties"),
        ).alias("driver")).alias("tool"),
        F.coalesce("items", F.array()).alias("results"),
        F.array(F.struct(
            F.lit(True).alias("executionSuccessful"), F.concat(F.lit(f"{TOOL} scan "), "target").alias("commandLine"),
            (F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("startTimeUtc"),
        )).alias("invocations"),
        F.struct(F.col("target").alias("scanTarget"), F.col("security_score").alias("securityScore"), F.col("total").alias("totalFindings")).alias("properties"),
    )
    document = F.struct(F.lit(_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return (
        with_parts(summary, results).join(results, ["target", "part"], "left").join(rules, "target", "left")
        .select("target", "part", "parts", F.to_json(document).alias("document"))
    )


def write_sarif(findings: DataFrame, summary: DataFrame, path: str) -> None:
    sarif_documents(findings, summary).select("target", F.col("document").alias("value")).write.mode("overwrite").partitionBy("target").text(path)
