"""CycloneDX 1.5 bills of materials from declared dependencies and findings."""

from pyspark.sql import DataFrame, functions as F

from wardspark.functions.text import basename
from wardspark.schemas import TOOL, VERSION
from wardspark.sinks.parts import MAX_BYTES, MAX_ROWS, in_parts, with_parts


def sbom_components(packages: DataFrame) -> DataFrame:
    """One component row per row of ``packages(target, package, version, …)``; a missing version reads 0.0.0."""
    version = F.coalesce("version", F.lit("0.0.0"))
    return packages.select(
        "target", F.lit("library").alias("type"), F.col("package").alias("name"), version.alias("version"),
        F.concat(F.lit("pkg:pypi/"), F.lower("package"), F.lit("@"), version).alias("purl"),
        F.concat(F.lit("https://pypi.org/project/"), "package", F.lit("/"), version, F.lit("/")).alias("distribution_url"),
    )


def sbom_vulnerabilities(findings: DataFrame) -> DataFrame:
    """One vulnerability row per finding."""
    number = F.regexp_extract("cwe_id", "^CWE-([0-9]+)$", 1)
    return findings.select(
        "target", "file_path", "line_number", "finding_id",
        F.when(F.coalesce("cwe_id", F.lit("")) != "", F.col("cwe_id")).otherwise(F.col("finding_id")).alias("id"),
        F.lower("severity").alias("severity"),
        F.when(number != "", F.array(number.cast("int"))).otherwise(F.array().cast("array<int>")).alias("cwes"),
        "description", F.col("remediation").alias("recommendation"), basename(F.col("file_path")).alias("affects"),
    )


def sbom_documents(packages: DataFrame, findings: DataFrame, timestamp: str, max_rows: int = MAX_ROWS, targets: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``target, part, parts, document``: the target is the project; target, ``timestamp`` and part make the serial number.

    Equal components of a target are listed once. ``targets``, such as a scan summary, adds those that have neither
    dependencies nor findings.
    """
    components = sbom_components(packages).distinct()
    vulnerabilities = sbom_vulnerabilities(findings)
    named = components.select("target").unionByName(vulnerabilities.select("target"))
    named = (named if targets is None else named.unionByName(targets.select("target"))).distinct()
    component = F.struct(
        "type", "name", "version", "purl", F.array().cast("array<string>").alias("licenses"),
        F.array(F.struct(F.lit("distribution").alias("type"), F.col("distribution_url").alias("url"))).alias("externalReferences"),
    )
    source = F.struct(F.lit(TOOL).alias("name"))
    vulnerability = F.struct(
        "id", source.alias("source"),
        F.array(F.struct(source.alias("source"), "severity", F.lit("other").alias("method"))).alias("ratings"),
        "cwes", "description", "recommendation",
        F.array(F.struct(F.col("affects").alias("ref"), F.array(F.struct(F.lit("1.0.0").alias("version"), F.lit("affected").alias("status"))).alias("versions"))).alias("affects"),
    )
    listed = in_parts(components, F.struct("name", "version"), component, max_rows, max_bytes).withColumnRenamed("items", "components")
    affected = in_parts(vulnerabilities, F.struct("file_path", "line_number", "finding_id", "id"), vulnerability, max_rows, max_bytes).withColumnRenamed("items", "vulnerabilities")
    serial = F.concat(F.lit("urn:uuid:"), F.substring(F.sha2(F.concat("target", F.lit(f"/{timestamp}/"), F.col("part").cast("string")), 256), 1, 32))
    document = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(
            F.lit(timestamp).alias("timestamp"), F.array(F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"))).alias("tools"),
            F.struct(F.lit("application").alias("type"), F.col("target").alias("name"), F.lit("1.0.0").alias("version")).alias("component"),
        ).alias("metadata"),
        F.coalesce("components", F.array()).alias("components"), F.coalesce("vulnerabilities", F.array()).alias("vulnerabilities"),
    )
    return (
        with_parts(named, listed, affected).join(listed, ["target", "part"], "left").join(affected, ["target", "part"], "left")
        .select("target", "part", "parts", F.to_json(document).alias("document"))
    )


def write_sbom(packages: DataFrame, findings: DataFrame, timestamp: str, path: str, targets: DataFrame | None = None) -> None:
    sbom_documents(packages, findings, timestamp, targets=targets).select("target", F.col("document").alias("value")).write.mode("overwrite").partitionBy("target").text(path)
