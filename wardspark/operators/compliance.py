"""Findings mapped to compliance control domains."""

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.catalog.controls import CONTROLS
from wardspark.functions.regex import any_contains

_BETWEEN = "\u0000"


def _framework(framework: str) -> dict[str, list[str]]:
    """An unknown framework name means SOC 2."""
    return CONTROLS.get(framework.lower(), CONTROLS["soc2"])


def _identifiers() -> Column:
    meta = lambda name: F.coalesce(F.try_element_at("metadata", F.lit(name)), F.lit(""))
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    return F.lower(F.concat_ws(_BETWEEN, empty("owasp_id"), empty("cwe_id"), "finding_id", meta("rule_id"), meta("detector")))


def _belongs(keys: list[str]) -> Column:
    return any_contains(_identifiers(), [k.lower() for k in keys])


def map_controls(findings: DataFrame, framework: str = "soc2") -> DataFrame:
    """One row per finding and domain it touches.

    A domain is touched when any of its keys occurs in any identifier of the finding, case aside. The keys are part of
    the plan, so this is a projection, not a join.
    """
    domains = F.array_compact(F.array(*[F.when(_belongs(keys), F.lit(domain)) for domain, keys in _framework(framework).items()]))
    return findings.withColumn("domain", F.explode(domains)).withColumn("framework", F.lit(framework.lower()))


def domain_status(findings: DataFrame, summary: DataFrame, framework: str = "soc2") -> DataFrame:
    """Findings per target and domain, PASS where there are none; targets come from the summary."""
    domains = _framework(framework)
    per_target = findings.groupBy("target").agg(F.array(*[F.count_if(_belongs(keys)) for keys in domains.values()]).alias("counts"))
    names = F.array(*[F.lit(d) for d in domains])
    zeros = F.array(*[F.lit(0).cast("bigint") for _ in domains])
    rows = summary.select("target").join(per_target, "target", "left").select(
        "target", F.explode(F.arrays_zip(names.alias("domain"), F.coalesce("counts", zeros).alias("findings"))).alias("d")
    )
    return rows.select(
        "target", F.lit(framework.lower()).alias("framework"), "d.domain", "d.findings",
        F.when(F.col("d.findings") == 0, F.lit("PASS")).otherwise(F.lit("FINDINGS")).alias("status"),
    )


def compliance_summary(findings: DataFrame, summary: DataFrame, framework: str = "soc2") -> DataFrame:
    """The headline row of an evidence report per target."""
    status = domain_status(findings, summary, framework).groupBy("target").agg(
        F.count_if(F.col("status") == "PASS").alias("domains_passed"), F.count("*").alias("domains")
    )
    return summary.select("target", "security_score", "critical", "high", "total", "files").join(status, "target").withColumn(
        "framework", F.lit(framework.lower())
    )
