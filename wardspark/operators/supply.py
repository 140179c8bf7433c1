"""Declared dependencies and the advisories that concern them."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardspark.catalog import patterns as cat
from wardspark.catalog.advisories import ADVISORIES
from wardspark.functions.cached import built_once
from wardspark.functions.identifiers import normalize_package
from wardspark.functions.text import basename, split_lines, strip
from wardspark.functions.versions import version_key
from wardspark.operators.hits import hit, no_hits
from wardspark.sources.local import local_table

# One dependency declaration, bare, in double quotes, in either quotes.
_DECLARATION = r"([A-Za-z0-9_\-\.]+)\s*([=<>!~^]+)\s*([0-9][0-9A-Za-z\.\-\+\*]*)"
ADVISORY_COLUMNS = (
    "adv_ord int, package string, vulnerable_below string, cve string, severity string, cwe string, owasp string, "
    "description string, remediation string"
)
_FORMS = {
    "requirements": f"(?U)^{_DECLARATION}",
    "pyproject": f'(?U)"{_DECLARATION}"',
    "setup": f"(?U)['\"]{_DECLARATION}['\"]",
}


def manifest_kind(path: Column) -> Column:
    """Which form a manifest has, by file name; null for other files."""
    name = F.lower(basename(path))
    return (
        F.when(name.isin(cat.REQUIREMENTS_FILES), F.lit("requirements"))
        .when(name == "pyproject.toml", F.lit("pyproject")).when(name == "setup.py", F.lit("setup"))
    )


def declared(kind: Column, lines: Column) -> Column:
    """``array<struct<line_number, package, version>>``: the first declaration of each line."""

    def parse(line: Column, number: Column) -> Column:
        bare = strip(line)
        ignored = (bare == "") | F.startswith(bare, F.lit("#")) | F.startswith(bare, F.lit("-"))
        requirement = F.when(~ignored, strip(F.substring_index(bare, "#", 1)))
        text = F.when(kind == "requirements", requirement).otherwise(line)
        pick = lambda group: (
            F.when(kind == "requirements", F.regexp_extract(text, _FORMS["requirements"], group))
            .when(kind == "pyproject", F.regexp_extract(text, _FORMS["pyproject"], group))
            .otherwise(F.regexp_extract(text, _FORMS["setup"], group))
        )
        return F.struct(number.alias("line_number"), normalize_package(pick(1)).alias("package"), pick(3).alias("version"))

    parsed = F.filter(F.transform(lines, lambda line, i: parse(line, i + 1)), lambda d: d["package"] != "")
    return F.when(kind.isNotNull(), parsed)


def dependencies(artifacts: DataFrame) -> DataFrame:
    """One row per declared dependency of the manifests among the artifacts."""
    manifests = artifacts.withColumn("_kind", manifest_kind(F.col("path"))).where("_kind is not null")
    return (
        manifests.select("path", "target", F.explode(declared(F.col("_kind"), split_lines(F.col("content")))).alias("d"))
        .select("path", "target", "d.package", "d.version", "d.line_number")
    )


def dependency_hits(path: Column, lines: Column) -> Column:
    """Dependencies as hits that still have to meet the advisories."""
    kind = manifest_kind(path)
    found = F.transform(
        declared(kind, lines),
        lambda d: hit("supply", "SC", d["line_number"], 1, [d["line_number"], 0, 0], attrs={"package": d["package"], "version": d["version"]}),
    )
    return F.when(kind.isNotNull(), found).otherwise(no_hits())


def advisory_table(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    return local_table(spark, rows or ADVISORIES, ADVISORY_COLUMNS)


@built_once
def _key_of(column: str) -> Column:
    return version_key(F.col(column))


def _stairs(advisories: DataFrame) -> DataFrame:
    """One row per package with what a look-up needs, whatever the number of its advisories.

    ``_stairs`` are bounds in ascending order, each with the first advisory (by ``adv_ord``) of those with this bound or a greater one; bounds that change nothing are left
    out. ``_always`` is the first advisory without a bound that can be read, ``_first`` the first of all.
    """
    told = F.struct("adv_ord", "vulnerable_below", "cve", "severity", "cwe", "owasp", "description", "remediation")
    rows = advisories.select(F.lower("package").alias("_package"), _key_of("vulnerable_below").alias("_bound"), told.alias("_advisory"))
    above = Window.partitionBy("_package").orderBy(F.desc("_bound"), F.col("_advisory.adv_ord")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.min(F.when(F.col("_bound").isNotNull(), F.col("_advisory.adv_ord"))).over(above)
    rows = rows.withColumn("_step", F.col("_bound").isNotNull() & F.coalesce(F.col("_advisory.adv_ord") < earlier, F.lit(True)))
    return rows.groupBy("_package").agg(
        F.array_sort(F.collect_list(F.when(F.col("_step"), F.struct(F.col("_bound").alias("bound"), F.col("_advisory").alias("advisory"))))).alias("_stairs"),
        F.min_by("_advisory", F.when(F.col("_bound").isNull(), F.col("_advisory.adv_ord"))).alias("_always"), F.min_by("_advisory", "_advisory.adv_ord").alias("_first"))


def _first_above(stairs: Column, key: Column) -> Column:
    """The advisory of the lowest bound above a key, by halving."""
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(stairs))))
    start = F.struct(F.lit(0).alias("low"), F.size(stairs).alias("high"))

    def halved(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        above = F.get(stairs, middle)["bound"] > key
        done = span["low"] >= span["high"]
        return F.struct(F.when(done | above, span["low"]).otherwise(middle + 1).alias("low"), F.when(~done & above, middle).otherwise(span["high"]).alias("high"))

    return F.aggregate(halvings, start, halved, lambda span: F.get(stairs, span["low"])["advisory"])


def match_advisories(deps: DataFrame, advisories: DataFrame, how: str = "inner") -> DataFrame:
    """Dependencies with the first advisory that covers their version, as struct ``advisory``.

    The declared operator plays no part, and a version that cannot be read counts as covered. Advisories are put in order per package first, so a dependency
    meets one row, is never multiplied, and looks at a few bounds only.
    """
    # Rows without a package meet nothing; apart, they do not pile up on one task should the join have to shuffle.
    apart = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*deps.columns[:2]), F.lit(1024)).cast("string"))
    keyed = deps.withColumn("_of", F.coalesce(F.lower("package"), apart))
    joined = keyed.join(_stairs(advisories), F.col("_of") == F.col("_package"), how).withColumn("_key", _key_of("version"))
    bounded = F.when(F.size("_stairs") > 0, _first_above(F.col("_stairs"), F.col("_key")))
    earliest = F.when(F.col("_always.adv_ord") < F.coalesce(bounded["adv_ord"], F.lit(1 << 30)), F.col("_always")).otherwise(bounded)
    matched = joined.withColumn("advisory", F.when(F.col("_key").isNull(), F.col("_first")).otherwise(F.coalesce(earliest, F.col("_always"))))
    if how == "inner":
        matched = matched.where("advisory is not null")
    return matched.drop("_stairs", "_always", "_first", "_package", "_key", "_of")
