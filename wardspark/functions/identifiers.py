"""Finding ids, families, fingerprints and masks."""

from pyspark.sql import Column, functions as F


def rule_family(finding_id: Column) -> Column:
    """The part of an id before its first dash."""
    return F.split_part(finding_id, F.lit("-"), F.lit(1))


def rule_base(finding_id: Column) -> Column:
    """An id without its last dash-separated part."""
    return F.regexp_replace(finding_id, "-[^-]*$", "")


def normalize_package(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def mask_match(match: Column) -> Column:
    """The first eight characters, dots, and the last four of what is longer than twelve."""
    return F.concat(F.substring(match, 1, 8), F.lit("..."), F.when(F.length(match) > 12, F.right(match, F.lit(4))).otherwise(F.lit("")))


def fingerprint_sha(rule_id: Column, path: Column, line: Column) -> Column:
    """Short stable hash of rule, path and line."""
    return F.substring(F.sha2(F.concat_ws("::", rule_id, path, line.cast("string")), 256), 1, 16)


def finding_id(*parts: Column) -> Column:
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def diff_fingerprint(finding_id: Column, basename: Column, line: Column) -> Column:
    """What a baseline comparison matches on: rule, file name and line."""
    return F.concat_ws("::", rule_base(finding_id), basename, line.cast("string"))
