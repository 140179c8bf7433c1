"""Version order after PEP 440, as comparable structs."""

from pyspark.sql import Column, functions as F

_RELEASE = r"[0-9]+(?:\.[0-9]+)*"
_PRE = r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
_POST = r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?"
_DEV = r"(?:[-_.]?(dev)[-_.]?([0-9]*))?"
_LOCAL = r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?"
VERSION = rf"^\s*v?(?:([0-9]+)!)?({_RELEASE}){_PRE}{_POST}{_DEV}{_LOCAL}\s*$"

_MAX = 9223372036854775807


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(_MAX))


def _number_or_zero(text: Column) -> Column:
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(_number(text))


def version_key(version: Column) -> Column:
    """A struct that sorts as PEP 440 versions do; null where the text is not a version.

    Trailing zeros of the release are dropped, so that 1.0 equals 1.0.0; pre-releases sort before the release,
    dev releases before both, post releases and local labels after.
    """
    text = F.lower(version)
    part = lambda i: F.regexp_extract(text, VERSION, i)
    numbers = F.transform(F.split(F.regexp_replace(part(2), r"(?:\.0+)+$", ""), r"\."), _number)
    phase = part(3)
    has_post, has_dev = (part(5) != "") | (part(6) != ""), part(8) != ""
    phase_rank = (
        F.when(phase.isin("a", "alpha"), 0).when(phase.isin("b", "beta"), 1).when(phase != "", 2)
        .when(has_dev & ~has_post, -1).otherwise(3)
    )
    post = F.when(has_post, _number_or_zero(F.concat(part(5), part(7)))).otherwise(F.lit(-1).cast("bigint"))
    dev = F.when(has_dev, _number_or_zero(part(9))).otherwise(F.lit(_MAX))
    local = F.when(part(10) == "", F.array().cast("array<string>")).otherwise(F.split(part(10), "[-_.]"))
    local_key = F.transform(
        local,
        lambda s: F.struct(
            s.rlike("^[0-9]+$").alias("numeric"),
            F.when(s.rlike("^[0-9]+$"), _number(s)).otherwise(F.lit(0).cast("bigint")).alias("number"),
            F.when(s.rlike("^[0-9]+$"), F.lit("")).otherwise(s).alias("word"),
        ),
    )
    key = F.struct(
        _number_or_zero(part(1)).alias("epoch"), numbers.alias("release"), phase_rank.alias("phase"),
        F.when(phase != "", _number_or_zero(part(4))).otherwise(F.lit(0).cast("bigint")).alias("phase_number"),
        post.alias("post"), dev.alias("dev"), local_key.alias("local"),
    )
    return F.when(text.rlike(VERSION), key)


def version_lt(left: Column, right: Column) -> Column:
    """Whether the left version is older; null where either text is not a version."""
    return version_key(left) < version_key(right)
