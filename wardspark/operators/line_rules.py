"""Rules that look at one line at a time: leaked keys and risky lines, and substring checks."""

from pyspark.sql import Column, functions as F

from wardspark.catalog import patterns as cat
from wardspark.functions.anchors import FOLDING, has_bit
from wardspark.functions.entropy import short_entropy
from wardspark.functions.regex import any_contains, find_all, java_pattern, marked, places
from wardspark.functions.text import is_blank
from wardspark.operators.hits import hit, join_arrays

LINE_GROUPS = [p["anchors"] for p in cat.LINE_PATTERNS]
_COMMENT = r"(?U)^[\s\x1c-\x1f]*#"
CHECK_GROUPS = [[w.lower() for w in c["any"]] for c in cat.SUBSTRING_CHECKS]


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))


def plausible_secret(rule_id: Column, match: Column) -> Column:
    """False for long key-like matches of low entropy, which are placeholders."""
    dull = F.startswith(rule_id, F.lit(cat.KEY_RULE_PREFIX)) & (F.length(match) > cat.KEY_MIN_LENGTH) & ~any_contains(match, cat.KEY_EXEMPT)
    return F.when(dull, short_entropy(match) >= cat.KEY_MIN_ENTROPY).otherwise(F.lit(True))


def builtin_rules(first_bit: int) -> list[dict]:
    return [r | {"pattern": java_pattern(r["pattern"], r["ignore_case"]), "bit": first_bit + i} for i, r in enumerate(cat.LINE_PATTERNS)]


def line_pattern_hits(lines: Column, mask: Column, rules: list[dict]) -> Column:
    """Every match of every line pattern. Each pattern marks its own lines; places are worked out for all at once.

    A rule with a ``bit`` looks only at texts that may match, and there at lines with one of its anchors. Rules from a file have ``attrs``, which say what
    the catalogue does not, and do not look at blank lines.
    """
    rows = numbered(lines)

    def marked_lines(order: int, rule: dict) -> Column:
        pattern, ci = rule["pattern"], rule["ignore_case"] or "attrs" in rule  # anchors that were worked out are in lower case
        if rule["bit"] is None:
            candidates = F.filter(rows, lambda x: x["text"].rlike(pattern))
        else:
            candidates = F.filter(rows, lambda x: any_contains(F.lower(x["text"]) if ci else x["text"], rule["anchors"] + (FOLDING if ci else [])))
        if "attrs" in rule:
            candidates = F.filter(candidates, lambda x: ~is_blank(x["text"]))
        return F.transform(candidates, lambda x: F.struct(
            F.lit(rule["rule_id"]).alias("rule_id"), F.lit(order).alias("order"), x["line"].alias("line"),
            marked(x["text"], pattern).alias("marked"), find_all(x["text"], pattern).alias("matches"),
        ))

    found = join_arrays([marked_lines(i, r) if r["bit"] is None else F.when(has_bit(mask, r["bit"]), marked_lines(i, r)) for i, r in enumerate(rules)])
    fields = sorted({name for r in rules for name in r.get("attrs", {})})
    told = {f: F.array(*[F.lit(r.get("attrs", {}).get(f)).cast("string") for r in rules]) for f in fields}

    def made(y: Column, m: Column) -> Column:
        attrs = {f: F.get(told[f], y["order"]) for f in fields}
        return hit("secrets", y["rule_id"], y["line"], m["col"], [y["line"], y["order"], m["ordinal"]], m["text"], attrs)

    return F.flatten(F.transform(found, lambda y: F.transform(
        F.filter(places(y["marked"], y["matches"]), lambda m: plausible_secret(y["rule_id"], m["text"])),
        lambda m: made(y, m),
    )))


def line_check_hits(lines: Column, mask: Column, first_bit: int) -> Column:
    """One hit per line and substring check; comment lines are skipped."""
    rows = numbered(lines)

    def flagged(order: int, check: dict) -> Column:
        wanted = F.filter(rows, lambda x: any_contains(x["text"], check["any"]) & ~any_contains(x["text"], check["none"]) & ~x["text"].rlike(_COMMENT))
        return F.transform(wanted, lambda x: F.struct(F.lit(check["rule_id"]).alias("rule_id"), F.lit(order).alias("order"), x["line"].alias("line")))

    found = join_arrays([F.when(has_bit(mask, first_bit + i), flagged(i, c)) for i, c in enumerate(cat.SUBSTRING_CHECKS)])
    return F.transform(found, lambda y: hit("owasp", y["rule_id"], y["line"], 1, [y["line"], y["order"], 0]))
