"""Prompt threat scoring: one narrow projection, the same for tables and streams."""

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.catalog import prompt_signatures as sig
from wardspark.functions.anchors import anchor_mask, any_bit, has_bit
from wardspark.functions.cached import built_once
from wardspark.functions.entropy import shannon_entropy
from wardspark.functions.payloads import obfuscation_evidence, sanitize_prompt
from wardspark.functions.regex import find_all, java_pattern
from wardspark.functions.text import is_blank


def default_signatures() -> list[dict]:
    """All signatures in evaluation order: those of the signature file, then the built-in ones."""
    from_file = [
        {"type": s["vector"], "weight": s["score"], "pattern": s["pattern"], "anchors": s["anchors"]}
        for group in sig.SIGNATURE_FILE.values() for s in group
    ]
    return from_file + sig.BUILTIN_SIGNATURES


def threat_level(score: Column) -> Column:
    level = F.when(score > 0, F.lit("LOW")).otherwise(F.lit("INFO"))
    for bound, name in reversed(sig.THREAT_LEVELS):
        level = F.when(score >= bound, F.lit(name)).otherwise(level)
    return level


def remediation_advice(types: Column, obfuscated: Column) -> Column:
    joined = F.array_join(types, " ")
    parts = [F.when(F.contains(joined, F.lit(word)), F.lit(advice)) for word, advice in sig.ADVICE]
    advice = F.concat_ws(" ", *parts, F.when(obfuscated, F.lit(sig.ADVICE_OBFUSCATED)))
    return F.when(advice == "", F.lit(sig.ADVICE_DEFAULT)).otherwise(advice)


HITS = "array<struct<type:string,weight:double,evidence:array<string>>>"


def signature_hits(text: Column, mask: Column, signatures: list[dict]) -> Column:
    """``array<struct<type, weight, evidence>>`` of the signatures that match, in order; ``mask`` tells which can."""
    hits = []
    for i, s in enumerate(signatures):
        found = F.slice(find_all(text, java_pattern(s["pattern"], ignore_case=True)), 1, sig.EVIDENCE_PER_RULE)
        possible = has_bit(mask, i) if s.get("anchors") else F.lit(True)
        hits.append(
            F.struct(
                F.lit(s["type"]).alias("type"), F.lit(float(s["weight"])).alias("weight"),
                F.when(possible, found).otherwise(F.array().cast("array<string>")).alias("evidence"),
            )
        )
    matched = F.filter(F.array(*hits), lambda h: F.size(h["evidence"]) > 0)
    if not all(s.get("anchors") for s in signatures):
        return matched
    return F.when(any_bit(mask), matched).otherwise(F.array().cast(HITS))


def score_prompts(df: DataFrame, text_col: str = "text", signatures: list[dict] | None = None) -> DataFrame:
    """Adds the threat assessment of ``text_col`` to every row.

    Columns added: is_threat, threat_score, threat_level, threat_types, matched_patterns, sanitized_prompt,
    remediation_advice, entropy_score, obfuscation_detected.
    """
    text = F.col(text_col)
    hits = signature_hits(text, F.col("_mask"), signatures) if signatures else _default_hits(text_col)
    staged = df.withColumns({
        "_mask": anchor_mask(text, [s.get("anchors") or [] for s in signatures or default_signatures()]),
        "_entropy": shannon_entropy(text),
        "_blank": is_blank(text),
    }).withColumns({
        "_hits": F.when(F.col("_blank"), F.array().cast(HITS)).otherwise(hits),
        "_hidden": F.when(~F.col("_blank"), obfuscation_evidence(text)),
    })
    assessed = _assessment(text_col)
    return staged.withColumns(assessed[0]).withColumns(assessed[1]).drop("_mask", "_blank", "_hits", "_hidden", "_entropy")


@built_once
def _default_hits(text_col: str) -> Column:
    return signature_hits(F.col(text_col), F.col("_mask"), default_signatures())


@built_once
def _assessment(text_col: str) -> tuple[dict, dict]:
    """The assessment columns, and those that follow from them."""
    text, blank, hits = F.col(text_col), F.col("_blank"), F.col("_hits")
    hidden, entropy = F.col("_hidden").isNotNull(), F.when(blank, F.lit(0.0)).otherwise(F.col("_entropy"))
    odd = (entropy > sig.ENTROPY_MIN) & (F.length(text) > sig.ENTROPY_MIN_LENGTH)
    optional = lambda condition, value: F.when(condition, F.array(value)).otherwise(F.array().cast("array<string>"))
    first = {
        "threat_score": F.least(
            F.lit(100.0),
            F.aggregate(hits, F.lit(0.0), lambda total, h: total + h["weight"])
            + F.when(hidden, F.lit(float(sig.OBFUSCATION_WEIGHT))).otherwise(0.0)
            + F.when(odd, F.lit(float(sig.ENTROPY_WEIGHT))).otherwise(0.0),
        ),
        "threat_types": F.concat(
            F.transform(hits, lambda h: h["type"]),
            optional(hidden, F.lit(sig.OBFUSCATION_TYPE)), optional(odd, F.lit(sig.ENTROPY_TYPE)),
        ),
        "matched_patterns": F.concat(F.flatten(F.transform(hits, lambda h: h["evidence"])), optional(hidden, F.col("_hidden"))),
        "sanitized_prompt": F.when(blank, F.lit("")).otherwise(sanitize_prompt(text)),
        "entropy_score": F.round(entropy, 2),
        "obfuscation_detected": hidden,
    }
    second = {
        "is_threat": F.col("threat_score") >= sig.THREAT_MIN,
        "threat_level": threat_level(F.col("threat_score")),
        "remediation_advice": F.when(blank, F.lit(sig.ADVICE_BLANK)).otherwise(
            remediation_advice(F.col("threat_types"), F.col("obfuscation_detected"))
        ),
    }
    return first, second


def threat_summary(scored: DataFrame, *keys: str) -> DataFrame:
    """Prompt counts, threat counts and score totals per key."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("prompts"),
        F.count_if("is_threat").alias("threats"),
        *[F.count_if(F.col("threat_level") == level).alias(level.lower()) for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")],
        F.count_if("obfuscation_detected").alias("obfuscated"),
        F.sum("threat_score").alias("score_total"),
        F.max("threat_score").alias("score_max"),
    )
