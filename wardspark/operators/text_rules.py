"""Rules over a whole artifact: retrieval and agent patterns, model files, custom patterns."""

from itertools import groupby

from pyspark.sql import Column, functions as F

from wardspark.catalog import patterns as cat
from wardspark.catalog.rules import UNSAFE_WEIGHT_FORMATS
from wardspark.functions.anchors import any_of_word, has_bit, word_at
from wardspark.functions.regex import any_contains, find_all, java_pattern, marked, places
from wardspark.functions.text import basename, suffix
from wardspark.operators.hits import hit, join_arrays, no_hits, only_if

RAG_GROUPS = [p["anchors"] for p in cat.RAG_PATTERNS]
AGENT_GROUPS = [p["anchors"] for p in cat.AGENT_PATTERNS]
SSL_GROUP = [flag.lower() for flag in cat.SSL_FLAGS]
_SHOWN = 80


def _matched(rule_id: str, order: int, content: Column, pattern: str, possible: Column) -> Column:
    """The marked text and the matches of a pattern; null without a match, which a first look settles."""
    row = F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(order).alias("order"),
        marked(content, pattern).alias("marked"), find_all(content, pattern).alias("matches"),
    )
    return F.when(possible & content.rlike(pattern), row)


def possible(mask: Column, rule: dict) -> Column:
    """Whether a rule can match at all, as far as its anchors tell."""
    return F.lit(True) if rule["bit"] is None else has_bit(mask, rule["bit"])


def _pattern_hits(detector: str, rules: list[dict], content: Column, mask: Column, first_bit: int) -> Column:
    found = F.array_compact(F.array(*[
        _matched(r["rule_id"], i, content, java_pattern(r["pattern"], True, r["dotall"]), has_bit(mask, first_bit + i)) for i, r in enumerate(rules)
    ]))
    return F.flatten(F.transform(found, lambda y: F.transform(
        places(y["marked"], y["matches"]),
        lambda m: hit(detector, y["rule_id"], m["line"], m["col"], [y["order"], m["ordinal"], 0], F.substring(m["text"], 1, _SHOWN)),
    )))


def rag_hits(content: Column, mask: Column, first_bit: int) -> Column:
    return _pattern_hits("rag", cat.RAG_PATTERNS, content, mask, first_bit)


def signature_hits(content: Column, mask: Column, rules: list[dict]) -> Column:
    """Matches of retrieval signatures out of a file, with the details the file gives. ``bit`` tells which texts a rule can match; None stands for all."""
    fields = {"title": "title", "severity": "severity", "cwe_id": "cwe", "owasp_id": "owasp", "remediation": "remediation"}
    found = F.array_compact(F.array(*[_matched(r["id"], i, content, java_pattern(r["pattern"], True, True), possible(mask, r)) for i, r in enumerate(rules)]))
    detail = lambda field, order: F.get(F.array(*[F.lit(r.get(field)).cast("string") for r in rules]), order)
    return F.flatten(F.transform(found, lambda y: F.transform(
        places(y["marked"], y["matches"]),
        lambda m: hit("rag", y["rule_id"], m["line"], m["col"], [y["order"], m["ordinal"], 0], F.substring(m["text"], 1, _SHOWN),
                      {name: detail(field, y["order"]) for name, field in fields.items()}),
    )))


def agent_hits(content: Column, mask: Column, first_bit: int) -> Column:
    return _pattern_hits("agent", cat.AGENT_PATTERNS, content, mask, first_bit)


def unverified_loader_hits(content: Column, lines: Column, mask: Column, bit: int) -> Column:
    """A web loader with certificate checks off, next to a retrieval library; placed on the first such line."""
    together = (
        has_bit(mask, bit) & any_contains(content, cat.SSL_LIBRARIES)
        & any_contains(content, cat.SSL_LOADERS) & any_contains(content, cat.SSL_FLAGS)
    )
    line = F.greatest(F.lit(1), F.array_position(F.transform(lines, lambda l: any_contains(l, cat.SSL_FLAGS)), F.lit(True)))
    return only_if(together, F.array(hit("rag", cat.SSL_RULE_ID, line, 1, [len(cat.RAG_PATTERNS), 0, 0])))


def model_hits(path: Column, content: Column) -> list[Column]:
    """Weight files in formats that can carry code, by name alone, and configurations that name remote code."""
    ext, name = F.lower(suffix(path)), basename(path)
    bare = F.replace(ext, F.lit("."), F.lit(""))
    told = F.create_map(*[F.lit(x) for pair in UNSAFE_WEIGHT_FORMATS.items() for x in pair])
    weights = hit(
        "model", F.concat(F.lit("MODEL-UNSAFE-FMT-"), F.upper(bare)), 1, 1, [0, 0, 0],
        attrs={
            "title": F.concat(F.lit("Weight file that can carry code: "), ext),
            "category": "LLM05: Supply Chain & Insecure Checkpoints", "severity": "HIGH",
            "description": F.concat(F.lit("'"), name, F.lit("' is "), F.try_element_at(told, bare), F.lit(".")),
            "remediation": "Convert the weights to safetensors.", "cwe_id": "CWE-502",
            "owasp_id": "LLM05:2025-Supply-Chain", "extension": ext,
        },
        snippet=F.concat(F.lit("# Artifact file: "), name, F.lit(" ("), ext, F.lit(")")),
    )
    config = hit("model", "MODEL-CUSTOM-CODE-001", 1, 1, [1, 0, 0], snippet=F.substring(content, 1, 200))
    return [
        only_if(bare.isin(*UNSAFE_WEIGHT_FORMATS) & (ext != ""), F.array(weights)),
        only_if((F.lower(name) == "config.json") & any_contains(content, ['"auto_map"', '"custom_code"']), F.array(config)),
    ]


def wanted_here(path: Column, mask: Column, rule: dict) -> Column:
    """Whether a custom rule's pattern has to run: the text has one of its anchors, and the extension is one it names."""
    named = F.lower(suffix(path)).isin(*rule["file_extensions"]) if rule["file_extensions"] else F.lit(True)
    return possible(mask, rule) & named


def custom_hits(path: Column, content: Column, mask: Column, rules: list[dict]) -> Column:
    """Matches of user-supplied patterns, each limited to the file extensions it names and to texts with one of its anchors."""
    if not rules:
        return no_hits()
    fields = ("name", "category", "severity", "message", "remediation", "cwe", "owasp")
    told = {f: F.array(*[F.lit(r[f]).cast("string") for r in rules]) for f in fields}

    def matched(numbered: list[tuple[int, dict]]) -> Column:
        found = F.array_compact(F.array(*[_matched(r["id"], i, content, "(?dU)" + r["pattern"], wanted_here(path, mask, r)) for i, r in numbered]))
        word = word_of(numbered[0][1])
        return found if word is None else F.when(any_of_word(mask, word), found)  # most words of the mask are zero

    def made(y: Column, m: Column) -> Column:
        default = F.concat(F.lit("Custom rule "), y["rule_id"], F.lit(" matched at line "), m["line"].cast("string"), F.lit("."))
        own = {f: F.get(told[f], y["order"]) for f in fields}
        attrs = {
            "title": own["name"], "category": own["category"], "severity": own["severity"], "description": F.coalesce(own["message"], default),
            "remediation": own["remediation"], "cwe_id": own["cwe"], "owasp_id": own["owasp"],
        }
        return hit("custom", y["rule_id"], m["line"], m["col"], [y["order"], m["ordinal"], 0], F.substring(m["text"], 1, _SHOWN), attrs)

    word_of = lambda rule: None if rule["bit"] is None else word_at(rule["bit"])
    found = join_arrays([matched(list(part)) for _, part in groupby(enumerate(rules), lambda x: word_of(x[1]))])
    return F.flatten(F.transform(found, lambda y: F.transform(places(y["marked"], y["matches"]), lambda m: made(y, m))))
