"""The artifact scan: every detector in one narrow pass, then one table of findings.

``scan_artifacts`` reads each artifact once and keeps its hits in an array, so it needs no shuffle and carries no
content onward. ``resolve_findings`` turns the arrays into the findings table.
"""

import json

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.catalog import patterns as cat
from wardspark.catalog.rules import DETECTOR_RULES, RULES
from wardspark.functions.anchors import any_bit, in_own_words, text_facts
from wardspark.functions.cached import built_once
from wardspark.functions.identifiers import finding_id, mask_match, rule_family
from wardspark.functions.pattern_anchors import anchors_of
from wardspark.functions.slices import small_batches
from wardspark.functions.text import snippet, split_lines
from wardspark.operators import code_rules, line_rules, supply, text_rules
from wardspark.operators.hits import HITS, join_arrays
from wardspark.operators.registry import Detectors
from wardspark.schemas import FINDING_COLUMNS
from wardspark.sources.local import local_table

# Anchor groups of all patterns; a rule's bit is its place in this list.
_PARTS = {
    "lines": line_rules.LINE_GROUPS, "checks": line_rules.CHECK_GROUPS, "rag": text_rules.RAG_GROUPS,
    "agent": text_rules.AGENT_GROUPS, "ssl": [text_rules.SSL_GROUP], "code": [code_rules.CODE_GROUP],
}
GROUPS = [group for part in _PARTS.values() for group in part]
_FIRST = dict(zip(_PARTS, [sum(len(p) for p in list(_PARTS.values())[:i]) for i in range(len(_PARTS))]))


@built_once
def _detector_hits(name: str) -> list[Column]:
    """The hit arrays of one built-in detector over the staged columns."""
    path, content, lines, mask = F.col("path"), F.col("content"), F.col("_lines"), F.col("_mask")
    if name == "ast":
        return [code_rules.code_hits(F.col("facts"))]
    if name == "secrets":
        return [line_rules.line_pattern_hits(lines, mask, line_rules.builtin_rules(_FIRST["lines"]))]
    if name == "owasp":
        return [line_rules.line_check_hits(lines, mask, _FIRST["checks"])]
    if name == "supply":
        return [supply.dependency_hits(path, lines)]
    if name == "rag":
        return [text_rules.rag_hits(content, mask, _FIRST["rag"]), text_rules.unverified_loader_hits(content, lines, mask, _FIRST["ssl"])]
    if name == "agent":
        return [text_rules.agent_hits(content, mask, _FIRST["agent"])]
    return text_rules.model_hits(path, content)


@built_once
def _custom_hits(rules: str) -> Column:
    return text_rules.custom_hits(F.col("path"), F.col("content"), F.col("_mask"), json.loads(rules))


def gated(rules: list[dict] | None, groups: list[list[str]]) -> list[dict]:
    """Rules of a file with their ``anchors`` and the ``bit`` of the mask that tells which texts may match; both are None where
    the pattern has no anchors, and the rule then runs over every text. Adds the anchors to ``groups``."""
    placed = []
    for rule in rules or []:
        anchors = rule["anchors"] if "anchors" in rule else anchors_of(rule["pattern"])
        placed.append(rule | {"anchors": anchors, "bit": len(groups) if anchors else None})
        if anchors:
            groups.append(anchors)
    return placed


def screened(rules: list[dict], groups: list[list[str]]) -> tuple[list[dict], dict[int, str]]:
    """Gated rules, and the screens of those that have one, by bit. A rule without anchors that has a screen gets a bit as well."""
    placed, screens = [], {}
    for rule in rules:
        if rule.get("screen"):
            if rule["bit"] is None:
                rule = rule | {"bit": len(groups)}
                groups.append([])
            screens[rule["bit"]] = rule["screen"]
        placed.append(rule)
    return placed, screens


def staged_texts(artifacts: DataFrame, groups: list[list[str]], *kept: str, screens: dict[int, str] | None = None, code_bit: int | None = None) -> DataFrame:
    """``path, target, content, _mask, n_lines, _plain`` and kept columns: what one look at every text tells. With ``code_bit`` also ``facts``, of Python sources that have that bit or
    characters beyond ASCII."""
    small_batches(artifacts.sparkSession)
    code = None if code_bit is None else (code_rules.is_python(F.col("path")), code_bit)
    looked = artifacts.select("path", "target", "content", *kept, text_facts(F.col("content"), groups, screens, code).alias("_facts"))
    told = [F.col("_facts.mask").alias("_mask"), F.col("_facts.n_lines").alias("n_lines"), F.col("_facts.plain").alias("_plain")]
    return looked.select("path", "target", "content", *kept, *told, *[F.col("_facts.facts").alias("facts")] * (code is not None))


def rule_trials(artifacts: DataFrame, custom_rules: list[dict]) -> DataFrame:
    """``rule_id, anchors, texts, tried, matched`` of every custom rule: over how many texts its pattern has to run, and how many it matches.

    ``anchors`` is null for rules whose pattern has none; they are tried on every text with an extension they name.
    """
    groups = in_own_words(GROUPS)
    rules = gated(custom_rules, groups)
    staged = staged_texts(artifacts, groups)
    runs = F.array_compact(F.array(*[F.when(text_rules.wanted_here(F.col("path"), F.col("_mask"), r), F.struct(F.lit(i).alias("i"), F.lit(0).alias("hit"))) for i, r in enumerate(rules)]))
    matches = F.transform(F.array_distinct(F.transform(_custom_hits(json.dumps(rules)), lambda h: F.get(h["seq"], 0))), lambda i: F.struct(i.alias("i"), F.lit(1).alias("hit")))
    seen = staged.select(F.explode_outer(F.concat(runs, matches)).alias("t")).where("t is not null")
    counts = seen.groupBy(F.col("t.i").alias("i")).agg(F.count_if(F.col("t.hit") == 0).alias("tried"), F.count_if(F.col("t.hit") == 1).alias("matched"))
    named = local_table(artifacts.sparkSession, [{"i": i, "rule_id": r["id"], "anchors": r["anchors"]} for i, r in enumerate(rules)], "i int, rule_id string, anchors array<string>")
    texts = artifacts.agg(F.count("*").alias("texts"))
    return named.join(counts, "i", "left").crossJoin(texts).select("rule_id", "anchors", "texts", F.coalesce("tried", F.lit(0)).alias("tried"), F.coalesce("matched", F.lit(0)).alias("matched"))


@built_once
def _placed_hits() -> Column:
    """Hits with their snippets; a text is split for them only if it has hits and was not split for the detectors."""
    placed = lambda lines: F.transform(F.col("_hits"), lambda h: h.withField("snippet", F.coalesce(h["snippet"], snippet(lines, h["line"]))))
    lines = F.when(F.col("_split"), F.col("_lines")).otherwise(split_lines(F.coalesce("content", F.lit("")), F.col("_plain")))
    return F.when(F.size("_hits") > 0, F.get(F.transform(F.array(lines), placed), 0)).otherwise(F.col("_hits"))


def scan_artifacts(
    artifacts: DataFrame,
    custom_rules: list[dict] | None = None,
    detectors: list[str] | None = None,
    extra_detectors: list | None = None,
    signature_rules: list[dict] | None = None,
    secret_rules: list[dict] | None = None,
    registered: Detectors | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per artifact: ``path, target, n_lines, hits``, and columns of the artifacts to ``keep``.

    ``detectors`` picks among the built-in ones. ``signature_rules``, as ``load_signature_rules`` reads them, take the place of
    the built-in retrieval patterns; ``secret_rules``, as ``load_secret_rules`` gives them, are line patterns in front of the built-in ones. The
    patterns of custom, signature and secret rules run only where one of the anchors that were worked out from them stands. Each of ``extra_detectors`` is a function of the columns
    ``(path, content, lines)`` that returns an array of ``operators.hits.hit`` values; ``registered`` ones are functions of the table.
    """
    wanted = detectors or cat.DETECTORS
    groups = in_own_words(GROUPS)
    secret_rules = gated(secret_rules if "secrets" in wanted else None, groups)
    signature_rules = gated(signature_rules if "rag" in wanted else None, groups)
    custom_rules, screens = screened(gated(custom_rules if "custom" in wanted else None, groups), groups)
    own = [registered.column(name) for name in registered or []]
    staged = staged_texts(registered.applied(artifacts) if registered else artifacts, groups, *own, *keep, screens=screens, code_bit=_FIRST["code"] if "ast" in wanted else None)
    needs_lines = any_bit(F.col("_mask"), len(GROUPS)) | supply.manifest_kind(F.col("path")).isNotNull() | F.lit(bool(extra_detectors))
    for rule in secret_rules:
        needs_lines |= text_rules.possible(F.col("_mask"), rule)
    staged = staged.withColumn("_split", needs_lines & F.col("content").isNotNull())
    staged = staged.withColumn("_lines", F.when(needs_lines, split_lines(F.col("content"), F.col("_plain"))).otherwise(F.array().cast("array<string>")))
    replaced = {name for name, given in (("secrets", secret_rules), ("rag", signature_rules)) if given} | {"custom"}
    hits = [h for name in wanted if name not in replaced for h in _detector_hits(name)]
    if secret_rules:
        hits.append(line_rules.line_pattern_hits(F.col("_lines"), F.col("_mask"), secret_rules + line_rules.builtin_rules(_FIRST["lines"])))
    if signature_rules:
        hits += [text_rules.signature_hits(F.col("content"), F.col("_mask"), signature_rules), _detector_hits("rag")[1]]
    if custom_rules:
        hits.append(_custom_hits(json.dumps(custom_rules)))
    hits += [extra(F.col("path"), F.col("content"), F.col("_lines")) for extra in extra_detectors or []]
    hits += registered.hits() if registered else []
    staged = staged.select(
        "path", "target", "content", "n_lines", "_plain", "_split", "_lines", *keep,
        join_arrays([h.cast(HITS) for h in hits]).alias("_hits"),
    )
    return staged.select("path", "target", "n_lines", _placed_hits().alias("hits"), *keep)


def dedup_hits(hits: Column, by: str = "family") -> Column:
    """The first hit of every rule family (or rule, with ``by="rule_id"``) on every line, decided inside the row.

    Declared dependencies stay apart from rules that others named alike: whether they are findings is not known yet.
    """
    group = lambda h: rule_family(h["rule_id"]) if by == "family" else h["rule_id"]
    keyed = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["line"].alias("line"), F.when(h["detector"] == "supply", F.lit("\u0000supply")).otherwise(group(h)).alias("family"), h["detector_ord"].alias("ord"), h["seq"].alias("seq"), h.alias("hit"),
    ).alias("x")), _by_place)
    kept = F.filter(keyed, lambda x, i: (i == 0) | ~(
        (F.get(keyed, i - 1)["line"] == x["line"]) & (F.get(keyed, i - 1)["family"] == x["family"])
    ))
    return F.transform(kept, lambda x: x["hit"])


def _by_place(a: Column, b: Column) -> Column:
    order = lambda x: F.struct(x["line"], x["family"], x["ord"], x["seq"])
    return F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)


def rule_table(spark, rows: list[dict] | None = None) -> DataFrame:
    """The rule catalogue as a table."""
    return local_table(
        spark, rows if rows is not None else RULES,
        "rule_id string, title string, category string, severity string, cwe_id string, owasp_id string, description string, "
        "remediation string, good_example string, bad_example string, tags array<string>",
    )


def enrich_findings(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Fills title, severity, standards and texts: the hit's own value first, then the catalogue's, then a default."""
    named, filled = _enrichment()
    return hits.join(rules.select(*named), "rule_id", "left").select(*hits.columns, *filled)


@built_once
def _enrichment() -> tuple[list[Column], list[Column]]:
    """The catalogue columns to join, and the columns to fill from hit and catalogue."""
    fields = ("title", "category", "severity", "cwe_id", "owasp_id", "description", "remediation")
    own = lambda field: F.try_element_at(F.col("attrs"), F.lit(field))
    pick = lambda field, default: F.coalesce(own(field), F.col(f"_{field}"), default if isinstance(default, Column) else F.lit(default)).alias(field)
    unknown = F.raise_error(F.concat(F.lit("neither the hit nor the catalogue describes rule "), "rule_id")).cast("string")
    return [F.col("rule_id"), *[F.col(c).alias(f"_{c}") for c in fields]], [
        pick("title", unknown), pick("category", "Hardcoded AI Secrets & Credentials"), pick("severity", "CRITICAL"),
        pick("cwe_id", "CWE-798"), pick("owasp_id", "LLM06:2025-Sensitive-Info-Disclosure"),
        pick("description", ""), pick("remediation", "Remove the hard-coded secret."),
    ]


def explode_hits(scanned: DataFrame) -> DataFrame:
    """One row per hit.

    The outer form with a test afterwards: for a plain explode the optimizer adds a test on the array below it, which
    would work out all hits once more.
    """
    rows = scanned.selectExpr("path as file_path", "target", "explode_outer(hits) as h").where("h is not null")
    return rows.select("file_path", "target", "h.*")


@built_once
def _advisory_attrs() -> Column:
    """What an advisory says about a dependency hit, as hit attributes."""
    a = F.col("advisory")
    return F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("package", "version", "cve", "safe_version", "title", "category", "severity", "cwe_id", "owasp_id", "description", "remediation")]),
        F.array(
            F.col("package"), F.col("version"), a["cve"], a["vulnerable_below"],
            F.concat(F.lit("Vulnerable dependency: "), F.col("package"), F.lit("=="), F.col("version")),
            F.lit("LLM05: Supply Chain & Insecure Checkpoints"),
            F.when(F.upper(a["severity"]).isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.upper(a["severity"])).otherwise(F.lit("MEDIUM")),
            a["cwe"], a["owasp"],
            F.concat(a["cve"], F.lit(": "), a["description"], F.lit(" (Detected: "), F.col("package"), F.lit("=="), F.col("version"),
                     F.lit(", safe version: >="), a["vulnerable_below"], F.lit(")")),
            a["remediation"],
        ),
    )


def _with_advisories(hits: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependency hits become findings where an advisory covers them and vanish where none does."""
    named = hits.selectExpr("*", *[f"case when detector = 'supply' then try_element_at(attrs, '{n}') end as {n}" for n in ("package", "version")])
    met = supply.match_advisories(named, advisories, "left").where("detector <> 'supply' or advisory is not null")
    return met.withColumn("attrs", F.when(F.col("detector") == "supply", _advisory_attrs()).otherwise(F.col("attrs"))).withColumn(
        "rule_id", F.expr("case when detector = 'supply' then concat('SC-', replace(advisory.cve, '-', '')) else rule_id end")
    ).drop("package", "version", "advisory")


def as_findings(enriched: DataFrame) -> DataFrame:
    """Enriched hits in the shape of the findings table."""
    return enriched.select(*_finding_columns())


@built_once
def _finding_columns() -> list[Column]:
    detector, rule, line = F.col("detector"), F.col("rule_id"), F.col("line")
    bare_id = rule.like("MODEL-%") & (detector == "model")
    new_id = (
        F.when(bare_id, rule).when(detector == "secrets", finding_id(rule, line, F.col("col"))).otherwise(finding_id(rule, line))
    )
    description = (
        F.when(detector == "secrets", F.concat(F.col("description"), F.lit(" (Matched: "), mask_match(F.col("match")), F.lit(")")))
        .when((detector == "rag") & F.col("match").isNotNull(),
              F.concat(F.lit("Retrieval risk: "), F.col("title"), F.lit(" (Matched: "), F.col("match"), F.lit(")")))
        .otherwise(F.col("description"))
    )
    names = F.create_map(*[F.lit(x) for pair in cat.DETECTOR_NAMES.items() for x in pair])
    confidences = F.create_map(*[F.lit(x) for pair in cat.CONFIDENCE.items() for x in pair])
    by_rule = F.create_map(*[F.lit(x) for pair in cat.CONFIDENCE_BY_RULE.items() for x in pair])
    attr = lambda name: F.try_element_at(F.col("attrs"), F.lit(name))
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    metadata = F.map_from_entries(F.filter(F.array(
        entry("detector", F.coalesce(names[detector], detector)),
        entry("rule_id", F.when((detector != "supply") & ~rule.like("MODEL-UNSAFE-FMT-%"), rule)),
        entry("match", F.when(detector == "secrets", mask_match(F.col("match"))).when(detector == "custom", F.col("match"))),
        entry("match_sha256", F.when(detector == "secrets", F.sha2(F.col("match"), 256))),
        *[entry(name, attr(name)) for name in ("package", "version", "cve", "safe_version", "extension")],
    ), lambda e: e["value"].isNotNull()))
    return [
        new_id.alias("finding_id"), "rule_id", rule_family(rule).alias("family"), detector.alias("detector"), "detector_ord", "seq",
        "title", "category", "severity", description.alias("description"), "file_path", "target",
        line.alias("line_number"), F.col("col").alias("column_number"), F.col("snippet").alias("code_snippet"), "remediation",
        "cwe_id", "owasp_id", F.coalesce(F.try_element_at(by_rule, rule), confidences[detector], attr("confidence").try_cast("double"), F.lit(0.85)).alias("confidence"), metadata.alias("metadata"),
    ]


def resolve_findings(scanned: DataFrame, advisories: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """All findings of a scan, before de-duplication."""
    spark = scanned.sparkSession
    if rules is None:
        rules = rule_table(spark, RULES + DETECTOR_RULES)
    if advisories is None:
        advisories = supply.advisory_table(spark)
    hits = _with_advisories(explode_hits(scanned), advisories)
    return as_findings(enrich_findings(hits, rules)).select(FINDING_COLUMNS)
