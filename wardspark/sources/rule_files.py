"""Signature, advisory and custom rule files. These are configuration: a few rows that become part of a plan."""

import json
import os
import re
import warnings

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardspark.catalog import patterns as cat
from wardspark.catalog.rules import DETECTOR_RULES, RULES
from wardspark.catalog.prompt_signatures import SIGNATURE_FILE
from wardspark.catalog.severity import CATEGORIES, CUSTOM_CATEGORIES, SEVERITY_NAMES
from wardspark.functions.pattern_anchors import anchors_of
from wardspark.functions.pattern_screens import screen_of
from wardspark.functions.regex import java_pattern
from wardspark.operators.prompts import default_signatures
from wardspark.schemas import CUSTOM_RULES
from wardspark.sources.local import local_table

RULE_FILE_NAMES = [".wardspark-rules.yaml", ".wardspark-rules.yml", "wardspark-rules.yaml", "wardspark-rules.yml"]


def _json_table(spark: SparkSession, path: str | None, builtin) -> DataFrame:
    """A one-row table with the file's text, or with the built-in data in the same form."""
    if path is None:
        return local_table(spark, [{"value": json.dumps(builtin)}], "value string")
    return spark.read.text(path, wholetext=True)


def load_prompt_signatures(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Signatures of a signature file, in file order: ``ord, category, name, type, weight, pattern, level``."""
    shape = "threat_categories map<string,array<struct<name:string,pattern:string,score:int,level:string,vector:string>>>"
    raw = _json_table(spark, path, {"threat_categories": SIGNATURE_FILE})
    groups = raw.select(F.posexplode(F.from_json("value", shape)["threat_categories"]).alias("group", "category", "items"))
    rows = groups.select("group", "category", F.posexplode("items").alias("place", "s"))
    order = F.row_number().over(_whole("group", "place")) - 1
    return rows.select(order.alias("ord"), "category", "s.name", F.col("s.vector").alias("type"), F.col("s.score").alias("weight"), "s.pattern", "s.level")


def _whole(*order):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)  # a rule file, not data


def all_signatures(spark: SparkSession, path: str | None = None) -> list[dict]:
    """What ``score_prompts`` takes: the file's signatures, then the built-in ones."""
    if path is None:
        return default_signatures()
    rows = load_prompt_signatures(spark, path).orderBy("ord").collect()
    from_file = [{"type": r["type"], "weight": r["weight"], "pattern": r["pattern"], "anchors": anchors_of(r["pattern"])} for r in rows]
    return from_file + [s for s in default_signatures() if s["type"] not in {v["vector"] for g in SIGNATURE_FILE.values() for v in g}]


def signature_table(spark: SparkSession, signatures: list[dict] | None = None) -> DataFrame:
    rows = [{"ord": i, **s} for i, s in enumerate(signatures or default_signatures())]
    return local_table(spark, rows, "ord int, type string, weight int, pattern string")


def load_signature_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rows of a retrieval signature file with the severity in upper case; incomplete or unknown ones are skipped."""
    details = {r["rule_id"]: r for r in DETECTOR_RULES}
    builtin = [
        {"id": p["rule_id"], "title": details[p["rule_id"]]["title"], "pattern": p["pattern"], "severity": details[p["rule_id"]]["severity"],
         "cwe": details[p["rule_id"]]["cwe_id"], "owasp": details[p["rule_id"]]["owasp_id"], "remediation": details[p["rule_id"]]["remediation"]}
        for p in cat.RAG_PATTERNS
    ]
    fields = ("id", "title", "pattern", "severity", "cwe", "owasp", "remediation")
    shape = f"signatures array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    rows = _json_table(spark, path, {"signatures": builtin}).select(F.explode(F.from_json("value", shape)["signatures"]).alias("s")).select("s.*")
    complete = rows.dropna(subset=list(fields)).withColumn("severity", F.upper("severity"))
    return complete.where(F.col("severity").isin(SEVERITY_NAMES))


SECRET_RULES = "id string, provider string, pattern string, title string, severity string, cwe string, owasp string, remediation string"


def read_secret_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a secret signature file, in file order: ``ord`` and the fields as the file gives them."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", f"signatures array<struct<{','.join(f.replace(' ', ':') for f in SECRET_RULES.split(', '))}>>")["signatures"]).alias("ord", "s"))
    return rows.select("ord", "s.*")


def compile_secret_rules(rules: DataFrame) -> list[dict]:
    """Secret signatures as ``scan_artifacts`` takes them: line patterns that go before the built-in ones.

    A file is read up to the first row without id, pattern or provider, with a pattern that does not compile, or with an unknown severity; a
    warning names that row and the number of rows behind it. Title and description are the catalogue's for rules it knows, unless the file gives a title.
    """
    known, blank, compiled = {r["rule_id"] for r in RULES + DETECTOR_RULES}, local_table(rules.sparkSession, [{"t": ""}], "t string"), []
    rows = rules.orderBy("ord").collect()
    for row in rows:
        severity = row["severity"] or "CRITICAL"
        if row["id"] is None or row["provider"] is None:
            reason = "no id or provider"
        elif severity not in SEVERITY_NAMES:
            reason = f"unknown severity {severity}"
        else:
            reason = _refusal(blank, row["pattern"])
        if reason:
            warnings.warn(f"secret signature {row['id']}: {reason}; {len(rows) - len(compiled)} rows from there on are left out", stacklevel=2)
            break
        given = row["id"] in known
        attrs = {
            "title": row["title"] or (None if given else f"Exposed secret ({row['id']})"), "severity": severity, "cwe_id": row["cwe"] or "CWE-798",
            "owasp_id": row["owasp"] or "LLM06:2025-Sensitive-Info-Disclosure", "remediation": row["remediation"] or "Keep the key in a vault or in the environment.",
            "description": None if given else f"A key or token of {row['provider']} is written out.",
        }
        compiled.append({"rule_id": row["id"], "pattern": java_pattern(to_java(row["pattern"])), "ignore_case": False, "anchors": anchors_of(row["pattern"]), "attrs": attrs})
    return compiled


def load_secret_rules(spark: SparkSession, path: str) -> list[dict]:
    return compile_secret_rules(read_secret_rules(spark, path))


def load_advisories(spark: SparkSession, path: str) -> DataFrame:
    """An advisory file in file order."""
    fields = ("package", "vulnerable_below", "cve", "severity", "cwe", "owasp", "description", "remediation")
    shape = f"advisories array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", shape)["advisories"]).alias("adv_ord", "a")).select("adv_ord", "a.*")


def find_rule_file(path: str | None = None, directories: list[str] | None = None) -> str | None:
    """The given file if it exists, else the first known name in the directories."""
    if path and os.path.exists(path):
        return path
    for directory in directories or ["."]:
        for name in RULE_FILE_NAMES:
            if os.path.exists(os.path.join(directory, name)):
                return os.path.join(directory, name)
    return None


def read_custom_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table of a YAML or JSON rule file (which is YAML too); entries without id or pattern are left out."""
    import yaml  # a file that cannot be read for want of this package must not look like a file without rules

    with open(path, encoding="utf-8") as handle:
        data = yaml.safe_load(handle)
    entries = (data.get("rules") if isinstance(data, dict) else None) or []
    if not isinstance(entries, list):
        raise ValueError(f"{path}: rules is no list")
    kept = [e for e in entries if isinstance(e, dict) and "id" in e and "pattern" in e]
    text = lambda name, value: value if value is None or name == "file_extensions" else str(value)
    return local_table(spark, [{name: text(name, value) for name, value in e.items()} for e in kept], CUSTOM_RULES)


def normalize_custom_rules(rules: DataFrame) -> DataFrame:
    """Rules with defaults filled in: severity medium, category code injection, name the id."""
    severity = F.upper(F.coalesce("severity", F.lit("medium")))
    category = F.create_map(*[F.lit(x) for pair in CUSTOM_CATEGORIES.items() for x in pair])[F.lower(F.coalesce("category", F.lit("code_injection")))]
    return rules.where("id is not null and pattern is not null").select(
        "id", F.coalesce("name", "id").alias("name"),
        F.when(severity.isin(SEVERITY_NAMES), severity).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.coalesce(category, F.lit(CATEGORIES["CODE_INJECTION"])).alias("category"),
        "pattern", "message", F.coalesce("remediation", F.lit("Look at the match and correct it.")).alias("remediation"),
        F.coalesce("cwe", F.lit("")).alias("cwe"), F.coalesce("owasp", F.lit("")).alias("owasp"),
        F.transform(F.coalesce("file_extensions", F.array().cast("array<string>")), lambda e: F.lower(e)).alias("file_extensions"),
    )


_PIECE = re.compile(
    r"\\(?:Z|.)|\(\?P<(?P<group>\w+)>|\(\?P=(?P<back>\w+)\)|\(\?\((?P<test>\w+)\)|^\(\?(?P<flags>[aimsxu]+)\)|(?P<count>\{[0-9]*,?[0-9]*\})|[\[{&]|[^\\(\[{&]+|\(", re.DOTALL)


def to_java(pattern: str) -> str:
    """A Python pattern in Java spelling.

    Differences that are seen to: names of groups (Java's have no underscore), back references, the end-of-text mark, the ASCII flag,
    braces that count nothing, opening brackets and ampersands inside a class. Conditional groups have no Java form.
    """
    out, names, at = [], {}, 0
    java_name = lambda name: names.setdefault(name, f"g{len(names)}x" + re.sub("[^A-Za-z0-9]", "", name))
    while at < len(pattern):
        piece = _PIECE.match(pattern, at)
        at = piece.end()
        if piece["group"]:
            out.append(f"(?<{java_name(piece['group'])}>")
        elif piece["back"]:
            out.append(rf"\k<{java_name(piece['back'])}>")
        elif piece["flags"]:
            flags = piece["flags"].replace("u", "")
            on = flags.replace("a", "")
            out.append((f"(?{on})" if on else "") + ("(?-U)" if "a" in flags else ""))
        elif piece["count"]:
            text = piece["count"]
            counts = re.fullmatch(r"\{([0-9]*)(,?)([0-9]*)\}", text)
            out.append("{0," + text[2:] if text.startswith("{,") and counts[3] else text if counts[1] else "\\" + text)
        elif piece[0] == "{":
            out.append(r"\{")
        elif piece[0] == "[":
            inside, at = _java_class(pattern, at)
            out.append(inside)
        else:
            out.append({r"\Z": r"\z"}.get(piece[0], piece[0]))
    return "".join(out)


def _java_class(pattern: str, at: int) -> tuple[str, int]:
    """A character class, from behind its opening bracket, and where it ends."""
    head = "^" if pattern.startswith("^", at) else ""
    at += len(head)
    body = []
    while at < len(pattern) and (pattern[at] != "]" or not body):
        if pattern[at] == "\\":
            body.append(pattern[at : at + 2])
            at += 2
        else:
            body.append("\\" + pattern[at] if pattern[at] in "[]&" else pattern[at])
            at += 1
    return f"[{head}{''.join(body)}]", at + 1


RULE_STATUS = "id string, accepted boolean, reason string"


def _refusal(blank: DataFrame, pattern: str | None) -> str | None:
    """Why a pattern cannot be used; null if it can. The look at it is over a local row: no job runs."""
    if pattern is None:
        return "no pattern"
    try:
        re.compile(pattern)
        blank.select(F.col("t").rlike("(?dU)" + to_java(pattern))).collect()
    except re.error:
        return "the pattern does not compile"
    except PySparkException:
        return "the pattern has no Java form"
    return None


def check_custom_rules(rules: DataFrame) -> list[dict]:
    """``id, accepted, reason`` of every rule, in order: nothing is left out without saying so."""
    blank = local_table(rules.sparkSession, [{"t": ""}], "t string")
    reasons = [(r["id"], "no id" if r["id"] is None else _refusal(blank, r["pattern"])) for r in rules.select("id", "pattern").collect()]
    return [{"id": rule, "accepted": reason is None, "reason": reason} for rule, reason in reasons]


def compile_custom_rules(rules: DataFrame) -> list[dict]:
    """The rules as ``scan_artifacts`` takes them. Those that cannot be used are left out with a warning that names them and the
    reason; ``check_custom_rules`` gives the same as rows.

    A rule table is configuration, so its rows are read by the driver and each pattern becomes a literal of the plan:
    Spark then compiles it once per task instead of once per row.
    """
    blank, compiled = local_table(rules.sparkSession, [{"t": ""}], "t string"), []
    for row in normalize_custom_rules(rules).collect():
        reason = _refusal(blank, row["pattern"])
        if reason:
            warnings.warn(f"custom rule {row['id']}: {reason}", stacklevel=2)
        else:
            compiled.append(row.asDict() | {"pattern": to_java(row["pattern"]), "anchors": anchors_of(row["pattern"]), "screen": screen_of(row["pattern"])})
    return compiled


def load_custom_rules(spark: SparkSession, path: str | None = None, directories: list[str] | None = None) -> list[dict]:
    """Rules of the first rule file found; none if there is no file, and none with a warning if it cannot be read."""
    import yaml

    found = find_rule_file(path, directories)
    if found is None:
        return []
    try:
        return compile_custom_rules(read_custom_rules(spark, found))
    except (OSError, ValueError, yaml.YAMLError) as error:
        warnings.warn(f"rule file {found} cannot be read: {error}", stacklevel=2)
        return []
