"""SQL twins of the registered queries, for DuckDB over the same tables.

Each statement is put together from named common table expressions; only those a query needs are included.
"""

import ast

from wardspark.catalog import patterns as cat
from wardspark.catalog import prompt_signatures as sig
from wardspark.catalog.advisories import ADVISORIES
from wardspark.catalog.controls import CONTROLS
from wardspark.catalog.rules import DETECTOR_RULES, RULES, UNSAFE_WEIGHT_FORMATS
from wardspark.catalog.severity import SARIF_LEVELS, SARIF_SCORES, WEIGHTS
from wardspark.functions.anchors import FOLDING
from wardspark.functions.pattern_anchors import anchors_of
from wardspark.operators.prompts import default_signatures
from wardspark.plans import corpora
from wardspark.plans.queries import HEX40, RULE_DETECTORS, STAMP
from wardspark.schemas import VERSION

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ",\n".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else lit(v) for v in row) + ")" for row in rows)


def contains_any(text: str, words) -> str:
    return "(" + (" OR ".join(f"contains({text}, {lit(w)})" for w in words) or "FALSE") + ")"


def split_lines(text: str) -> str:
    parts = f"string_split_regex({text}, {lit(LINE_ENDS)})"
    return f"(CASE WHEN {text} IS NULL THEN [] WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def mask(m: str) -> str:
    return f"(left({m}, 8) || '...' || CASE WHEN length({m}) > 12 THEN right({m}, 4) ELSE '' END)"


def entropy(text: str) -> str:
    return f"coalesce(list_aggregate(string_split({text}, ''), 'entropy'), 0)"


# --- artifacts -----------------------------------------------------------------------------------------------------

CODE = corpora.code_corpus_sql()
LINES = f"""texts AS (SELECT path, target, slot, name, ext, content, first_line, {split_lines('content')} AS all_lines FROM code),
lines AS (SELECT path, target, slot, name, ext, all_lines, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS line_number FROM texts)"""

CATALOGUE = "catalogue(rule_id, title, category, severity, cwe_id, owasp_id) AS (" + values(
    (r["rule_id"], r["title"], r["category"], r["severity"], r["cwe_id"], r["owasp_id"]) for r in RULES + DETECTOR_RULES
) + ")"

_HIT = "path, target, {ord} AS ord, {detector} AS detector, {rule} AS rule_id"


def _head(detector: str, rule: str) -> str:
    return _HIT.format(ord=cat.DETECTORS.index(detector), detector=lit(detector), rule=rule)


def _secrets(rules=tuple(cat.LINE_PATTERNS)) -> str:
    parts = []
    for i, r in enumerate(rules):
        pattern = ("(?i)" if r["ignore_case"] else "") + r["pattern"]
        keep, match = "TRUE", "m"
        if r["rule_id"] == "SEC-DOS-001":  # the look-ahead, spelled as a condition on the argument list
            pattern = r"\.(?:create|generate|complete)\s*\([^)]*"
            keep = r"regexp_matches(m, 'model\s*=') AND NOT contains(m, 'max_tokens')"
            match = r"regexp_extract(m, '(?s)^.*model\s*=')"
        if r["rule_id"].startswith("SEC-KEY-"):
            keep = f"NOT (length(m) > 10 AND {entropy('m')} < 2.2 AND NOT contains(m, 'sk-') AND NOT contains(m, 'hf_'))"
        parts.append(f"""
  SELECT {_head('secrets', lit(r['rule_id']))}, line_number AS line, col, {match} AS match, line_number AS s1, {i} AS s2, k - 1 AS s3, all_lines FROM (
    SELECT *, ms[k] AS m, 1 + list_sum(list_transform(ps[1:k], lambda x: length(x))) AS col FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT *, regexp_extract_all(line, {lit(pattern)}) AS ms, string_split(regexp_replace(line, {lit(pattern)}, chr(1) || '\\0', 'g'), chr(1)) AS ps
        FROM lines WHERE regexp_matches(line, {lit(pattern)})))) WHERE {keep}""")
    return "secrets AS (" + " UNION ALL ".join(parts) + ")"


def _owasp() -> str:
    parts = []
    for i, c in enumerate(cat.SUBSTRING_CHECKS):
        parts.append(f"""
  SELECT {_head('owasp', lit(c['rule_id']))}, line_number AS line, 1 AS col, NULL AS match, line_number AS s1, {i} AS s2, 0 AS s3, all_lines
  FROM lines WHERE {contains_any('line', c['any'])} AND NOT {contains_any('line', c['none'])} AND NOT regexp_matches(line, '^\\s*#')""")
    return "owasp AS (" + " UNION ALL ".join(parts) + ")"


def _code() -> str:
    rows = [(slot, line, col, rule, i) for slot, (_, _, facts) in enumerate(corpora.CODE_SLOTS) for i, (line, col, rule) in enumerate(facts)]
    return f"""expected(slot, rel, col, rule, i) AS ({values(rows)}),
ast AS (SELECT {_head('ast', 'rule')}, first_line + rel - 1 AS line, col, NULL AS match, i AS s1, 0 AS s2, 0 AS s3, all_lines FROM texts JOIN expected USING (slot))"""


def _whole(name: str, source: str, rules) -> str:
    """Matches over whole texts; ``rules`` are (detector, rule, pattern, order, condition)."""
    parts = []
    for detector, rule, pattern, order, condition in rules:
        parts.append(f"""
  SELECT {_head(detector, lit(rule))}, 1 + length(prefix) - length(replace(prefix, chr(10), '')) AS line,
         length(string_split(prefix, chr(10))[-1]) + 1 AS col, left(ms[k], 80) AS match, {order} AS s1, k - 1 AS s2, 0 AS s3, all_lines FROM (
    SELECT *, array_to_string(ps[1:k], '') AS prefix FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT *, regexp_extract_all(content, {lit(pattern)}) AS ms, string_split(regexp_replace(content, {lit(pattern)}, chr(1) || '\\0', 'g'), chr(1)) AS ps
        FROM {source} WHERE {condition} AND regexp_matches(content, {lit(pattern)}))))""")
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def _rag() -> str:
    rules = [("rag", p["rule_id"], "(?is)" + p["pattern"], i, "TRUE") for i, p in enumerate(cat.RAG_PATTERNS)]
    together = " AND ".join(contains_any("content", w) for w in (cat.SSL_LIBRARIES, cat.SSL_LOADERS, cat.SSL_FLAGS))
    return _whole("rag_patterns", "texts", rules) + f""",
rag AS (SELECT * FROM rag_patterns UNION ALL
  SELECT {_head('rag', lit(cat.SSL_RULE_ID))}, list_position(list_transform(all_lines, lambda x: {contains_any('x', cat.SSL_FLAGS)}), TRUE) AS line, 1 AS col,
         NULL AS match, 3 AS s1, 0 AS s2, 0 AS s3, all_lines FROM texts WHERE {together})"""


def _agent() -> str:
    return _whole("agent", "texts", [("agent", p["rule_id"], ("(?is)" if p["dotall"] else "(?i)") + p["pattern"], i, "TRUE") for i, p in enumerate(cat.AGENT_PATTERNS)])


CUSTOM = [r for r in corpora.CUSTOM_RULES if r["id"] in ("CUSTOM-001", "CUSTOM-002", "TOKEN-001")]


def _custom(name: str = "custom", source: str = "texts") -> str:
    return _whole(name, source, [
        ("custom", r["id"], r["pattern"], i, f"ext IN ({', '.join(lit(e.lower()) for e in r['file_extensions'])})" if r["file_extensions"] else "TRUE")
        for i, r in enumerate(CUSTOM)
    ])


MODEL = f"""model AS (
  SELECT {_head('model', "'MODEL-UNSAFE-FMT-' || upper(ext[2:])")}, 1 AS line, 1 AS col, NULL AS match, 0 AS s1, 0 AS s2, 0 AS s3, all_lines
  FROM texts WHERE ext IN ({', '.join(lit('.' + e) for e in UNSAFE_WEIGHT_FORMATS)})
  UNION ALL
  SELECT {_head('model', "'MODEL-CUSTOM-CODE-001'")}, 1, 1, NULL, 1, 0, 0, all_lines
  FROM texts WHERE lower(name) = 'config.json' AND {contains_any('content', ['"auto_map"', '"custom_code"'])})"""

_DECLARED = r"([A-Za-z0-9_\-\.]+)\s*([=<>!~^]+)\s*([0-9][0-9A-Za-z\.\-\+\*]*)"
DEPS = f"""declared AS (
  SELECT *, CASE WHEN lower(name) LIKE '%requirements%.txt' OR lower(name) = 'pipfile' THEN
                   CASE WHEN trim(line) = '' OR trim(line)[1] IN ('#', '-') THEN '' ELSE trim(split_part(line, '#', 1)) END
                 ELSE line END AS decl,
         CASE WHEN lower(name) LIKE '%requirements%.txt' OR lower(name) = 'pipfile' THEN {lit('^' + _DECLARED)}
              WHEN lower(name) = 'pyproject.toml' THEN {lit('"' + _DECLARED + '"')} ELSE {lit("['" + chr(34) + "]" + _DECLARED + "['" + chr(34) + "]")} END AS form
  FROM lines WHERE lower(name) IN ({', '.join(lit(m) for m in cat.MANIFEST_FILES)})),
picked AS (
  SELECT *, CASE WHEN form = {lit('^' + _DECLARED)} THEN regexp_extract(decl, {lit('^' + _DECLARED)}, ['p', 'o', 'v'])
                 WHEN form = {lit('"' + _DECLARED + '"')} THEN regexp_extract(decl, {lit('"' + _DECLARED + '"')}, ['p', 'o', 'v'])
                 ELSE regexp_extract(decl, {lit("['" + chr(34) + "]" + _DECLARED + "['" + chr(34) + "]")}, ['p', 'o', 'v']) END AS g FROM declared),
deps AS (SELECT path, target, replace(lower(g.p), '_', '-') AS package, g.v AS version, line_number, all_lines FROM picked WHERE g.p <> '')"""


def version_key(v: str) -> str:
    low = f"lower({v})"
    number = lambda pattern: f"coalesce(TRY_CAST(nullif(regexp_extract({low}, '{pattern}', 1), '') AS BIGINT), 0)"
    release = f"list_transform(string_split(regexp_replace(regexp_extract({low}, '^([0-9]+([.][0-9]+)*)', 1), '([.]0+)+$', ''), '.'), lambda x: TRY_CAST(x AS BIGINT))"
    has = lambda pattern: f"regexp_matches({low}, '{pattern}')"
    phase = f"CASE WHEN {has('[0-9]a[0-9]*')} THEN 0 WHEN {has('[0-9]b[0-9]*')} THEN 1 WHEN {has('[0-9]rc[0-9]*')} THEN 2 WHEN {has('[.]dev')} AND NOT {has('[.]post')} THEN -1 ELSE 3 END"
    post = f"CASE WHEN {has('[.]post')} THEN {number('[.]post([0-9]*)')} ELSE -1 END"
    dev = f"CASE WHEN {has('[.]dev')} THEN {number('[.]dev([0-9]*)')} ELSE 9223372036854775807 END"
    valid = f"regexp_full_match({low}, '[0-9]+([.][0-9]+)*((a|b|rc)[0-9]*)?([.]post[0-9]+)?([.]dev[0-9]+)?([+][a-z0-9.]+)?')"
    return f"CASE WHEN {valid} THEN row({release}, {phase}, {number('(?:a|b|rc)([0-9]*)')}, {post}, {dev}, regexp_extract({low}, '[+](.*)$', 1)) END"


ADVISORY = "advisory(adv_ord, package, below, cve, severity, cwe, owasp) AS (" + values(
    (a["adv_ord"], a["package"], a["vulnerable_below"], a["cve"], a["severity"], a["cwe"], a["owasp"]) for a in ADVISORIES
) + ")"
MATCHED = f"""{ADVISORY},
covered AS (
  SELECT d.path, d.target, d.package, d.version, d.line_number, d.all_lines, a.below, a.cve, a.severity, a.cwe, a.owasp
  FROM deps d JOIN advisory a ON d.package = a.package
  WHERE {version_key('d.version')} IS NULL OR {version_key('d.version')} < {version_key('a.below')})"""
SUPPLY = f"supply AS (SELECT {_head('supply', "'SC-' || replace(cve, '-', '')")}, line_number AS line, 1 AS col, NULL AS match, line_number AS s1, 0 AS s2, 0 AS s3, all_lines, severity, cwe, owasp FROM covered)"

_PARTS = {"ast": _code(), "secrets": _secrets(), "owasp": _owasp(), "supply": f"{DEPS},\n{MATCHED},\n{SUPPLY}", "rag": _rag(), "agent": _agent(), "model": MODEL, "custom": _custom()}
_CUSTOM_ROWS = "custom_rules(rule_id, c_title, c_category, c_severity, c_cwe, c_owasp, c_message, c_remediation) AS (" + values([
    ("CUSTOM-001", "Dangerous call", "Dynamic Code Execution (eval/exec/subprocess)", "HIGH", "CWE-78", "", "dangerous_call is used.", "Use safe_call."),
    ("CUSTOM-002", "CUSTOM-002", "Dynamic Code Execution (eval/exec/subprocess)", "MEDIUM", "", "", None, "Look at the match and correct it."),
    ("TOKEN-001", "Forty hex digits", "Hardcoded AI Secrets & Credentials", "CRITICAL", "CWE-798", "LLM06", "A token is written out.", "Revoke it."),
]) + ")"
_CONFIDENCE = "CASE " + " ".join(f"WHEN h.rule_id = {lit(r)} THEN {v}" for r, v in cat.CONFIDENCE_BY_RULE.items()) + " " + " ".join(
    f"WHEN detector = {lit(d)} THEN {v}" for d, v in cat.CONFIDENCE.items()) + " END"


def findings_ctes(detectors=None, base: str = "", found: str = "found", kept: str = "kept") -> str:
    """CTEs up to ``found`` (all findings) and ``kept`` (after de-duplication)."""
    wanted = detectors or cat.DETECTORS
    union = " UNION ALL ".join(
        f"SELECT path, target, ord, detector, rule_id, line, col, match, s1, s2, s3, all_lines, "
        + ("severity, cwe, owasp" if d == "supply" else "NULL AS severity, NULL AS cwe, NULL AS owasp") + f" FROM {d}" for d in wanted
    )
    return f"""{found} AS (
  SELECT h.path AS file_path, h.target, h.ord, h.detector, h.rule_id, h.line AS line_number, h.col AS column_number, h.match, h.s1, h.s2, h.s3, h.all_lines,
         CASE WHEN h.detector = 'model' THEN h.rule_id WHEN h.detector = 'secrets' THEN h.rule_id || '-' || h.line || '-' || h.col
              ELSE h.rule_id || '-' || h.line END AS finding_id,
         split_part(h.rule_id, '-', 1) AS family,
         coalesce(h.severity, c_severity, r.severity, CASE WHEN h.detector = 'model' THEN 'HIGH' END) AS severity,
         coalesce(h.cwe, c_cwe, r.cwe_id, CASE WHEN h.detector = 'model' THEN 'CWE-502' END) AS cwe_id,
         coalesce(h.owasp, c_owasp, r.owasp_id, CASE WHEN h.detector = 'model' THEN 'LLM05:2025-Supply-Chain' END) AS owasp_id,
         coalesce(c_category, r.category, 'LLM05: Supply Chain & Insecure Checkpoints') AS category, coalesce(c_title, r.title) AS title,
         c_message, c_remediation, {_CONFIDENCE} AS confidence,
         {_detector_name('h.detector')} AS detector_name,
         CASE WHEN h.detector = 'supply' THEN 'SC-' || replace(replace(h.rule_id, 'SC-', ''), 'x', 'x') WHEN h.rule_id LIKE 'MODEL-UNSAFE-FMT-%' THEN 'MODEL-UNSAFE-FMT' ELSE h.rule_id END AS sarif_rule,
         CASE WHEN h.detector = 'supply' OR h.rule_id LIKE 'MODEL-UNSAFE-FMT-%' THEN '' ELSE h.rule_id END AS meta_rule
  FROM ({union}) h LEFT JOIN catalogue r ON r.rule_id = h.rule_id LEFT JOIN custom_rules c ON c.rule_id = h.rule_id),
{kept} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, file_path, line_number, family ORDER BY ord, s1, s2, s3) AS rn FROM {found}) WHERE rn = 1)"""


def _detector_name(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {lit(k)} THEN {lit(v)}" for k, v in cat.DETECTOR_NAMES.items()) + " END"


def scan(select: str, detectors=None, more: str = "") -> str:
    """A statement over ``found`` and ``kept``; ``more`` adds CTEs after them."""
    wanted = detectors or cat.DETECTORS
    ctes = [CODE, LINES, *[_PARTS[d] for d in wanted], CATALOGUE, _CUSTOM_ROWS, findings_ctes(wanted)]
    return "WITH " + ",\n".join(ctes + ([more] if more else [])) + "\n" + select


def weight(severity: str) -> str:
    return "CASE " + " ".join(f"WHEN {severity} = {lit(s)} THEN {w}" for s, w in WEIGHTS.items()) + " END"


def by_severity(mapping) -> str:
    return "CASE " + " ".join(f"WHEN severity = {lit(s)} THEN {lit(v)}" for s, v in mapping.items()) + " END"


COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in WEIGHTS)


def summary_ctes(texts: str = "texts", kept: str = "kept") -> str:
    zero = ", ".join(f"coalesce(n.{c}, 0) AS {c}" for c in [s.lower() for s in WEIGHTS] + ["total"])
    return f"""totals AS (SELECT target, count(*) AS files, sum(len(all_lines))::BIGINT AS lines FROM {texts} GROUP BY target),
counts AS (SELECT target, {COUNTS}, count(*) AS total FROM {kept} GROUP BY target),
summary AS (
  SELECT *, round(greatest(0.0, 100.0 - (25 * critical + 15 * high + 5 * medium + 1.5 * low + 0.2 * info))::DOUBLE, 1) AS security_score
  FROM (SELECT t.target, files, lines, {zero} FROM totals t LEFT JOIN counts n ON t.target = n.target))"""


# --- prompts -------------------------------------------------------------------------------------------------------

SIGNATURES = default_signatures()


def scored_ctes(source: str, key: str, text: str = "text") -> str:
    """CTE ``scored`` over ``source`` with the columns of a threat assessment."""
    types = ", ".join(f"CASE WHEN regexp_matches({text}, {lit('(?i)' + s['pattern'])}) THEN {lit(s['type'])} END" for s in SIGNATURES)
    score = " + ".join(f"CASE WHEN regexp_matches({text}, {lit('(?i)' + s['pattern'])}) THEN {s['weight']} ELSE 0 END" for s in SIGNATURES)
    proof = ", ".join(f"regexp_extract_all({text}, {lit('(?i)' + s['pattern'])})[1:3]" for s in SIGNATURES)
    keywords = lambda c, words: contains_any(f"lower({c})", words)
    level = "CASE WHEN threat_score >= 65 THEN 'CRITICAL' WHEN threat_score >= 40 THEN 'HIGH' WHEN threat_score >= 20 THEN 'MEDIUM' WHEN threat_score > 0 THEN 'LOW' ELSE 'INFO' END"
    advice = ", ".join(f"CASE WHEN contains(array_to_string(threat_types, ' '), {lit(w)}) THEN {lit(a)} END" for w, a in sig.ADVICE)
    return f"""b64 AS (
  SELECT {key}, k, TRY(decode(from_base64(c))) AS plain FROM (
    SELECT {key}, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM (SELECT {key}, regexp_extract_all({text}, {lit(sig.BASE64_CANDIDATE)}) AS cs FROM {source}))
  WHERE length(c) % 4 = 0),
b64_first AS (SELECT {key}, arg_min(plain, k) AS b64 FROM b64 WHERE length(plain) > 10 AND {keywords('plain', sig.BASE64_KEYWORDS)} GROUP BY ALL),
hex AS (
  SELECT {key}, k, TRY(decode(unhex(regexp_replace(c, '\\s+', '', 'g')))) AS plain FROM (
    SELECT {key}, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM (SELECT {key}, regexp_extract_all({text}, {lit(sig.HEX_CANDIDATE)}) AS cs FROM {source}))),
hex_first AS (SELECT {key}, arg_min(plain, k) AS hex FROM hex WHERE length(plain) > 8 AND {keywords('plain', sig.HEX_KEYWORDS)} GROUP BY ALL),
staged AS (
  SELECT s.*, b64, hex, regexp_full_match({text}, '\\s*') AS blank, {entropy(text)} AS bits,
         CASE WHEN b64 IS NOT NULL THEN 'Base64 Obfuscated Payload: ''' || left(b64, 60) || '...'''
              WHEN hex IS NOT NULL THEN 'Hex Obfuscated Payload: ''' || left(hex, 60) || '...''' END AS evidence
  FROM {source} s LEFT JOIN b64_first USING ({key}) LEFT JOIN hex_first USING ({key})),
typed AS (
  SELECT *, evidence IS NOT NULL AS obfuscation_detected,
         CASE WHEN blank THEN 0.0 ELSE round(bits, 2) END AS entropy_score, bits > 4.8 AND length({text}) > 80 AND NOT blank AS odd,
         list_filter(list_concat([{types}], [CASE WHEN evidence IS NOT NULL THEN {lit(sig.OBFUSCATION_TYPE)} END,
                     CASE WHEN bits > 4.8 AND length({text}) > 80 AND NOT blank THEN {lit(sig.ENTROPY_TYPE)} END]), lambda x: x IS NOT NULL) AS threat_types,
         list_concat(flatten([{proof}]), CASE WHEN evidence IS NULL THEN [] ELSE [evidence] END) AS matched_patterns
  FROM staged),
totalled AS (SELECT *, least(100.0, ({score}) + CASE WHEN obfuscation_detected THEN 45 ELSE 0 END + CASE WHEN odd THEN 15 ELSE 0 END)::DOUBLE AS threat_score FROM typed),
scored AS (
  SELECT *, threat_score >= 20 AS is_threat, {level} AS threat_level,
         CASE WHEN blank THEN '' ELSE regexp_replace({text}, {lit('(?i)' + sig.SANITIZE_PATTERN)}, {lit(sig.SANITIZE_TOKEN)}, 'g') END AS sanitized_prompt,
         CASE WHEN blank THEN {lit(sig.ADVICE_BLANK)} ELSE coalesce(nullif(concat_ws(' ', {advice}, CASE WHEN obfuscation_detected THEN {lit(sig.ADVICE_OBFUSCATED)} END), ''), {lit(sig.ADVICE_DEFAULT)}) END AS remediation_advice
  FROM totalled)"""


PROMPTS = f"WITH {corpora.prompt_corpus_sql()},\n{scored_ctes('prompts', 'conv_id, turn')}\n"
SIGNATURE_ROWS = values((i, s["type"], s["weight"]) for i, s in enumerate(SIGNATURES))
FILE_ROWS = values((i, c, s["vector"], s["level"]) for i, (c, s) in enumerate((c, s) for c, group in sig.SIGNATURE_FILE.items() for s in group))

ORACLES: dict[str, str] = {}

# --- sources -------------------------------------------------------------------------------------------------------

ORACLES["artifacts_from_documents"] = "SELECT 'docs/' || doc_id || '.txt' AS path, source AS target, length(text) AS chars, md5(text) AS content_md5 FROM documents"
ORACLES["decode_invalid_utf8"] = "SELECT doc_id, md5(text || 'end') AS text_md5 FROM documents"
ORACLES["explode_lines"] = f"SELECT doc_id, generate_subscripts(l, 1) AS line_number, md5(unnest(l)) AS line_md5 FROM (SELECT doc_id, {split_lines('text')} AS l FROM documents)"
ORACLES["line_totals"] = f"""SELECT source, count(*) AS files, sum(len({split_lines('text')}))::BIGINT AS lines
FROM (SELECT source, text FROM documents UNION ALL SELECT 'pages', html FROM pages) GROUP BY source"""
ORACLES["signature_hit_counts"] = PROMPTS + f""", hit AS (SELECT unnest(threat_types) AS type FROM scored), n AS (SELECT type, count(*) AS prompts FROM hit GROUP BY type)
SELECT ord, s.type, weight, coalesce(prompts, 0) AS prompts FROM ({SIGNATURE_ROWS}) s(ord, type, weight) LEFT JOIN n ON n.type = s.type"""
ORACLES["signature_file_hit_counts"] = PROMPTS + f""", hit AS (SELECT unnest(threat_types) AS type FROM scored), n AS (SELECT type, count(*) AS prompts FROM hit GROUP BY type)
SELECT ord, category, s.type, level, coalesce(prompts, 0) AS prompts FROM ({FILE_ROWS}) s(ord, category, type, level) LEFT JOIN n ON n.type = s.type"""
ORACLES["retrieval_signature_counts"] = scan(
    "SELECT r.rule_id, r.severity, r.cwe_id AS cwe, r.owasp_id AS owasp, count(f.rule_id) AS findings FROM catalogue r LEFT JOIN found f ON f.rule_id = r.rule_id "
    f"WHERE r.rule_id IN ({', '.join(lit(p['rule_id']) for p in cat.RAG_PATTERNS)}) GROUP BY ALL", ["rag"])
ORACLES["advisory_exposure"] = f"WITH {CODE},\n{LINES},\n{DEPS},\n{MATCHED}\nSELECT a.cve, a.package, a.severity, count(c.cve) AS dependencies FROM advisory a LEFT JOIN covered c ON c.cve = a.cve GROUP BY ALL"
ORACLES["custom_rule_findings"] = scan(
    "SELECT file_path, finding_id, title, category, severity, coalesce(c_message, 'Custom rule ' || rule_id || ' matched at line ' || line_number || '.') AS description, "
    "line_number, column_number, cwe_id, owasp_id, c_remediation AS remediation FROM found", ["custom"])
_PAGES = "texts AS (SELECT 'page' || page_id || '.html' AS path, 'pages' AS target, replace(html, '&quot;', '\"') AS content, '.html' AS ext, [] AS all_lines FROM pages)"
ORACLES["custom_rule_status"] = scan("""SELECT r.id, r.reason IS NULL AS accepted, r.reason, coalesce(n, 0) AS findings
  FROM (VALUES ('CUSTOM-001', NULL), ('CUSTOM-002', NULL), ('CUSTOM-003', 'the pattern does not compile'), ('CUSTOM-004', 'no pattern'), ('TOKEN-001', NULL)) r(id, reason)
  LEFT JOIN (SELECT rule_id, count(*) AS n FROM found WHERE detector = 'custom' GROUP BY rule_id) f ON f.rule_id = r.id""")
ORACLES["signature_rule_findings"] = scan("SELECT file_path, 'OWN-' || finding_id AS finding_id, line_number, column_number, 'LOW' AS severity FROM found WHERE rule_id IN (" + ", ".join(lit(p["rule_id"]) for p in cat.RAG_PATTERNS) + ")"
  + f" UNION ALL SELECT file_path, finding_id, line_number, column_number, severity FROM found WHERE rule_id = {lit(cat.SSL_RULE_ID)}", ["rag"])
ORACLES["advisory_file_findings"] = scan("SELECT file_path, finding_id, severity, line_number FROM found", ["supply"])
ORACLES["extra_detector_findings"] = f"""SELECT 'docs/' || doc_id || '.txt' AS file_path, 'WIDE-001-' || n AS finding_id, n AS line_number, 'INFO' AS severity
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {split_lines('text')} AS l FROM documents)) WHERE length(line) >= 500"""
_FOLDED = contains_any("lower(content)", FOLDING) + " OR contains(content, 'İ')"
_MANY = corpora.many_rules(200)
MANY = f"""WITH {CODE}, many(rule_id, pattern, only_py) AS ({values([(r["id"], r["pattern"], str(bool(r["file_extensions"])).lower()) for r in _MANY])}),
anchored(rule_id, anchor) AS ({values([(r["id"], a) for r in _MANY for a in anchors_of(r["pattern"]) or []])}),
wanted AS (SELECT rule_id, pattern, path, content FROM many, code WHERE content IS NOT NULL AND (only_py = 'false' OR ext = '.py'))"""
ORACLES["many_custom_rules"] = MANY + """, found AS (
  SELECT rule_id, path, unnest(range(1, len(ms) + 1)) AS k, ms, string_split(regexp_replace(content, '(' || pattern || ')', chr(1) || '\\1', 'g'), chr(1)) AS ps
  FROM (SELECT *, regexp_extract_all(content, pattern) AS ms FROM wanted) WHERE len(ms) > 0),
placed AS (SELECT rule_id, path, ms[k] AS m, array_to_string(ps[1:k], '') AS prefix FROM found)
SELECT rule_id, count(*) AS findings, count(DISTINCT path) AS artifacts, CAST(sum(1 + length(prefix) - length(replace(prefix, chr(10), ''))) AS BIGINT) AS lines,
  CAST(sum(length(string_split(prefix, chr(10))[-1]) + 1) AS BIGINT) AS columns, CAST(sum(length(m)) AS BIGINT) AS characters FROM placed GROUP BY rule_id"""
ORACLES["custom_rule_trials"] = MANY + f""", tried AS (
  SELECT rule_id, count(*) AS tried FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM anchored a WHERE a.rule_id = w.rule_id) OR {_FOLDED}
    OR EXISTS (SELECT 1 FROM anchored a WHERE a.rule_id = w.rule_id AND contains(lower(content), anchor)) GROUP BY rule_id),
matched AS (SELECT rule_id, count(*) AS matched FROM wanted WHERE regexp_matches(content, pattern) GROUP BY rule_id)
SELECT m.rule_id, EXISTS (SELECT 1 FROM anchored a WHERE a.rule_id = m.rule_id) AS gated, (SELECT count(*) FROM code) AS texts, coalesce(matched, 0) AS matched, TRUE AS covered,
  coalesce(tried, 0) + CASE WHEN EXISTS (SELECT 1 FROM anchored a WHERE a.rule_id = m.rule_id) THEN 0 ELSE (SELECT count(*) FROM code WHERE content IS NULL AND (m.only_py = 'false' OR ext = '.py')) END AS tried
FROM many m LEFT JOIN tried t ON t.rule_id = m.rule_id LEFT JOIN matched x ON x.rule_id = m.rule_id"""
_OWN = [{"rule_id": s["id"], "pattern": s["pattern"], "ignore_case": False} for s in corpora.SECRET_SIGNATURES[:3]] + cat.LINE_PATTERNS
_TOLD = {r["rule_id"]: r for r in RULES + DETECTOR_RULES}
_OWN_ROWS = [(i, s["severity"] or "CRITICAL", s["cwe"] or "CWE-798", s["owasp"] or "LLM06:2025-Sensitive-Info-Disclosure") for i, s in enumerate(corpora.SECRET_SIGNATURES[:3])]
_OWN_ROWS += [(3 + i, *[_TOLD[p["rule_id"]][f] for f in ("severity", "cwe_id", "owasp_id")]) for i, p in enumerate(cat.LINE_PATTERNS)]
ORACLES["secret_signature_findings"] = f"""WITH {CODE},\n{LINES},\n{_secrets(_OWN)}, told(place, severity, cwe_id, owasp_id) AS ({values(_OWN_ROWS)})
SELECT path AS file_path, rule_id || '-' || line || '-' || col AS finding_id, rule_id, severity, cwe_id, owasp_id, line AS line_number, col AS column_number, s2 AS place FROM secrets JOIN told ON s2 = place"""
_NUMBERS = """numbers AS (SELECT path AS file_path, 'NUM-001-' || line_number AS finding_id, 'LOW' AS severity, CAST(line_number AS INTEGER) AS line_number,
  CAST(length(regexp_extract(line, '^(.*?)[0-9]{6}', 1)) + 1 AS INTEGER) AS column_number FROM lines WHERE regexp_matches(line, '[0-9]{6}'))"""
ORACLES["registered_detector_findings"] = f"""WITH {CODE},\n{LINES},\n{_secrets(_OWN)}, told(place, severity, cwe_id, owasp_id) AS ({values(_OWN_ROWS)}), {_NUMBERS}
SELECT file_path, finding_id, severity, line_number, column_number FROM (
  SELECT path AS file_path, rule_id || '-' || line || '-' || col AS finding_id, severity, line AS line_number, col AS column_number, row_number() OVER (PARTITION BY path, line, split_part(rule_id, '-', 1) ORDER BY s2, s3) AS pick
  FROM secrets JOIN told ON s2 = place) WHERE pick = 1 UNION ALL SELECT * FROM numbers"""
ORACLES["stream_registered_findings"] = f"""WITH {CODE},\n{LINES},\n{_rag()}, {_NUMBERS}
SELECT file_path, finding_id, severity, line_number, column_number FROM (
  SELECT path AS file_path, CASE WHEN rule_id = {lit(cat.SSL_RULE_ID)} THEN '' ELSE 'OWN-' END || rule_id || '-' || line AS finding_id, CASE WHEN rule_id = {lit(cat.SSL_RULE_ID)} THEN 'HIGH' ELSE 'LOW' END AS severity, line AS line_number, col AS column_number,
    row_number() OVER (PARTITION BY path, line, CASE WHEN rule_id = {lit(cat.SSL_RULE_ID)} THEN 1 ELSE 0 END ORDER BY s1, s2) AS pick FROM rag) WHERE pick = 1 UNION ALL SELECT * FROM numbers"""
ORACLES["custom_rule_on_pages"] = f"WITH {_PAGES},\n{_custom()},\n{_CUSTOM_ROWS}\nSELECT path AS file_path, rule_id || '-' || line AS finding_id, line AS line_number, col AS column_number, c_severity AS severity FROM custom JOIN custom_rules USING (rule_id)"
ORACLES["baseline_round_trip"] = scan("SELECT target, finding_id, family, severity, file_path, line_number, column_number, cwe_id, owasp_id, confidence::DOUBLE AS confidence FROM kept")
ORACLES["dependencies"] = f"WITH {CODE},\n{LINES},\n{DEPS}\nSELECT path, target, package, version, line_number FROM deps"

# --- filters -------------------------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(string_split(path, '/')[-1], '.(\\.[^.]+)$', 1))"
ORACLES["path_filters"] = f"""WITH {corpora.path_corpus_sql()}
SELECT doc_id, {_EXT} IN ({', '.join(lit(e) for e in cat.SCAN_EXTENSIONS)}) OR string_split(path, '/')[-1] LIKE '.env%' AS scannable,
  len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1], lambda d: d IN ({', '.join(lit(d) for d in cat.IGNORED_DIRECTORIES)}) OR d LIKE '.%')) > 0 AS ignored,
  CASE WHEN lower(string_split(path, '/')[-1]) IN ({', '.join(lit(f) for f in cat.REQUIREMENTS_FILES)}) THEN 'requirements'
       WHEN lower(string_split(path, '/')[-1]) = 'pyproject.toml' THEN 'pyproject' WHEN lower(string_split(path, '/')[-1]) = 'setup.py' THEN 'setup' END AS manifest,
  path LIKE '%.py' OR path LIKE '%.pyw' AS python, regexp_extract(string_split(path, '/')[-1], '.(\\.[^.]+)$', 1) AS suffix, string_split(path, '/')[-1] AS basename
FROM paths"""
ORACLES["severity_filter_equal"] = scan("SELECT file_path, finding_id FROM kept WHERE severity = 'HIGH'")
ORACLES["severity_filter_at_least"] = scan("SELECT file_path, finding_id, severity FROM kept WHERE severity IN ('CRITICAL', 'HIGH')")
ORACLES["policy_gate"] = scan("SELECT target, critical + high + medium AS violations, CASE WHEN critical + high + medium > 0 THEN 3 WHEN critical > 0 THEN 2 WHEN high > 0 THEN 1 ELSE 0 END AS status FROM summary", more=summary_ctes())
ORACLES["search_findings"] = scan("""SELECT file_path, finding_id, cwe_id FROM kept WHERE severity = 'CRITICAL' AND (contains(lower(coalesce(title, '')), 'cwe-5')
  OR contains(lower(finding_id), 'cwe-5') OR contains(lower(file_path), 'cwe-5') OR contains(lower(cwe_id), 'cwe-5') OR contains(lower(owasp_id), 'cwe-5'))""")
_CRITICAL_RCE = [r["rule_id"] for r in RULES if r["severity"] == "CRITICAL" and "rce" in r["tags"] and r["cwe_id"] == "CWE-502"]
ORACLES["filter_rules_with_counts"] = scan(f"SELECT r.rule_id, r.severity, count(k.rule_id) AS findings FROM catalogue r LEFT JOIN kept k ON k.rule_id = r.rule_id WHERE r.rule_id IN ({', '.join(lit(r) for r in _CRITICAL_RCE)}) GROUP BY ALL")
_TAGS = values((r["rule_id"], "|".join(r["tags"])) for r in RULES)
ORACLES["rule_catalogue_with_counts"] = scan(f"SELECT r.rule_id, r.category, r.severity, r.cwe_id, r.owasp_id, tags, count(k.rule_id) AS findings FROM catalogue r JOIN ({_TAGS}) t(rule_id, tags) ON t.rule_id = r.rule_id LEFT JOIN kept k ON k.rule_id = r.rule_id GROUP BY ALL")
ORACLES["get_rule_findings"] = scan("SELECT rule_id, file_path, line_number, owasp_id FROM kept WHERE rule_id = 'SEC-KEY-003'")
ORACLES["registered_rule_counts"] = scan("SELECT rule_id, CASE WHEN rule_id = 'SEC-KEY-003' THEN 'LOW' ELSE severity END AS severity, count(*) AS findings FROM found GROUP BY ALL", ["secrets"])

# --- detection rules -----------------------------------------------------------------------------------------------

for _rule, _detector in RULE_DETECTORS.items():
    ORACLES["rule_" + _rule.lower().replace("-", "_")] = scan(f"SELECT file_path, finding_id, line_number, column_number, severity FROM found WHERE rule_id = {lit(_rule)}", [_detector])

_SNIPPET = """array_to_string(list_transform(range(greatest(1, {n} - 2), least(len({lines}), {n} + 2) + 1),
  lambda i: printf('%4d', i) || CASE WHEN i = {n} THEN ' > ' ELSE '   ' END || {lines}[i]), chr(10))"""
ORACLES["chunked_findings"] = scan(f"SELECT file_path, finding_id, severity, line_number, column_number, CASE WHEN detector IN ('secrets', 'owasp') THEN md5({_SNIPPET.format(n='line_number', lines='all_lines')}) END AS snippet FROM kept")
ORACLES["chunk_places"] = """WITH cut AS (
  SELECT 'docs/' || doc_id || '.txt' AS path, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT path, list_transform(range(1, len(l) + 1), lambda i: l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END) AS l FROM cut),
kept AS (SELECT path, l, unnest(range(0, greatest(1, CAST(ceil(len(l) / 5.0) AS BIGINT)))) AS part FROM lines)
SELECT path, CAST(part AS INTEGER) AS part, CAST(5 * part AS INTEGER) AS first_line, CAST(length(array_to_string(l[1 : 5 * part], '')) AS BIGINT) AS first_offset, md5(array_to_string(l[5 * part + 1 : 5 * part + 5], '')) AS chunk FROM kept"""
_FILE_DETECTORS = ["secrets", "owasp", "rag", "agent", "model"]
ORACLES["file_findings"] = "WITH " + ",\n".join([corpora.file_corpus_sql(), LINES, *[_PARTS[d] for d in _FILE_DETECTORS], CATALOGUE, _CUSTOM_ROWS, findings_ctes(_FILE_DETECTORS)]) + "\nSELECT file_path, finding_id, severity, line_number, column_number FROM found"
ORACLES["secret_details"] = scan(f"SELECT file_path, finding_id, {mask('match')} AS match, sha256(match) AS match_sha256, md5({_SNIPPET.format(n='line_number', lines='all_lines')}) AS snippet_md5, 0.92::DOUBLE AS confidence FROM found", ["secrets"])
ORACLES["model_artifacts"] = scan("SELECT file_path, finding_id, severity, line_number, CASE WHEN rule_id LIKE 'MODEL-UNSAFE-FMT-%' THEN '.' || lower(split_part(rule_id, '-', 4)) END AS extension, confidence::DOUBLE AS confidence FROM found", ["model"])
ORACLES["supply_chain_findings"] = f"WITH {CODE},\n{LINES},\n{DEPS},\n{MATCHED}\nSELECT path AS file_path, 'SC-' || replace(cve, '-', '') || '-' || line_number AS finding_id, severity, line_number, cwe AS cwe_id, owasp AS owasp_id, package, version, cve, below AS safe_version FROM covered"

def _read_calls():
    """(slot, line, column, name, full name, kind and source of the first argument, keywords) of the calls of every fragment, each looked up and written out by itself."""
    for slot, (name, text, _) in enumerate(corpora.CODE_SLOTS):
        if text is None or not name.endswith(".py"):
            continue
        try:
            order = []
            visit = lambda node: (order.append(node), [visit(child) for child in ast.iter_child_nodes(node)])  # noqa: E731, B023
            visit(ast.parse(text))
        except SyntaxError:
            continue
        for place, node in enumerate(order):
            if not isinstance(node, ast.Call):
                continue
            parts, owner = [], node.func
            while isinstance(owner, ast.Attribute):
                parts.insert(0, owner.attr)
                owner = owner.value
            func = ".".join([owner.id] * isinstance(owner, ast.Name) + parts)
            full = [f"{n.module}.{a.name}" if isinstance(n, ast.ImportFrom) and n.module else a.name for n in order[:place] if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names
                    if func == (a.asname or (a.name if isinstance(n, ast.ImportFrom) else None))]
            keywords = "|".join(sorted(f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords if k.arg))
            yield slot, node.lineno, node.col_offset, func, full[-1] if full and "." not in func else func, type(node.args[0]).__name__ if node.args else "", ast.unparse(node.args[0]) if node.args else "", keywords


_READ = f"WITH {CODE}, calls(slot, rel, col, func, resolved_name, kind, first_arg, kwargs) AS ({values(_read_calls())})\n"
ORACLES["resolved_calls"] = _READ + "SELECT path, first_line + rel - 1 AS line, c.col, func, resolved_name FROM code JOIN calls c USING (slot)"
ORACLES["call_arguments"] = _READ + "SELECT path, first_line + rel - 1 AS line, c.col, kind AS first_arg_kind, md5(first_arg) AS first_arg, md5(kwargs) AS kwargs FROM code JOIN calls c USING (slot)"


def _fact_counts():
    for slot, (name, text, _) in enumerate(corpora.CODE_SLOTS):
        if text is None or not name.endswith(".py"):
            continue
        try:
            nodes = list(ast.walk(ast.parse(text)))
        except SyntaxError:
            continue
        count = lambda kind: sum(isinstance(n, kind) for n in nodes)
        imports = sum(len(n.names) for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)))
        names = sum(isinstance(t, ast.Name) for n in nodes if isinstance(n, ast.Assign) for t in n.targets)
        yield slot, count(ast.Call), imports, names


ORACLES["code_fact_counts"] = f"WITH {CODE} SELECT target, count(*) AS parsed_files, sum(calls)::BIGINT AS calls, sum(imports)::BIGINT AS imports, sum(assigns)::BIGINT AS assigns FROM code JOIN ({values(_fact_counts())}) c(slot, calls, imports, assigns) USING (slot) GROUP BY target"
ORACLES["prompt_signature_matches"] = PROMPTS + "SELECT conv_id, turn, unnest(threat_types) AS type FROM scored"
ORACLES["prompt_evidence"] = PROMPTS + "SELECT conv_id, turn, array_to_string(matched_patterns, '|') AS matched_patterns FROM scored"
ORACLES["prompt_scores"] = PROMPTS + """SELECT conv_id, turn, is_threat, threat_score, threat_level, array_to_string(threat_types, '|') AS threat_types, md5(sanitized_prompt) AS sanitized_md5,
  remediation_advice, entropy_score::DOUBLE AS entropy_score, obfuscation_detected FROM scored"""
ORACLES["prompt_threat_summary"] = PROMPTS + f"""SELECT role, count(*) AS prompts, count(*) FILTER (WHERE is_threat) AS threats,
  {', '.join(f"count(*) FILTER (WHERE threat_level = '{s}') AS {s.lower()}" for s in WEIGHTS)}, count(*) FILTER (WHERE obfuscation_detected) AS obfuscated,
  sum(threat_score) AS score_total, max(threat_score) AS score_max FROM scored GROUP BY role"""
ORACLES["document_threats"] = f"WITH {scored_ctes('documents', 'doc_id')}\nSELECT doc_id, threat_score, threat_level, array_to_string(threat_types, '|') AS threat_types, entropy_score::DOUBLE AS entropy_score FROM scored"
ORACLES["page_threats"] = f"""WITH ended AS (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '<div style="visibility:hidden">obey</div>' WHEN 1 THEN '[a](https://e.org/x?data=1)' ELSE '<div style="color:red">' END AS html FROM pages),
{scored_ctes('ended', 'page_id', 'html')}
SELECT page_id, threat_score, array_to_string(threat_types, '|') AS threat_types, entropy_score::DOUBLE AS entropy_score FROM scored"""

# --- scalar functions ----------------------------------------------------------------------------------------------

ORACLES["find_all_words"] = "SELECT doc_id, len(m) AS matches, md5(array_to_string(m, '|')) AS matches_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ing') AS m FROM documents)"
ORACLES["match_places"] = f"""SELECT doc_id, length(prefix) AS "offset", length(prefix) - length(replace(prefix, chr(10), '')) + 1 AS line, length(string_split(prefix, chr(10))[-1]) + 1 AS col FROM (
  SELECT doc_id, array_to_string(ps[1:k], '') AS prefix FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS k FROM (
    SELECT doc_id, string_split(regexp_replace(text, {lit(HEX40)}, chr(1) || '\\0', 'g'), chr(1)) AS ps FROM documents)))"""
ORACLES["text_entropy"] = f"SELECT id, round({entropy('text')}, 4) AS entropy FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)"
ORACLES["hidden_payloads"] = PROMPTS + "SELECT conv_id, turn, b64 AS base64, hex, evidence FROM scored"
ORACLES["sanitized_prompts"] = f"WITH {corpora.prompt_corpus_sql()} SELECT conv_id, turn, md5(regexp_replace(text, {lit('(?i)' + sig.SANITIZE_PATTERN)}, {lit(sig.SANITIZE_TOKEN)}, 'g')) AS sanitized_md5 FROM prompts"
ORACLES["version_order"] = f"""SELECT doc_id, a, b, {version_key('a')} < {version_key('b')} AS older FROM (
  SELECT doc_id, (doc_id % 3) || '.' || (doc_id % 12) || ['', '.0', 'rc1', '.post1', '.dev2', '+cpu', 'b2.dev1', '.*'][doc_id % 8 + 1] AS a, (doc_id % 2) || '.' || (doc_id % 11) || '.0' AS b FROM documents)"""
ORACLES["identifier_functions"] = scan(f"""SELECT file_path, finding_id, split_part(finding_id, '-', 1) AS family_of, regexp_replace(finding_id, '-[^-]*$', '') AS base,
  string_split(file_path, '/')[-1] AS basename, regexp_extract(string_split(file_path, '/')[-1], '.(\\.[^.]+)$', 1) AS suffix, {mask('file_path')} AS masked,
  left(sha256(rule_id || '::' || file_path || '::' || line_number), 16) AS sha, replace(lower(upper(target)), '_', '-') AS normalized, rule_id || '-' || line_number AS made_id FROM kept""")

# --- findings ------------------------------------------------------------------------------------------------------

ORACLES["findings_by_detector"] = scan("SELECT detector, rule_id, count(*) AS findings FROM found GROUP BY ALL")
ORACLES["dedup_findings"] = scan("SELECT target, file_path, line_number, family, finding_id, severity FROM kept")
ORACLES["dedup_by_rule"] = scan("SELECT target, rule_id, count(*) AS findings FROM (SELECT DISTINCT target, file_path, line_number, rule_id FROM found) GROUP BY ALL")
ORACLES["enriched_findings"] = scan("SELECT file_path, finding_id, rule_id, category, severity, cwe_id, owasp_id, confidence::DOUBLE AS confidence, detector_name AS detector FROM kept")
ORACLES["finding_sequence"] = scan("SELECT file_path, finding_id, ord AS detector_ord, CASE WHEN detector = 'ast' THEN '' ELSE s1 || '|' || s2 || '|' || s3 END AS seq FROM kept")
ORACLES["first_match_place"] = f'SELECT * FROM ({ORACLES["match_places"]}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY "offset") = 1'
ORACLES["line_snippets"] = f"""SELECT doc_id, line, md5(CASE WHEN line BETWEEN 1 AND len(l) THEN {_SNIPPET.format(n='line', lines='l')} ELSE '' END) AS snippet_md5 FROM (
  SELECT doc_id, l, unnest(range(0, len(l) + 2)) AS line FROM (SELECT doc_id, {split_lines('text')} AS l FROM documents))"""
ORACLES["order_findings"] = scan(f"SELECT severity, file_path, line_number, finding_id FROM kept ORDER BY {weight('severity')} DESC, file_path, line_number")
ORACLES["severity_counts"] = scan(f"SELECT target, {COUNTS}, count(*) AS total FROM kept GROUP BY target")
ORACLES["scan_totals"] = f"WITH {CODE},\n{LINES}\nSELECT target, count(*) AS files, sum(len(all_lines))::BIGINT AS lines FROM texts GROUP BY target"
ORACLES["scan_summary"] = scan("SELECT * FROM summary", more=summary_ctes())
_NATIVE = f"texts AS (SELECT 'docs/' || doc_id || '.txt' AS path, source AS target, text AS content, '.txt' AS ext, 'x.txt' AS name, 0 AS slot, 0 AS first_line, {split_lines('text')} AS all_lines FROM documents)"
ORACLES["native_document_scan"] = "WITH " + ",\n".join([
    _NATIVE, "lines AS (SELECT path, target, slot, name, ext, all_lines, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS line_number FROM texts)",
    *[_PARTS[d] for d in ("secrets", "owasp", "rag", "agent", "custom")], CATALOGUE, _CUSTOM_ROWS, findings_ctes(["secrets", "owasp", "rag", "agent", "custom"]), summary_ctes()]) + "\nSELECT * FROM summary"

# --- diff and compliance -------------------------------------------------------------------------------------------


def _diff(select: str) -> str:
    both = "\n".join([])
    sides = []
    for name, detectors in (("old", corpora.BASELINE_DETECTORS), ("new", corpora.CURRENT_DETECTORS)):
        sides.append(findings_ctes(detectors, found=f"{name}_found", kept=f"{name}_kept"))
        sides.append(f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, fingerprint ORDER BY {weight('severity')}, file_path DESC, line_number DESC, ord DESC, s1 DESC, s2 DESC, s3 DESC) AS pick
  FROM (SELECT *, regexp_replace(finding_id, '-[^-]*$', '') || '::' || string_split(file_path, '/')[-1] || '::' || line_number AS fingerprint FROM {name}_kept)) WHERE pick = 1)""")
    diffed = """diffed AS (SELECT CASE WHEN o.target IS NULL THEN 'new' WHEN n.target IS NULL THEN 'fixed' ELSE 'persisting' END AS status,
  coalesce(n.target, o.target) AS target, coalesce(n.fingerprint, o.fingerprint) AS fingerprint, coalesce(n.file_path, o.file_path) AS file_path,
  coalesce(n.finding_id, o.finding_id) AS finding_id, coalesce(n.severity, o.severity) AS severity
  FROM old o FULL OUTER JOIN new n ON o.target = n.target AND o.fingerprint = n.fingerprint)"""
    ctes = [CODE, LINES, *_PARTS.values(), CATALOGUE, _CUSTOM_ROWS, *sides, diffed]
    return "WITH " + ",\n".join(ctes) + both + "\n" + select


_DIFF = "target, fingerprint, file_path, finding_id, severity"
ORACLES["diff_findings"] = _diff(f"SELECT status, {_DIFF} FROM diffed")
ORACLES["order_diff"] = _diff("SELECT status, fingerprint, target FROM diffed ORDER BY 1, 2, 3")
ORACLES["new_findings"] = _diff(f"SELECT {_DIFF} FROM diffed WHERE status = 'new'")
ORACLES["fixed_findings"] = _diff(f"SELECT {_DIFF} FROM diffed WHERE status = 'fixed'")
ORACLES["persisting_findings"] = _diff(f"SELECT {_DIFF} FROM diffed WHERE status = 'persisting'")
ORACLES["fingerprint_sets"] = _diff("SELECT target, fingerprint, status FROM diffed")
ORACLES["diff_summary"] = _diff("SELECT target, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'persisting') AS persisting, count(*) FILTER (WHERE status = 'new') > 0 AS has_regressions FROM diffed GROUP BY target")


def _rescan(version: int, select: str) -> str:
    """The difference between two versions of the corpus, each scanned whole."""
    wanted = corpora.RESCAN_DETECTORS
    snapshot = lambda v: "WITH " + ",\n".join([corpora.versions_sql(v), LINES, *[_PARTS[d] for d in wanted], CATALOGUE, _CUSTOM_ROWS, findings_ctes(wanted)]) + f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, fingerprint ORDER BY {weight('severity')}, file_path DESC, line_number DESC, ord DESC, s1 DESC, s2 DESC, s3 DESC) AS pick
  FROM (SELECT *, regexp_replace(finding_id, '-[^-]*$', '') || '::' || string_split(file_path, '/')[-1] || '::' || line_number AS fingerprint FROM kept)) WHERE pick = 1"""  # noqa: E731
    before = snapshot(version - 1) if version else snapshot(0) + " AND FALSE"
    return f"""SELECT {version} AS batch, {select} FROM (
  SELECT CASE WHEN o.target IS NULL THEN 'new' WHEN n.target IS NULL THEN 'fixed' ELSE 'persisting' END AS status, coalesce(n.target, o.target) AS target, coalesce(n.fingerprint, o.fingerprint) AS fingerprint,
    coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.finding_id, o.finding_id) AS finding_id, coalesce(n.severity, o.severity) AS severity
  FROM ({before}) o FULL OUTER JOIN ({snapshot(version)}) n ON o.target = n.target AND o.fingerprint = n.fingerprint)"""


ORACLES["rescan_changes"] = " UNION ALL ".join(_rescan(v, "status, target, fingerprint, file_path, finding_id, severity") + " WHERE status <> 'persisting'" for v in range(len(corpora.VERSIONS)))
ORACLES["rescan_diffs"] = " UNION ALL ".join(_rescan(v, "status, target, fingerprint, file_path, severity") for v in range(len(corpora.VERSIONS)))


def _control_ctes(framework: str) -> str:
    rows = values((domain, key) for domain, keys in CONTROLS[framework].items() for key in keys)
    matched = " OR ".join(f"contains(lower({c}), lower(key))" for c in ("owasp_id", "cwe_id", "finding_id", "meta_rule", "detector_name"))
    return f"""controls(domain, key) AS ({rows}),
mapped AS (SELECT DISTINCT '{framework}' AS framework, domain, target, file_path, finding_id FROM kept JOIN controls ON {matched})"""


_STATUS = """domains AS (SELECT DISTINCT domain FROM controls),
status AS (SELECT s.target, d.domain, count(m.finding_id) AS findings FROM summary s CROSS JOIN domains d LEFT JOIN mapped m ON m.target = s.target AND m.domain = d.domain GROUP BY ALL)"""
for _name, _framework in (("controls_soc2", "soc2"), ("controls_iso27001", "iso27001")):
    ORACLES[_name] = scan("SELECT framework, domain, file_path, finding_id FROM mapped", more=_control_ctes(_framework))
ORACLES["domain_status_soc2"] = scan("SELECT target, 'soc2' AS framework, domain, findings, CASE WHEN findings = 0 THEN 'PASS' ELSE 'FINDINGS' END AS status FROM status", more=f"{_control_ctes('soc2')},\n{summary_ctes()},\n{_STATUS}")
ORACLES["compliance_summary_iso27001"] = scan("""SELECT s.target, security_score, critical, high, total, files, count(*) FILTER (WHERE findings = 0) AS domains_passed, count(*) AS domains, 'iso27001' AS framework
  FROM summary s JOIN status t ON s.target = t.target GROUP BY ALL""", more=f"{_control_ctes('iso27001')},\n{summary_ctes()},\n{_STATUS}")

# --- exports -------------------------------------------------------------------------------------------------------

ORACLES["report_documents"] = scan("SELECT target, total AS findings_count, security_score, files, critical, total AS listed FROM summary", more=summary_ctes())
ORACLES["csv_rows"] = scan("SELECT finding_id AS id, severity, category, file_path AS file, line_number AS line, cwe_id AS cwe, owasp_id AS owasp FROM kept")
_PLACE = f"{weight('severity')} DESC, file_path, line_number, ord, s1, s2, s3"


def _in_parts(columns: str, more: str = "") -> str:
    """Findings of each target in report order, twenty a part, put together as text; targets without any have one empty part."""
    return scan(f"""SELECT t.target, CAST(coalesce(part, 0) AS INTEGER) AS part, CAST(coalesce(parts, 1) AS INTEGER) AS parts{more}, md5(coalesce(said, '')) AS digest FROM (SELECT DISTINCT target FROM code) t LEFT JOIN (
  SELECT target, part, 1 + max(part) OVER (PARTITION BY target) AS parts, n AS findings, said FROM (
    SELECT target, place // 20 AS part, count(*) AS n, string_agg(concat_ws('|', {columns}), chr(10) ORDER BY place) AS said FROM (
      SELECT *, row_number() OVER (PARTITION BY target ORDER BY {_PLACE}, finding_id) - 1 AS place FROM kept) GROUP BY target, part)) p ON p.target = t.target""")


ORACLES["report_contents"] = _in_parts("finding_id, severity, category, file_path, line_number, column_number, cwe_id, owasp_id", ", CAST(coalesce(findings, 0) AS INTEGER) AS findings")
ORACLES["sarif_contents"] = _in_parts(f"sarif_rule, {by_severity(SARIF_LEVELS)}, file_path, greatest(1, line_number), greatest(1, column_number), cwe_id, owasp_id", ", coalesce((SELECT string_agg(DISTINCT sarif_rule, '|' ORDER BY sarif_rule) FROM kept k WHERE k.target = t.target), '') AS rules")
ORACLES["sbom_contents"] = scan("""SELECT t.target, CAST(t.part AS INTEGER) AS part, CAST(t.parts AS INTEGER) AS parts, md5(coalesce(components, '')) AS components, md5(coalesce(vulnerabilities, '')) AS vulnerabilities
FROM (SELECT target, parts, unnest(range(0, parts)) AS part FROM (
  SELECT c.target, CAST(greatest(1, ceil(coalesce(max(cn), 0) / 20.0), ceil(coalesce(max(vn), 0) / 20.0)) AS BIGINT) AS parts FROM (SELECT DISTINCT target FROM code) c
  LEFT JOIN (SELECT target, count(*) AS cn FROM (SELECT DISTINCT target, package, version FROM deps) GROUP BY target) d ON d.target = c.target
  LEFT JOIN (SELECT target, count(*) AS vn FROM kept GROUP BY target) v ON v.target = c.target GROUP BY c.target)) t
LEFT JOIN (SELECT target, place // 20 AS part, string_agg('pkg:pypi/' || package || '@' || version, chr(10) ORDER BY place) AS components FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY package, version) - 1 AS place FROM (SELECT DISTINCT target, package, version FROM deps)) GROUP BY ALL) x ON x.target = t.target AND x.part = t.part
LEFT JOIN (SELECT target, place // 20 AS part, string_agg(CASE WHEN cwe_id = '' THEN finding_id ELSE cwe_id END || '|' || string_split(file_path, '/')[-1], chr(10) ORDER BY place) AS vulnerabilities FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY file_path, line_number, finding_id) - 1 AS place FROM kept) GROUP BY ALL) y ON y.target = t.target AND y.part = t.part""")
_TEXTS = "texts_of(rule_id, description, remediation) AS (" + values((r["rule_id"], r["description"], r["remediation"]) for r in RULES + DETECTOR_RULES) + ")"
ORACLES["csv_columns"] = scan(f"""SELECT finding_id AS id, severity, category, file_path AS file, line_number AS line, cwe_id AS cwe, owasp_id AS owasp, md5(title) AS title, md5(remediation) AS remediation,
  md5(CASE WHEN detector = 'secrets' THEN description || ' (Matched: ' || {mask('match')} || ')' WHEN detector = 'rag' AND match IS NOT NULL THEN 'Retrieval risk: ' || title || ' (Matched: ' || match || ')' ELSE description END) AS description
  FROM kept JOIN texts_of t ON t.rule_id = kept.rule_id""", ["ast", "secrets", "owasp", "rag", "agent"], _TEXTS)
ORACLES["code_finding_ranks"] = scan("SELECT file_path, finding_id, column_number, CAST(row_number() OVER (PARTITION BY file_path ORDER BY s1) AS INTEGER) AS rank FROM found", ["ast"])
ORACLES["sarif_rules"] = scan(f"""SELECT sarif_rule AS id, CASE WHEN owasp_id = '' THEN 'AI-Security' ELSE split_part(owasp_id, ':', 1) END || '|' || CASE WHEN cwe_id = '' THEN 'CWE-Unknown' ELSE cwe_id END || '|ai-security|llm-security' AS tags,
  lower(severity) AS problem_severity, {by_severity(SARIF_SCORES)} AS security_severity, {by_severity(SARIF_LEVELS)} AS level
FROM (SELECT *, row_number() OVER (PARTITION BY sarif_rule ORDER BY {_PLACE}) AS pick FROM kept) WHERE pick = 1""")
ORACLES["sarif_results"] = scan(f"SELECT sarif_rule AS rule_id, {by_severity(SARIF_LEVELS)} AS level, file_path AS uri, greatest(1, line_number) AS start_line, greatest(1, column_number) AS start_column, left(sha256(sarif_rule || '::' || file_path || '::' || line_number), 16) AS fingerprint FROM kept")
ORACLES["sarif_documents"] = scan("SELECT target, total AS results, critical + high AS errors, security_score, total FROM summary", more=summary_ctes())
ORACLES["sbom_components"] = f"WITH {CODE},\n{LINES},\n{DEPS}\nSELECT target, 'library' AS type, package AS name, version, 'pkg:pypi/' || package || '@' || version AS purl, 'https://pypi.org/project/' || package || '/' || version || '/' AS distribution_url FROM deps"
ORACLES["sbom_vulnerabilities"] = scan("SELECT target, finding_id, CASE WHEN cwe_id = '' THEN finding_id ELSE cwe_id END AS id, lower(severity) AS severity, replace(cwe_id, 'CWE-', '') AS cwes, string_split(file_path, '/')[-1] AS affects FROM kept")
ORACLES["sbom_documents"] = scan(f"""SELECT k.target, 'urn:uuid:' || left(sha256(k.target || '/{STAMP}/0'), 32) AS serial, true AS own_serials, coalesce(components, 0) AS components, coalesce(vulnerabilities, 0) AS vulnerabilities
  FROM (SELECT DISTINCT target FROM code UNION ALL SELECT 'clean') k
  LEFT JOIN (SELECT target, count(*) AS vulnerabilities FROM kept GROUP BY target) v ON v.target = k.target
  LEFT JOIN (SELECT target, count(*) AS components FROM (SELECT DISTINCT target, package, version FROM deps) GROUP BY target) d ON d.target = k.target""")
ORACLES["audit_scan_events"] = scan(f"SELECT 'scan' AS event, '{STAMP}.000000' AS timestamp, target, files AS files_scanned, lines AS lines_scanned, security_score, total, high FROM summary", more=summary_ctes())
ORACLES["audit_prompt_events"] = PROMPTS + f"SELECT 'prompt_analysis' AS event, '{STAMP}.000000' AS timestamp, threat_level, array_to_string(threat_types, '|') AS attack_vectors, count(*) AS prompts, sum(threat_score) AS score FROM scored GROUP BY ALL"
_ENTRIES = "entries AS (SELECT 'scan' AS event, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 't' || event_id AS target, value AS security_score FROM events WHERE event_type <> 'error')"
ORACLES["audit_last_entries"] = f"WITH {_ENTRIES} SELECT * FROM (SELECT * FROM entries ORDER BY timestamp DESC, target DESC LIMIT 50) ORDER BY timestamp, target"
ORACLES["audit_entries_per_day"] = f"WITH {_ENTRIES} SELECT left(timestamp, 10) AS day, count(*) AS entries, round(sum(security_score), 2) AS score FROM entries GROUP BY 1"

# --- streaming -----------------------------------------------------------------------------------------------------

_PAIRS = " + ".join(f"CASE WHEN contains(lower(text), '{chr(97 + i // 10)}{chr(97 + i % 10)}x') THEN 1 ELSE 0 END" for i in range(100))
ORACLES["many_signatures"] = PROMPTS + f"SELECT conv_id, turn, pairs, least(100, threat_score + pairs) AS threat_score FROM scored JOIN (SELECT conv_id, turn, {_PAIRS} AS pairs FROM prompts) USING (conv_id, turn)"
ORACLES["stream_prompt_scores"] = f"WITH {scored_ctes('conversations', 'conv_id, turn')}\nSELECT conv_id, turn, threat_score, threat_level, array_to_string(threat_types, '|') AS threat_types, entropy_score::DOUBLE AS entropy_score FROM scored"
_PAGE_TEXTS = f"texts AS (SELECT 'page' || page_id || '.html' AS path, 'pages' AS target, content, '.html' AS ext, 'x.html' AS name, 0 AS slot, 0 AS first_line, {split_lines('content')} AS all_lines FROM (SELECT page_id, replace(html, '&quot;', '\"') AS content FROM pages))"
_PAGE_DETECTORS = ["secrets", "owasp", "rag", "agent", "custom"]
ORACLES["stream_artifact_findings"] = scan("SELECT file_path, finding_id, line_number, column_number, severity FROM kept")
ORACLES["stream_page_findings"] = "WITH " + ",\n".join([
    _PAGE_TEXTS, "lines AS (SELECT path, target, slot, name, ext, all_lines, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS line_number FROM texts)",
    *[_PARTS[d] for d in _PAGE_DETECTORS], CATALOGUE, _CUSTOM_ROWS, findings_ctes(_PAGE_DETECTORS)]) + "\nSELECT file_path, finding_id, line_number, column_number, severity FROM kept"
ORACLES["stream_audit_two_streams"] = "SELECT 't' || user_id AS target, 2 * count(*) AS entries, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS latest, round(2 * sum(value), 2) AS score FROM events GROUP BY 1"
ORACLES["stream_audit_entries"] = "SELECT 't' || user_id AS target, count(*) AS entries, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS latest, round(sum(value), 2) AS score FROM events GROUP BY 1"

# --- the same with finer targets -----------------------------------------------------------------------------------

_GATES = " UNION ALL ".join(
    f"SELECT target, {violations} AS violations, CASE WHEN {violations} > 0 THEN 3 WHEN critical > 0 THEN 2 WHEN high > 0 THEN 1 ELSE 0 END AS status, '{bound}' AS fail_on FROM summary"
    for bound, violations in (("medium", "critical + high + medium"), ("none", "0")))
_FINE = ("source AS target", "source || '/' || slot AS target")
ORACLES["policy_gate_fine"] = scan(_GATES, more=summary_ctes()).replace(*_FINE)
ORACLES["domain_status_fine"] = ORACLES["domain_status_soc2"].replace(*_FINE)
