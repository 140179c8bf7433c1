"""The registered queries: one per operator, each over whole tables or over data derived from them."""

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardspark.catalog import patterns as cat
from wardspark.catalog.advisories import ADVISORIES
from wardspark.catalog.rules import DETECTOR_RULES, RULES
from wardspark.functions import identifiers as ids
from wardspark.functions.entropy import shannon_entropy
from wardspark.functions.payloads import base64_payload, hex_payload, obfuscation_evidence, sanitize_prompt
from wardspark.functions.regex import column_of, find_all, line_of, match_offsets, match_places as match_places_of
from wardspark.functions.text import basename, count_lines, decode_text, snippet, split_lines, strip, suffix
from wardspark.functions.versions import version_lt
from wardspark.operators import code_rules, compliance, diff, findings as fnd, prompts, supply
from wardspark.operators.scan import dedup_hits, enrich_findings, explode_hits, resolve_findings, rule_table, rule_trials, scan_artifacts
from wardspark.operators.chunks import chunk_offsets, cut_artifacts, scan_chunks
from wardspark.operators.hits import hit
from wardspark.operators.registry import FOUND, Detectors
from wardspark.plans import corpora
from wardspark.plans.pipelines import ScanRun, run_scan
from wardspark.plans.storage import new_location, written
from wardspark.sinks import audit, reports as report_sink, sarif, sbom
from wardspark.schemas import CUSTOM_RULES
from wardspark.sources.local import local_table
from wardspark.sources import reports as report_source, rule_files
from wardspark.sources.files import opened, read_chunks
from wardspark.sources.artifacts import artifacts_from_table, in_ignored_directory, scannable, spread
from wardspark.streaming.rescan import Rescan, stream_rescan
from wardspark.streaming.pipelines import stream_audit_append, stream_scan_artifacts, stream_score_prompts

QUERIES: dict = {}
STAMP = "2026-01-01T00:00:00"
HEX40 = r'token = "[0-9a-f]{40}"'


def query(function=None, *, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        return f

    return add(function) if function else add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


def document_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts_from_table(documents(spark, sf_dir), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")), F.col("text"), F.col("source"))


def page_artifacts(rows: DataFrame) -> DataFrame:
    """Pages as artifacts, with quotes unescaped."""
    return artifacts_from_table(rows, F.concat(F.lit("page"), "page_id", F.lit(".html")), F.replace("html", F.lit("&quot;"), F.lit('"')), F.lit("pages"))


def joined(column, separator: str = "|") -> Column:
    return F.array_join(column, separator)


# --- shared inputs -------------------------------------------------------------------------------------------------

def custom_rules(spark: SparkSession) -> list[dict]:
    return rule_files.compile_custom_rules(local_table(spark, corpora.CUSTOM_RULES, CUSTOM_RULES))


def scanned(spark: SparkSession, sf_dir: str, detectors: list[str] | None = None) -> DataFrame:
    rules = custom_rules(spark) if detectors is None or "custom" in detectors else []
    return scan_artifacts(corpora.code_corpus(spark, sf_dir), rules, detectors)


def all_findings(spark: SparkSession, sf_dir: str, detectors: list[str] | None = None) -> DataFrame:
    return resolve_findings(scanned(spark, sf_dir, detectors))


def findings(spark: SparkSession, sf_dir: str, by: str = "family") -> DataFrame:
    return resolve_findings(scanned(spark, sf_dir).withColumn("hits", dedup_hits(F.col("hits"), by)))


def run(spark: SparkSession, sf_dir: str) -> ScanRun:
    """One stored scan, for queries that read its result more than once."""
    return run_scan(corpora.code_corpus(spark, sf_dir), custom_rules(spark))


def baseline_and_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of two sets of detectors, so that some are new, fixed and persisting. The corpus is scanned once, for both sets."""
    both = sorted(set(corpora.BASELINE_DETECTORS) | set(corpora.CURRENT_DETECTORS), key=cat.DETECTORS.index)
    stored = written(scanned(spark, sf_dir, both), "scanned")
    of = lambda names: resolve_findings(stored.withColumn("hits", dedup_hits(F.filter("hits", lambda h: h["detector"].isin(names)))))
    return of(corpora.BASELINE_DETECTORS), of(corpora.CURRENT_DETECTORS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.score_prompts(corpora.prompt_corpus(spark, sf_dir))


# --- sources -------------------------------------------------------------------------------------------------------

@query
def artifacts_from_documents(spark, sf_dir):
    return document_artifacts(spark, sf_dir).select("path", "target", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


@query
def chunked_findings(spark, sf_dir):
    """All findings of the code corpus, cut into chunks of seven lines."""
    chunks = cut_artifacts(corpora.code_corpus(spark, sf_dir), 7)
    rows = resolve_findings(scan_chunks(chunks, custom_rules(spark)).withColumn("hits", dedup_hits(F.col("hits"))))
    return rows.select("file_path", "finding_id", "severity", "line_number", "column_number", F.when(F.col("detector").isin("secrets", "owasp"), F.md5("code_snippet")).alias("snippet"))


@query
def chunk_places(spark, sf_dir):
    """Lines and characters before each chunk of five lines of every document."""
    chunks = chunk_offsets(cut_artifacts(document_artifacts(spark, sf_dir), 5))
    return chunks.select("path", "part", "first_line", "first_offset", F.md5("content").alias("chunk"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for every document, written by the tasks."""
    folder = new_location(spark, "files")

    def save(batches):
        for batch in batches:
            system, top = opened(folder)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(content.encode())
            yield batch.select(["name"])

    corpora.file_artifacts(documents(spark, sf_dir)).mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query
def file_findings(spark, sf_dir):
    """Line findings of files that were written to the shared folder, read in ranges of 2,000 bytes, hidden names among them."""
    folder = _files(spark, sf_dir)
    chunks = read_chunks(spark, folder, range_bytes=2000, task_bytes=1 << 20)
    top = len(opened(folder)[1]) + 2
    rows = resolve_findings(scan_chunks(chunks, detectors=["secrets", "owasp", "rag", "agent", "model"]))
    return rows.select(F.expr(f"substring(file_path, {top})").alias("file_path"), "finding_id", "severity", "line_number", "column_number")


@query
def decode_invalid_utf8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(F.unhex(F.lit("FFC3")), F.col("text").cast("binary"), F.unhex(F.lit("E282")), F.lit("end").cast("binary"))
    return docs.select("doc_id", F.md5(decode_text(raw)).alias("text_md5"))


@query
def explode_lines(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return docs.select("doc_id", (F.col("pos") + 1).alias("line_number"), F.md5("line").alias("line_md5"))


@query
def line_totals(spark, sf_dir):
    html = pages(spark, sf_dir).select(F.lit("pages").alias("source"), F.col("html").alias("text"))
    return documents(spark, sf_dir).select("source", "text").unionAll(html).groupBy("source").agg(F.count("*").alias("files"), F.sum(count_lines(F.col("text"))).alias("lines"))


@query
def signature_hit_counts(spark, sf_dir):
    signatures = rule_files.signature_table(spark).select("ord", "type", "weight")
    hits = scored(spark, sf_dir).select(F.explode("threat_types").alias("type")).groupBy("type").agg(F.count("*").alias("prompts"))
    return signatures.join(hits, "type", "left").select("ord", "type", "weight", F.coalesce("prompts", F.lit(0)).alias("prompts"))


@query
def signature_file_hit_counts(spark, sf_dir):
    signatures = rule_files.load_prompt_signatures(spark)
    hits = scored(spark, sf_dir).select(F.explode("threat_types").alias("type")).groupBy("type").agg(F.count("*").alias("prompts"))
    return signatures.join(hits, "type", "left").select("ord", "category", "type", "level", F.coalesce("prompts", F.lit(0)).alias("prompts"))


@query
def retrieval_signature_counts(spark, sf_dir):
    rules = rule_files.load_signature_rules(spark).select(F.col("id").alias("rule_id"), "severity", "cwe", "owasp")
    hits = all_findings(spark, sf_dir, ["rag"]).groupBy("rule_id").agg(F.count("*").alias("findings"))
    return rules.join(hits, "rule_id", "left").select("rule_id", "severity", "cwe", "owasp", F.coalesce("findings", F.lit(0)).alias("findings"))


@query
def signature_rule_findings(spark, sf_dir):
    """Retrieval findings by signatures that were written to a file in the shared folder and read back from it."""
    place = new_location(spark, "signatures")
    entries = [{"id": f"OWN-{p['rule_id']}", "title": "Own", "pattern": p["pattern"], "severity": "low", "cwe": "CWE-1", "owasp": "LLM01", "remediation": "r"} for p in cat.RAG_PATTERNS]
    local_table(spark, [{"value": json.dumps({"signatures": entries})}], "value string").coalesce(1).write.text(place)
    rules = [r.asDict() for r in rule_files.load_signature_rules(spark, place).collect()]
    rows = resolve_findings(scan_artifacts(corpora.code_corpus(spark, sf_dir), detectors=["rag"], signature_rules=rules))
    return rows.select("file_path", "finding_id", "line_number", "column_number", "severity")


@query
def advisory_file_findings(spark, sf_dir):
    """Dependencies by an advisory file in the shared folder."""
    place = new_location(spark, "advisories")
    rows = [{k: a[k] for k in ("package", "vulnerable_below", "cve", "severity", "cwe", "owasp", "description", "remediation")} for a in ADVISORIES]
    local_table(spark, [{"value": json.dumps({"advisories": rows})}], "value string").coalesce(1).write.text(place)
    scan = scanned(spark, sf_dir, ["supply"])
    return resolve_findings(scan, rule_files.load_advisories(spark, place)).select("file_path", "finding_id", "severity", "line_number")


@query
def extra_detector_findings(spark, sf_dir):
    """A detector of the caller's own: lines of at least 500 characters."""
    def wide(path, content, lines):
        numbered = F.filter(F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), F.length(line).alias("size"))), lambda x: x["size"] >= 500)
        return F.transform(numbered, lambda x: hit("custom", "WIDE-001", x["n"], 1, [x["n"], 0, 0], attrs={"severity": "INFO", "title": "Wide line"}))

    rows = resolve_findings(scan_artifacts(document_artifacts(spark, sf_dir), detectors=["model"], extra_detectors=[wide]))
    return rows.select("file_path", "finding_id", "line_number", "severity")


def own_detectors() -> Detectors:
    """A detector that is a function of a table: lines with a number of at least six digits."""
    detectors = Detectors()

    @detectors.register("numbers")
    def numbers(artifacts: DataFrame) -> DataFrame:
        lines = F.transform(split_lines(F.coalesce("content", F.lit(""))), lambda line, i: F.struct((i + 1).alias("n"), F.regexp_instr(line, F.lit("[0-9]{6}")).alias("at")))
        row = lambda x: F.struct(
            F.lit("NUM-001").alias("rule_id"), x["n"].alias("line"), x["at"].alias("col"), F.lit(None).cast("string").alias("match"),
            F.create_map(F.lit("title"), F.lit("Long number"), F.lit("severity"), F.lit("LOW")).alias("attrs"))
        return artifacts.withColumn("found", F.transform(F.filter(lines, lambda x: x["at"] > 0), row).cast(FOUND))

    return detectors


@query
def registered_detector_findings(spark, sf_dir):
    """A whole scan with a registered detector, line findings by a file's secret rules among the others."""
    rules = rule_files.compile_secret_rules(local_table(spark, [{"ord": i, **r} for i, r in enumerate(corpora.SECRET_SIGNATURES)], f"ord int, {rule_files.SECRET_RULES}"))
    done = run_scan(corpora.code_corpus(spark, sf_dir), detectors=["secrets"], secret_rules=rules, registered=own_detectors())
    return done.findings.select("file_path", "finding_id", "severity", "line_number", "column_number")


@query
def stream_registered_findings(spark, sf_dir):
    """The same over a stream, with retrieval signatures of a file."""
    rules = [{"id": f"OWN-{p['rule_id']}", "title": "Own", "pattern": p["pattern"], "severity": "LOW", "cwe": "CWE-1", "owasp": "LLM01", "remediation": "r"} for p in cat.RAG_PATTERNS]
    artifacts = corpora.code_artifacts(_read_stream(spark, sf_dir, "documents"))
    rows = stream_scan_artifacts(artifacts, detectors=["rag"], signature_rules=rules, registered=own_detectors())
    return _streamed(rows.select("file_path", "finding_id", "severity", "line_number", "column_number"))


@query
def advisory_exposure(spark, sf_dir):
    advisories = supply.advisory_table(spark)
    deps = supply.dependencies(corpora.code_corpus(spark, sf_dir))
    hits = supply.match_advisories(deps, advisories).groupBy(F.col("advisory.cve").alias("cve")).agg(F.count("*").alias("dependencies"))
    return advisories.join(hits, "cve", "left").select("cve", F.col("package").alias("package"), "severity", F.coalesce("dependencies", F.lit(0)).alias("dependencies"))


@query
def custom_rule_findings(spark, sf_dir):
    return all_findings(spark, sf_dir, ["custom"]).select(
        "file_path", "finding_id", "title", "category", "severity", "description", "line_number", "column_number", "cwe_id", "owasp_id", "remediation")


@query
def custom_rule_status(spark, sf_dir):
    """Every custom rule: whether it is accepted, why not, and how often it hits."""
    rules = local_table(spark, rule_files.check_custom_rules(local_table(spark, corpora.CUSTOM_RULES, CUSTOM_RULES)), rule_files.RULE_STATUS)
    hits = all_findings(spark, sf_dir, ["custom"]).groupBy("rule_id").agg(F.count("*").alias("findings"))
    return rules.join(hits, rules["id"] == hits["rule_id"], "left").select("id", "accepted", "reason", F.coalesce("findings", F.lit(0)).alias("findings"))


@query
def many_signatures(spark, sf_dir):
    """Prompts scored with a hundred signatures more than there are built in, more than one mask holds."""
    extra = [{"type": f"Letter pair {i}", "weight": 1, "pattern": f"{chr(97 + i // 10)}{chr(97 + i % 10)}x", "anchors": [f"{chr(97 + i // 10)}{chr(97 + i % 10)}x"]} for i in range(100)]
    rows = prompts.score_prompts(corpora.prompt_corpus(spark, sf_dir), signatures=rule_files.all_signatures(spark) + extra)
    return rows.select("conv_id", "turn", F.size(F.filter("threat_types", lambda t: t.startswith("Letter pair"))).alias("pairs"), "threat_score")


def many_rules(spark: SparkSession) -> list[dict]:
    return rule_files.compile_custom_rules(local_table(spark, corpora.many_rules(200), CUSTOM_RULES))


@query
def many_custom_rules(spark, sf_dir):
    """Findings of 200 custom rules, counted, with the sums of their places."""
    rows = scan_artifacts(corpora.code_corpus(spark, sf_dir), many_rules(spark), ["custom"]).select("path", F.explode_outer("hits").alias("h")).where("h is not null")
    return rows.groupBy(F.col("h.rule_id").alias("rule_id")).agg(
        F.count("*").alias("findings"), F.countDistinct("path").alias("artifacts"), F.sum("h.line").alias("lines"), F.sum("h.col").alias("columns"), F.sum(F.length("h.match")).alias("characters"))


@query
def custom_rule_trials(spark, sf_dir):
    """Over how many texts the pattern of each of 200 custom rules has to run, and how many it matches."""
    rows = rule_trials(corpora.code_corpus(spark, sf_dir), many_rules(spark))
    return rows.select("rule_id", F.col("anchors").isNotNull().alias("gated"), "texts", "matched", (F.col("tried") >= F.col("matched")).alias("covered"), "tried")


@query
def secret_signature_findings(spark, sf_dir):
    """Line findings by secret signatures that were written to a file in the shared folder, together with the built-in ones."""
    place = new_location(spark, "secrets")
    local_table(spark, [{"value": json.dumps({"signatures": corpora.SECRET_SIGNATURES})}], "value string").coalesce(1).write.text(place)
    rules = rule_files.load_secret_rules(spark, place)
    rows = resolve_findings(scan_artifacts(corpora.code_corpus(spark, sf_dir), detectors=["secrets"], secret_rules=rules))
    return rows.select("file_path", "finding_id", "rule_id", "severity", "cwe_id", "owasp_id", "line_number", "column_number", F.element_at("seq", 2).alias("place"))


@query
def custom_rule_on_pages(spark, sf_dir):
    return resolve_findings(scan_artifacts(page_artifacts(pages(spark, sf_dir)), custom_rules(spark), ["custom"])).select("file_path", "finding_id", "line_number", "column_number", "severity")


@query
def baseline_round_trip(spark, sf_dir):
    done = run(spark, sf_dir)
    documents = report_sink.report_documents(done.findings, done.summary, STAMP)
    back = report_source.baseline_findings(documents, "document")
    return back.select("target", "finding_id", "family", "severity", "file_path", "line_number", "column_number", "cwe_id", "owasp_id",
                       F.round("confidence", 2).alias("confidence"))


@query
def dependencies(spark, sf_dir):
    return supply.dependencies(corpora.code_corpus(spark, sf_dir))


# --- filters -------------------------------------------------------------------------------------------------------

@query
def path_filters(spark, sf_dir):
    path = F.col("path")
    return corpora.path_corpus(spark, sf_dir).select(
        "doc_id", scannable(path).alias("scannable"), in_ignored_directory(path).alias("ignored"),
        supply.manifest_kind(path).alias("manifest"), code_rules.is_python(path).alias("python"), suffix(path).alias("suffix"),
        basename(path).alias("basename"))


@query
def severity_filter_equal(spark, sf_dir):
    return fnd.severity_filter(findings(spark, sf_dir), "high").select("file_path", "finding_id")


@query
def severity_filter_at_least(spark, sf_dir):
    return fnd.severity_filter(findings(spark, sf_dir), "high", mode="at_least").select("file_path", "finding_id", "severity")


@query
def policy_gate(spark, sf_dir):
    return fnd.policy_gate(run(spark, sf_dir).summary, "medium")


def run_fine(spark: SparkSession, sf_dir: str) -> ScanRun:
    """A stored scan with a target per source and kind of fragment, so that clean targets and all degrees of trouble occur."""
    number = F.regexp_extract("path", "/d([0-9]+)/", 1).cast("bigint")
    corpus = corpora.code_corpus(spark, sf_dir).withColumn("target", F.concat("target", F.lit("/"), number % len(corpora.CODE_SLOTS)))
    return run_scan(corpus, custom_rules(spark))


@query
def policy_gate_fine(spark, sf_dir):
    summary = run_fine(spark, sf_dir).summary
    return fnd.policy_gate(summary, "medium").withColumn("fail_on", F.lit("medium")).unionByName(fnd.policy_gate(summary).withColumn("fail_on", F.lit("none")))


@query
def domain_status_fine(spark, sf_dir):
    done = run_fine(spark, sf_dir)
    return compliance.domain_status(done.findings, done.summary, "soc2")


@query
def search_findings(spark, sf_dir):
    return fnd.search_findings(findings(spark, sf_dir), "CWE-5", "critical").select("file_path", "finding_id", "cwe_id")


@query
def filter_rules_with_counts(spark, sf_dir):
    rules = fnd.filter_rules(rule_table(spark), severity="critical", tag="RCE", keyword="cwe-502")
    counts = findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("findings"))
    return rules.join(counts, "rule_id", "left").select("rule_id", "severity", F.coalesce("findings", F.lit(0)).alias("findings"))


@query
def rule_catalogue_with_counts(spark, sf_dir):
    counts = findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("findings"))
    return rule_table(spark).join(counts, "rule_id", "left").select(
        "rule_id", "category", "severity", "cwe_id", "owasp_id", joined("tags").alias("tags"), F.coalesce("findings", F.lit(0)).alias("findings"))


@query
def get_rule_findings(spark, sf_dir):
    rule = fnd.get_rule(rule_table(spark), "SEC-KEY-003").select("rule_id", "owasp_id")
    return findings(spark, sf_dir).select("rule_id", "file_path", "line_number").join(rule, "rule_id")


@query
def registered_rule_counts(spark, sf_dir):
    catalogue = rule_table(spark, RULES + DETECTOR_RULES)
    changed = catalogue.where("rule_id = 'SEC-KEY-003'").withColumn("severity", F.lit("LOW"))
    added = catalogue.where("rule_id = 'SEC-KEY-001'").withColumn("rule_id", F.lit("SEC-KEY-999"))
    rules = fnd.register_rules(catalogue, changed.unionByName(added))
    hits = explode_hits(scanned(spark, sf_dir, ["secrets"]))
    return enrich_findings(hits, rules).groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))


# --- detection rules -----------------------------------------------------------------------------------------------

def _rule_query(rule_id: str, detector: str):
    def matches(spark, sf_dir):
        hits = scanned(spark, sf_dir, [detector]).withColumn("hits", F.filter("hits", lambda h: h["rule_id"] == rule_id))
        return resolve_findings(hits).select("file_path", "finding_id", "line_number", "column_number", "severity")

    return matches


RULE_DETECTORS = {p["rule_id"]: "secrets" for p in cat.LINE_PATTERNS}
RULE_DETECTORS |= {c["rule_id"]: "owasp" for c in cat.SUBSTRING_CHECKS}
RULE_DETECTORS |= {r["rule_id"]: "ast" for r in RULES if r["rule_id"].startswith("AST-")}
RULE_DETECTORS |= {p["rule_id"]: "rag" for p in cat.RAG_PATTERNS} | {cat.SSL_RULE_ID: "rag"}
RULE_DETECTORS |= {p["rule_id"]: "agent" for p in cat.AGENT_PATTERNS}
for _rule, _detector in RULE_DETECTORS.items():
    QUERIES["rule_" + _rule.lower().replace("-", "_")] = _rule_query(_rule, _detector)


@query
def secret_details(spark, sf_dir):
    return all_findings(spark, sf_dir, ["secrets"]).select(
        "file_path", "finding_id", "metadata.match", "metadata.match_sha256", F.md5("code_snippet").alias("snippet_md5"), "confidence")


@query
def model_artifacts(spark, sf_dir):
    return all_findings(spark, sf_dir, ["model"]).select("file_path", "finding_id", "severity", "line_number", F.try_element_at("metadata", F.lit("extension")).alias("extension"),
                                                         "confidence")


@query
def supply_chain_findings(spark, sf_dir):
    return all_findings(spark, sf_dir, ["supply"]).select(
        "file_path", "finding_id", "severity", "line_number", "cwe_id", "owasp_id", "metadata.package", "metadata.version", "metadata.cve", "metadata.safe_version")


@query
def resolved_calls(spark, sf_dir):
    return code_rules.resolve_imports(corpora.code_corpus(spark, sf_dir)).select("path", "line", "col", "func", "resolved_name")


@query
def call_arguments(spark, sf_dir):
    """The source text of the arguments of all calls, hashed."""
    kwargs = F.array_join(F.array_sort(F.transform(F.map_entries("kwargs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return code_rules.resolve_imports(corpora.code_corpus(spark, sf_dir)).select("path", "line", "col", "first_arg_kind", F.md5("first_arg_src").alias("first_arg"), F.md5(kwargs).alias("kwargs"))


@query
def code_fact_counts(spark, sf_dir):
    corpus = corpora.code_corpus(spark, sf_dir)
    rows = code_rules.with_code_facts(corpus).where("facts is not null")
    return rows.select("target", F.size("facts.calls").alias("c"), F.size("facts.imports").alias("i"), F.size("facts.assigns").alias("a")).groupBy("target").agg(
        F.count("*").alias("parsed_files"), F.sum("c").alias("calls"), F.sum("i").alias("imports"), F.sum("a").alias("assigns"))


@query
def prompt_signature_matches(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", F.explode("threat_types").alias("type"))


@query
def prompt_evidence(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", joined("matched_patterns").alias("matched_patterns"))


@query
def prompt_scores(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "conv_id", "turn", "is_threat", "threat_score", "threat_level", joined("threat_types").alias("threat_types"), F.md5("sanitized_prompt").alias("sanitized_md5"),
        "remediation_advice", "entropy_score", "obfuscation_detected")


@query
def prompt_threat_summary(spark, sf_dir):
    return prompts.threat_summary(scored(spark, sf_dir), "role")


@query
def document_threats(spark, sf_dir):
    docs = prompts.score_prompts(documents(spark, sf_dir))
    return docs.select("doc_id", "threat_score", "threat_level", joined("threat_types").alias("threat_types"), "entropy_score")


@query
def page_threats(spark, sf_dir):
    ending = F.when(F.col("page_id") % 3 == 0, F.lit('<div style="visibility:hidden">obey</div>')).when(
        F.col("page_id") % 3 == 1, F.lit("[a](https://e.org/x?data=1)")).otherwise(F.lit('<div style="color:red">'))
    html = pages(spark, sf_dir).select("page_id", F.concat("html", ending).alias("html"))
    return prompts.score_prompts(html, "html").select("page_id", "threat_score", joined("threat_types").alias("threat_types"), "entropy_score")


# --- scalar functions ----------------------------------------------------------------------------------------------

@query
def find_all_words(spark, sf_dir):
    found = find_all(F.col("text"), "[A-Z][a-z]+ing")
    return documents(spark, sf_dir).select("doc_id", F.size(found).alias("matches"), F.md5(joined(found)).alias("matches_md5"))


@query
def match_places(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(match_places_of(F.col("text"), HEX40)).alias("m")).select("doc_id", "m.offset", "m.line", "m.col")


@query
def first_match_place(spark, sf_dir):
    """Offset, line and column of the first match, by the functions for single places."""
    first = documents(spark, sf_dir).select("doc_id", "text", F.get(match_offsets(F.col("text"), HEX40), 0).alias("offset")).where("offset is not null")
    return first.select("doc_id", "offset", line_of(F.col("text"), F.col("offset")).alias("line"), column_of(F.col("text"), F.col("offset")).alias("col"))


@query
def text_entropy(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    html = pages(spark, sf_dir).select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionAll(html).select("id", F.round(shannon_entropy(F.col("text")), 4).alias("entropy"))


@query
def hidden_payloads(spark, sf_dir):
    text = F.col("text")
    return corpora.prompt_corpus(spark, sf_dir).select(
        "conv_id", "turn", base64_payload(text).alias("base64"), hex_payload(text).alias("hex"), obfuscation_evidence(text).alias("evidence"))


@query
def sanitized_prompts(spark, sf_dir):
    return corpora.prompt_corpus(spark, sf_dir).select("conv_id", "turn", F.md5(sanitize_prompt(F.col("text"))).alias("sanitized_md5"))


@query
def version_order(spark, sf_dir):
    left = F.concat(F.col("doc_id") % 3, F.lit("."), F.col("doc_id") % 12, F.element_at(F.array(*[F.lit(x) for x in ("", ".0", "rc1", ".post1", ".dev2", "+cpu", "b2.dev1", ".*")]), (F.col("doc_id") % 8 + 1).cast("int")))
    right = F.concat(F.col("doc_id") % 2, F.lit("."), F.col("doc_id") % 11, F.lit(".0"))
    return table(spark, sf_dir, "documents").select("doc_id", left.alias("a"), right.alias("b")).withColumn("older", version_lt(F.col("a"), F.col("b")))


@query
def identifier_functions(spark, sf_dir):
    fid = F.col("finding_id")
    return findings(spark, sf_dir).select(
        "file_path", fid, ids.rule_family(fid).alias("family_of"), ids.rule_base(fid).alias("base"), basename(F.col("file_path")).alias("basename"),
        suffix(F.col("file_path")).alias("suffix"), ids.mask_match(F.col("file_path")).alias("masked"),
        ids.fingerprint_sha(F.col("rule_id"), F.col("file_path"), F.col("line_number")).alias("sha"),
        ids.normalize_package(F.upper("target")).alias("normalized"), ids.finding_id(F.col("rule_id"), F.col("line_number")).alias("made_id"))


# --- findings ------------------------------------------------------------------------------------------------------

@query
def findings_by_detector(spark, sf_dir):
    return all_findings(spark, sf_dir).groupBy("detector", "rule_id").agg(F.count("*").alias("findings"))


@query
def dedup_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("target", "file_path", "line_number", "family", "finding_id", "severity")


@query
def dedup_by_rule(spark, sf_dir):
    return findings(spark, sf_dir, by="rule_id").groupBy("target", "rule_id").agg(F.count("*").alias("findings"))


@query
def enriched_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("file_path", "finding_id", "rule_id", "category", "severity", "cwe_id", "owasp_id", "confidence", "metadata.detector")


@query
def finding_sequence(spark, sf_dir):
    return findings(spark, sf_dir).select("file_path", "finding_id", "detector_ord", F.when(F.col("detector") == "ast", F.lit("")).otherwise(joined(F.col("seq").cast("array<string>"))).alias("seq"))


@query
def line_snippets(spark, sf_dir):
    shown = lambda lines: F.transform(F.sequence(F.lit(0), F.size(lines) + 1), lambda n: F.struct(n.alias("line"), F.md5(snippet(lines, n)).alias("snippet_md5")))
    every = F.get(F.transform(F.array(split_lines(F.col("text"))), shown), 0)
    return documents(spark, sf_dir).select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.line", "s.snippet_md5")


@query
def order_findings(spark, sf_dir):
    return fnd.order_findings(findings(spark, sf_dir)).select("severity", "file_path", "line_number", "finding_id")


@query
def severity_counts(spark, sf_dir):
    return fnd.severity_counts(findings(spark, sf_dir))


@query
def scan_totals(spark, sf_dir):
    return fnd.scan_totals(scanned(spark, sf_dir, ["model"]))


@query
def scan_summary(spark, sf_dir):
    return run(spark, sf_dir).summary


@query
def native_document_scan(spark, sf_dir):
    return run_scan(document_artifacts(spark, sf_dir), custom_rules(spark)).summary


# --- diff and compliance -------------------------------------------------------------------------------------------

_DIFF_COLUMNS = ("target", "fingerprint", "file_path", "finding_id", "severity")


@query
def diff_findings(spark, sf_dir):
    return diff.diff_findings(*baseline_and_current(spark, sf_dir)).select("status", *_DIFF_COLUMNS)


@query
def order_diff(spark, sf_dir):
    return diff.order_diff(diff.diff_findings(*baseline_and_current(spark, sf_dir))).select("status", "fingerprint", "target")


@query
def new_findings(spark, sf_dir):
    return diff.new_findings(*baseline_and_current(spark, sf_dir)).select(*_DIFF_COLUMNS)


@query
def fixed_findings(spark, sf_dir):
    return diff.fixed_findings(*baseline_and_current(spark, sf_dir)).select(*_DIFF_COLUMNS)


@query
def persisting_findings(spark, sf_dir):
    return diff.persisting_findings(*baseline_and_current(spark, sf_dir)).select(*_DIFF_COLUMNS)


@query
def fingerprint_sets(spark, sf_dir):
    new, fixed, both = diff.fingerprint_sets(*baseline_and_current(spark, sf_dir))
    return new.withColumn("status", F.lit("new")).unionByName(fixed.withColumn("status", F.lit("fixed"))).unionByName(both.withColumn("status", F.lit("persisting")))


@query
def diff_summary(spark, sf_dir):
    return diff.diff_summary(diff.diff_findings(*baseline_and_current(spark, sf_dir)), "target")


@query
def controls_soc2(spark, sf_dir):
    return compliance.map_controls(findings(spark, sf_dir), "soc2").select("framework", "domain", "file_path", "finding_id")


@query
def controls_iso27001(spark, sf_dir):
    return compliance.map_controls(findings(spark, sf_dir), "iso27001").select("framework", "domain", "file_path", "finding_id")


@query
def domain_status_soc2(spark, sf_dir):
    done = run(spark, sf_dir)
    return compliance.domain_status(done.findings, done.summary, "soc2")


@query
def compliance_summary_iso27001(spark, sf_dir):
    done = run(spark, sf_dir)
    return compliance.compliance_summary(done.findings, done.summary, "iso27001")


# --- exports -------------------------------------------------------------------------------------------------------

@query
def report_documents(spark, sf_dir):
    done = run(spark, sf_dir)
    documents = report_sink.report_documents(done.findings, done.summary, STAMP, max_rows=20)
    shape = "target_path string, findings_count bigint, metrics struct<security_score:double,total_files_scanned:bigint,critical_count:bigint>, findings array<struct<id:string>>"
    d = F.from_json("document", shape)
    return documents.select("target", "part", d.alias("d")).groupBy("target").agg(
        F.max("d.findings_count").alias("findings_count"), F.max("d.metrics.security_score").alias("security_score"),
        F.max("d.metrics.total_files_scanned").alias("files"), F.max("d.metrics.critical_count").alias("critical"),
        F.sum(F.size("d.findings")).alias("listed"))


def _digest(items: Column, *fields: str) -> Column:
    """A hash of a document's list, in its order."""
    return F.md5(F.array_join(F.transform(items, lambda i: F.concat_ws("|", *[functools.reduce(lambda x, name: x[name], f.split("."), i).cast("string") for f in fields])), "\n"))


@query
def report_contents(spark, sf_dir):
    """What the parts of report documents hold, in order."""
    done = run(spark, sf_dir)
    documents = report_sink.report_documents(done.findings, done.summary, STAMP, max_rows=20)
    shape = "findings array<struct<id:string,severity:string,category:string,file_path:string,line_number:int,column_number:int,cwe_id:string,owasp_id:string>>"
    d = F.from_json("document", shape)["findings"]
    return documents.select("target", "part", "parts", F.size(d).alias("findings"), _digest(d, "id", "severity", "category", "file_path", "line_number", "column_number", "cwe_id", "owasp_id").alias("digest"))


@query
def sarif_contents(spark, sf_dir):
    """What the parts of SARIF documents hold, in order."""
    done = run(spark, sf_dir)
    documents = sarif.sarif_documents(done.findings, done.summary, STAMP, max_rows=20)
    shape = ("runs array<struct<results:array<struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>,"
             "properties:struct<cwe:string,owasp:string>>>,tool:struct<driver:struct<rules:array<struct<id:string>>>>>>")
    first = F.from_json("document", shape)["runs"][0]
    results = F.transform(first["results"], lambda r: F.struct(r["ruleId"].alias("rule"), r["level"].alias("level"), r["locations"][0]["physicalLocation"].alias("at"), r["properties"].alias("p")))
    return documents.select(
        "target", "part", "parts", _digest(results, "rule", "level", "at.artifactLocation.uri", "at.region.startLine", "at.region.startColumn", "p.cwe", "p.owasp").alias("digest"),
        F.array_join(first["tool"]["driver"]["rules"]["id"], "|").alias("rules"))


@query
def sbom_contents(spark, sf_dir):
    """What the parts of bills of materials hold, in order."""
    done = run(spark, sf_dir)
    documents = sbom.sbom_documents(supply.dependencies(corpora.code_corpus(spark, sf_dir)), done.findings, STAMP, max_rows=20, targets=done.summary)
    d = F.from_json("document", "components array<struct<purl:string>>, vulnerabilities array<struct<id:string,affects:array<struct<ref:string>>>>")
    affected = F.transform(d["vulnerabilities"], lambda v: F.struct(v["id"].alias("id"), v["affects"][0].alias("a")))
    return documents.select("target", "part", "parts", _digest(d["components"], "purl").alias("components"), _digest(affected, "id", "a.ref").alias("vulnerabilities"))


@query
def csv_columns(spark, sf_dir):
    """All ten columns of the line, agent, code and library detectors' findings, texts as hashes."""
    rows = resolve_findings(scanned(spark, sf_dir, ["ast", "secrets", "owasp", "rag", "agent"]).withColumn("hits", dedup_hits(F.col("hits"))))
    plain = {"ID": "id", "Severity": "severity", "Category": "category", "File": "file", "Line": "line", "CWE": "cwe", "OWASP": "owasp"}
    return report_sink.csv_rows(rows).select(*[F.col(k).alias(v) for k, v in plain.items()], *[F.md5(k).alias(k.lower()) for k in ("Title", "Description", "Remediation")])


@query
def code_finding_ranks(spark, sf_dir):
    """Where each code finding stands among those of its file."""
    rows = all_findings(spark, sf_dir, ["ast"])
    place = Window.partitionBy("file_path").orderBy("seq")
    return rows.select("file_path", "finding_id", "column_number", F.row_number().over(place).alias("rank"))


@query
def csv_rows(spark, sf_dir):
    columns = {"ID": "id", "Severity": "severity", "Category": "category", "File": "file", "Line": "line", "CWE": "cwe", "OWASP": "owasp"}
    return report_sink.csv_rows(findings(spark, sf_dir)).select(*[F.col(k).alias(v) for k, v in columns.items()])


@query
def sarif_rules(spark, sf_dir):
    return sarif.sarif_rules(findings(spark, sf_dir)).select("id", joined("tags").alias("tags"), "problem_severity", "security_severity", "level")


@query
def sarif_results(spark, sf_dir):
    return sarif.sarif_results(findings(spark, sf_dir)).select("rule_id", "level", "uri", "start_line", "start_column", "fingerprint")


@query
def sarif_documents(spark, sf_dir):
    done = run(spark, sf_dir)
    documents = sarif.sarif_documents(done.findings, done.summary, STAMP, max_rows=20)
    shape = "version string, runs array<struct<results:array<struct<ruleId:string,level:string>>,properties:struct<securityScore:double,totalFindings:bigint>>>"
    first = F.from_json("document", shape)["runs"][0]
    return documents.select("target", first.alias("run")).groupBy("target").agg(
        F.sum(F.size("run.results")).alias("results"), F.sum(F.size(F.filter("run.results", lambda r: r["level"] == "error"))).alias("errors"),
        F.max("run.properties.securityScore").alias("security_score"), F.max("run.properties.totalFindings").alias("total"))


@query
def sbom_components(spark, sf_dir):
    return sbom.sbom_components(supply.dependencies(corpora.code_corpus(spark, sf_dir))).select("target", "type", "name", "version", "purl", "distribution_url")


@query
def sbom_vulnerabilities(spark, sf_dir):
    rows = sbom.sbom_vulnerabilities(findings(spark, sf_dir))
    return rows.select("target", "finding_id", "id", "severity", joined(F.col("cwes").cast("array<string>")).alias("cwes"), "affects")


@query
def sbom_documents(spark, sf_dir):
    done = run(spark, sf_dir)
    targets = done.summary.select("target").unionByName(spark.createDataFrame([("clean",)], "target string"))  # one without anything in it
    documents = sbom.sbom_documents(supply.dependencies(corpora.code_corpus(spark, sf_dir)), done.findings, STAMP, max_rows=20, targets=targets)
    shape = "serialNumber string, components array<struct<purl:string>>, vulnerabilities array<struct<id:string>>"
    d = F.from_json("document", shape)
    return documents.select("target", "part", d.alias("d")).groupBy("target").agg(
        F.max(F.when(F.col("part") == 0, F.col("d.serialNumber"))).alias("serial"), (F.count_distinct("d.serialNumber") == F.count("*")).alias("own_serials"), F.sum(F.size("d.components")).alias("components"), F.sum(F.size("d.vulnerabilities")).alias("vulnerabilities"))


@query
def audit_scan_events(spark, sf_dir):
    rows = audit.scan_events(run(spark, sf_dir).summary, F.lit(STAMP).cast("timestamp"))
    return rows.select("event", "timestamp", "target", "files_scanned", "lines_scanned", "security_score", F.col("findings.total").alias("total"), F.col("findings.high").alias("high"))


@query
def audit_prompt_events(spark, sf_dir):
    rows = audit.prompt_events(scored(spark, sf_dir), F.lit(STAMP).cast("timestamp"))
    return rows.groupBy("event", "timestamp", "threat_level", joined("attack_vectors").alias("attack_vectors")).agg(F.count("*").alias("prompts"), F.sum("threat_score").alias("score"))


def _audit_lines(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.to_json(F.struct(F.lit("scan").alias("event"), stamp.alias("timestamp"), F.concat(F.lit("t"), "event_id").alias("target"), F.col("value").alias("security_score")))
    return events.select(F.when(F.col("event_type") == "error", F.substring(line, 1, 40)).otherwise(line).alias("value"))


@query
def audit_last_entries(spark, sf_dir):
    entries = report_source.parse_audit(_audit_lines(spark, sf_dir))
    return report_source.last_entries(entries, 50).select("event", "timestamp", "target", "security_score")


@query
def audit_entries_per_day(spark, sf_dir):
    entries = report_source.parse_audit(_audit_lines(spark, sf_dir))
    return entries.groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(F.count("*").alias("entries"), F.round(F.sum("security_score"), 2).alias("score"))


# --- streaming -----------------------------------------------------------------------------------------------------

def _streamed(df: DataFrame) -> DataFrame:
    """Rows of a finished stream, through a table in the shared folder."""
    spark = df.sparkSession
    out, checkpoint = new_location(spark, "stream"), new_location(spark, "stream-checkpoint")
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query
def stream_prompt_scores(spark, sf_dir):
    rows = stream_score_prompts(_read_stream(spark, sf_dir, "conversations"))
    kept = rows.select("conv_id", "turn", "threat_score", "threat_level", joined("threat_types").alias("threat_types"), "entropy_score")
    return _streamed(kept)


@query
def stream_artifact_findings(spark, sf_dir):
    rows = corpora.code_artifacts(_read_stream(spark, sf_dir, "documents"))
    return _streamed(stream_scan_artifacts(rows, custom_rules(spark)).select("file_path", "finding_id", "line_number", "column_number", "severity"))


@query
def stream_page_findings(spark, sf_dir):
    rows = page_artifacts(_read_stream(spark, sf_dir, "pages"))
    return _streamed(stream_scan_artifacts(rows, custom_rules(spark)).select("file_path", "finding_id", "line_number", "column_number", "severity"))


def _rescanned(spark: SparkSession, sf_dir: str, compact_every: int = 20) -> Rescan:
    """Three versions of the corpus, taken in by a stream one after the other."""
    incoming, checkpoint = new_location(spark, "versions"), new_location(spark, "rescan-checkpoint")
    state = Rescan(new_location(spark, "rescan"), compact_every=compact_every, scan={"detectors": corpora.RESCAN_DETECTORS})
    for version in range(len(corpora.VERSIONS)):
        rows = corpora.versioned_artifacts(documents(spark, sf_dir), version)
        rows.write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(rows.schema).parquet(incoming)
        stream_rescan(stream, state, checkpoint, removed_col="removed").trigger(availableNow=True).start().awaitTermination()
    return state


@query
def rescan_changes(spark, sf_dir):
    """Findings of artifacts that changed, over three batches of which each brings a part of the corpus."""
    return _rescanned(spark, sf_dir).changes(spark).where("status <> 'persisting'").select("batch", "status", "target", "fingerprint", "file_path", "finding_id", "severity")


@query
def rescan_diffs(spark, sf_dir):
    """Differences between the corpus before and after each of three batches, with the state written whole in between."""
    state = _rescanned(spark, sf_dir, compact_every=2)
    rows = [state.diff(spark, i).withColumn("batch", F.lit(i)) for i in range(len(corpora.VERSIONS))]
    return functools.reduce(DataFrame.unionByName, rows).select("batch", "status", "target", "fingerprint", "file_path", "severity")


@query
def stream_audit_entries(spark, sf_dir):
    return _streamed_audit(spark, sf_dir, 1)


@query
def stream_audit_two_streams(spark, sf_dir):
    """Two streams, each with a checkpoint of its own, into one trail: every event is there twice."""
    return _streamed_audit(spark, sf_dir, 2)


def _streamed_audit(spark, sf_dir, streams: int) -> DataFrame:
    events = _read_stream(spark, sf_dir, "events").select(
        F.lit("scan").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.concat(F.lit("t"), "user_id").alias("target"), F.col("value").alias("security_score"))
    path = new_location(spark, "audit")
    for _ in range(streams):
        stream_audit_append(events, path, new_location(spark, "audit-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    entries = report_source.parse_audit(spark.read.option("recursiveFileLookup", "true").text(path))
    return entries.groupBy("target").agg(F.count("*").alias("entries"), F.max("timestamp").alias("latest"), F.round(F.sum("security_score"), 2).alias("score"))
