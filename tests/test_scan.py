import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardspark.operators import code_rules, supply
from wardspark.operators.compliance import domain_status, map_controls
from wardspark.operators.diff import diff_findings, diff_summary, fingerprint_sets, fixed_findings, new_findings, persisting_findings
from wardspark.operators.findings import dedup_findings, order_findings, policy_gate, search_findings, severity_filter
from wardspark.operators.hits import hit
from wardspark.operators.scan import dedup_hits, explode_hits, resolve_findings, scan_artifacts
from wardspark.plans.pipelines import run_evidence, run_regression, run_scan
from wardspark.sinks import reports, sarif, sbom
from wardspark.sinks.parts import in_parts, with_parts
from wardspark.sources.reports import baseline_findings

KEY = "sk-proj-" + "0a1B2c3D4e" * 5
FLAWED = f'''import pickle, torch, yaml
KEY = "{KEY}"
system_prompt = "our database password is hunter2"
def answer(user_input):
    prompt = f"Do as told: {{user_input}}"
    eval(llm_response)
    torch.load(path)
    pickle.load(handle)
    yaml.load(handle, Loader=yaml.Loader)
URL = "http://huggingface.co/o/m/w.bin"
'''
SOUND = '''import os, torch, yaml
KEY = os.getenv("KEY")
def answer(text):
    client.chat.completions.create(
        model="m", max_tokens=5)
    torch.load(path, weights_only=True)
    yaml.safe_load(handle)
URL = "https://huggingface.co/o/m/w.safetensors"
'''


def artifacts(spark, *rows):
    return spark.createDataFrame([r if len(r) == 3 else ("t", *r) for r in rows], "target string, path string, content string").select("path", "target", "content")


def found(spark, *rows, **kwargs):
    return dedup_findings(resolve_findings(scan_artifacts(artifacts(spark, *rows), **kwargs)))


def ids(df):
    return sorted(r.finding_id for r in df.select("finding_id").collect())


def test_flawed_and_sound_samples(spark):
    run = run_scan(artifacts(spark, ("bad", "a/flawed.py", FLAWED), ("good", "b/sound.py", SOUND), ("none", "c/clean.py", "x = 1\n")))
    assert ids(run.findings) == sorted([
        "SEC-KEY-001-2-8", "SEC-PROMPT-002-3-1", "SEC-PROMPT-001-5-5", "AST-LLMOUT-001-6", "AST-DESER-002-7", "AST-DESER-001-8", "AST-DESER-004-9", "SEC-NET-001-10-8"])
    rows = {r.target: r for r in run.summary.collect()}
    assert (rows["bad"].critical, rows["bad"].high, rows["bad"].security_score) == (5, 3, 0.0)
    assert rows["good"].total == 0 and rows["good"].security_score == 100.0 and rows["none"].files == 1
    assert rows["bad"].lines == 10
    gate = {r.target: r.status for r in policy_gate(run.summary, "high").collect()}
    assert gate == {"bad": 3, "good": 0, "none": 0}
    assert {r.target: r.status for r in policy_gate(run.summary).collect()} == {"bad": 2, "good": 0, "none": 0}
    first = order_findings(run.findings).first()
    assert first.severity == "CRITICAL" and first.metadata["match"] == "sk-proj-...3D4e"
    assert KEY not in json.dumps([r.description + json.dumps(r.metadata) for r in run.findings.collect()])


def test_unreadable_and_null_content(spark):
    rows = found(spark, ("a.py", None), ("model.bin", None), ("x/config.json", '{"custom_code": 1}'), ("broken.py", "eval(x"))
    assert ids(rows) == ["MODEL-CUSTOM-CODE-001", "MODEL-UNSAFE-FMT-BIN"]


def test_branch_chain_stops_at_first_taker(spark):
    code = "import subprocess\nsubprocess.run(x, debug=True)\nsubprocess.run(x, shell=True, debug=True)\nfrom torch import load\nload(x)\nload(x, weights_only=True)\n"
    assert ids(found(spark, ("a.py", code))) == ["AST-DESER-002-5", "AST-EXEC-002-3"]


def test_imports_resolve_as_read(spark):
    code = "loads(a)\nfrom pickle import loads\nloads(b)\ndef f():\n    from json import loads\n    return loads(c)\nimport pickle as p\np.loads(d)\n"
    calls = code_rules.resolve_imports(artifacts(spark, ("a.py", code))).orderBy("line").collect()
    assert [(c.line, c.resolved_name) for c in calls] == [(1, "loads"), (3, "pickle.loads"), (6, "json.loads"), (8, "p.loads")]
    assert code_rules.import_table(artifacts(spark, ("a.py", code))).count() == 3
    assert code_rules.assign_table(artifacts(spark, ("a.py", "a = b = random.random()"))).count() == 2


def test_wide_identifiers_are_seen(spark):
    assert ids(found(spark, ("a.py", "ｅｖａｌ(x)\n"))) == ["AST-EXEC-001-1"]


def test_two_rules_of_a_family_on_a_line(spark):
    line = f"k = '{KEY}'; u = 'http://models.x/a.pt'"
    rows = resolve_findings(scan_artifacts(artifacts(spark, ("a.txt", line))))
    assert rows.count() == 2
    assert ids(dedup_findings(rows)) == ["SEC-KEY-001-1-6"]
    assert dedup_findings(rows, by="rule_id").count() == 2


def test_in_row_dedup_equals_table_dedup(spark):
    scanned = scan_artifacts(artifacts(spark, ("a.py", FLAWED), ("b.txt", f"k = '{KEY}'; k = '{KEY}'\n" * 3)))
    in_row = scanned.withColumn("hits", dedup_hits(F.col("hits")))
    assert explode_hits(in_row).count() == dedup_findings(resolve_findings(scanned)).count()


def test_many_signatures_and_unknown_rules(spark):
    scanned = scan_artifacts(artifacts(spark, ("a.txt", "one two")), detectors=["rag"], signature_rules=[
        {"id": f"OWN-{i}", "title": "t", "pattern": word, "severity": "LOW", "cwe": "", "owasp": "", "remediation": ""} for i, word in enumerate(["two", "none"])])
    assert [(r.finding_id, r.title, r.severity, r.column_number) for r in resolve_findings(scanned).collect()] == [("OWN-0-1", "t", "LOW", 5)]
    nameless = lambda path, content, lines: F.array(hit("custom", "NOBODY-001", F.lit(1), 1, [1, 0, 0]))
    with pytest.raises(PySparkException, match="NOBODY-001"):
        resolve_findings(scan_artifacts(artifacts(spark, ("a.txt", "x")), detectors=["model"], extra_detectors=[nameless])).collect()


def test_documents_are_bounded_and_in_order(spark, tmp_path):
    """One target has most rows, and a few long ones; parts joined in order are the report."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("t"), F.col("id") % 7)).otherwise(F.lit("hot")).alias("target"), (F.col("id") * 7919 % 6007).alias("n"),
        F.when(F.col("id") % 500 == 1, F.repeat(F.lit("é"), 900)).when(F.col("id") % 977 == 3, F.repeat(F.lit("x"), 4000)).otherwise(F.repeat(F.lit("y"), F.col("id").cast("int") % 90)).alias("text"))
    for max_rows, max_bytes in ((5000, 2000), (40, 1 << 20), (50, 3000), (10_000, 1 << 30)):
        parted = in_parts(rows, F.struct("n"), F.struct("n", "text"), max_rows, max_bytes).collect()
        expected = {}
        for r in rows.collect():
            expected.setdefault(r.target, []).append((r.n, r.text))
        for target, items in expected.items():
            own = sorted((p for p in parted if p.target == target), key=lambda p: p.part)
            assert [p.part for p in own] == list(range(len(own))) and [(i.n, i.text) for p in own for i in p["items"]] == sorted(items)
            for p in own:
                size = sum(len(json.dumps({"n": i.n, "text": i.text}, separators=(",", ":"), ensure_ascii=False).encode()) + 1 for i in p["items"])
                assert len(p["items"]) <= max_rows and (size <= max_bytes or len(p["items"]) == 1)
    empty = in_parts(rows.where("false"), F.struct("n"), F.struct("n", "text"))
    targets = spark.createDataFrame([("a",)], "target string")
    assert empty.count() == 0 and [tuple(r) for r in with_parts(targets, empty).collect()] == [("a", 1, 0)]


def test_many_matches_in_one_artifact(spark):
    text = f"a = '{KEY}'\n" * 3000
    rows = resolve_findings(scan_artifacts(artifacts(spark, ("a.txt", text), ("b.txt", "x " + "hf_" + "aB3" * 12 + " "))))
    assert rows.where("file_path = 'a.txt'").count() == 3000


def test_whole_text_patterns(spark):
    rows = found(
        spark, ("a.py", "x = 1\n  messages = [{'role': 'system',\n 'content': chunks}]"), ("b.py", "@tool\ndef f():\n  eval(x)"),
        ("c.py", "import chromadb\nUnstructuredURLLoader(u)\n# ssl_verify=False"), ("d.py", "require_confirmation = False"), ("e.py", "def delete_file(path: str): pass"))
    assert {(r.file_path, r.rule_id, r.line_number, r.column_number) for r in rows.collect()} == {
        ("a.py", "RAG-INJ-001", 2, 3), ("b.py", "AGENT-TOOL-SHELL", 1, 1), ("b.py", "AST-EXEC-001", 3, 2), ("c.py", "RAG-SSL-001", 3, 1),
        ("d.py", "AGENT-AUTO-APPROVE", 1, 1), ("e.py", "AGENT-FS-WRITE", 1, 5)}


def test_dependencies_and_advisories(spark):
    deps = supply.dependencies(artifacts(
        spark, ("requirements.txt", "langchain==0.1.0\nTransformers >= 4.40\n# torch==1\n-r x\nray[d]==1\nsafe==1.0\nopenai==1.*\n"),
        ("pyproject.toml", 'a = ["torch==2.0", "ray==1"]'), ("setup.py", "x = ['dspy_ai==2.4']"), ("notes.txt", "torch==1.0")))
    assert {(r.package, r.version, r.line_number) for r in deps.collect()} == {
        ("langchain", "0.1.0", 1), ("transformers", "4.40", 2), ("safe", "1.0", 6), ("openai", "1.*", 7), ("torch", "2.0", 1), ("dspy-ai", "2.4", 1)}
    hits = supply.match_advisories(deps, supply.advisory_table(spark))
    assert {r.package for r in hits.collect()} == {"langchain", "openai", "torch"}


def test_first_advisory_wins(spark):
    rows = [{"adv_ord": i, "package": "p", "vulnerable_below": b, "cve": f"CVE-{i}", "severity": "HIGH"} for i, b in enumerate(["1.0", "3.0", "2.0"])]
    deps = spark.createDataFrame([("a", "t", "p", "1.5", 1), ("a", "t", "p", "0.5", 2), ("a", "t", "p", "9", 3)], "path string, target string, package string, version string, line_number int")
    hits = supply.match_advisories(deps, supply.advisory_table(spark, rows)).collect()
    assert {(r.line_number, r.advisory.cve) for r in hits} == {(1, "CVE-1"), (2, "CVE-0")}


def test_extra_detector(spark):
    def todo(path, content, lines):
        marked = F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("n"), l.alias("l"))), lambda x: x["l"].contains("TODO"))
        return F.transform(marked, lambda x: hit("custom", "NOTE-001", x["n"], 1, [x["n"], 0, 0], attrs={"severity": "INFO", "title": "Note"}))

    rows = found(spark, ("a.txt", "x\nTODO y\n"), extra_detectors=[todo], detectors=["secrets"])
    assert [(r.finding_id, r.severity, r.code_snippet) for r in rows.collect()] == [("NOTE-001-2", "INFO", "   1   x\n   2 > TODO y")]


@pytest.fixture(scope="module")
def run(spark):
    return run_scan(artifacts(spark, ("one", "a/x.py", FLAWED), ("one", "b/y.py", FLAWED), ("two", "c/z.py", "eval(x)\n"), ("three", "d/w.py", "")))


def test_filters_and_search(run):
    assert severity_filter(run.findings, "high").count() == 6
    assert severity_filter(run.findings, "high", mode="at_least").count() == run.findings.count()
    assert search_findings(run.findings, " cwe-95 ").count() == 1
    assert search_findings(run.findings, "", "critical").count() == 11


def test_diff(run):
    baseline = run.findings.where("rule_id <> 'AST-DESER-001'")
    current = run.findings.where("rule_id <> 'AST-EXEC-001'")
    counts = {r.target: (r.new, r.fixed, r.persisting, r.has_regressions) for r in diff_summary(diff_findings(baseline, current), "target").collect()}
    # x.py and y.py differ in name, so both count
    assert counts == {"one": (2, 0, 14, True), "two": (0, 1, 0, False)}
    assert new_findings(baseline, current).count() == 2 and fixed_findings(baseline, current).count() == 1 and persisting_findings(baseline, current).count() == 14
    assert [d.count() for d in fingerprint_sets(baseline, current)] == [2, 1, 14]
    same = diff_findings(run.findings, run.findings)
    assert {r.status for r in same.collect()} == {"persisting"}
    diff, summary, gate = run_regression(baseline, run)
    assert summary.where("target = 'one'").first().new == 2 and gate.where("target = 'three'").first().status == 0


def test_same_file_name_collides(spark):
    rows = found(spark, ("a/x.py", "eval(a)\n"), ("b/x.py", "eval(b)\n"))
    diff = diff_findings(rows, rows)
    assert [r.file_path for r in diff.collect()] == ["b/x.py"]


def test_controls(run):
    mapped = {(r.domain.split(" ")[0], r.finding_id) for r in map_controls(run.findings, "soc2").where("target = 'two'").collect()}
    assert mapped == {("CC7", "AST-EXEC-001-1")}
    status = {r.domain.split(" ")[0]: r.status for r in domain_status(run.findings, run.summary).where("target = 'three'").collect()}
    assert set(status.values()) == {"PASS"} and len(status) == 5
    headline, _ = run_evidence(run, "iso27001")
    assert headline.where("target = 'three'").first().domains_passed == 5


def test_report_parts_lose_nothing(run):
    whole = reports.report_documents(run.findings, run.summary, "2026-01-01T00:00:00").collect()
    assert len(whole) == 3
    parts = reports.report_documents(run.findings, run.summary, "2026-01-01T00:00:00", max_rows=3)
    listed = [f["id"] + f["file_path"] for r in parts.collect() for f in json.loads(r.document)["findings"]]
    assert len(listed) == len(set(listed)) == run.findings.count()
    one = json.loads(next(r.document for r in whole if r.target == "one"))
    weights = {"CRITICAL": 0, "HIGH": 1}
    order = [(weights[f["severity"]], f["file_path"], f["line_number"]) for f in one["findings"]]
    assert order == sorted(order) and one["findings_count"] == 16 and one["metrics"]["critical_count"] == 10


def test_baseline_survives_gaps(spark):
    good = {"id": "AST-EXEC-001-3", "title": "x", "severity": "HIGH"}
    findings = [good, {"id": "B-1", "severity": "HIGH"}, {**good, "severity": "odd"}, {**good, "line_number": "seven"}, {**good, "line_number": "7", "metadata": {"rule_id": "R"}}]
    docs = spark.createDataFrame([(json.dumps({"target_path": "t", "findings": findings}),), ("not json",)], "value string")
    rows = baseline_findings(docs).orderBy("line_number").collect()
    assert [(r.line_number, r.column_number, r.confidence, r.rule_id) for r in rows] == [(0, 1, 0.95, "AST-EXEC-001"), (7, 1, 0.95, "R")]


def test_sarif(run):
    docs = {r.target: json.loads(r.document) for r in sarif.sarif_documents(run.findings, run.summary, "2026-01-01T00:00:00").collect()}
    one = docs["one"]["runs"][0]
    assert docs["one"]["version"] == "2.1.0" and len(one["results"]) == 16 and docs["three"]["runs"][0]["results"] == []
    assert {r["ruleId"] for r in one["results"]} == {r["id"] for r in one["tool"]["driver"]["rules"]}
    assert one["results"][0]["level"] == "error" and len(one["results"][0]["partialFingerprints"]["primaryLocationLineHash/v1"]) == 16


def test_sbom(spark, run):
    packages = spark.createDataFrame([("two", "Torch", "2.0"), ("two", "Torch", "2.0"), ("two", "x", None)], "target string, package string, version string")
    docs = {r.target: json.loads(r.document) for r in sbom.sbom_documents(packages, run.findings, "2026-01-01T00:00:00Z").collect()}
    assert docs["two"]["bomFormat"] == "CycloneDX" and {c["purl"] for c in docs["two"]["components"]} == {"pkg:pypi/torch@2.0", "pkg:pypi/x@0.0.0"}
    parts = [json.loads(r.document) for r in sbom.sbom_documents(packages, run.findings, "2026-01-01T00:00:00Z", max_rows=3, targets=run.summary).collect()]
    assert len({p["serialNumber"] for p in parts}) == len(parts) > 4
    assert [p["components"] + p["vulnerabilities"] for p in parts if p["metadata"]["component"]["name"] == "three"] == [[]]
    assert docs["two"]["vulnerabilities"][0]["cwes"] == [95] and len(docs["one"]["vulnerabilities"]) == 16


def test_csv(run, tmp_path, spark):
    reports.write_findings_csv(run.findings, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["ID", "Title", "Severity", "Category", "File", "Line", "CWE", "OWASP", "Description", "Remediation"] and back.count() == run.findings.count()
