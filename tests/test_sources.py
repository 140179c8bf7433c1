import json
import os
import re
import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardspark.operators.prompts import score_prompts
from wardspark.operators.scan import resolve_findings, scan_artifacts
from wardspark.plans.pipelines import run_scan
from wardspark.sinks.audit import append_audit_prompt, append_audit_scan, scan_events
from wardspark.sources import rule_files
from wardspark.sources.artifacts import read_artifacts
from wardspark.sources.reports import load_baseline, read_audit
from wardspark.streaming.pipelines import stream_audit_append, stream_scan_artifacts, stream_score_prompts

RULES = """
rules:
  - id: OWN-001
    pattern: 'secret_(?P<kind>\\w+)'
    severity: critical
    category: secret_leak
    file_extensions: [".TXT"]
  - id: OWN-002
    pattern: '('
  - id: OWN-003
  - id: OWN-004
    pattern: 'plain'
    severity: unheard
"""


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.py": b"eval(x)\n", "_hidden.py": b"exec(x)\n", "__init__.py": b"", ".env": b"k=1", ".env.local": b"k=2", "notes.md": b"eval",
        "bad.txt": b"ok\xff\xfe text", "w.BIN": b"\x00\x01", "sub/deep/er/b.PY": b"x", "venv/c.py": b"eval(x)", ".hid/d.py": b"eval(x)", "sub/.git/e.json": b"{}",
        "sub/build/f.py": b"x",
    }
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


@pytest.mark.parametrize("min_tasks", [1, 2, 50])
def test_read_artifacts(spark, tree, min_tasks):
    rows = {os.path.relpath(r.path, tree): r.content for r in read_artifacts(spark, tree, min_tasks=min_tasks).collect()}
    assert rows == {"a.py": "eval(x)\n", "_hidden.py": "exec(x)\n", "__init__.py": "", ".env": "k=1", ".env.local": "k=2", "bad.txt": "ok text", "w.BIN": None, "sub/deep/er/b.PY": "x"}


def test_single_file_and_missing(spark, tree):
    assert read_artifacts(spark, os.path.join(tree, "notes.md")).first().content == "eval"
    with pytest.raises(FileNotFoundError):
        read_artifacts(spark, os.path.join(tree, "nowhere"))


def test_directory_scan(spark, tree):
    run = run_scan(read_artifacts(spark, tree))
    assert sorted(r.finding_id for r in run.findings.collect()) == ["AST-EXEC-001-1", "AST-EXEC-001-1", "MODEL-UNSAFE-FMT-BIN"]
    assert run.summary.first().files == 8


def test_custom_rule_file(spark, tmp_path):
    (tmp_path / "wardspark-rules.yml").write_text(RULES)
    rules = rule_files.load_custom_rules(spark, directories=[str(tmp_path)])
    assert [(r["id"], r["severity"], r["category"]) for r in rules] == [
        ("OWN-001", "CRITICAL", "Hardcoded AI Secrets & Credentials"), ("OWN-004", "MEDIUM", "Dynamic Code Execution (eval/exec/subprocess)")]
    rows = spark.createDataFrame([("a.txt", "t", "x\nsecret_key plain"), ("a.py", "t", "secret_key")], "path string, target string, content string")
    found = resolve_findings(scan_artifacts(rows, rules, ["custom"])).collect()
    assert {(r.finding_id, r.file_path, r.column_number, r.metadata["match"]) for r in found} == {("OWN-001-2", "a.txt", 1, "secret_key"), ("OWN-004-2", "a.txt", 12, "plain")}
    assert rule_files.load_custom_rules(spark, directories=[str(tmp_path / "none")]) == []


def test_signature_files(spark, tmp_path):
    assert rule_files.load_prompt_signatures(spark).count() == 10
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"threat_categories": {"c": [{"name": "n", "pattern": "abra", "score": 25, "level": "LOW", "vector": "Spell"}]}}))
    signatures = rule_files.all_signatures(spark, str(path))
    assert len(signatures) == 8
    row = score_prompts(spark.createDataFrame([("Abra cadabra",)], "text string"), signatures=signatures).first()
    assert row.threat_types == ["Spell"] and row.matched_patterns == ["Abra", "abra"]
    path.write_text(json.dumps({"signatures": [{"id": "a", "title": "t", "pattern": "p", "severity": "high", "cwe": "c", "owasp": "o", "remediation": "r"}, {"id": "b", "severity": "high"}]}))
    assert [(r.id, r.severity) for r in rule_files.load_signature_rules(spark, str(path)).collect()] == [("a", "HIGH")]
    path.write_text(json.dumps({"advisories": [{"package": "p", "vulnerable_below": "2"}, {"package": "q", "vulnerable_below": "3"}]}))
    assert [(r.adv_ord, r.package) for r in rule_files.load_advisories(spark, str(path)).collect()] == [(0, "p"), (1, "q")]


def test_audit_trail(spark, tmp_path):
    path = str(tmp_path / "audit")
    run = run_scan(spark.createDataFrame([("a.py", "t", "eval(x)")], "path string, target string, content string"))
    append_audit_scan(run.summary, path)
    append_audit_prompt(score_prompts(spark.createDataFrame([("dan mode",), ("hello",)], "text string")), path)
    append_audit_scan(run.summary, path)
    day = next(d for d in os.listdir(path) if d.startswith("day="))
    (tmp_path / "audit" / day / "broken.json").write_text('{"event": "sc\n')
    rows = read_audit(spark, path).collect()
    assert [r.event for r in rows] == ["scan", "prompt_analysis", "prompt_analysis", "scan"] and rows[0].findings.critical == 1
    assert [r.event for r in read_audit(spark, path, 1).collect()] == ["scan"]


def _run_stream(frame, out, checkpoint):
    frame.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"d{i}/a.py", "t", f"eval(x)\nk = 'hf_{'aB3' * 12}'; k = 'hf_{'xY9' * 12}'\n") for i in range(4)] + [("m.bin", "t", None)]
    df = spark.createDataFrame(rows, "path string, target string, content string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run_stream(stream_scan_artifacts(stream).drop("metadata"), str(tmp_path / "out"), str(tmp_path / "cp"))
    streamed = sorted((r.file_path, r.finding_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted((r.file_path, r.finding_id) for r in run_scan(df).findings.collect()) and len(streamed) == 9
    prompts = spark.createDataFrame([("dan mode",), ("hello",)], "text string")
    prompts.write.parquet(str(tmp_path / "p"))
    _run_stream(stream_score_prompts(spark.readStream.schema(prompts.schema).parquet(str(tmp_path / "p"))), str(tmp_path / "po"), str(tmp_path / "pc"))
    score = lambda d: sorted((r.text, r.threat_score) for r in d.collect())
    assert score(spark.read.parquet(str(tmp_path / "po"))) == score(score_prompts(prompts))


def _audit_stream(spark, folder, checkpoint, schema):
    events = scan_events(spark.readStream.schema(schema).parquet(str(folder / "in")), F.lit("2026-01-01").cast("timestamp"))
    stream_audit_append(events, str(folder / "audit"), str(folder / checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_audit_streams_add_and_replays_replace(spark, tmp_path):
    summary = spark.createDataFrame([("t", 1, 1, 0, 0, 0, 0, 0, 0, 100.0)], "target string, files long, lines long, critical long, high long, medium long, low long, info long, total long, security_score double")
    summary.write.parquet(str(tmp_path / "in"))
    _audit_stream(spark, tmp_path, "one", summary.schema)
    for name in os.listdir(tmp_path / "one" / "commits"):  # as if the stream had stopped before it noted the batch as done
        os.remove(tmp_path / "one" / "commits" / name)
    _audit_stream(spark, tmp_path, "one", summary.schema)
    assert read_audit(spark, str(tmp_path / "audit")).count() == 1
    _audit_stream(spark, tmp_path, "two", summary.schema)
    assert read_audit(spark, str(tmp_path / "audit")).count() == 2
    append_audit_scan(summary, str(tmp_path / "audit"))
    assert read_audit(spark, str(tmp_path / "audit")).count() == 3


def test_streams_match_advisories(spark, tmp_path):
    df = spark.createDataFrame([("requirements.txt", "t", "langchain==0.0.1\nnothing-known==1.0\n")], "path string, target string, content string")
    df.write.parquet(str(tmp_path / "in"))
    _run_stream(stream_scan_artifacts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).drop("metadata"), str(tmp_path / "out"), str(tmp_path / "cp"))
    streamed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.rule_id, r.line_number) for r in streamed] == [(r.rule_id, r.line_number) for r in run_scan(df).findings.collect()] and len(streamed) == 1


def test_rule_files_that_cannot_be_used(spark, tmp_path):
    path = tmp_path / "wardspark-rules.yaml"
    for text in ("rules: [", "rules:\n", "rules: 7\n", "- a\n"):
        path.write_text(text)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert rule_files.load_custom_rules(spark, str(path)) == []
    table = spark.createDataFrame([("A", "(x"), ("B", None), ("C", "(?P<my_name>x)(?P=my_name)"), ("D", r"(a)(?(1)b|c)")], "id string, pattern string")
    assert [(r["id"], r["accepted"], r["reason"]) for r in rule_files.check_custom_rules(table)] == [
        ("A", False, "the pattern does not compile"), ("B", False, "no pattern"), ("C", True, None), ("D", False, "the pattern has no Java form")]


@pytest.mark.parametrize("pattern, text", [
    (r"(?P<user_name>x+)y(?P=user_name)", "xxyxx"), ("[[]x", "[x"), ("x{2", "x{2"), ("(?a)\\w+", "aéb"), ("x{,2}y", "xxy"), ("[]a]+", "]a"), ("[^]&&a]", "b"), (r"a{2,3}\Z", "aaa"), ("{x}", "{x}"), (r"[\]\w[]", "[")])
def test_python_patterns_in_java(spark, pattern, text):
    found = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract("t", "(?dU)" + rule_files.to_java(pattern), 0)).first()[0]
    assert found == re.search(pattern, text)[0]


def test_indented_baseline(spark, tmp_path):
    report = {"target_path": "t", "findings": [{"id": "AST-EXEC-001-3", "title": "x", "severity": "HIGH"}, {"id": "B-1", "title": "y", "severity": "LOW"}]}
    (tmp_path / "a.json").write_text(json.dumps(report, indent=2))
    assert load_baseline(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.json").write_text(json.dumps(report) + "\n\n" + json.dumps(report) + "\n")
    assert load_baseline(spark, str(tmp_path / "b.json")).count() == 4
    (tmp_path / "c.json").write_text("not a report")
    with pytest.raises(PySparkException):
        load_baseline(spark, str(tmp_path / "c.json")).collect()
