import pytest
from pyspark.sql import functions as F

from wardspark.operators.registry import FOUND, Detectors
from wardspark.operators.scan import dedup_hits, resolve_findings, scan_artifacts
from wardspark.plans.pipelines import run_scan
from wardspark.sources.reports import read_audit

KEY = "hf_" + "0a1B2c3D4e5F6g7H8i9J" * 2
ROW = "struct(rule as rule_id, line as line, cast(null as int) as col, cast(null as string) as match, map('title', 'T', 'severity', 'LOW', 'confidence', '0.5') as attrs)"


def fixed(rule, line):
    return lambda rows: rows.withColumn("found", F.expr("array(" + ROW.replace("rule as", f"'{rule}' as").replace("line as", f"{line} as") + ")").cast(FOUND))


def test_registered_detectors_come_after_the_built_in_ones(spark):
    detectors = Detectors()
    detectors.register("late", fixed("SEC-KEY-777", 1))
    detectors.register("other", fixed("SEC-KEY-778", 2))
    detectors.register("third", fixed("SEC-KEY-779", 2))
    artifacts = spark.createDataFrame([("a.py", "t", f"k = '{KEY}'\nx"), ("b.py", "t", "y"), ("c.bin", "t", None)], "path string, target string, content string")
    run = run_scan(artifacts, registered=detectors)
    found = {(r.file_path, r.line_number, r.rule_id, r.detector, r.confidence, r.metadata["detector"]) for r in run.findings.where("detector <> 'model'").collect()}
    expected = {("a.py", 1, "SEC-KEY-003", "secrets", 0.92)} | {(p, 1, "SEC-KEY-777", "late", 0.5) for p in ("b.py", "c.bin")} | {(p, 2, "SEC-KEY-778", "other", 0.5) for p in ("a.py", "b.py", "c.bin")}
    assert {f[:5] for f in found} == expected and {f[5] for f in found} >= {"late", "other"}
    assert run.summary.first().total == run.findings.count()
    snippets = {(r.file_path, r.line_number): r.code_snippet for r in run.findings.collect()}
    assert snippets["a.py", 2].endswith("2 > x") and snippets["b.py", 2] == ""


def test_detectors_work_on_table_functions(spark):
    import pyarrow as pa

    detectors = Detectors()

    @detectors.register("shouting")
    def shouting(artifacts):
        kind = pa.list_(pa.struct([("rule_id", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("match", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))

        def run(batches):
            for batch in batches:
                rows = [[{"rule_id": "LOUD-1", "line": 1, "col": 1, "match": t, "attrs": [("title", "Loud")]}] if t and t.isupper() else None for t in batch.column("content").to_pylist()]
                yield batch.append_column("found", pa.array(rows, kind))

        return artifacts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in artifacts.schema) + f", found {FOUND}")

    artifacts = spark.createDataFrame([("a.txt", "t", "LOUD"), ("b.txt", "t", "quiet")], "path string, target string, content string")
    rows = scan_artifacts(artifacts, detectors=["rag"], registered=detectors)
    assert [(r.file_path, r.finding_id, r.title) for r in resolve_findings(rows.withColumn("hits", dedup_hits(F.col("hits")))).collect()] == [("a.txt", "LOUD-1-1", "Loud")]


def test_wrong_detectors_are_refused(spark):
    artifacts = spark.createDataFrame([("a", "t", "x")], "path string, target string, content string")
    for function, message in ((lambda rows: rows, "missing: found"), (lambda rows: fixed("R", 1)(rows).drop("content"), "missing: content"), (lambda rows: rows.withColumn("found", F.array(F.lit("x"))), "found is array<string>")):
        detectors = Detectors()
        detectors.register("d", function)
        with pytest.raises(TypeError, match=message):
            scan_artifacts(artifacts, registered=detectors)
    with pytest.raises(ValueError, match="already"):
        detectors.register("d", fixed("R", 1))
    with pytest.raises(ValueError, match="already"):
        detectors.register("secrets", fixed("R", 1))


def test_the_trail_is_read_from_its_newest_days(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.range(400).selectExpr("'scan' as event", "concat('2026-01-', lpad(cast(1 + id div 20 as string), 2, '0'), 'T10:00:', lpad(cast(id % 20 as string), 2, '0')) as timestamp", "cast(id as string) as target", "substring(concat('2026-01-', lpad(cast(1 + id div 20 as string), 2, '0')), 1, 10) as day")
    events.coalesce(1).write.partitionBy("day").json(path)
    streamed = events.where("id >= 380").withColumn("target", F.concat(F.lit("s"), "target")) if "id" in events.columns else events.where("cast(target as int) >= 380").withColumn("target", F.concat(F.lit("s"), "target"))
    streamed.coalesce(1).write.partitionBy("day").json(f"{path}/stream=x/batch_id=0")
    for limit, files, days in ((10, 2, 1), (50, 3, 2), (150, 9, 8), (1000, 21, 20)):
        rows = read_audit(spark, path, limit)
        assert len(rows.inputFiles()) <= files and len({f.split("day=")[1][:10] for f in rows.inputFiles()}) <= days
        found = rows.collect()
        assert len(found) == min(limit, 420) and [r.timestamp for r in found] == sorted(r.timestamp for r in found) and found[-1].target.startswith("s")
    (tmp_path / "audit" / "loose.json").write_text('{"event": "scan", "timestamp": "2027", "target": "loose"}\n')
    assert read_audit(spark, path, 1).first().target == "loose"
