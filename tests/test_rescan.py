import pytest
from pyspark.sql import functions as F

from wardspark.operators.diff import diff_findings
from wardspark.operators.scan import dedup_hits, resolve_findings, scan_artifacts
from wardspark.streaming import rescan
from wardspark.streaming.rescan import Rescan, stream_rescan

KEY = "hf_" + "0a1B2c3D4e5F6g7H8i9J" * 2
SCHEMA = "path string, target string, content string, removed boolean, version int"
SHOWN = ["status", "target", "fingerprint", "file_path", "finding_id", "severity"]


def artifact(path, content, target="t", removed=False, version=0):
    return path, target, content, removed, version


def batches():
    """What comes, batch by batch; files of one name in several folders, some of which share fingerprints."""
    return [
        [artifact("a/m.py", f"x = '{KEY}'"), artifact("b/m.py", f"y = '{KEY}'\nst.markdown(t, unsafe_allow_html=True)"), artifact("c/k.py", "eval(x)"), artifact("c/k.py", "exec(x)", "u"), artifact("w.bin", None)],
        [artifact("a/m.py", f"x = '{KEY}'"), artifact("b/m.py", "clean"), artifact("d/m.py", f"z = '{KEY}'"), artifact("c/k.py", "\neval(x)"), artifact("w.bin", None)],
        [artifact("a/m.py", "", removed=True), artifact("nowhere.py", "x", removed=True), artifact("c/k.py", "old", version=1), artifact("c/k.py", f"k = '{KEY}'", version=2), artifact("c/k.py", "older", version=0)],
        [artifact("a/m.py", f"x = '{KEY}'"), artifact("a/m.py", f"x = '{KEY}'"), artifact(None, "eval(x)"), artifact("n.py", "eval(x)", None)],
    ]


def snapshots():
    there, out = {}, []
    for batch in batches():
        last = {}
        for path, target, content, removed, version in batch:
            if path is not None and target is not None and version >= last.get((target, path), (None, None, -1))[2]:
                last[target, path] = content, removed, version
        for key, (content, removed, _) in last.items():
            if removed:
                there.pop(key, None)
            else:
                there[key] = content
        out.append([(path, target, content) for (target, path), content in there.items()])
    return out


def found(spark, rows):
    scanned = scan_artifacts(spark.createDataFrame(rows, "path string, target string, content string"))
    return resolve_findings(scanned.withColumn("hits", dedup_hits(F.col("hits"))))


def shown(rows):
    return sorted(tuple(r) for r in rows.select(*SHOWN).collect())


@pytest.fixture(scope="module")
def expected(spark):
    scans = [found(spark, rows) for rows in snapshots()]
    return [shown(diff_findings(before, after)) for before, after in zip([found(spark, []), *scans], scans)]


@pytest.mark.parametrize("compact_every", [2, 20])
def test_batches_differ_as_whole_scans_do(spark, tmp_path, expected, compact_every):
    state = Rescan(str(tmp_path / "state"), slots=3, compact_every=compact_every)
    for i, rows in enumerate(batches()):
        state.apply(spark.createDataFrame(rows, SCHEMA), i, "version", "removed")
    assert [shown(state.diff(spark, i)) for i in range(4)] == expected
    changes = [shown(state.changes(spark).where(F.col("batch") == i)) for i in range(4)]
    assert all([r for r in rows if r[0] != "persisting"] == [r for r in whole if r[0] != "persisting"] for rows, whole in zip(changes, expected))
    assert {r.path for r in state.artifacts(spark, 4).collect()} == {"a/m.py", "b/m.py", "d/m.py", "c/k.py", "w.bin"}


def test_unchanged_artifacts_are_not_scanned(spark, tmp_path):
    state = Rescan(str(tmp_path / "state"))
    for i, rows in enumerate(batches()[:2]):
        state.apply(spark.createDataFrame(rows, SCHEMA), i, "version", "removed")
    log = state._log(spark, "artifacts", "target string, path string, full int, batch bigint, slot int").where("batch = 1")
    assert {r.path for r in log.collect()} == {"b/m.py", "d/m.py", "c/k.py"}
    again = Rescan(state.folder, rules_version="2")
    again.apply(spark.createDataFrame(batches()[0][:1], SCHEMA), 2, "version", "removed")
    assert [(r.status, r.file_path) for r in again.changes(spark).where("batch = 2").collect()] == [("persisting", "d/m.py")]


def test_batches_that_run_again_change_nothing(spark, tmp_path, expected):
    state = Rescan(str(tmp_path / "state"), slots=2, compact_every=1)
    for i, rows in enumerate(batches()):
        batch = spark.createDataFrame(rows, SCHEMA)
        wrong = spark.createDataFrame([artifact("half.py", f"q = '{KEY}'"), *rows[:1]], SCHEMA)
        state.apply(wrong, i, "version", "removed")  # a batch that was cut off, and left other tables
        state.apply(batch, i, "version", "removed")
        state.apply(batch, i, "version", "removed")
    assert [shown(state.diff(spark, i)) for i in range(4)] == expected


def test_stream_goes_on_where_it_stopped(spark, tmp_path, expected):
    state = Rescan(str(tmp_path / "state"))
    for rows in batches()[:2]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second time there is nothing new
            stream_rescan(stream, state, str(tmp_path / "checkpoint"), "version", "removed").trigger(availableNow=True).start().awaitTermination()
    assert [shown(state.diff(spark, i)) for i in range(2)] == expected[:2]
    assert state.changes(spark).select(F.max("batch")).first()[0] == 1


def test_empty_batches(spark, tmp_path):
    state = Rescan(str(tmp_path / "state"))
    state.apply(spark.createDataFrame([], SCHEMA), 0)
    assert state.changes(spark).count() == 0 and state.artifacts(spark, 5).count() == 0 and state.diff(spark, 0).count() == 0


def test_texts_are_not_shuffled(spark):
    """Without broadcasts by size, as over many artifacts, no exchange carries a text."""
    import re

    rows = rescan._keyed(spark.createDataFrame([("a", "t", "eval(x)")] * 2, "path string, target string, content string"), "", 2, None, None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Rescan("unused", scan={"detectors": ["owasp"]})._scanned(rows, rows.select("slot", "target", "path", "content_sha").distinct())
        plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        exchanges = re.findall(r"\n\(\d+\) Exchange\n(?:Input [^\n]*)", plan)
        assert exchanges and not any("content#" in e for e in exchanges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_full_map_lets_no_other_version_in(spark, monkeypatch):
    """A map so small that all rows pass: versions that are not wanted are scanned, but not taken in."""
    monkeypatch.setattr(rescan, "_MAP_BITS", 3)
    rows = rescan._keyed(spark.createDataFrame([(f"src/f{i}.py", "t", f"app.run(debug=True)  # {i % 2}\nk = 'sk-{'0a1B2c3D4e5F6g7H8i9J' * 2}'\n") for i in range(400)] , "path string, target string, content string"), "", 2, None, None)
    wanted = rows.where("path < 'src/f2'").select(*rescan._VERSION)
    assert rescan._in_map(rows, wanted).count() == 400
    found = Rescan("unused", scan={"detectors": ["secrets"]})._scanned(rows, wanted)
    assert {r.file_path for r in found.select("file_path").collect()} == {r.path for r in wanted.collect()}


def test_persisting_only(spark):
    from wardspark.operators.diff import diff_findings, persisting_only
    from wardspark.operators.scan import resolve_findings

    artifacts = spark.createDataFrame([(f"{d}/m.py", t, f"eval(x{d})\nimport os\nos.system(a)\n") for d in "abc" for t in ("t", "u", None)], "path string, target string, content string")
    rows = resolve_findings(rescan.scan_artifacts(artifacts, detectors=["ast"]))
    show = lambda d: sorted(map(str, d.select("status", "fingerprint", "target", "file_path", "finding_id", "severity").collect()))
    assert show(persisting_only(rows)) == show(diff_findings(rows, rows)) and rows.count() > 9
