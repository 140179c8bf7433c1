import pytest
from pyspark.sql import functions as F

from wardspark.operators.chunks import chunk_offsets, cut_artifacts, scan_chunks
from wardspark.operators.scan import dedup_hits, resolve_findings, scan_artifacts
from wardspark.plans import corpora
from wardspark.plans.queries import custom_rules
from wardspark.sources import files
from wardspark.sources.files import plan, read_chunks, read_range

KEY = "hf_" + "0a1B2c3D4e5F6g7H8i9J" * 2
SCHEMA = "path string, target string, content string"


def artifacts(spark):
    rows = [(f"d{i}/{name}", f"t{i % 3}", text) for i, (name, text, _) in enumerate(corpora.CODE_SLOTS)]
    rows += [
        ("x/long.py", "t", "\n".join(f"a = {i}" if i % 50 else f"t = '{KEY}' # {i}" for i in range(400))), ("x/ends.py", "t", f"a\r\n\r\nb = '{KEY}'\x0bc d = '{KEY}'\r\ne\n\n"), ("x/one.py", "t", f"k = '{KEY}'"),
        ("x/none.py", "t", None), ("x/empty.py", "t", ""), ("x/blank.py", "t", "\n"), ("x/far.py", "t", "messages = [\n" + "\n" * 60 + "{'role': 'system', 'content': f'{context}'}]"),
        ("x/edge.py", "u", f"k = '{KEY}'\nl = 1\nm = '{KEY}'\n"), ("x/é.py", "t", "ｅval(x)\n\nx = 1"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def found(scanned):
    rows = resolve_findings(scanned.withColumn("hits", dedup_hits(F.col("hits"))))
    return sorted(tuple(str(v) for v in r) for r in rows.drop("metadata").collect())


@pytest.fixture(scope="module")
def uncut(spark):
    scanned = scan_artifacts(artifacts(spark), custom_rules(spark))
    return found(scanned), sorted(scanned.select("path", "n_lines").collect())


@pytest.mark.parametrize("lines", [1, 7, 10_000])
def test_findings_do_not_depend_on_the_cut(spark, uncut, lines):
    scanned = scan_chunks(cut_artifacts(artifacts(spark), lines).repartition(5), custom_rules(spark))
    assert found(scanned) == uncut[0]
    assert sorted(scanned.select("path", "n_lines").collect()) == uncut[1]


def test_line_detectors_need_no_whole_texts(spark):
    rows = scan_chunks(cut_artifacts(artifacts(spark), 3), detectors=["secrets", "owasp"])
    assert found(rows) == found(scan_artifacts(artifacts(spark), detectors=["secrets", "owasp"]))


@pytest.mark.parametrize("lines", [1, 2, 1000])
def test_offsets_of_chunks(spark, lines):
    rows = chunk_offsets(cut_artifacts(artifacts(spark), lines)).collect()
    whole = {r.path: r.content for r in artifacts(spark).collect()}
    for r in rows:
        before = (whole[r.path] or "")[: r.first_offset]
        assert r.content is None or (whole[r.path].startswith(r.content, r.first_offset) and before.count("\n") == r.first_line)
    assert {p: "".join(r.content or "" for r in sorted(rows, key=lambda r: r.part) if r.path == p) for p in whole} == {p: t or "" for p, t in whole.items()}


FILES = {"src/_x.py": f"k = '{KEY}'", "src/__init__.py": "eval(x)", "src/.env": f"H={KEY}", "src/.env.local": "", "src/long.py": "\n".join(f"line {i} 'é'" for i in range(500)) + f"\nk = '{KEY}'", "src/m.H5": "\x00\x01",
         "src/readme.zip": "x", "src/.git/a.py": "x", "node_modules/a.py": "x", "src/b/c/d.PY": "x\r\n\r\ny", "src/wide.py": "w" * 3000, "src/bad.py": None}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"a\xff\xc3(\nb\xe2\x82" if text is None else text.encode())
    return tmp_path


@pytest.mark.parametrize("size", [1, 10, 1000, 64 << 20])
def test_files_in_ranges(spark, folder, size):
    rows = read_chunks(spark, f"file://{folder}", range_bytes=size, task_bytes=100).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.path, r.part)):
        name = r.path[len(str(folder)) + 1 :]
        texts[name] = None if r.content is None else texts.get(name, "") + r.content
    skipped = {"src/readme.zip", "src/.git/a.py", "node_modules/a.py"}
    expected = {n: (t if t is not None else "a(\nb") for n, t in FILES.items() if n not in skipped} | {"src/m.H5": None}
    assert texts == expected


def test_findings_of_files_in_ranges(spark, folder):
    whole = scan_artifacts(read_chunks(spark, str(folder)).drop("part"))
    ranged = scan_chunks(read_chunks(spark, str(folder), range_bytes=100))
    rows = found(whole)
    assert found(ranged) == rows and len(rows) >= 5


def test_single_files_and_missing_folders(spark, folder):
    assert [r.path for r in read_chunks(spark, str(folder / "src/readme.zip")).collect()] == [str(folder / "src/readme.zip")]
    with pytest.raises(Exception, match="nowhere"):
        read_chunks(spark, str(folder / "nowhere")).collect()
    assert read_chunks(spark, str(folder), extensions=[".nothing"]).where("path not like '%.env%'").count() == 0


def test_plan_shares_bytes():
    tasks = plan([("b", 10), ("a", 250), ("c", 0), ("d", 95), ("e", 5)], 100, 120)
    assert tasks == [[("a", 0, 0, 100)], [("a", 1, 100, 200)], [("a", 2, 200, 250), ("b", 0, 0, 10), ("c", 0, 0, 0)], [("d", 0, 0, 95), ("e", 0, 0, 5)]]


def test_long_lines_are_read_to_their_end(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_STEP", 3)
    (tmp_path / "f").write_bytes(b"aaaaaaaaaa\nbb\n\ncccccc")
    system, _ = files.opened(str(tmp_path))
    parts = [read_range(system, str(tmp_path / "f"), start, min(21, start + 4)) for start in range(0, 21, 4)]
    assert b"".join(parts) == b"aaaaaaaaaa\nbb\n\ncccccc" and parts[0] == b"aaaaaaaaaa\n" and parts[1] == b""
