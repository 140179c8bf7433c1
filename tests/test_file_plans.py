"""Reading files: what the driver holds does not grow with the files, and tasks list a tree in rounds."""

from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as fs
import pytest

from wardspark.operators.chunks import scan_chunks
from wardspark.sources import files
from wardspark.sources.files import FORMAT, FilesSource, plan, read_chunks, walk


EXTENSIONS = [".py", ".txt", ".h5"]


@pytest.fixture
def tree(tmp_path):
    """Contents by path, in folders of different depth and width; the last of them are not looked at."""
    texts = {f"d{i}/f{j}.py": f"x = {i}\ny = {j}\n" for i in range(7) for j in range(i)}
    texts |= {f"deep{'/e' * i}/g.txt": "é\n" * i for i in range(9)} | {"top.txt": "", "w/m.h5": "\x00", "_x.py": "a\n" * 40}
    unseen = {".git/a.py": "x", "d1/node_modules/a.py": "x", "a.zip": "x"}
    for name, text in (texts | unseen).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty/none").mkdir(parents=True)
    return tmp_path, {str(tmp_path / n): None if n == "w/m.h5" else t for n, t in texts.items()}


def joined(rows):
    texts, seen = {}, [(r.path, r.part) for r in rows]
    assert len(seen) == len(set(seen))
    for r in sorted(rows, key=lambda r: (r.path, r.part)):
        texts[r.path] = None if r.content is None else texts.get(r.path, "") + r.content
    return texts


@pytest.mark.parametrize("entries,folders,pieces", [(1, 1, 1), (4, 2, 3), (10_000, 4096, 10_000)])
def test_rounds_of_listing_tell_every_file_once(spark, tree, monkeypatch, entries, folders, pieces):
    for name, value in (("_ENTRIES", entries), ("_FOLDERS", folders), ("_PIECES", pieces)):
        monkeypatch.setattr(files, name, value)
    chunks = read_chunks(spark, str(tree[0]), range_bytes=16, task_bytes=40)
    assert joined(chunks.collect()) == tree[1]
    assert joined(chunks.collect()) == tree[1]  # the plan serves more than one reading


def test_driver_holds_no_paths(spark, tree):
    """A task is told by a number; its files stand in the plan. They came with the task, all of them through the driver."""
    partitions = read_chunks(spark, str(tree[0]), range_bytes=16, task_bytes=1 << 20)._jdf.queryExecution().toRdd().partitions()
    told = [bytes(spark.sparkContext._jvm.org.apache.spark.util.Utils.serialize(p)) for p in partitions]
    assert len(told) == 1 and len(told[0]) < 1000 and b"f3.py" not in told[0]


def test_driver_holds_a_name_for_each_listing_task(spark, tree, monkeypatch):
    place, plans = files._planned(spark, str(tree[0]), EXTENSIONS, 16, 40)
    assert len(plans) == 1 and plans[0][1] > 10
    monkeypatch.setattr(files, "_ENTRIES", 4)
    assert 1 < len(files._planned(spark, str(tree[0]), EXTENSIONS, 16, 40)[1]) <= 4 * 10  # rounds of four tasks at most, one for each level


def test_shares_hold_few_pieces(monkeypatch):
    monkeypatch.setattr(files, "_PIECES", 2)
    assert [[p[0] for p in share] for share in plan([(c, 0) for c in "abcde"], 100, 120)] == [["a", "b"], ["c", "d"], ["e"]]


def test_empty_folders_and_single_files(spark, tree):
    assert read_chunks(spark, str(tree[0] / "empty")).collect() == []
    assert joined(read_chunks(spark, str(tree[0] / "_x.py"), range_bytes=7).collect()) == {str(tree[0] / "_x.py"): "a\n" * 40}
    assert joined(read_chunks(spark, str(tree[0] / "w/m.h5")).collect()) == {str(tree[0] / "w/m.h5"): None}


def test_walk_leaves_folders_to_others(tree):
    system, top = files.opened(str(tree[0]))
    every = dict(walk(system, [top], EXTENSIONS, ["node_modules"]))
    some = list(walk(system, [top], EXTENSIONS, ["node_modules"], most=1))
    left = [path for path, size in some if size is None]
    assert left and set(every) == set(tree[1]) and None not in every.values()
    assert dict(f for f in some if f[1] is not None) | dict(walk(system, left, EXTENSIONS, ["node_modules"])) == every


def test_walk_lists_large_folders_one_at_a_time(monkeypatch):
    """After a folder of many entries one folder is listed at a time, and more again after smaller ones."""
    monkeypatch.setattr(files, "_ENTRIES", 5)
    widths = []

    class System:
        def get_file_info(self, selector):
            return [fs.FileInfo(f"{selector.base_dir}/{i}.py", fs.FileType.File, size=1) for i in range(9 if selector.base_dir.startswith("large") else 1)]

    class Pool(ThreadPoolExecutor):
        def map(self, function, folders):
            widths.append(len(folders))
            return super().map(function, folders)

    monkeypatch.setattr(files, "ThreadPoolExecutor", Pool)
    found = list(walk(System(), [*(f"s{i}" for i in range(7)), *(f"large{i}" for i in range(12)), *(f"t{i}" for i in range(3))], [".py"], []))
    assert widths == [1, 2, 4, 8, 1, 1, 1, 1, 1, 2] and len(found) == len(set(found)) == 7 + 12 * 9 + 3


def test_data_source_gives_the_same_rows(spark, tree):
    spark.dataSource.register(FilesSource)
    rows = spark.read.format(FORMAT).option("rangeBytes", 16).option("taskBytes", 40).load(str(tree[0])).collect()
    expected = read_chunks(spark, str(tree[0]), range_bytes=16, task_bytes=40).collect()
    assert sorted((r.path, r.part, bytes(r.content).decode()) for r in rows if r.content is not None) == sorted(tuple(r[c] for c in ("path", "part", "content")) for r in expected if r.content is not None)
    assert {r.path for r in rows} == {r.path for r in expected} == set(tree[1])


def test_findings_of_whole_texts_are_not_sent_to_the_driver(spark, tree):
    """Chunks out of Python count for a few bytes in the optimizer's eyes, however many they are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scanned = scan_chunks(read_chunks(spark, str(tree[0])), detectors=["secrets", "rag"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [line for line in scanned.splitlines() if "Join" in line and "LeftOuter" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
