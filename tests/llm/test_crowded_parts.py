import random

import pytest

from pyspark.sql import functions as F

from wardspark.llm.perspectives import rotate
from test_perspectives import brute

RANDOM = random.Random(7)
ROWS = [(None, RANDOM.choice([None, 0, 0, 1]), RANDOM.choice(["ann", "bob", "system"]), f"text {RANDOM.randrange(40)}") for _ in range(900)]
ROWS += [(1, 5, "ann", "the same")] * 300 + [(2, n, "bob", f"{n}") for n in range(20)] + [(3, None, "ann", "no number"), (3, -1, "ann", "with a number")]


@pytest.mark.parametrize("bound", [1, 64, 10_000])
def test_pieces_are_bounded_and_in_order(spark, bound):
    table = spark.createDataFrame(RANDOM.sample(ROWS, len(ROWS)), "conv_id long, turn long, role string, text string").repartition(7)
    got = {}
    for r in rotate(table, rows_per_piece=bound).collect():
        assert r.n_turns <= bound and all(r.text[s.start : s.end].endswith("<|end|>\n") for s in r["mask"])
        got.setdefault((r.conv_id, r.part, r.speaker), []).append((r.piece, r.n_turns, r.n_own, r.text))
    whole = {(c, p, s): (n, own, text) for c, p, s, n, own, _, _, _, text in brute(ROWS)}
    assert got.keys() == whole.keys()
    for key, pieces in got.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[1] == bound for p in pieces[:-1])
        assert (sum(p[1] for p in pieces), sum(p[2] for p in pieces), "".join(p[3] for p in pieces)) == whole[key]


def test_twin_cuts_crowded_parts_alike(spark, tmp_path):
    import duckdb

    from wardspark.llm.perspectives import SQL, rotation_report

    rows = [(None, n % 3, ["ann", "bob", None, "system"][n % 4], f"text {n % 97}") for n in range(3000)] + [(1, n, "ann", "x") for n in range(1500)] + [(2, None, "bob", "y")] * 1100
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    table.write.parquet(str(tmp_path / "c"))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/c/*.parquet'")
    found = rotation_report(rotate(table))
    order = sorted(found.columns)
    expected = database.execute(f"SELECT {', '.join(order)} FROM ({SQL})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(order).collect()))) == sorted(map(repr, expected)) and max(r.piece for r in found.collect()) == 2
