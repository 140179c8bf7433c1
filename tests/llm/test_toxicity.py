import random
import zlib

import numpy as np
import pytest

from corpus import TEXTS, documents
from wardspark.llm import toxicity as tox


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        line = ["".join(draw.choice(["an", "er", "th", "on", "re"]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(5, 150))]
        bad = i % 6 == 0
        for _ in range(3 * bad):
            line[draw.randrange(len(line))] = draw.choice(["Vexnub", "grolfic"])
        rows.append((i, " ".join(line)))
        labels.append((i, int(bad)))
    return rows, labels


def checksum(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_held_out_rows_are_told_apart(spark, tables):
    rows, labels = tables
    table = spark.createDataFrame(labels + [(5, None), (9999, 1), (None, 1), (7, 0)], "doc_id long, toxic int")
    found = tox.toxicity(documents(spark, rows + TEXTS[-1:] + [(None, "x"), (None, None)]), table).collect()
    truth = dict(labels)
    assert len(found) == len(rows) + 3
    assert all(r.held_out == (r.doc_id is None or checksum(r.doc_id) == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.5) for r in found)


def test_learns_nothing_from_held_out_rows(spark, tables):
    rows, labels = tables
    docs = documents(spark, rows)
    flipped = [(i, 1 - t if checksum(i) == 0 else t) for i, t in labels]
    first, second = (tox.fit(docs, spark.createDataFrame(ls, "doc_id long, toxic int")) for ls in (labels, flipped))
    assert np.array_equal(first.index, second.index) and np.array_equal(first.weight, second.weight) and first.bias == second.bias


def test_sample_is_bounded(spark, tables):
    rows, labels = tables
    sample = tox.labelled_sample(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), 50, "doc_id", "text", "toxic")
    assert sample.count() == 50


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in tox.toxicity(documents(spark), none).collect()} == {(0.0, 0)}
    assert tox.toxicity(documents(spark, []), none).count() == 0


def test_pieces_lose_no_ngram(monkeypatch):
    text = " ".join(f"word{i * 7919}" for i in range(300))
    whole = tox.features(text)
    monkeypatch.setattr(tox, "PIECE", 100)
    assert np.array_equal(tox.features(text), whole)


def test_the_sample_has_one_row_for_each_id(spark):
    from wardspark.llm.toxicity import labelled_sample

    rows = [(1, f"text {i}") for i in range(500)] + [(2, "b"), (2, "b"), (3, None), (3, None), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(1, 0)], "doc_id long, toxic int")
    one = labelled_sample(docs, labels, 100, "doc_id", "text", "toxic").collect()
    again = labelled_sample(docs.repartition(3), labels, 100, "doc_id", "text", "toxic").collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, again), key=str) and len({r.doc for r in one}) == len(one) >= 2
    assert len(labelled_sample(docs, labels, 2, "doc_id", "text", "toxic").collect()) == 2
