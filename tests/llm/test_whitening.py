import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import whitening as w
from wardspark.llm.whitening import by_component, whitened_vectors


def table(spark, rows):
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return plain.select("*", *[F.lit("x").alias(c) for c in ("id", "width", "rows", "values", "n", "whitened", "explained", "vector")])


def exact(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], directions[:, ::-1]


def compare(spark, rows, components=32, **settings):
    found = by_component(whitened_vectors(table(spark, rows), components=components, **settings)).collect()
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    deviation, centred, values, directions = exact([v for _, v in kept])
    count = min(components, len(values))
    assert len(found) == len(kept) * count
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == len(kept) and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
    signs = None
    for place, (i, _) in enumerate(kept):
        row = by_row[i]
        assert row[1].deviation == deviation[place]
        ours = np.array([row[k].whitened for k in range(1, count + 1)])
        theirs = centred[place] @ directions[:, :count] / np.sqrt(values[:count])
        if signs is None:
            signs = np.sign(ours * theirs)
        assert np.abs(ours - signs * theirs).max() < 1e-6 and sorted(row) == list(range(1, count + 1))


def cloud(n, width, seed=1, scale=None):
    draw = np.random.default_rng(seed)
    scale = np.linspace(3, 0.5, width) if scale is None else scale
    return [(i, (draw.standard_normal(width) * scale + 100).tolist()) for i in range(n)]


def test_equals_a_dense_eigendecomposition(spark):
    compare(spark, cloud(400, 70))


def test_block_as_wide_as_the_space(spark):
    compare(spark, cloud(300, 12))


def test_few_components_of_a_flat_spectrum(spark):
    compare(spark, cloud(3000, 40, scale=np.linspace(1.2, 1.0, 40)), components=5, guard=4)


def test_many_tasks_add_up_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(w, "ADDERS", 1)
    monkeypatch.setattr(w, "packed", lambda *a, f=w.packed: f(a[0].repartition(9), *a[1:]).repartition(9))
    compare(spark, cloud(400, 60, seed=4), components=4, guard=4)


def test_unfit_rows_are_dropped(spark):
    rows = [*cloud(50, 6), (50, None), (51, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (52, [math.nan] * 6), (53, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [-0.4] * 6)]
    compare(spark, rows)
    other = [*rows, (60, [1.0, 2.0]), (61, [2.0**41] * 6)]
    assert {r.vec_id for r in whitened_vectors(table(spark, other)).collect()} == {*range(50), 55}


def test_repeated_rows_and_ids_count_each(spark):
    rows = cloud(40, 5)
    found = whitened_vectors(table(spark, [*rows, *rows[:3], (None, rows[4][1])])).collect()
    assert len(found) == 44 and found[0].n == 44 and sum(r.vec_id is None for r in found) == 1


def test_directions_without_variance_have_no_component(spark):
    assert by_component(whitened_vectors(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)]))).count() == 0
    assert by_component(whitened_vectors(table(spark, []))).count() == 0
    assert by_component(whitened_vectors(table(spark, [(1, [1.0, 2.0])]))).count() == 0
    flat = [(i, [v[0], 7.0, v[1], v[0]]) for i, v in cloud(30, 2)]
    assert {r.component for r in by_component(whitened_vectors(table(spark, flat))).collect()} == {1, 2}


def test_filter_stays_small_on_the_unwanted_part():
    spectrum = np.linspace(0.0, 10.0, 101)
    block = w.filtered(lambda b: spectrum[:, None] * b, np.ones((101, 1)), 12, 0.0, 8.0, 10.0)[:, 0]
    assert block[100] == pytest.approx(1) and np.abs(block[spectrum <= 8.0]).max() < 1e-4 and (np.diff(block[spectrum >= 8.0]) > 0).all()


def test_deviations_are_whole_numbers_or_an_error():
    values = np.array([[10**12], [-(10**12)], [5]])
    with pytest.raises(OverflowError):
        w.deviations(values, 3, [5])
    assert w.deviations(np.array([[1], [2], [4]]), 3, [7]) == [16, 1, 25]


def test_start_without_a_wanted_direction_is_not_certified():
    spectrum = np.array([9.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.9, 0.8, 0.7, 0.6])
    times = lambda b: spectrum[:, None] * b
    vectors = np.eye(10)[:, [1, 2, 3]]  # an exact invariant space that lacks the greatest pair
    assert not w._probed(times, spectrum[[1, 2, 3]], vectors, 2, 8, 0.5, np.random.default_rng(0), 1e-13)
    assert w._probed(times, spectrum[:3], np.eye(10)[:, :3], 2, 8, 0.5, np.random.default_rng(0), 1e-13)
