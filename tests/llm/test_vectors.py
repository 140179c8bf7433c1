from collections import defaultdict

import numpy as np
import pytest

from corpus import plain
from wardspark.llm import cap_filters as caps

SCHEMA = "vec_id long, embedding array<double>, label int, component string, node string"


def unit(row):
    _, values, label = row
    if label is None or not values or None in values:
        return None
    vector = np.array(values, float)
    if not np.isfinite(vector).all() or not vector.any():
        return None
    vector = vector / np.abs(vector).max()
    return vector / np.linalg.norm(vector)


def brute(rows, threshold=0.98):
    parent, links, units = list(range(len(rows))), [0] * len(rows), [unit(r) for r in rows]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    for i, r in enumerate(rows):
        component = min(ids[find(i)], default=None)
        yield r[0], links[i], component, None if r[0] is None or component is None else r[0] == component


def vectors():
    draw, rows = np.random.default_rng(1), []
    for cluster in range(8):
        center = draw.standard_normal(16)
        center /= np.linalg.norm(center)
        for _ in range(25):
            rows.append((len(rows), [float(x) for x in center + draw.standard_normal(16) * draw.choice([0, 0.02, 0.04])], int(cluster % 3)))
    return rows + [
        (None, rows[3][1], 0), (9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, rows[5][1], None),
        (9005, [1.0, 2.0], 0), (9006, [1.0, 2.0], 0), (7, rows[7][1], 0), (9007, [], 0), (9008, [1e200] * 16, 2), (9009, [1e-200] * 16, 2), (9010, [float("inf")] * 16, 2)]


@pytest.mark.parametrize("group", [caps.GROUP, 5])
def test_equals_brute_force(spark, group):
    rows = vectors()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert plain(caps.vector_dedup(table, group=group).collect()) == plain(brute(rows))


def test_float_vectors_and_empty_table(spark):
    table = spark.createDataFrame([(1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [0.5, -1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert plain(caps.vector_dedup(table).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert caps.vector_dedup(table.limit(0)).count() == 0


def test_decoding_lists_exactly_the_near_filters():
    draw = np.random.default_rng(2)
    books = caps.codebook(10, 3, 6, 1)
    products = lambda u: [sum(float(books[b][n[b]] @ u[s]) for b, s in enumerate(np.split(np.arange(10), np.cumsum([x.shape[1] for x in books])[:-1]))) for n in np.ndindex(6, 6, 6)]
    for _ in range(20):
        vector = draw.standard_normal(10)
        vector /= np.linalg.norm(vector)
        every = np.array(products(vector))
        assert caps.decode(vector, books, 0.1) == np.flatnonzero(every >= every.max() - 0.1).tolist()


def test_recall_on_the_test_table(sf_dir):
    """Pairs at cosines just above the threshold share a cap."""
    draw, missed, total = np.random.default_rng(3), 0, 0
    books = caps.codebook(64)
    for _ in range(300):
        a, noise = draw.standard_normal(64), draw.standard_normal(64)
        a /= np.linalg.norm(a)
        noise -= noise @ a * a
        b = 0.981 * a + np.sqrt(1 - 0.981**2) * noise / np.linalg.norm(noise)
        missed += not set(caps.decode(a, books)) & set(caps.decode(b, books))
        total += 1
    assert missed <= 0.01 * total
