import hashlib
import random
from collections import defaultdict

from corpus import TEXTS, documents, plain, words
from wardspark.llm.winnowing import contamination_report, decontaminate


def brute(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        line = words(text)
        size = min(13, len(line))
        for i in range(len(line) - size + 1 if line else 0):
            windows[tuple(line[i : i + size])].add(item)
    for doc, text in rows:
        line, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(line) - size + 1):
                if (who := windows.get(tuple(line[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= who
        ids = sorted(str(i) for i in found if i is not None)
        yield doc, len(line), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(line)


def found(spark, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    return plain(contamination_report(decontaminate(documents(spark, rows), table)).collect())


def test_equals_brute_force(spark):
    draw = random.Random(3)
    rows = TEXTS + [(100 + i, " ".join(draw.choice("abc") for _ in range(draw.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(draw.choice("abc") for _ in range(draw.choice([0, 1, 5, 9, 12, 13, 14, 20, 30])))) for i in range(12)]
    items += [(None, "a b a"), (3, None), (77, "Quick-BROWN fox; jumps over the lazy dog again and again the quick brown fox"), (78, "x y"), (78, "漢字")]
    assert found(spark, rows, items) == plain(brute(rows, items))
    long = [i for i in items if len(words(i[1])) >= 13]
    assert found(spark, rows, long) == plain(brute(rows, long))


def test_every_long_shared_span_is_found(spark):
    """Spans of thirteen words at every place of a text are hit as a whole, whatever stands around them."""
    draw = random.Random(8)
    item = [f"w{draw.randrange(10**6)}" for _ in range(40)]
    rows = [(i, " ".join([f"x{draw.randrange(10**6)}" for _ in range(draw.randrange(20))] + item[i : i + 13] + ["end"])) for i in range(28)]
    assert all(r[2] == 13 for r in found(spark, rows, [(1, " ".join(item))]))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert {r[2] for r in found(spark, TEXTS, [])} == {0}


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate(documents(spark), table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
