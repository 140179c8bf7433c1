import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import LOWER, documents
from wardspark.llm import collocations as col
from wardspark.llm.collocations import collocations, phrase_counts


def counted(rows, longest):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts, sizes


def expected(rows, longest=3, least=10, top=2000):
    counts, sizes = counted(rows, longest)
    out = []
    for lang, found in counts.items():
        phrases = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in phrases.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        ranked = []
        for p, a in phrases.items():
            if not longer[p] or 100 * longer[p] < 50 * a:
                score, _, l, r = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, sizes[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def some_rows():
    draw = np.random.default_rng(3)
    words = [*"abcdefgh", "Élan", "ünd", "x\x01y", " ", "the", "THE", "-"]
    text = lambda: "".join(str(draw.choice(words)) + str(draw.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "])) for _ in range(draw.integers(0, 60)))
    rows = [(str(draw.choice(["en", "de"])) if draw.random() < 0.9 else None, text()) for _ in range(300)]
    return rows + [("en", "hot pair " * 4000), ("en", None), (None, ""), ("fr", None), ("xx", "one. two; three"), ("de", "the " * 3000), *[("en", "copy of this text")] * 40]


@pytest.mark.parametrize("longest, budget, size, part", [(3, 500_000, 2_000_000, 1 << 22), (3, 200, 500, 64), (2, 50, 300, 1), (4, 100, 1000, 1 << 22), (5, 40, 7, 9)])
def test_equals_brute_force(spark, monkeypatch, longest, budget, size, part):
    monkeypatch.setattr(col.chunks, "__defaults__", (col.CHUNK, part))
    rows = some_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns({"phrase": F.lit(1), "word": F.lit(2), "n": F.lit(3), "group": F.lit(4)})
    assert sorted(map(tuple, collocations(docs, max_words=longest, budget=budget, size=size).collect())) == expected(rows, longest)


def test_counts_of_all_phrases(spark):
    rows = some_rows()
    words, phrases = phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 3, 1, budget=100, size=100)
    counts, sizes = counted(rows, 3)
    assert {(r.lang, r.phrase): r.n for r in phrases.collect()} == {(lang, " ".join(p)): n for lang, found in counts.items() for p, n in found.items() if len(p) > 1}
    assert {r.lang: r.n for r in words.where("word is null").collect()} == {lang: n for lang, n in sizes.items() if lang not in ("fr",)}


def test_ranks_cut_at_the_top_and_ties_go_by_bytes(spark):
    rows = [("en", f"z{c} y{c}. " * 10) for c in ["é", "z", "a", "Z", "𐍈", "￮"]]
    found = collocations(spark.createDataFrame(rows, "lang string, text string"), top=4).collect()
    assert sorted(map(tuple, found)) == expected(rows, top=4) and len(found) == 4


def test_prefixes_are_extended_and_grouped(spark):
    texts = spark.createDataFrame(some_rows(), "lang string, text string")
    words = col.word_counts(texts, 10)
    cut = col.partition_prefixes(texts, words, 3, budget=300)
    assert len(cut.hot) == 2 and all(h.any() for h in cut.hot) and max(s.max() for s in cut.starts) > 10 and cut.ways[2].max() > 1 and cut.ways[0].max() == cut.ways[1].max() == 1
    assert col.partition_prefixes(texts, words, 3).hot == []


def test_keys_of_long_paths_do_not_overflow():
    draw = np.random.default_rng(0)
    columns = [draw.integers(0, 1 << 30, 500) for _ in range(4)]
    columns = [np.concatenate([c, c[:100]]) for c in columns]
    paths, sums = col.merged(columns, np.arange(600))
    expected = Counter()
    for path, n in zip(zip(*(c.tolist() for c in columns)), range(600)):
        expected[path] += n
    assert dict(zip(zip(*(c.tolist() for c in paths)), sums.tolist())) == expected


def test_products_beyond_64_bits(spark):
    """Scores of counts near 10^9 come out exact: counts are put in place of a corpus."""
    big = 10**13
    assert spark.range(1).selectExpr(f"(1000000 * CAST({big - 1} AS DECIMAL(15,0)) * CAST({big - 1} AS DECIMAL(15,0))) div (CAST({big} AS DECIMAL(15,0)) * CAST({big + 7} AS DECIMAL(15,0))) as s").first().s == 10**6 * (big - 1) ** 2 // (big * (big + 7))


def test_awkward_tables(spark):
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0
    rows = documents(spark)
    assert sorted(map(tuple, collocations(rows).collect())) == expected([(r.lang, r.text) for r in rows.collect()])
