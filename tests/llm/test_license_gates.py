"""Gates may only save work: with and without them the same is found."""

import re
from itertools import product

import duckdb
import pytest

from corpus import documents, plain
from wardspark.llm.license_rules import NAMES, needs_context, rules
from wardspark.llm.license_scan import license_report, license_scan
from wardspark.llm.oracles import licenses

CONTEXT = {short for _, short, _, _ in NAMES if needs_context(short)}
TEXTS = [
    (1, "Released under MIT"), (2, "distributed under Apache 2.0"), (3, "published under BSD-3-Clause"), (4, "Licensed under CC BY-NC 4.0."), (5, "It is MPL 2.0, they say"),
    (6, "apache and zlib are products"), (7, "zlib, see the license"), (8, "under the limits permitted"),
]


def shortest(pattern):
    """Texts that a pattern matches, one for every way through its choices; gaps are filled with a word."""

    def ways(items):
        return ["".join(p) for p in product(*(one(op, value) for op, value in items))]

    def one(op, value):
        name = str(op)
        if name == "LITERAL":
            return [chr(value)]
        if name == "SUBPATTERN":
            return ways(value[-1])
        if name == "BRANCH":
            return [w for branch in value[1] for w in ways(branch)]
        if name == "IN":
            return [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            return ways(list(inner) * low) + ([] if low or str(inner[0][0]) == "ANY" else ways(inner))
        assert name == "ANY", name
        return ["x"]

    return set(ways(re._parser.parse(pattern)))


@pytest.mark.parametrize("rule", [r for r in rules() if r.pattern not in CONTEXT], ids=lambda r: f"{r.label}-{r.rank}")
def test_every_match_contains_the_keyword(rule):
    pattern = rule.pattern if rule.pattern.count("licensed )?") == 0 else "licensed under" + rule.pattern[rule.pattern.index("following)?") + len("following)?") :]
    texts = shortest(pattern)
    assert texts and all(re.fullmatch(rule.pattern, t) and rule.keyword in t for t in texts)


def test_grants_by_short_name(spark):
    rows = {r.doc_id: r for r in license_report(license_scan(documents(spark, TEXTS))).collect()}
    assert [(rows[i].labels, rows[i].score) for i in range(1, 9)] == [
        ("mit", 0.95), ("apache-2.0", 0.95), ("bsd-3-clause", 0.95), ("cc-by,cc-by-nc-4.0", 0.95), ("mpl-2.0", 0.7), ("", 0.0), ("zlib", 0.7), ("", 0.0)]


def test_the_same_without_gates(spark):
    gated = "AND contains(line, keyword)"
    context = ", ".join(f"'{s}'" for s in sorted(CONTEXT))
    ungated = licenses().replace(gated, f"AND (pattern NOT IN ({context}) OR contains(line, keyword))")
    assert ungated != licenses()
    start, end = ungated.index("gated AS ("), ungated.index("spots AS (")
    ungated = ungated[:start] + "gated AS (SELECT * FROM docs),\n" + ungated[end:]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", TEXTS)
    expected = plain(duck.execute(ungated).fetchall())
    assert expected == plain(duck.execute(licenses()).fetchall()) == plain(license_report(license_scan(documents(spark, TEXTS))).collect())
