"""What must not grow with the square of a file or a rule table."""

import ast
import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from wardspark.functions.code_facts import facts_of
from wardspark.functions.versions import version_key
from wardspark.operators import supply


def plain_facts(code):
    """Calls and assignments, each written out by itself; names looked up among all imports before."""
    order = []

    def visit(node):
        order.append(node)
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(ast.parse(code))
    calls, assigns = [], []
    for place, node in enumerate(order):
        if isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else None
            full = [f"{n.module}.{a.name}" if isinstance(n, ast.ImportFrom) and n.module else a.name for n in order[:place] if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names
                    if name is not None and name == (a.asname or (a.name if isinstance(n, ast.ImportFrom) else None))]
            calls.append((place + 1, full[-1] if full else None, ast.unparse(node.args[0]) if node.args else "", [(k.arg, ast.unparse(k.value)) for k in node.keywords if k.arg]))
        elif isinstance(node, ast.Assign):
            assigns += [(place + 1, ast.unparse(node.value)) for t in node.targets if isinstance(t, ast.Name)]
    return calls, assigns


SOURCES = [
    "f(g(h(1)), k=g(2)(3), **m(4))", "x = f(a if g(1) else h(2))(i(3))[j(4)].k(l(5))", "f(f'{g(1)!r:>{h(2)}} {f(\"x\")}')", "f(lambda a: g(a), *h(b))", "f(x for x in g(y))", "f(not g(1), -h(2), g(1) ** h(2), (yield))",
    "from a import b as c\nc(1)\nimport c\nc(2)\ndef f():\n  from d import c\n  c(c(3))\nc(4)\nimport torch as t\nt(5)", "f((g(1), h(2)), [i(3)], {j(4): k(5)}, {l(6)})", "f(x := g(1), 5 .real(), (1).x(h(2)))", "async def f():\n  g(await h(1))", "f('''a\nb''', g(\"q'\"))",
]


@pytest.mark.parametrize("code", SOURCES + sorted(glob.glob(os.path.join(os.path.dirname(__file__), "..", "wardspark", "**", "*.py"), recursive=True)))
def test_facts_are_those_of_each_call_by_itself(code):
    code = open(code, encoding="utf-8").read() if code.endswith(".py") else code
    found, (calls, assigns) = facts_of(code), plain_facts(code)
    assert [(c["seq"], c["first_arg_src"], c["kwargs"]) for c in found["calls"]] == [(seq, first, kwargs) for seq, _, first, kwargs in calls]
    assert [c["resolved_name"] for c in found["calls"]] == [full or c["func"] for (_, full, _, _), c in zip(calls, found["calls"])]
    assert [(a["seq"], a["value_src"]) for a in found["assigns"]] == assigns


def seconds(code):
    start = time.process_time()
    assert facts_of(code) is not None
    return time.process_time() - start


def test_many_imports_and_calls():
    code = "".join(f"from m{i} import f{i % 100}\nf{i % 100}(x)\n" for i in range(20_000))
    assert seconds(code) < 10
    found = facts_of(code)["calls"]
    assert all(c["resolved_name"] == f"m{i}.f{i % 100}" for i, c in enumerate(found))


def test_nested_calls():
    nested = lambda times: ("f(" * 90 + "1" + ")" * 90 + "\n") * times
    assert facts_of(nested(1))["calls"][0]["first_arg_src"] == "f(" * 89 + "1" + ")" * 89
    assert seconds(nested(24)) < 5  # 2,160 calls


def brute(key_less, advisories, version):
    covering = [a for a in advisories if key_less(version, a[1])]
    return min(covering)[0] if covering else None


def test_many_advisories_of_one_package(spark):
    draw = random.Random(5)
    version = lambda: ".".join(str(draw.randrange(40)) for _ in range(draw.randrange(1, 4))) + draw.choice(["", "", "", "rc1", ".post2", ".dev3"])
    rows = [{"adv_ord": i, "package": "One", "vulnerable_below": version() if draw.random() < 0.9995 or i < 20_000 else "unreadable", "cve": f"CVE-{i}", "severity": "HIGH", "cwe": "c", "owasp": "o", "description": "d", "remediation": "r"} for i in range(50_000)]
    draw.shuffle(rows)
    rows += [{**rows[0], "adv_ord": 7, "package": "two", "vulnerable_below": "2.0", "cve": "CVE-two"}, {**rows[0], "adv_ord": 3, "package": "two", "vulnerable_below": "1.0", "cve": "CVE-one"}, {**rows[0], "adv_ord": 9, "package": "two", "vulnerable_below": "2.0", "cve": "CVE-three"},
             {**rows[0], "adv_ord": 1, "package": "odd", "vulnerable_below": "?", "cve": "CVE-odd"}]
    deps = [("one", version()) for _ in range(200)] + [("one", "junk"), ("one", None), ("ONE", "0"), ("one", "99"), ("two", "0.5"), ("two", "1.0"), ("two", "1.5"), ("two", "2.0"), ("odd", "5"), ("none", "1"), (None, "1")]
    table = spark.createDataFrame([(i, *d) for i, d in enumerate(deps)], "n int, package string, version string")
    advisories = supply.advisory_table(spark, rows).repartition(7)
    found = {r.n: r.adv_ord for r in supply.match_advisories(table, advisories, "left").select("n", "advisory.adv_ord").collect()}
    keyed = advisories.select(F.lower("package").alias("p"), version_key(F.col("vulnerable_below")).alias("b"), "adv_ord")
    pairs = table.withColumn("k", version_key(F.col("version"))).join(F.broadcast(keyed), F.lower("package") == F.col("p"), "left")
    slow = pairs.where("p is null or k is null or b is null or k < b").groupBy("n").agg(F.min("adv_ord").alias("a")).collect()
    expected = {i: None for i in range(len(deps))} | {r.n: r.a for r in slow}
    assert found == expected and found[205] == 7 and found[204] == 3
    assert supply.match_advisories(table, advisories).count() == sum(v is not None for v in expected.values())
