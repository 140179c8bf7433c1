import itertools
import math
import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from wardspark.catalog import patterns as cat
from wardspark.functions.anchors import FOLDING, _bits
from wardspark.functions.entropy import shannon_entropy, short_entropy
from wardspark.functions.regex import column_of, java_pattern, line_of, match_offsets, match_positions
from wardspark.functions.text import count_lines, decode_text, snippet, split_lines, suffix
from wardspark.functions.versions import version_lt
from wardspark.operators.prompts import default_signatures
from wardspark.operators.scan import GROUPS

TEXTS = ["", "a", "a\n", "\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce\x85f g h\n\n", "x=1\n  y\x01z\nx=2x=3", "über\nx=9 日本x=1\n"]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string").orderBy("i")


def test_lines_follow_python(spark):
    rows = texts(spark, TEXTS).select("t", split_lines(F.col("t")).alias("l"), count_lines(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.l == r.t.splitlines()
        assert r.n == len(r.l)


def test_match_places_follow_python(spark):
    for pattern in (r"x=\d", r"\s+", r"b?", r"(?<=x)=", r"[a-z]+"):
        rows = texts(spark, TEXTS).select("t", match_positions(F.col("t"), java_pattern(pattern)).alias("m"), match_offsets(F.col("t"), java_pattern(pattern)).alias("o")).collect()
        for r in rows:
            if "\x1c" in r.t and "s" in pattern:
                continue  # Java does not count U+001C as white space
            found = list(re.finditer(pattern, r.t))
            assert r.o == [m.start() for m in found], (pattern, r.t)
            expected = [(i, r.t[: m.start()].count("\n") + 1, m.start() - r.t.rfind("\n", 0, m.start()), m.group()) for i, m in enumerate(found)]
            assert [tuple(m) for m in r.m] == expected, (pattern, r.t)


def test_line_and_column_of_offset(spark):
    rows = spark.sql("select 'ab\ncd\n\ne' as t, explode(sequence(0, 7)) as o").select("o", line_of(F.col("t"), F.col("o")).alias("l"), column_of(F.col("t"), F.col("o")).alias("c")).collect()
    text = "ab\ncd\n\ne"
    for r in rows:
        assert r.l == text[: r.o].count("\n") + 1
        assert r.c == r.o - text.rfind("\n", 0, r.o)


def test_entropy_two_ways(spark):
    values = ["", "aaaa", "abcd", "日本日", "aé😀é" * 30, "The quick brown fox"]
    rows = texts(spark, values).select("t", shannon_entropy(F.col("t")).alias("a"), short_entropy(F.col("t")).alias("b")).collect()
    for r in rows:
        expected = -sum(n / len(r.t) * math.log2(n / len(r.t)) for n in Counter(r.t).values()) if r.t else 0.0
        assert abs(r.a - expected) < 1e-9 and abs(r.b - expected) < 1e-9


def test_decode_drops_bad_bytes(spark):
    values = [b"plain", b"\xff\xfea", "né�é".encode(), b"a\xe2\x82b\xf0\x9f\x98", b"\xed\xa0\x80x"]
    rows = spark.createDataFrame([(v,) for v in values], "b binary").select("b", decode_text(F.col("b")).alias("t")).collect()
    for r in rows:
        assert r.t == bytes(r.b).decode("utf-8", errors="ignore")


def test_snippet_marks_the_line(spark):
    lines = F.array(*[F.lit(x) for x in "abcdef"])
    row = spark.range(1).select(snippet(lines, F.lit(2)).alias("x"), snippet(lines, F.lit(6)).alias("y"), snippet(lines, F.lit(7)).alias("z"), snippet(lines, F.lit(0)).alias("w")).first()
    assert row.x == "   1   a\n   2 > b\n   3   c\n   4   d"
    assert row.y == "   4   d\n   5   e\n   6 > f"
    assert row.z == "" and row.w == ""


def test_suffix(spark):
    cases = {"a/b.tar.GZ": ".GZ", "a/.env": "", "a/.env.local": ".local", "a.b/c": "", "x.": ""}
    rows = texts(spark, list(cases)).select("t", suffix(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_version_order_follows_pep440(spark):
    values = ["1.0", "1.0.0", "1", "1.0rc1", "1.0a2", "1.0.b3", "1.0.dev1", "1.0a2.dev1", "1.0.post1", "1.0-2", "1.0.post1.dev3", "1.0+cpu", "1.0+1", "1.0+1.a",
              "0.9.12", "1.10", "2024.1.1", "1!0.1", "1.*", "1.0x", "v1.1", "1.0-alpha", "1.0c1", "1.0preview2", "0.0"]
    pairs = list(itertools.product(values, values))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", version_lt(F.col("a"), F.col("b")).alias("lt")).collect()
    for r in rows:
        try:
            assert r.lt == (Version(r.a) < Version(r.b)), (r.a, r.b)
        except InvalidVersion:
            assert r.lt is None, (r.a, r.b)


def _anchored(groups, index, text):
    squeezed = " ".join(text.lower().split())
    return any(bit >> index & 1 and phrase in squeezed for phrase, bit in _bits(groups).items())


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_every_prompt_match_contains_an_anchor(data):
    signatures = default_signatures()
    index = data.draw(st.integers(0, len(signatures) - 1))
    text = data.draw(st.from_regex(re.compile(signatures[index]["pattern"], re.IGNORECASE), fullmatch=True))
    assert _anchored([s["anchors"] for s in signatures], index, text)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_every_scan_match_contains_an_anchor(data):
    rules = cat.LINE_PATTERNS + cat.RAG_PATTERNS + cat.AGENT_PATTERNS
    places = list(range(9)) + [12, 13, 14, 15, 16, 17]
    i = data.draw(st.integers(0, len(rules) - 1))
    flags = (re.IGNORECASE if rules[i].get("ignore_case", True) else 0) | (re.DOTALL if rules[i].get("dotall") else 0)
    text = data.draw(st.from_regex(re.compile(rules[i]["pattern"], flags), fullmatch=True))
    assert _anchored(GROUPS, places[i], text)


def test_folding_letters_count_as_anchors():
    assert all(_bits([["x"]])[letter] == 1 for letter in FOLDING)
