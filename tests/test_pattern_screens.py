import re
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardspark.functions import anchors
from wardspark.functions.anchors import text_facts
from wardspark.functions.pattern_screens import screen_of
from wardspark.operators.scan import scan_artifacts
from wardspark.plans import corpora
from wardspark.schemas import CUSTOM_RULES
from wardspark.sources import rule_files
from wardspark.sources.local import local_table

from test_pattern_anchors import PATTERNS, _random


def holds(screen, text):
    return pc.match_substring_regex(pa.array([text]), screen)[0].as_py()


@pytest.mark.parametrize("pattern, no, yes", [
    ("[ti][0-9]{3}[a-f]", "t12a i1234 T123a", "xt123a"), (r"from[a-z_]* *= *['\"]", "from here to there = 'x'", "from_x ='"), ("(?i)ment[ _]?call", "ment  call", "MENT_Call"),
    (r"\bab(?=c)(d)\1", "abcc", "abdd"), ("a{9,200}", "a" * 7, "a" * 9), (r"\d\s\w", "1a", "٣ é"), ("(?i:k)x", "jx", "Kx"), ("(?i)é", "", "É"), ("[^a]b", "b", "cb"), ("a*", None, ""),
])
def test_screens(pattern, no, yes):
    screen = screen_of(pattern)
    assert holds(screen, yes) and not (no is not None and holds(screen, no))


@pytest.mark.parametrize("pattern", ["(?x) a b", "(unclosed", "\ud800", "(?:" + "abc|xyz" * 400 + ")"])
def test_no_screen(pattern):
    assert screen_of(pattern) is None


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_no_match_without_the_screen(data):
    pattern = data.draw(st.one_of(st.sampled_from(PATTERNS), _random))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compiled = re.compile(pattern, re.MULTILINE)
        screen = screen_of(pattern)
    text = data.draw(st.one_of(st.from_regex(compiled), st.text("abcKSiIkſKı_-=( é\n1", max_size=12)))
    if screen is not None and compiled.search(text):
        assert holds(screen, text)


def test_masks_with_screens(spark):
    groups, texts = [["the"], [], [], ["zz"], []], ["the 1", "the a", "b2c", "", None, "zz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = rows.select("i", text_facts(F.col("t"), groups, {0: "[0-9]", 1: "[a-c][0-9]", 2: "x*", 4: "9"})["mask"][0].alias("m")).orderBy("i").collect()
    assert [r.m for r in found] == [0b101, 0b100, 0b110, 0b100, 0, 0b1100]


def test_slices_of_a_batch():
    texts = pa.array(["a" * 10, None, "", "b" * 50, "c", "d" * 9])
    parts = [p.to_pylist() for p in anchors.looks(texts, 12)]
    assert sum(parts, []) == texts.to_pylist() and [len(p) for p in parts] == [3, 1, 2] and list(anchors.looks(texts.slice(0, 0))) == []
    masks = np.full((3, 1), 1, np.int64)
    anchors._screened(pa.array(["x", "y", None]), masks, [["a"], []], {1: "x"})
    assert masks.ravel().tolist() == [3, 1, 1]


def test_findings_do_not_depend_on_screens(spark, monkeypatch):
    """Rules whose words are in nearly every text, but which match few, run only there; what is found stays the same."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rules = rule_files.compile_custom_rules(local_table(spark, corpora.many_rules(60) + corpora.CUSTOM_RULES, CUSTOM_RULES))
    artifacts = corpora.code_corpus(spark, "/root/testdata/sf0.001")
    hits = lambda given: sorted(map(str, scan_artifacts(artifacts, given, ["custom"]).select("path", "n_lines", "hits").collect()))
    assert all(r["screen"] for r in rules)
    assert hits(rules) == hits([{k: v for k, v in r.items() if k != "screen"} for r in rules])


def test_patterns_run_only_where_the_screen_matches(spark):
    """A rule without anchors gets a bit, which only texts have that its screen matches."""
    from wardspark.operators.scan import gated, screened, staged_texts

    groups = []
    rules, screens = screened(gated([{"pattern": "[ti][0-9]{3}[a-f]", "anchors": None, "screen": screen_of("[ti][0-9]{3}[a-f]")}, {"pattern": ".", "anchors": None}], groups), groups)
    assert [r["bit"] for r in rules] == [0, None] and groups == [[]]
    rows = spark.createDataFrame([("a", "t", "x t123 y"), ("b", "t", "t123f"), ("c", "t", None)], "path string, target string, content string")
    assert {r.path: r["_mask"][0] for r in staged_texts(rows, groups, screens=screens).collect()} == {"a": 0, "b": 1, "c": 0}


def test_plain_texts_are_split_alike(spark):
    """Texts are told that have no line ends but line feeds; splitting them without a pattern gives the same lines."""
    from wardspark.functions.text import split_lines

    ends = ["\n", "\r", "\r\n", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "\x1f", "é"]
    texts = [None, "", "a", "\n", "a\n\n"] + [t for e in ends for t in (e, f"a{e}", f"a{e}b", f"{e}\n", f"a\n{e}b\n", f"\n{e}")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_facts(F.col("t"), [["a"]]).alias("f"))
    found = rows.select("t", "f.plain", "f.n_lines", split_lines(F.col("t")).alias("old"), split_lines(F.col("t"), F.col("f.plain")).alias("new")).collect()
    for r in found:
        assert r.old == r.new
        assert r.plain == (r.t is None or not any(e in r.t for e in ends[1:-2])), repr(r.t)
