import re
import warnings

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardspark.catalog import patterns as cat, prompt_signatures as sig
from wardspark.functions.anchors import FOLDING, anchor_mask, any_bit, has_bit, in_own_words, text_facts
from wardspark.functions.pattern_anchors import anchors_of
from wardspark.operators.scan import gated, rule_trials, scan_artifacts
from wardspark.plans import corpora
from wardspark.schemas import CUSTOM_RULES
from wardspark.sources import rule_files
from wardspark.sources.local import local_table


def looked_at(text):
    return " ".join(text.lower().split())


def holds_one(text, anchors):
    return any(a in looked_at(text) for a in [*anchors, *FOLDING])


@pytest.mark.parametrize("pattern, anchors", [
    (r"(?i)api[_-]?key\s*=", ["api-key", "api_key", "apikey"]), ("foo|bar|bazinga", ["bar", "bazinga", "foo"]), ("(abc){2}x*", ["abcabc"]), (r"(?:ab|cd)(?:ef|gh)z", ["abefz", "abghz", "cdefz", "cdghz"]),
    ("insert into", ["insert"]), ("(ab)?cde", ["cde"]), ("colou?r", ["color", "colour"]), ("[Aa]bc", ["abc"]), (r"x{3,}", ["xxx"]), (r"(a|b|[0-9])cdef", ["acdef", "bcdef"]),
    ("[a-z]+", None), ("a.b", None), ("(?x) a b c d", None), ("Σίσυφος", None), ("abc|d", None), ("(?:abc)?", None), (r"(abc)?\1", None), ("(unclosed", None), ("", None), ("abc|abcd", ["abc"]), ("ab c", None),
])
def test_anchors(pattern, anchors):
    found = anchors_of(pattern)
    assert found == anchors or anchors and pattern.startswith("(a|b|[0-9])") and "acdef" in found


PATTERNS = [p["pattern"] for p in cat.LINE_PATTERNS + cat.RAG_PATTERNS + cat.AGENT_PATTERNS] + [s["pattern"] for group in sig.SIGNATURE_FILE.values() for s in group]
PATTERNS += [r["pattern"] for r in corpora.many_rules(60)]


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_no_match_without_an_anchor(data):
    pattern = data.draw(st.sampled_from(PATTERNS))
    anchors = anchors_of(pattern)
    if anchors:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compiled = re.compile(pattern, data.draw(st.sampled_from([0, re.IGNORECASE])))
        found = compiled.search(data.draw(st.from_regex(compiled)))
        assert found is None or holds_one(found[0], anchors)


_chars = st.sampled_from([re.escape(c) for c in "abcKSiI_-=( é"] + [r"\s", r"\w", ".", "[ab]", "[^a]", "[A-C]", r"\d", r"\b", "^"])
_random = st.recursive(
    st.lists(_chars, min_size=1, max_size=6).map("".join),
    lambda inner: st.one_of(
        st.tuples(inner, inner).map("".join), st.tuples(inner, inner).map(lambda x: f"(?:{x[0]}|{x[1]})"),
        st.tuples(inner, st.sampled_from(["?", "*", "+", "{2}", "{1,3}", "{2,}", "+?", "??"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
        inner.map(lambda x: f"({x})"), inner.map(lambda x: f"(?i:{x})"), inner.map(lambda x: f"(?={x})"), inner.map(lambda x: f"(?!{x})")),
    max_leaves=8)


@settings(max_examples=1500, deadline=None, suppress_health_check=list(HealthCheck))
@given(_random, st.data())
def test_no_match_of_a_random_pattern_without_an_anchor(pattern, data):
    anchors = anchors_of(pattern, 1)
    if anchors:
        text = data.draw(st.one_of(st.from_regex(pattern), st.text(alphabet="abcksiKSI_-=( é\nıſİK", max_size=30)))
        for flags in (0, re.IGNORECASE):
            assert not re.search(pattern, text, flags) or holds_one(text, anchors)


def test_rules_run_only_where_an_anchor_stands(spark):
    rules = rule_files.compile_custom_rules(local_table(spark, [{"id": "A", "pattern": "needle[^a-z]"}, {"id": "B", "pattern": "[0-9]{3}"}, {"id": "C", "pattern": "NEEDLE", "file_extensions": [".py"]}], CUSTOM_RULES))
    rows = [("a.py", "t", "needle7 NEEDLE"), ("b.txt", "t", "Needle! x 123"), ("c.py", "t", "nothing"), ("d.py", "t", None), ("e.py", "t", ""), ("f.txt", "t", "ſ")]
    artifacts = spark.createDataFrame(rows, "path string, target string, content string")
    found = {r.rule_id: (r.anchors, r.texts, r.tried, r.matched) for r in rule_trials(artifacts, rules).collect()}
    assert found == {"A": (["needle"], 6, 3, 1), "B": (None, 6, 6, 1), "C": (["needle"], 6, 1, 1)}
    hits = scan_artifacts(artifacts, rules, ["custom"]).select("path", F.explode("hits").alias("h")).select("path", "h.rule_id").collect()
    assert sorted(map(tuple, hits)) == [("a.py", "A"), ("a.py", "C"), ("b.txt", "B")]


def test_groups_of_files_have_words_of_their_own(spark):
    groups = in_own_words([["abc"]] * 5)
    rules = gated([{"pattern": "xyz"}, {"pattern": "."}, {"pattern": "uvw", "anchors": ["uv"]}], groups)
    assert [r["bit"] for r in rules] == [63, None, 64] and len(groups) == 65
    row = spark.createDataFrame([("xyz uv\n",)], "t string").select(text_facts(F.col("t"), groups).alias("f")).select("f.mask", "f.n_lines", any_bit(F.col("f.mask"), 5).alias("own"), has_bit(F.col("f.mask"), 64).alias("last")).first()
    assert row.mask == [0, 3] and row.n_lines == 1 and not row.own and row.last
    assert spark.createDataFrame([(None,), ("",)], "t string").select(anchor_mask(F.col("t"), groups).alias("m")).collect() == [([0, 0],), ([0, 0],)]


def test_secret_signatures(spark, tmp_path):
    import json

    path = tmp_path / "secrets.json"
    path.write_text(json.dumps({"signatures": corpora.SECRET_SIGNATURES}, indent=2))
    with pytest.warns(UserWarning, match="OWN-KEY-002: no id or provider; 2 rows"):
        rules = rule_files.load_secret_rules(spark, str(path))
    assert [(r["rule_id"], r["anchors"]) for r in rules] == [("OWN-KEY-001", ["hf_"]), ("SEC-KEY-002", ["sk-ant-"]), ("SEC-KEY-900", None)]
    text = "x = 'Hf_" + "a1" * 20 + "'\n   \n1a2B3"
    rows = scan_artifacts(spark.createDataFrame([("a.py", "t", text)], "path string, target string, content string"), detectors=["secrets"], secret_rules=rules)
    hits = rows.select(F.explode("hits").alias("h")).select("h.rule_id", "h.line", "h.col", "h.attrs").collect()
    assert [(h.rule_id, h.line, h.col) for h in hits] == [("OWN-KEY-001", 1, 6), ("SEC-KEY-900", 3, 1)]
    assert hits[0].attrs["severity"] == "CRITICAL" and hits[0].attrs["title"] and "Example" in hits[0].attrs["description"]


def test_signatures_of_a_prompt_file_get_anchors(spark, tmp_path):
    path = tmp_path / "own.json"
    path.write_text('{"threat_categories": {"own": [{"name": "n", "pattern": "open the\\\\s+gate", "score": 5, "level": "LOW", "vector": "Gate"}]}}')
    assert rule_files.all_signatures(spark, str(path))[0]["anchors"] == ["open"]
