import random
import re
from re import _constants as sre, _parser as parser

import pytest

from corpus import documents
from wardspark.llm.license_rules import rules
from wardspark.llm.license_scan import REACH, license_report, license_scan


def a_match(items, draw):
    """One of the strings that an expression matches; optional parts are there half the time."""
    out = ""
    for kind, value in items:
        if kind is sre.LITERAL:
            out += chr(value)
        elif kind is sre.ANY:
            out += draw.choice("xyz")
        elif kind is sre.IN:
            chars = [chr(c) for c in range(32, 127) if re.match("[" + ("^ ]" if value[0][0] is sre.NEGATE else "".join(f"{chr(v[0])}-{chr(v[1])}" if k is sre.RANGE else chr(v) for k, v in value) + "]"), chr(c))]
            out += draw.choice([c for c in chars if c.isalnum()])
        elif kind is sre.BRANCH:
            out += a_match(draw.choice(value[1]), draw)
        elif kind is sre.SUBPATTERN:
            out += a_match(value[3], draw)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "".join(a_match(value[2], draw) for _ in range(draw.randint(value[0], min(value[1], value[0] + 3))))
        else:
            raise AssertionError(kind)
    return out


@pytest.mark.parametrize("rule", rules(), ids=lambda r: r.pattern[:50])
def test_starts_and_keyword_of_every_rule(rule):
    draw = random.Random(rule.pattern)
    for _ in range(60):
        found = a_match(parser.parse(rule.pattern), draw)
        assert re.fullmatch(rule.pattern, found) and found.split(" ")[0] in rule.starts and len(found.split(" ")) <= REACH
        assert rule.keyword.strip() in found or rule.rank == 2 and rule.keyword == "licen"


def test_long_names_and_one_word_forms(spark):
    holder = "the Regents of the University of California and Lawrence Berkeley Laboratory and a great many other owners of all kinds"
    rows = [(1, f"Neither the name of {holder} nor the names of its contributors may be used to endorse"), (2, "Weights under OpenRAIL-M."), (3, "An open rail m licence"), (4, "To the extent possible under law, " + "Somebody " * 30 + "has waived all copyright and related rights")]
    found = {r.doc_id: r.labels for r in license_report(license_scan(documents(spark, rows))).collect()}
    assert "bsd-3-clause" in found[1] and "openrail" in found[2] and "openrail" in found[3] and "cc0-1.0" in found[4]
