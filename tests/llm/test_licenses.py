import re

import pytest

from corpus import TEXTS, documents, plain, words
from wardspark.llm.license_rules import BASE, rules
from wardspark.llm.license_scan import REACH, license_report, license_scan


def brute_base(text):
    line, found = words(text), []
    for phrase, label in BASE:
        parts = phrase.split(" ")
        found += [(i, label) for i in range(len(line) - len(parts) + 1) if line[i : i + len(parts)] == parts]
    return len(line), sorted(found)


def brute_detections(text):
    """Every rule at every word, then the winner per place, then containment between all pairs."""
    line, best = words(text), {}
    joined = " ".join(line)
    for number, rule in enumerate(rules()):
        if rule.keyword not in joined:
            continue
        for i, word in enumerate(line):
            if word in rule.starts and (m := re.match(rf"(?:{rule.pattern})(?= |$)", " ".join(line[i : i + REACH]))) and m[0]:
                best[i] = max(best.get(i, (0, 0, 0)), (rule.rank, len(m[0]), -number))
    labels = [rule.label for rule in rules()]
    hits = [(i, i + len(" ".join(line[i:])[:size].split(" ")), rank, labels[-order]) for i, (rank, size, order) in sorted(best.items())]
    kept = []
    for hit in hits:
        inside = any(o[0] < hit[0] and o[1] >= hit[1] and o[2] >= hit[2] for o in hits)
        beaten = any(o[0] > hit[0] and o[1] <= hit[1] and o[2] > hit[2] for o in hits)
        if not inside and not beaten:
            kept.append((hit[3], hit[0], hit[1]))
    return kept


EXTRA = [
    (20, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    (21, "SPDX-License-Identifier: GPL-3.0. This program is free software: you can redistribute it and/or modify it"),
    (22, "general public license, general public license; gnu lesser general public license version 2.1 cc by-sa 4.0 cc by"),
    (23, "BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (24, "all rights reserved all rights reserved, licence, copyright 2020 x. Released into the public domain. CC0"),
]


def test_equals_brute_force(spark):
    rows = TEXTS + EXTRA
    scanned = license_scan(documents(spark, rows))
    got = plain((r.doc_id, r.n_words, [tuple(b) for b in r.base], [(d.label, d.start, d.end) for d in r.detections]) for r in scanned.collect())
    assert got == plain((i, *brute_base(t), brute_detections(t)) for i, t in rows)


def test_report(spark):
    rows = {r.doc_id: r for r in license_report(license_scan(documents(spark, EXTRA + [(30, None)]))).collect()}
    assert rows[30].labels == "" and rows[30].score == 0.0 and rows[30].first_word is None and rows[30].n_words == 0
    assert rows[20].labels == "apache-2.0" and rows[21].score == 1.0
    assert rows[24].n_base == 2 and (rows[24].first_word, rows[24].last_word) == (0, 3)
    assert license_report(license_scan(documents(spark, []))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = license_report(license_scan(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("rule", rules()[:5])
def test_rules_compile(rule):
    assert re.compile(rule.pattern)
