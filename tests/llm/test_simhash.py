import random
import re

import pytest
import xxhash

from corpus import LOWER, TEXTS, documents, plain
from wardspark.llm import simhash
from wardspark.llm.components import components


def brute_fingerprint(text):
    line = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(line[i : i + 3]) for i in range(len(line) - 2)] if len(line) >= 3 else [" ".join(line)] * bool(line)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def texts():
    draw, rows = random.Random(4), list(TEXTS)
    for n in range(60):
        line = [draw.choice("abcdefgh") * draw.randrange(1, 4) for _ in range(draw.randrange(1, 120))]
        rows.append((100 + 10 * n, " ".join(line)))
        for copy in range(3):
            line[draw.randrange(len(line))] = f"z{copy}"
            rows.append((101 + 10 * n + copy, " \t".join(line)))
    return rows


@pytest.mark.parametrize("crowd", [simhash.CROWD, 0])
def test_equals_brute_force(spark, crowd):
    rows = texts()
    prints = [brute_fingerprint(t) for _, t in rows]
    top = classes(set(prints), lambda a, b: bin(a ^ b).count("1") <= 2)
    assert len(set(top.values())) < len(set(prints))  # there are links
    first = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[top[p]] = min(i, first.get(top[p], i))
    found = simhash.simhash_dedup(documents(spark, rows), crowd=crowd).collect()
    assert plain((r.doc_id, r.fingerprint, r.component_id) for r in found) == plain((i, f"{p:016x}", first.get(top[p])) for (i, _), p in zip(rows, prints))
    kept = {(r.component_id, r.doc_id, r.text_key) for r in found if r.keep}
    assert len(kept) == len(set(top.values()))


def test_blocks_of_long_texts(monkeypatch):
    text = " ".join(str(i) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_empty_table(spark):
    assert simhash.simhash_dedup(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3), (7, 6), (6, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
