import re

import pytest
from pyspark.sql import functions as F

from corpus import TEXTS, documents, plain
from wardspark.llm import surrogates as pii

KEY = b"test key"
ROWS = TEXTS + [
    (40, "Mr. John Smith wrote to Mrs Anna Smith (ANNA@Mail2.example.com, anna@mail2.example.com)."), (41, "call +1 (017) 555-7713 or +1 017-555-7713!!! or (030) 555-1234"),
    (42, "card 4111 1111 1111 1111 = 4111111111111111, 9807915762804490 ip 97.51.17.173."), (43, "DE89 3704 0044 0532 0130 00 and 123-45-6789"),
    (44, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 2020-01-02 1.2.3 12345 @nobody x@y'), (45, "Господин Иванов, Frau Müller, Mr 王小明; anna@mail2.example.com"),
]


@pytest.mark.parametrize("size", [1, 2, 9, 10, 26, 1000])
def test_permutation(size):
    assert sorted(pii._permuted(i, size, KEY, b"t") for i in range(size)) == list(range(size))


def test_formats_and_coreference():
    new = {i: pii.replace(t, KEY, {})[0] for i, t in ROWS if i and i >= 40}
    first = re.fullmatch(r"Mr\. (\w{4}) (\w{5}) wrote to Mrs (\w{3}a) (\w{5}) \(([A-Z]{4}@[A-Z][a-z]{3}\d\.[a-z]{7}\.com), ([a-z]{4}@[a-z]{4}\d\.[a-z]{7}\.com)\)\.", new[40])
    assert first and first[2] == first[4] and first[1][-1] == "n" and first[5].lower() == first[6] and first[6] in new[45]
    phones = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3})-(\d{3})-(\d{4})!!! or \(\d{3}\) \d{3}-\d{4}", new[41])
    assert phones and phones.groups()[:3] == phones.groups()[3:] != ("017", "555", "7713")
    cards = re.match(r"card ((?:\d{4} ){3}\d{4}) = (\d{16}), (\d{16}) ip (\S+)\.$", new[42])
    assert cards[1].replace(" ", "") == cards[2] and pii._luhn(cards[2][:-1]) == int(cards[2][-1]) and pii._luhn(cards[3][:-1]) != int(cards[3][-1])
    assert all(0 <= int(o) <= 255 for o in cards[4].split("."))
    iban = re.match(r"DE[\d ]{25}", new[43])[0].replace(" ", "")
    assert pii._iban_check("DE", iban[4:]) == iban[2:4]
    assert new[44] == dict(ROWS)[44]
    assert re.fullmatch(r"Господин [А-Я][а-я]{5}, Frau [A-Z][a-zà-ÿ]{5}, Mr [一-鿿]{3}; .*", new[45])


def test_other_key_other_surrogates():
    assert pii.replace(ROWS[-6][1], KEY, {})[0] != pii.replace(ROWS[-6][1], b"other", {})[0]


def test_table_equals_texts_one_by_one(spark):
    found = pii.pseudonymize(documents(spark, ROWS), KEY, ("doc_id", "lang")).collect()
    assert plain((r.doc_id, r.text) for r in found) == plain((i, None if t is None else pii.replace(t, KEY, {})[0]) for i, t in ROWS)
    assert pii.pseudonymize(documents(spark, []), KEY, ("doc_id",)).count() == 0


@pytest.mark.parametrize("sent", [pii.SENT, 0])
def test_collisions_are_drawn_again(spark, sent):
    """Tiny formats, where permutations leave some values in place."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"to {a}@{b}.com, {a}@{b}.com") for i, (a, b) in enumerate((a, b) for a in "aeiou" for b in letters)]
    docs = documents(spark, rows)
    again = pii.drawn_again(docs, KEY).collect()
    found = {r.doc_id: r.text for r in pii.pseudonymize(docs, KEY, ("doc_id",), sent=sent).collect()}
    assert again and len(set(found.values())) == len(rows)
    assert all(found[i] != t for i, t in rows)
    assert all(len(set(re.findall(r"\S+@\w\.com", t))) == 1 for t in found.values())


def test_long_text_with_many_entities():
    text = " ".join(f"user{i}@host{i}.org {i % 200}.7.8.9" for i in range(5000))
    new, found = pii.replace(text, KEY, {})
    assert len(found) == 10_000 and len(set(re.findall(r"\S+@\S+", new))) == 5000
