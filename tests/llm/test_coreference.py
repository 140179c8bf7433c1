import pytest

from corpus import documents
from wardspark.llm import surrogates as pii

KEY = b"test key"


def test_later_and_earlier_mentions_of_a_name():
    text = "JOHN and Smith. Mr John Smith called. John Smith said so. Smith's dog and Smith-Jones left; Johnson and Smithers, john@smith.org stayed."
    new, found = pii.replace(text, KEY, {})
    given, family = (pii.surrogate(k, v, KEY).capitalize() for k, v in (("given_m", "john"), ("family", "smith")))
    mail = pii.surrogate("email", "john@smith.org", KEY)
    assert new == (f"{given.upper()} and {family}. Mr {given} {family} called. {given} {family} said so. {family}'s dog and {family}-Jones left; "
                   f"Johnson and Smithers, {mail} stayed.")
    assert [e.kind for e in found].count("family") == 5 and found == sorted(found, key=lambda e: e.start)


def test_names_with_hyphens_and_plain_words():
    new, _ = pii.replace("Frau Anna-Lena Müller. Anna-Lena Müller, MÜLLER; mr. may. Mrs May may come in May", KEY, {})
    given, family, may = (pii.surrogate(k, v, KEY) for k, v in (("given_f", "anna-lena"), ("family", "müller"), ("family", "may")))
    full = f"{'-'.join(p.capitalize() for p in given.split('-'))} {family.capitalize()}"
    assert new == f"Frau {full}. {full}, {family.upper()}; mr. may. Mrs {may.capitalize()} may come in {may.capitalize()}"


def test_initials_are_no_names_elsewhere():
    new, _ = pii.replace("Mr A Smith came. A dog saw Smith.", KEY, {})
    assert new.split(". ")[1].startswith("A dog saw ") and "Smith" not in new


@pytest.mark.parametrize("ways", [
    ("+12025550123", "+1 202 555 0123", "+1 (202) 555-0123", "+1.202.555.0123"), ("+493012345678", "+49 30 1234 5678", "+49 (30) 1234-5678"), ("+353 86 123 4567", "+353861234567"),
    ("+74951234567", "+7 495 123 4567")])
def test_phones_however_written(ways):
    values = {e.value for way in ways for e in pii.entities(f"call {way} now")}
    assert len(values) == 1
    new = [pii.replace(f"call {way} now", KEY, {})[0] for way in ways]
    assert len({"".join(c for c in n if c.isdigit()) for n in new}) == 1 and all(n != f"call {w} now" for n, w in zip(new, ways))
    assert all([c.isdigit() for c in n] == [c.isdigit() for c in f"call {w} now"] for n, w in zip(new, ways))


def test_in_the_table(spark):
    rows = [(1, "Mr John Smith called. Smith left."), (2, "Smith without a title")]
    found = {r.doc_id: r.text for r in pii.pseudonymize(documents(spark, rows), KEY, ("doc_id",)).collect()}
    assert "Smith" not in found[1] and found[2] == rows[1][1]
