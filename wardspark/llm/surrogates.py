"""Personal data replaced by keyed surrogates of the same type and format.

Detection: e-mail addresses, IBANs, IPv4 addresses, card and account numbers, social security numbers, phone numbers, and names after a
form of address, with every other mention of these given and family names as whole words in the same text (written alike or all in capitals). Replacement: a keyed permutation of all values of the same format (a Feistel network walked until it stays inside
the format). Digits become digits, letters letters of the same script and case, vowels vowels; country codes,
top-level domains and separators stay; check digits are made right where they were right. A given name after a form of address
keeps its last letter, which is where names show their gender.

Equal values get equal surrogates wherever they stand and however they are written, so references survive; as a permutation
takes different values to different ones, so does distinctness. A corpus-wide check makes sure: surrogates that equal their value or
that two values share are drawn again, in rounds, until none is left (a value that its format leaves alone, like a single sign of an unknown
script, stays). The few values drawn again travel to the tasks if they are at most
``SENT``; beyond that they are joined to their documents.

Texts are read twice and not shuffled. Null texts stay null and count as empty. Rows with equal ids stay apart.
"""

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardspark.llm.shared import slices, text_key, written

#: Values drawn again that may be sent to every task.
SENT = 100_000
#: How often a value is drawn again at most. From the fifth time on surrogates of addresses and names grow by a letter each
#: time, since short formats may have no value left.
DRAWS, LONGER = 20, 4

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Госпожа": "f",
}
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]*(?:[-'’][^\W\d_]+)*"
#: In order of precedence: an earlier kind keeps its characters from the later ones.
PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[\w][\w.%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])"),
    "card": re.compile(r"(?<![\w+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])"),
    "name": re.compile(rf"(?<!\w)({'|'.join(_TITLES)})\.? ({_CAPITAL})(?: ({_CAPITAL}))?"),
}
KINDS = tuple(PATTERNS)
#: Calling codes: those of one and of two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NUMBERS = ("iban", "ip", "card", "ssn", "phone")
_DIGIT = re.compile(r"[0-9]")
NAME_KINDS = ("given_m", "given_f", "family")
_NAME_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:[-'’][^\W\d_]+)*(?!\w)")
_NAME_PART = re.compile(r"[^\W\d_]+")

#: Letters that may stand for each other.
_CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöøùúûü", "çñýÿšžčćđłńśźżřťďňľĺ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ",
    *("".join(map(chr, range(first, last))) for first, last in (  # Hebrew, Arabic, Devanagari, Thai, kana, ideographs, Hangul
        (0x5D0, 0x5EB), (0x621, 0x63B), (0x905, 0x93A), (0xE01, 0xE2F), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4))),
]
_PLACE = {c: (number, n) for number, letters in enumerate(_CLASSES) for n, c in enumerate(letters)}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    value: str  # in a form that all ways of writing it share


def entities(text: str) -> list[Entity]:
    """Entities from left to right, none over another."""
    found: list[Entity] = []
    starts: list[int] = []  # of what earlier kinds have taken, and their ends
    ends: list[int] = []

    def add(kind: str, start: int, end: int, value: str) -> None:
        before = bisect.bisect_right(starts, start)
        if (not before or ends[before - 1] <= start) and (before == len(starts) or starts[before] >= end):
            found.append(Entity(start, end, kind, value))

    digits = _DIGIT.search(text) is not None
    for kind, pattern in PATTERNS.items():
        if (kind == "email" and "@" not in text) or (kind in _NUMBERS and not digits) or (kind == "name" and not any(t in text for t in _TITLES)):
            continue
        for m in pattern.finditer(text):  # matches of one kind lie apart anyway
            if kind == "name":
                gender = _TITLES[m[1]]
                if m[3]:
                    add("given_" + gender, m.start(2), m.end(2), m[2].lower())
                add("family", *m.span(3 if m[3] else 2), (m[3] or m[2]).lower())
            elif kind == "phone":
                number = re.sub(r"[^0-9+]", "", m[0])
                if 7 <= len(number.lstrip("+")) <= 15:
                    add(kind, m.start(), m.end(), _country(m[0]) + ":" + _national(m[0]))
            elif kind == "email":
                add(kind, m.start(), m.end(), m[0].lower())
            else:
                add(kind, m.start(), m.end(), m[0] if kind == "ip" else re.sub(r"[ -]", "", m[0]))
        found.sort(key=lambda e: e.start)
        starts, ends = [e.start for e in found], [e.end for e in found]
    known: dict[str, Entity] = {}  # names as they may be written again; of a name with several kinds the first one counts
    for e in found:
        if e.kind in NAME_KINDS:
            name = text[e.start : e.end]
            if len(name) == 1 and name.lower() != name.upper():  # initials are plain words elsewhere, like A and I
                continue
            for written_as in dict.fromkeys((name, name.upper(), name.lower().title())):
                if written_as != written_as.lower() or written_as == name:  # lower case would hit plain words
                    known.setdefault(written_as, e)
    if known:
        for m in _NAME_WORD.finditer(text):
            for start, end in _mentions(m, known):
                e = known[text[start:end]]
                add(e.kind, start, end, e.value)
        found.sort(key=lambda e: e.start)
    return found


def _mentions(word: re.Match, known: dict[str, Entity]) -> Iterator[tuple[int, int]]:
    """Known names in a word: the whole of it, without a genitive's ending, or its parts between hyphens and apostrophes."""
    if word[0] in known:
        yield word.span()
        return
    parts = [(word.start() + m.start(), word.start() + m.end()) for m in _NAME_PART.finditer(word[0])]
    first = 0
    while first < len(parts):
        last = next((n for n in range(len(parts) - 1, first - 1, -1) if word.string[parts[first][0] : parts[n][1]] in known), None)
        if last is not None:
            yield parts[first][0], parts[last][1]
        first = first + 1 if last is None else last + 1


def _prefix(written_as: str) -> int:
    """How many characters of a phone number are its calling code with the plus; 0 without one. It ends by the table of codes, wherever a separator stands."""
    if not written_as.startswith("+"):
        return 0
    places = [m.end() for m in _DIGIT.finditer(written_as)]
    digits = re.sub(r"[^0-9]", "", written_as)
    return places[next((n for n in (1, 2) if digits[:n] in _CODES), 3) - 1]


def _country(written_as: str) -> str:
    return re.sub(r"[^0-9+]", "", written_as[: _prefix(written_as)])


def _national(written_as: str) -> str:
    return re.sub(r"[^0-9]", "", written_as[_prefix(written_as) :])


def _permuted(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the numbers below ``size``: eight Feistel rounds, walked until the result is below."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(8):
            width = (half + 7) // 8
            noise = hashlib.shake_128(key + bytes([turn, len(tweak)]) + tweak + right.to_bytes(width, "big")).digest(width)
            left, right = right, left ^ (int.from_bytes(noise, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _letters(text: str, key: bytes, tweak: str, fixed_last: bool = False) -> str:
    """Every known character permuted among its class; the pattern of classes, and so the format, stays."""
    places = [_PLACE.get(c) for c in text]
    if fixed_last and places:
        places[-1] = None
    value, size = 0, 1
    for p in places:
        if p:
            radix = len(_CLASSES[p[0]])
            value, size = value * radix + p[1], size * radix
    pattern = "".join("." if not p else chr(48 + p[0]) for p in places) + (text[-1:] if fixed_last else "")
    value, out = _permuted(value, size, key, (tweak + pattern).encode()), list(text)
    for i in range(len(text) - 1, -1, -1):
        if places[i]:
            letters = _CLASSES[places[i][0]]
            value, n = divmod(value, len(letters))
            out[i] = letters[n]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    doubled = (int(d) * 2 if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -sum(d - 9 if d > 9 else d for d in doubled) % 10


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


@functools.lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a value, in the same form; ``attempt`` draws another permutation."""
    tweak, longer = f"{kind}/{attempt}/", "a" * max(0, attempt - LONGER)
    if kind == "email":
        local, _, domain = value.partition("@")
        local += longer
        labels = domain.split(".")
        return _letters(local, key, tweak) + "@" + ".".join([_letters(label, key, tweak + "label") for label in labels[:-1]] + labels[-1:])
    if kind == "ip":
        number = functools.reduce(lambda n, octet: n * 256 + int(octet), value.split("."), 0)
        number = _permuted(number, 1 << 32, key, tweak.encode())
        return ".".join(str(number >> shift & 255) for shift in (24, 16, 8, 0))
    if kind == "card":
        if _luhn(value[:-1]) == int(value[-1]):
            body = _letters(value[:-1], key, tweak + "luhn")
            return body + str(_luhn(body))
        size = 10 ** (len(value) - 1)  # numbers with a wrong check digit, which the permutation keeps wrong
        body, wrong = int(value[:-1]), (int(value[-1]) - _luhn(value[:-1])) % 10 - 1
        number = _permuted(body * 9 + wrong, size * 9, key, f"{tweak}{len(value)}".encode())
        digits = f"{number // 9:0{len(value) - 1}d}"
        return digits + str((_luhn(digits) + number % 9 + 1) % 10)
    if kind == "iban":
        account = _letters(value[4:].lower(), key, tweak + value[:2]).upper()
        return value[:2] + (_iban_check(value[:2], account) if _iban_check(value[:2], value[4:]) == value[2:4] else value[2:4]) + account
    if kind == "phone":
        country, _, national = value.partition(":")
        return country + ":" + _letters(national, key, tweak + country)
    if kind == "ssn":
        return _letters(value, key, tweak)
    return _letters(value[:-1] + longer + value[-1:], key, tweak, fixed_last=kind.startswith("given"))


def _dressed(kind: str, original: str, new: str) -> str:
    """The surrogate, written as the original was: separators, capitals."""
    if kind == "ip":
        return new
    if kind == "phone":
        code, digits = _prefix(original), iter(new.partition(":")[2])
        return original[:code] + "".join(next(digits) if c.isdigit() else c for c in original[code:])
    if kind in ("card", "ssn", "iban"):
        signs = iter(new)
        return "".join(c if c in " -" else next(signs) for c in original)
    if len(new) != len(original):  # lower-casing changed the length, or the surrogate is longer
        return new.upper() if original == original.upper() else new.capitalize() if original[0] != original[0].lower() else new
    return "".join(n.upper() if o != o.lower() else n for o, n in zip(original, new))


def replace(text: str, key: bytes, again: dict[tuple[str, str], int]) -> tuple[str, list[Entity]]:
    """The text with surrogates, and what was found in it. ``again``: attempts of values that were drawn again."""
    found, out, at = entities(text), [], 0
    for e in found:
        out += [text[at : e.start], _dressed(e.kind, text[e.start : e.end], surrogate(e.kind, e.value, key, again.get((e.kind, e.value), 0)))]
        at = e.end
    return "".join([*out, text[at:]]), found


def _assigned(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) for (kind, value, attempt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, v, key, a) for k, v, a in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def drawn_again(documents: DataFrame, key: bytes, text_col: str = "text", max_rounds: int = DRAWS + 1) -> DataFrame:
    """(kind, value, attempt) of the corpus's values whose first surrogate equals them or belongs to another value too."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = {(e.kind, e.value) for text in batch.column(0).to_pylist() if text for e in entities(text)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    distinct = documents.select(text_col).mapInArrow(values, "kind string, value string").distinct()
    table = written(_assigned(distinct.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(max_rounds):
        owners = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count(F.lit(1)).alias("n"))
        lost = (F.col("n") > 1) & (F.col("owner.value") != F.col("value")) | (F.col("surrogate") == F.col("value"))
        judged = table.join(owners.where("n > 1"), ["kind", "surrogate"], "left").select("kind", "value", "attempt", "surrogate", F.coalesce(lost, F.col("surrogate") == F.col("value")).alias("lost"))
        losers = written(judged.where(f"lost AND attempt < {DRAWS}").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "surrogates-again")
        if losers.isEmpty():
            break
        kept = table.join(losers.select("kind", "value"), ["kind", "value"], "left_anti")
        table = written(kept.unionByName(_assigned(losers, key)), "surrogates")
    return table.where("attempt > 0").select("kind", "value", "attempt")


def pseudonymize(documents: DataFrame, key: bytes, keep: tuple[str, ...], text_col: str = "text", sent: int = SENT) -> DataFrame:
    """``keep``, the text with surrogates, and ``entities``: where they stood, their kinds.

    Columns of ``keep`` may hold the text's own name only if it is meant: the replaced text comes under ``text_col``, before ``entities``.
    """
    again = drawn_again(documents, key, text_col)
    rows = documents.select(*keep, F.col(text_col).alias("_old"))
    known: dict[tuple[str, str], int] = {}
    if again.limit(sent + 1).count() <= sent:
        known = {(r.kind, r.value): r.attempt for r in again.collect()}
        rows = rows.withColumn("_again", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        rows = _joined(rows, again)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(text_col, T.StringType()), T.StructField("entities", T._parse_datatype_string("array<struct<start:int,end:int,kind:string>>"))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, found = [], []
            for text, own in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                attempts = known if own is None else {(x["kind"], x["value"]): x["attempt"] for x in own}
                new, spans = (None, []) if text is None else replace(text, key, attempts)
                texts.append(new)
                found.append([{"start": e.start, "end": e.end, "kind": e.kind} for e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(found, kind)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Every row with its own values that were drawn again, by way of a join; rows meet by what their text says."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = sorted({(k, e.kind, e.value) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for e in entities(text)})
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[i] for f in found], pa.string()) for i in (1, 2))], names=["_key", "kind", "value"])

    keyed = rows.withColumn("_key", text_key(F.col("_old")))
    met = keyed.select("_key", "_old").mapInArrow(values, "_key long, kind string, value string").distinct().join(again, ["kind", "value"])
    lists = met.groupBy("_key").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_again"))
    none = F.array().cast("array<struct<kind:string,value:string,attempt:int>>")
    return keyed.join(lists, "_key", "left").withColumn("_again", F.coalesce("_again", none)).drop("_key")
