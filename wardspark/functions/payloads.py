"""Hidden base64 and hex payloads, and prompt clean-up."""

from pyspark.sql import Column, functions as F

from wardspark.catalog import prompt_signatures as sig
from wardspark.functions.regex import any_contains, find_all, java_pattern
from wardspark.functions.text import decode_text

_SHOWN = 60
# A run can only start where no run character precedes; saying so spares a rescan from every character of a word.
_BASE64_JAVA = r"(?<![A-Za-z0-9+/])" + sig.BASE64_CANDIDATE
# The candidate pattern with quantifiers that never back off: nothing follows them, and Java then needs no recursion.
_HEX_JAVA = sig.HEX_CANDIDATE.replace(r"\s*", r"\s*+").replace("{12,}", "{12,}+")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def base64_payload(text: Column) -> Column:
    """The first base64 run that decodes to text with a suspicious word, decoded; null if none."""
    runs = F.filter(find_all(text, _BASE64_JAVA), lambda c: F.length(c) % 4 == 0)
    decoded = F.transform(runs, lambda c: decode_text(F.try_to_binary(c, F.lit("base64"))))
    return _first(F.filter(decoded, lambda d: (F.length(d) > sig.BASE64_MIN_LENGTH) & any_contains(F.lower(d), sig.BASE64_KEYWORDS)))


def hex_payload(text: Column) -> Column:
    """The first run of hex pairs that decodes to text with a suspicious word, decoded; null if none."""
    runs = find_all(text, java_pattern(_HEX_JAVA))
    decoded = F.transform(runs, lambda c: decode_text(F.try_to_binary(F.regexp_replace(c, r"(?U)\s+", ""), F.lit("hex"))))
    return _first(F.filter(decoded, lambda d: (F.length(d) > sig.HEX_MIN_LENGTH) & any_contains(F.lower(d), sig.HEX_KEYWORDS)))


def obfuscation_evidence(text: Column) -> Column:
    """A note on the first hidden payload, base64 before hex; null if there is none."""
    note = lambda kind, payload: F.concat(F.lit(f"{kind} Obfuscated Payload: '"), F.substring(payload, 1, _SHOWN), F.lit("...'"))
    return F.coalesce(note("Base64", base64_payload(text)), note("Hex", hex_payload(text)))


def sanitize_prompt(text: Column) -> Column:
    """The prompt with plain override phrases replaced."""
    return F.regexp_replace(text, java_pattern(sig.SANITIZE_PATTERN, ignore_case=True), sig.SANITIZE_TOKEN)
