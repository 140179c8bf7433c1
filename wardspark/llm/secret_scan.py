"""Secrets in texts, told apart by who else has them.

Scan: three base kinds by their patterns, each from left to right without overlap, and more kinds for well-known formats. Every
candidate's value is hashed. Ownership: over the whole corpus, each hash gets the number of different repositories and
owners it occurs in. A value that many owners hold is a copied example, and one that few owners hold in many repositories is repeated text rather
than a secret of one place; one that a single owner holds in few, and that does not look like a placeholder, may be live.

The span of a private key is its first line; its value is the body behind it, so that two keys of one type are two values. The value of a bearer is its token.

Texts are read once and never shuffled; what is shuffled is one short row per candidate. A hash that a third of all rows
holds is reduced in two steps, first per owner and repository, before its counts meet.

Null and empty texts have no spans. Null repositories and owners count as one of their own. Rows with equal ids stay apart.
"""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardspark.llm.shared import slices, written

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of one class: the long ones are the same as among all runs

#: Formats that the method adds: kind, what a text must contain, pattern.
FORMATS = [
    ("private_key", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?=((?:\s*[A-Za-z-]+: [^\r\n]*)*[A-Za-z0-9+/=\s]*))")),
    ("github", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
    ("gitlab", "glpat-", re.compile(r"\bglpat-[A-Za-z0-9_-]{20,}")),
    ("slack", "xox", re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("google", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
    ("stripe", "_live_", re.compile(r"\b[rs]k_live_[A-Za-z0-9]{16,}")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("url_password", "://", re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"']+:[^\s:/@\"']{3,}@")),
    ("bearer", "earer ", re.compile(r"\b[Bb]earer ([A-Za-z0-9+/_.~-]{20,}=*)")),
]
#: Characters of a key's body, at least; a first line with less behind it stands for itself.
SHORTEST = 16
KINDS = BASE_KINDS + tuple(kind for kind, _, _ in FORMATS)
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test|todo|redacted|1234567|abcdef0?1?2")


def spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of all candidates, by start, then by kind."""
    found, low = [], text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    for number, (_, needed, pattern) in enumerate(FORMATS, len(BASE_KINDS)):
        if needed in text:
            found += [(m.start(), number, m.end(), _value(m)) for m in pattern.finditer(text)]
    return sorted(found)


def _value(match: re.Match) -> str:
    """What is secret in a match: the body that follows a key's first line, without its line breaks, or a bearer's token; else all of it."""
    inner = "".join(match[1].split()) if match.re.groups else ""
    return inner if len(inner) >= SHORTEST else match[0]


def _random_looking(value: str) -> bool:
    """Enough different characters for its length, and no word that examples are made of; in long values such words come about by chance."""
    if len(value) <= 200 and _PLACEHOLDER.search(value):
        return False
    counts, n = Counter(value), len(value)
    return -sum(c / n * math.log2(c / n) for c in counts.values()) >= min(3.0, 0.6 * math.log2(n))


SPAN = "struct<start:int,end:int,kind:string,sha256:string,random:boolean>"


def secret_spans(documents: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``spans`` per row, in code points, with the hash of each value."""
    rows = documents.select(F.col(text_col).alias("_text"), *keep)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("spans", T.ArrayType(T._parse_datatype_string(SPAN)))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("sha256", pa.string()), ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                [{"start": s, "end": e, "kind": KINDS[k], "sha256": hashlib.sha256(value.encode()).hexdigest(), "random": _random_looking(value)} for s, k, e, value in spans(text or "")]
                for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(sha256, repositories, owners) out of (sha256, repository, owner): counted over the whole corpus."""
    per_repository = candidates.groupBy("sha256", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repository.groupBy("sha256", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("sha256").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def secret_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 3, repeated_repositories: int = 10) -> DataFrame:
    """Per row: id, ``spans`` with ``repositories`` and ``owners`` of their value and a ``verdict`` each.

    Verdicts: ``copied`` (at least ``copied_owners`` owners have the value), ``placeholder`` (it looks like no secret),
    ``repeated`` (fewer owners, but at least ``repeated_repositories`` repositories), ``shared`` (two owners up to ``copied_owners``), ``live`` (one owner only).
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("_text"))
    found = secret_spans(rows, "_text", ("_id", "repository", "owner"))
    scanned = written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "secret-spans")
    candidates = scanned.select("row", "repository", "owner", F.posexplode("spans").alias("place", "span"))
    counts = ownership(candidates.select(F.col("span.sha256").alias("sha256"), "repository", "owner"))
    verdict = (
        F.when(F.col("owners") >= copied_owners, "copied").when(~F.col("span.random"), "placeholder")
        .when(F.col("repositories") >= repeated_repositories, "repeated").when(F.col("owners") > 1, "shared").otherwise("live"))
    judged = candidates.select("row", "place", "span", F.col("span.sha256").alias("sha256")).join(counts, "sha256")
    full = F.struct("place", F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.col("span.kind").alias("kind"), "sha256", "repositories", "owners", verdict.alias("verdict"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(full)).alias("judged"))
    none = F.array().cast("array<struct<place:int,start:int,end:int,kind:string,sha256:string,repositories:bigint,owners:bigint,verdict:string>>")
    return scanned.select("row", "_id").join(per_row, "row", "left").select(F.col("_id").alias(id_col), F.coalesce("judged", none).alias("spans"))


def secret_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One line per row of :func:`secret_scan`. ``held_by`` has repositories:owners of every span, in the order of ``spans``."""

    def line(rows):
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    base = F.filter("spans", lambda x: x.kind.isin(*BASE_KINDS))
    return found.select(
        id_col, *[_count("kind", kind) for kind in BASE_KINDS],
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
        *[_count("verdict", v) for v in ("live", "shared", "copied", "placeholder", "repeated")],
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.repositories.cast("string"), x.owners.cast("string"))), ",").alias("held_by"))


def _count(field: str, value: str) -> Column:
    return F.size(F.filter("spans", lambda x: x[field] == value)).cast("long").alias(f"n_{value}")
