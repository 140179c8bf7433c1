"""Near-duplicate documents by SimHash and multi-index hashing.

Fingerprints: words are runs between white space, A-Z lowered; every shingle of three words is hashed with XXH64 (seed 42); a bit is
set if more than half of the hashes have it. Texts with fewer words are one shingle; null, empty and blank texts get zero.

Search: a fingerprint is two segments of 32 bits. Fingerprints that differ in at most ``r`` bits differ in at most ``r // 2`` bits of the
first segment or in fewer than the rest of the second, so the table, keyed by segment value, is asked for every value in
a small Hamming ball around each segment. Candidates are verified over all 64 bits inside the join. A segment value that very
many fingerprints share would make that quadratic; its fingerprints enumerate their whole ball and look the members up
by equality, which is linear and finds the same links.

Only different fingerprints enter the search, so exact copies cost nothing. Texts are read once and never shuffled.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardspark.llm.components import components
from wardspark.llm.shared import slices, text_key, written

SEGMENT = 32
#: Fingerprints with one segment value, from which on they are looked up by whole balls.
CROWD = 20_000
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])), np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text_key, fp): the fingerprint as a signed long, one row per document."""
    rows = documents.select(id_col, text_key(F.col(text_col)).alias("text_key"), text_col)
    schema = T.StructType([rows.schema[id_col], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _masks(bits: int, radius: int) -> list[int]:
    """All bit patterns of at most ``radius`` set bits, as signed longs."""
    patterns = [sum(1 << i for i in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]
    return [p - (1 << 64) if p >= 1 << 63 else p for p in patterns]


def _segments(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, SEGMENT), fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))]


def _key(segment: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(segment << 40))


def _ball(segment: int, half: Column, radius: int) -> Column:
    return F.transform(F.lit(_masks(SEGMENT, radius)).cast("array<bigint>"), lambda mask: _key(segment, half.bitwiseXOR(mask)))


def near_pairs(distinct: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: pairs of the different fingerprints ``fp`` that differ in 1 to ``distance`` bits, each at least once."""
    radii = [distance // 2, distance - distance // 2 - 1]
    fp, halves = F.col("fp"), _segments(F.col("fp"))
    table = distinct.select("fp", F.explode(F.array(*[_key(i, half) for i, half in enumerate(halves)])).alias("key"))
    crowds = written(table.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowds")
    asked = F.concat(*[_ball(i, half, radius) for i, (radius, half) in enumerate(zip(radii, halves)) if radius >= 0])
    probes = distinct.select(fp.alias("a"), F.explode(asked).alias("key"))
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    sparse = table.join(crowds, "key", "left_anti").select("key", fp.alias("b"))
    found = probes.join(crowds, "key", "left_anti").join(sparse, "key").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowded = probes.join(crowds, "key", "left_semi").select("a").distinct()
    ball = crowded.select("a", F.explode(F.transform(F.lit(_masks(64, distance)[1:]).cast("array<bigint>"), lambda m: F.col("a").bitwiseXOR(m))).alias("b"))
    whole = ball.join(distinct.select(fp.alias("b")), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(whole)


def simhash_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Per document: id, ``text_key``, ``fingerprint`` (hex), ``component_id`` (the smallest id reachable by links) and ``keep``.

    ``keep`` marks one row of every component: that of the smallest id; among rows with equal ids, that of the smallest text key.
    Rows equal in id and text are marked alike. Null ids are never the smallest; a component of null ids only has a
    null ``component_id``.
    """
    marked = written(fingerprints(documents, id_col, text_col, width).withColumnRenamed(id_col, "_id"), "fingerprints")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("text_key").alias("text_key"))).alias("first")
    distinct = written(marked.groupBy("fp").agg(first), "distinct-fingerprints")
    linked = components(near_pairs(distinct.select("fp"), distance, crowd))
    members = distinct.join(linked.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "first")
    heads = members.groupBy("component").agg(F.min("first").alias("head"))
    heads = members.join(heads, "component").select("fp", "head")
    # written, so that both sides of the last join come straight from an exchange and a crowded fingerprint can be split at run time
    every = written(distinct.join(heads, "fp", "left").select("fp", F.coalesce("head", "first").alias("head")), "fingerprint-heads")
    rows = marked.join(every, "fp")
    return rows.select(
        F.col("_id").alias(id_col), "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("head.id").alias("component_id"),
        (F.col("head.id").eqNullSafe(F.col("_id")) & (F.col("head.text_key") == F.col("text_key"))).alias("keep"),
    )
