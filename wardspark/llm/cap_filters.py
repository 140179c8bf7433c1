"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector's dimensions are cut into blocks; each block has a few random directions, and every combination of one direction per
block is a filter direction. A vector is in the caps of all filters whose inner product with it is within ``margin`` of its best one;
list decoding finds them from the block products alone, without looking at all combinations. Vectors of the same label that share a cap
are compared; the cosine is worked out in double precision, and a pair counts once, in the first cap that both share.

Equal vectors are one until the end, so copies cost nothing. A crowded cap is cut into blocks, every pair of blocks is a
group of its own, and a group only gives back counts per vector and a spanning forest of its links: nothing grows with the square of a
group but arithmetic. Components come from rounds of joins.

Vectors that are null, empty or zero, or that hold null or non-finite components, and those without a label, link with nothing. Vectors of
different lengths are not compared. Rows with equal or null ids stay apart; null ids are never a component's smallest.
"""

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardspark.llm.components import components
from wardspark.llm.shared import slices, written

BLOCKS, DIRECTIONS, MARGIN, SEED = 4, 32, 0.04, 7
#: Vectors of a cap that one group compares.
GROUP = 2048


def codebook(width: int, blocks: int = BLOCKS, directions: int = DIRECTIONS, seed: int = SEED) -> list[np.ndarray]:
    """Per block its random directions, drawn from the seed; a filter direction has length one."""
    draw, sizes = np.random.default_rng(seed), [len(part) for part in np.array_split(np.arange(width), min(blocks, width))]
    books = [draw.standard_normal((directions, size)) for size in sizes]
    return [b / np.linalg.norm(b, axis=1, keepdims=True) / np.sqrt(len(books)) for b in books]


def decode(unit: np.ndarray, books: list[np.ndarray], margin: float = MARGIN) -> list[int]:
    """The numbers of all filters whose product with the vector is within ``margin`` of the greatest, in order.

    Block by block, partial combinations are kept while the best completion could still be within the margin: since each block adds
    at most its own best, a partial sum must be within the margin of the best partial sum.
    """
    sums, numbers, at = np.zeros(1), np.zeros(1, np.int64), 0
    for book in books:
        products = book @ unit[at : at + book.shape[1]]
        at += book.shape[1]
        sums, numbers = (sums[:, None] + products).ravel(), (numbers[:, None] * len(book) + np.arange(len(book))).ravel()
        near = sums >= sums.max() - margin
        sums, numbers = sums[near], numbers[near]
    return np.sort(numbers).tolist()


def _vectors(rows: DataFrame) -> DataFrame:
    """(id, group, digest, vector): the vector as bytes, of floats where they are exact, else of doubles; nulls where it cannot link."""
    schema = T.StructType([rows.schema["_id"], T.StructField("group", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("vector", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            groups, digests, vectors = [], [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                vector = np.array(values, np.float64) if label is not None and values and None not in values else None
                with np.errstate(over="ignore"):
                    fine = vector is not None and np.isfinite(vector).all() and vector.any()
                raw = _packed(vector) if fine else None
                groups.append(f"{label}/{len(values)}" if fine else None)
                digests.append(hashlib.blake2b(raw, digest_size=16).hexdigest() if fine else None)
                vectors.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string()), pa.array(digests, pa.string()), pa.array(vectors, pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _packed(vector: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        short = vector.astype(np.float32)
    exact = (short == vector).all()
    return (b"f" if exact else b"d") + ((short if exact else vector) + 0.0).tobytes()  # no negative zeros


def _unit(raw: bytes) -> np.ndarray:
    vector = np.frombuffer(raw[1:], np.float32 if raw[:1] == b"f" else np.float64).astype(np.float64)
    vector = vector / np.abs(vector).max()  # neither overflows nor vanishes when squared
    return vector / np.linalg.norm(vector)


def _caps(distinct: DataFrame, blocks: int, directions: int, margin: float, seed: int) -> DataFrame:
    """(node, group, cap): a row for every cap that a vector is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list[np.ndarray]] = {}
        for batch in slices(batches, 1024):
            nodes, groups, caps = [], [], []
            for node, group, raw in zip(*(column.to_pylist() for column in batch.columns)):
                unit = _unit(raw)
                found = decode(unit, books.setdefault(len(unit), codebook(len(unit), blocks, directions, seed)), margin)
                nodes += [node] * len(found)
                groups += [group] * len(found)
                caps += found
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(groups, pa.string()), pa.array(caps, pa.int64())], names=["node", "group", "cap"])

    return distinct.select("node", "group", "vector").mapInArrow(run, "node long, group string, cap long")


def _shares_earlier(caps: list[list[int]], cap: int) -> np.ndarray:
    """Which pairs of vectors also share a cap before this one."""
    earlier = sorted({c for own in caps for c in own if c < cap})
    place = {c: i for i, c in enumerate(earlier)}
    marks = np.zeros((len(caps), len(earlier)), np.float32)
    for i, own in enumerate(caps):
        marks[i, [place[c] for c in own if c < cap]] = 1.0
    return marks @ marks.T > 0.5


def _spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A few links with the same components: from every vector to the least one it can reach."""
    least = np.arange(len(linked))
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(axis=1, initial=len(linked)))
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    return ((i, int(low)) for i, low in enumerate(least) if low != i)


def _compared(rows: list[dict], threshold: float) -> tuple[list[int], list[int | None], list[int]]:
    """Of one group: (a, null, n) with the number of rows that ``a`` is linked with here first, and (a, b, 0) of a spanning forest."""
    units = np.stack([_unit(row["vector"]) for row in rows])
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    if rows[0]["low"] != rows[0]["high"]:  # two blocks: pairs inside a block belong to other groups
        block = np.array([row["block"] for row in rows])
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return [], [], []
    forest = list(_spanning(linked))
    counts = (linked & ~_shares_earlier([row["caps"] for row in rows], rows[0]["cap"])) @ np.array([row["copies"] for row in rows])
    some = np.flatnonzero(counts).tolist()
    nodes = [row["node"] for row in rows]
    return [nodes[i] for i in some] + [nodes[i] for i, _ in forest], [None] * len(some) + [nodes[j] for _, j in forest], [int(counts[i]) for i in some] + [0] * len(forest)


def _links(spread: DataFrame, threshold: float) -> DataFrame:
    """What all groups give, group after group of each partition's sorted rows; a group is one cap, or two blocks of it."""

    def key(row: dict) -> tuple:
        return row["group"], row["cap"], row["low"], row["high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches, 1024) for row in batch.to_pylist())
        a, b, n = [], [], []
        for _, group in itertools.groupby(rows, key):
            members = list(group)
            if len(members) > 1:
                for whole, part in zip((a, b, n), _compared(members, threshold)):
                    whole += part
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])
                a, b, n = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    keys = ["group", "cap", "low", "high"]
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def vector_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, group: int = GROUP,
    blocks: int = BLOCKS, directions: int = DIRECTIONS, margin: float = MARGIN, seed: int = SEED,
) -> DataFrame:
    """Per row: id, ``n_links`` (other rows it is linked with), ``component_id`` (the smallest id reachable) and ``kept``."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("values"))
    marked = written(_vectors(rows), "vectors")
    classes = marked.where("digest IS NOT NULL").groupBy("group", "digest").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("vector").alias("vector"))
    distinct = written(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "distinct-vectors")
    caps = written(_caps(distinct, blocks, directions, margin, seed), "caps")
    shared = caps.groupBy("group", "cap").count().where("count > 1").select("group", "cap", F.ceil(F.col("count") / group).cast("int").alias("cuts"))
    own = caps.join(shared, ["group", "cap"]).groupBy("node").agg(F.collect_list(F.struct("cap", "cuts")).alias("shared"))
    rows = distinct.select("node", "group", "copies", "vector").join(own, "node")
    rows = rows.select("*", F.transform("shared", lambda x: x.cap).alias("caps"), F.explode("shared").alias("s")).select("node", "group", "copies", "vector", "caps", "s.cap", "s.cuts")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    spread = rows.select("node", "group", "copies", "vector", "caps", "cap", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = written(_links(spread, threshold), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b IS NOT NULL"))
    nodes = distinct.select("node", "group", "digest", "first", "copies").join(counts, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = nodes.groupBy("component").agg(F.min("first").alias("head"))
    nodes = nodes.join(heads, "component").select("group", "digest", "head", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    judged = marked.drop("vector").join(nodes, ["group", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("head"))
    return judged.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("_id") == component).alias("kept"))
