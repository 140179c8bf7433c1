"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become integers, so sums and deviations are exact. The covariance is never formed: every step multiplies it with a block of a few columns, as one pass over all
rows in which each task adds up its part of ``Yt (Y Q)`` over centred rows ``Y``; parts of many tasks are added again in a few before the driver sees their sums. The driver
holds blocks of ``dimensions x columns`` only.

A round applies a Chebyshev polynomial of the covariance, by its three-term recurrence, that stays below one on the unwanted part of the spectrum and grows fast above it; then QR and
Rayleigh-Ritz. The unwanted part reaches from below the smallest Ritz value to the smallest one of the block, which has more columns than components are asked for.
Rounds end when they are certified: the residuals of all wanted pairs are below ``tolerance`` times the greatest eigenvalue, and random
columns outside the block, filtered in the same way, change none of the wanted values when they join it. If the block is as wide as the space there is nothing to filter.

Rows whose vector is null, empty, or holds null or non-finite entries or entries of 2^40 and more are dropped, as are rows of another length than the most frequent
one (the longest of equally frequent ones). Directions without variance, beyond rounding, have no components, so identical rows give no result. Repeated ids and rows count as
often as they stand there. Deviations beyond 63 bits are an error, not a wrong number.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wardspark.llm.shared import slices, written

#: Integers are ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS, GUARD, DEGREE, TOLERANCE, ROUNDS, PROBES, SEED = 32, 16, 10, 1e-13, 40, 6, 11
#: Rows in a packed block; tasks that add up the parts of all others.
BLOCK, ADDERS = 4096, 16
LARGEST = float(1 << 40)


def integers(vector: list | None) -> np.ndarray | None:
    """``floor(64 c)`` of a vector's entries, or nothing if the vector is dropped; the shift is added where it is asked for."""
    if not vector or None in vector:
        return None
    values = np.array(vector, np.float64)
    if not np.isfinite(values).all() or np.abs(values).max() >= LARGEST:
        return None
    return np.floor(SCALE * values).astype(np.int64)


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(width, rows, ids, values): blocks of rows of one width, their ids as an Arrow stream, the integers side by side."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            found: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, vector in enumerate(batch.column(1).to_pylist()):
                if (values := integers(vector)) is not None:
                    found.setdefault(len(values), []).append((i, values))
            for width, members in found.items():
                ids = pa.table({"id": batch.column(0).take(pa.array([i for i, _ in members]))})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as writer:
                    writer.write_table(ids)
                values = np.stack([v for _, v in members])
                small = np.abs(values).max() < 1 << 15
                body = values.astype(np.int16 if small else np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([len(members)], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([body], pa.binary())], names=["width", "rows", "ids", "values"])

    return written(rows.mapInArrow(run, "width int, rows int, ids binary, values binary"), "blocks")


def _values(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for rows, body in zip(batch.column("rows").to_pylist(), batch.column("values").to_pylist()):
        yield np.frombuffer(body, np.int16 if len(body) == 2 * rows * width else np.int64).reshape(rows, width).astype(np.int64)


def _added(blocks: DataFrame, width: int, columns: int, part: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
    """The sum over all blocks of ``part``, a ``width x columns`` array: added in every task, then in a few, then on the driver."""
    whole = np.object_ if kind is int else kind

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros((width, columns), kind if kind is not int else np.object_), None
        for batch in batches:
            for values in _values(batch, width):
                slot = int(abs(values[0].sum())) % ADDERS if slot is None else slot
                total += part(values)
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([_bytes(total)], pa.binary())], names=["slot", "sum"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, columns), whole), False
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                total, seen = total + _array(raw, (width, columns)), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_bytes(total)], pa.binary())], names=["slot", "sum"])

    schema = "slot int, sum binary"
    parts = blocks.mapInArrow(sums, schema)
    if blocks.rdd.getNumPartitions() > 4 * ADDERS:
        parts = parts.repartition(ADDERS, "slot").mapInArrow(again, schema)
    return sum((_array(bytes(row.sum), (width, columns)) for row in parts.collect()), np.zeros((width, columns), whole))


def _bytes(array: np.ndarray) -> bytes:
    """Doubles as they are; exact integers in decimal, for they may be of any size."""
    return b"i" + b" ".join(b"%d" % int(x) for x in array.ravel()) if array.dtype == object else b"d" + array.tobytes()


def _array(raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    if raw[:1] == b"d":
        return np.frombuffer(raw[1:], np.float64).reshape(shape)
    whole = np.empty(shape[0] * shape[1], object)
    whole[:] = [int(x) for x in raw[1:].split()]
    return whole.reshape(shape)


@dataclass
class Fit:
    """Of the fit list: ``n`` rows with the ``sums`` of their integers (without the shift), the wanted eigenpairs and what is known about them."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float

    def centred(self, integer_rows: np.ndarray) -> np.ndarray:
        return centred(integer_rows, self.n, self.sums)


def centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less their mean: a whole number is taken off first, so nothing is lost to a mean far from zero."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (values - base) - rest


class Covariance:
    """Multiplies the covariance of the fit list with blocks of columns, a pass over the rows each."""

    def __init__(self, blocks: DataFrame, width: int) -> None:
        self.blocks, self.width, self.passes = blocks.where(F.col("width") == width).select("rows", "values"), width, 0
        first = _added(self.blocks, width, 2, lambda v: np.stack([v.sum(axis=0), np.full(width, len(v))], axis=1).astype(object), int)
        self.n, self.sums = int(first[0, 1]), [int(x) for x in first[:, 0]]

    def spread(self) -> np.ndarray:
        """The variance of every dimension."""
        n, sums = self.n, self.sums
        return _added(self.blocks, self.width, 1, lambda v: (centred(v, n, sums) ** 2).sum(axis=0)[:, None])[:, 0] / n

    def times(self, columns: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        self.passes += 1

        def part(values: np.ndarray) -> np.ndarray:
            rows = centred(values, n, sums)
            return rows.T @ (rows @ columns)

        return _added(self.blocks, self.width, columns.shape[1], part) / n


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A scaled Chebyshev polynomial of the covariance times a block: at most one on [low, high], one at ``top``."""
    centre, half = (low + high) / 2, (high - low) / 2
    first = half / (top - centre)
    scale, before = first, block
    now = (times(block) - centre * block) * (scale / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - scale)
        now, before = 2 * (following / half) * (times(now) - centre * now) - scale * following * before, now
        scale = following
    return now


def ritz(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the span of a block: values from the greatest on, vectors, and the residual of each pair."""
    basis = np.linalg.qr(np.linalg.qr(block)[0])[0]
    product = times(basis)
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def fit(blocks: DataFrame, width: int, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = SEED) -> Fit:
    """The first eigenpairs of the covariance, certified."""
    covariance = Covariance(blocks, width)
    trace = float(covariance.spread().sum())
    draw, wanted = np.random.default_rng(seed), min(components, width)
    size = min(width, wanted + guard)
    values, vectors, residuals = ritz(covariance.times, draw.standard_normal((width, size)))
    low = max(0.0, values[-1] - residuals[-1])
    for _ in range(rounds):
        top = max(values[0], 1e-300)
        if size == width or residuals[:wanted].max() <= tolerance * top:
            if size + PROBES > width or _probed(covariance.times, values, vectors, wanted, degree, low, draw, tolerance):
                break
        high = values[-1]
        if high - low <= 1e-12 * top:  # the rest of the spectrum is one value, or zero
            low = min(0.0, high) - 1e-9 * top
        values, vectors, residuals = ritz(covariance.times, filtered(covariance.times, vectors, degree, low, high, top))
        low = max(0.0, min(low, values[-1] - residuals[-1]))
    else:
        raise RuntimeError(f"the components are not certified after {rounds} rounds: residual {residuals[:wanted].max():.3g}")
    rank = int((values[:wanted] > max(values[0], 0) * width * np.finfo(float).eps * 16).sum()) if trace > 0 else 0
    worst = float(residuals[:rank].max() / values[0]) if rank else 0.0
    return Fit(covariance.n, covariance.sums, values[:rank], vectors[:, :rank], trace, covariance.passes, worst)


def _probed(times: Callable[[np.ndarray], np.ndarray], values: np.ndarray, vectors: np.ndarray, wanted: int, degree: int, low: float, draw: np.random.Generator, tolerance: float) -> bool:
    """Whether random columns outside the block, filtered, bring no new direction among the wanted ones."""
    probes = draw.standard_normal((len(vectors), PROBES))
    outside = lambda block: block - vectors @ (vectors.T @ block)
    top, high = max(values[0], 1e-300), values[-1]
    low = low if high - low > 1e-12 * top else min(0.0, high) - 1e-9 * top
    probes = outside(filtered(times, outside(probes), degree, low, high, top))
    if not np.linalg.norm(probes):
        return True
    found = ritz(times, outside(probes / np.linalg.norm(probes, axis=0).clip(1e-300)))[0]
    return bool(found[0] <= values[wanted - 1] + max(tolerance, 1e-12) * top)


def whiten(blocks: DataFrame, width: int, model: Fit, id_field: T.StructField) -> DataFrame:
    """(id, deviation, whitened): the exact deviation of every row, and its coordinates, one for each component."""
    n, sums, scaled = model.n, model.sums, model.vectors / np.sqrt(model.values)
    schema = T.StructType([id_field, *T.StructType.fromDDL("deviation long, whitened array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, values in zip(batch.column("ids").to_pylist(), _values(batch, width)):
                ids = pa.ipc.open_stream(raw).read_all().combine_chunks().column(0).combine_chunks()
                rows = centred(values, n, sums) @ scaled
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(values, n, sums), pa.int64()), whitened], names=schema.fieldNames())

    return blocks.where(F.col("width") == width).select("rows", "ids", "values").mapInArrow(run, schema)


def deviations(values: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over the dimensions of ``(n x - S) ** 2``, in whole numbers; beyond 63 bits an error."""
    base = [s // n for s in sums]
    near = values - np.array(base, np.int64)
    rest = [s - n * b for s, b in zip(sums, base)]
    reach = n * (int(np.abs(near).max(initial=0)) + 1)
    if reach * reach * max(1, len(sums)) < 1 << 62:
        return ((n * near - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, rest)) for row in near.tolist()]
    if max(exact, default=0) >= 1 << 63:
        raise OverflowError("a deviation does not fit 63 bits")
    return exact


def identity_error(blocks: DataFrame, width: int, model: Fit) -> float:
    """The largest entry of the covariance of the whitened rows less the identity, from a pass of its own."""
    n, sums, count = model.n, model.sums, len(model.values)
    if not count:
        return 0.0
    scaled = model.vectors / np.sqrt(model.values)

    def part(values: np.ndarray) -> np.ndarray:
        rows = centred(values, n, sums) @ scaled
        whole = np.zeros((width, count))
        whole[:count] = rows.T @ rows
        return whole

    found = _added(blocks.where(F.col("width") == width).select("rows", "values"), width, count, part)[:count] / n
    return float(np.abs(found - np.eye(count)).max())


def common_width(blocks: DataFrame) -> int:
    """The most frequent length of a vector; 0 if there are none."""
    found = blocks.groupBy("width").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return found.width if found else 0


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, **settings) -> DataFrame:
    """Per remaining row its id, ``n``, ``deviation``, ``whitened`` (an array, one entry per component), ``explained`` (likewise) and ``identity_error``."""
    blocks = packed(vectors, id_col, vector_col)
    width = common_width(blocks)
    id_field = T.StructField(id_col, vectors.schema[id_col].dataType)
    if not width:
        schema = T.StructType([id_field, *T.StructType.fromDDL("n long, deviation long, whitened array<double>, explained array<double>, identity_error double").fields])
        return vectors.sparkSession.createDataFrame([], schema)
    model = fit(blocks, width, components, **settings)
    explained = [float(v / model.trace) for v in model.values]
    rows = whiten(blocks, width, model, id_field)
    constant = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    return rows.select(id_col, F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", constant.alias("explained"), F.lit(identity_error(blocks, width, model)).alias("identity_error"))


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each row and component, numbered from 1 by falling eigenvalue."""
    spread = whitened.select(id_col, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return spread.select(id_col, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
