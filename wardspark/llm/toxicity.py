"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the whole lower-case text, present or absent: three to five characters anywhere, six to nine
from the beginning of a word. Each one's naive Bayes ratio is
the log of its smoothed share among toxic texts over its share among others; the features whose ratio stands out most
enter a logistic regression, with the ratios as their values.

The classifier is fitted on a bounded sample: the ``max_labelled`` labelled rows with the smallest hash of their id. Their texts are
stored once; counting and feature extraction run on them as Spark jobs, and the driver gets at most ``max_features`` ratios and
the sample's few selected features. Scoring is one narrow pass over all whole texts; nothing is shuffled.

Only the text enters a score. Null texts count as empty and get the score of a text without features; without labelled
rows of both classes every score is 0.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wardspark.llm.shared import slices, text_key, written

SIZES = (3, 4, 5)
#: Lengths counted only from the beginning of a word, its blank included.
LONG_SIZES = (6, 7, 8, 9)
BITS = 20
#: Characters hashed at a time; pieces overlap, so no n-gram is lost.
PIECE = 1 << 20


def _bucket(rolled: np.ndarray, size: int) -> np.ndarray:
    return (((rolled ^ np.uint64(size)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int32)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, piece by piece."""
    clean = " " + " ".join((text or "").lower().split()) + " "
    for start in range(0, max(1, len(clean) - SIZES[0]), PIECE):
        codes = np.frombuffer(clean[start : start + PIECE + LONG_SIZES[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        rolled = codes
        for size in range(2, min(SIZES[-1], len(codes)) + 1):
            rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :]
            if size in SIZES:
                yield _bucket(rolled, size)
        if len(codes) >= SIZES[-1]:
            places = np.flatnonzero(codes[: len(rolled)] == 32)
            rolled = rolled[places]
            for size in LONG_SIZES:
                inside = places + size <= len(codes)
                places, rolled = places[inside], rolled[inside]
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[places + size - 1]
                yield _bucket(rolled, size)


def features(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The different hashed n-grams of a text, all of them or those marked in ``wanted``."""
    found = [g if wanted is None else g[wanted[g]] for g in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.array([], np.int32)


@dataclass(frozen=True)
class Classifier:
    """Weights per hashed n-gram, and the weight of an empty text."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        weights, wanted = np.zeros(1 << BITS, np.float64), np.zeros(1 << BITS, bool)
        weights[self.index], wanted[self.index] = self.weight, True
        return weights, wanted


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the checksum of the id as text is divisible by five. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc, text, toxic): at most ``max_labelled`` rows that may be learnt from, one for each labelled id; conflicting labels count as toxic. Of
    several texts of one id, the one with the smallest key stands for all, so no id weighs more than another."""
    known = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("toxic")).where(f"doc IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc"))).groupBy("doc").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc"), "doc").limit(max_labelled)
    texts = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc")  # at most max_labelled rows of two numbers
    return met.groupBy("doc", "toxic").agg(F.min_by("text", F.struct(text_key(F.col("text")), "text")).alias("text")).select("doc", "text", "toxic")


def _counts(sample: DataFrame) -> DataFrame:
    schema = "gram int, toxic long, clean long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic][features(text)] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[1][used]), pa.array(counts[0][used])], names=["gram", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(run, schema).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _selected(sample: DataFrame, index: np.ndarray) -> DataFrame:
    wanted = np.zeros(1 << BITS, bool)
    wanted[index] = True
    packed = np.packbits(wanted).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in slices(batches):
            found = [features(t, marks).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc", "toxic", "grams"])

    return sample.mapInArrow(run, T.StructType([sample.schema["doc"], T.StructField("toxic", T.IntegerType()), T.StructField("grams", T.ArrayType(T.IntegerType()))]))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_features: int = 4096, smoothing: float = 1.0, penalty: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """A classifier from at most ``max_labelled`` labelled rows and ``max_features`` n-grams."""
    nothing = Classifier(np.array([], np.int32), np.array([]), -np.inf)
    sample = written(labelled_sample(documents, labels, max_labelled, id_col, text_col, label_col).select("doc", "text", "toxic"), "toxicity-sample")
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return nothing
    pos, neg = F.lit(float(totals[1])), F.lit(float(totals[0]))
    p, q = (F.col("toxic") + smoothing) / (pos + 2 * smoothing), (F.col("clean") + smoothing) / (neg + 2 * smoothing)
    z = (p - q) / F.sqrt(p * (1 - p) / pos + q * (1 - q) / neg)  # how far apart the shares are, in standard errors
    rated = _counts(sample).select("gram", F.log(p / q).alias("ratio"), F.abs(z).alias("z"))
    best = rated.where("z > 3").orderBy(F.desc("z"), "gram").limit(max_features).collect()
    if not best:
        return nothing
    best = sorted(best, key=lambda r: r.gram)
    index, ratio = np.array([r.gram for r in best], np.int32), np.array([r.ratio for r in best])
    rows = sorted(_selected(sample, index).collect(), key=lambda r: (r.doc, r.toxic, r.grams))
    target = np.array([r.toxic for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r.grams) for r in rows])
    column = np.searchsorted(index, np.array([g for r in rows for g in r.grams], np.int32))
    weight, bias = _logistic(row, column, ratio[column], target, len(index), penalty)
    return Classifier(index, weight * ratio, bias)


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty, by accelerated gradient steps over a sparse matrix.

    Each weight has a step of its own, from a bound of the curvature: the column's absolute values times the sums of their rows.
    """
    n = len(target)
    reach = np.bincount(row, np.abs(value), n) + 1.0
    rate = 1.0 / (0.25 / n * np.bincount(column, np.abs(value) * reach[row], width) + penalty / n)
    bias_rate = 4.0 * n / reach.sum()
    weight, bias, ahead, ahead_bias, momentum = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(steps):
        score = np.bincount(row, value * ahead[column], n) + ahead_bias
        error = (1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))) - target) / n
        step = ahead - rate * (np.bincount(column, value * error[row], width) + penalty / n * ahead)
        step_bias = ahead_bias - bias_rate * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, ahead_bias = step + (momentum - 1) / following * (step - weight), step_bias + (momentum - 1) / following * (step_bias - bias)
        weight, bias, momentum = step, step_bias, following
    return weight, float(bias)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Per document: id, ``held_out`` (never learnt from), ``score`` from 0 to 1 and ``predicted``, 1 from a score of 0.5."""
    model = fit(documents, labels, id_col=id_col, text_col=text_col, **parameters)
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_words"))
    return score(rows, model, ("_id",), "_words").select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(documents: DataFrame, model: Classifier, keep: tuple[str, ...], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``keep`` and the score, the probability of the toxic label, for every row."""
    rows = documents.select(F.col(text_col).alias("_text"), *keep)
    schema = T.StructType([T.StructField(score_col, T.DoubleType()), *[rows.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, wanted = model.table()
        for batch in slices(batches):
            sums = np.array([weights[features(t, wanted)].sum() for t in batch.column(0).to_pylist()]) + model.bias
            scores = 1.0 / (1.0 + np.exp(-np.clip(sums, -700, 700)))
            if not len(model.index):
                scores[:] = 0.0
            yield pa.RecordBatch.from_arrays([pa.array(scores), *batch.columns[1:]], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
