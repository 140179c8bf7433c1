"""From raw documents to token ids: the stages of a training-data pipeline, each written as Parquet and read again."""

import os
import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardspark.llm import toxicity as tox
from wardspark.llm.byte_bpe import encode
from wardspark.llm.shared import read, text_key, written
from wardspark.llm.simhash import simhash_dedup
from wardspark.llm.surrogates import pseudonymize
from wardspark.llm.winnowing import decontaminate

#: The key of the surrogates. Whoever has it can work out which surrogate belongs to a known value. Without a setting, every session draws a key that nobody
#: learns: surrogates agree within its runs and with no others.
KEY = os.environ.get("SURROGATE_KEY", "").encode() or secrets.token_bytes(32)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic, learnt from the labels of those at hand."""
    model = tox.fit(docs, read(spark, sf_dir, "labels"))
    return tox.score(docs, model, tuple(COLUMNS), score_col="_score").where("_score < 0.5").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id. Rows equal in id and text count once."""
    kept = simhash_dedup(docs).where("keep").select("doc_id", "text_key").distinct()
    return _matching(docs, kept, "left_semi").dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_key").distinct()
    return _matching(docs, found, "left_anti").select(*COLUMNS)


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents with or without a partner of the same id and text; null ids are partners too."""
    rows = rows.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"))
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    return keyed.join(rows, (F.col("_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), how)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates under the key of this run."""
    kept = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    return pseudonymize(docs, KEY, kept).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("simhash", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("surrogates", replace_personal_data),
    ("byte_bpe", tokenize),
]

#: Training, fingerprints, keyed surrogates and tokenizers have no form in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
