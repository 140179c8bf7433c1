"""The registered corpus queries: each applies its operator to a whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardspark.llm.byte_bpe import encode
from wardspark.llm.cap_filters import vector_dedup
from wardspark.llm.collocations import collocations
from wardspark.llm.license_scan import license_report, license_scan
from wardspark.llm.oracles import ORACLES
from wardspark.llm.perspectives import rotate, rotation_report
from wardspark.llm.secret_scan import secret_report, secret_scan
from wardspark.llm.shared import read
from wardspark.llm.simhash import simhash_dedup
from wardspark.llm.surrogates import pseudonymize
from wardspark.llm.tag_paths import extract
from wardspark.llm.token_files import read_tokens, write_tokens
from wardspark.llm.toxicity import toxicity
from wardspark.llm.whitening import by_component, whitened_vectors
from wardspark.llm.winnowing import contamination_report, decontaminate
from wardspark.plans.storage import new_location

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}
#: Of the registered queries only; a real run brings its own key.
KEY = b"a key for tests"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return license_report(license_scan(read(spark, sf_dir, "documents")))


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document: shingles of three words, at most two bits apart."""
    return simhash_dedup(read(spark, sf_dir, "documents"), width=3, distance=2).select("doc_id", "fingerprint", "component_id", "keep")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from at most 20,000 labelled ones."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), max_labelled=20_000)


@query
def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with what the corpus says about their owners."""
    return secret_report(secret_scan(read(spark, sf_dir, "documents")))


@query
def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every vector."""
    return vector_dedup(read(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op6_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))


@query
def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's view."""
    return rotation_report(rotate(read(spark, sf_dir, "conversations")))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to, as digests."""
    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: what was found, and the new text with its digest."""
    rows = pseudonymize(read(spark, sf_dir, "documents"), KEY, ("doc_id",))
    counts = [F.size(F.filter("entities", lambda e: e.kind.startswith(kind))).cast("long").alias(f"n_{kind}") for kind in ("email", "iban", "ip", "card", "ssn", "phone", "given", "family")]
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e.kind, e.start.cast("string"), e.end.cast("string"))), ",")
    return rows.select("doc_id", *counts, spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")


@query
def op10_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows shared with the benchmark."""
    return contamination_report(decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two and three words of each language."""
    return collocations(read(spark, sf_dir, "documents"), max_words=3, min_count=10, top=2000, covered=50)


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to seekable files and read back from them."""
    folder = new_location(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 32 components, whitened."""
    return by_component(whitened_vectors(read(spark, sf_dir, "embeddings"), components=32))
