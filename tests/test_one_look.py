"""What a task of a scan holds in Python: one process, and results of a few megabytes of texts at a time."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wardspark.functions.anchors import has_bit, in_own_words, text_facts
from wardspark.operators import code_rules
from wardspark.operators.chunks import scan_chunks
from wardspark.operators.scan import GROUPS, _FIRST, scan_artifacts, staged_texts

ROWS = [
    ("a.py", "import torch\ntorch.load('x')\n"), ("b.txt", "torch.load('x')"), ("c.py", None), ("d.py", ""), ("e.py", "ｅval(x)"), ("f.pyw", "print(1)"),
    (None, "eval(x)"), ("g.py", "eval(x"), ("h.txt", "a " * (3 << 20)), ("i.py", "x = 'é'\nexec(y)"), ("j.txt", "b" * (5 << 20)), ("k.py", "eval(z)"), ("l.pyw", "import pickle\npickle.load(f)"),
]


def rows(spark):
    return spark.createDataFrame([(p, "t", c) for p, c in ROWS], "path string, target string, content string").coalesce(1)


def test_one_python_process_a_task(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(scan_artifacts(rows(spark))).count("ArrowEvalPython") == 1
    assert plan(scan_artifacts(rows(spark), detectors=["rag"])).count("ArrowEvalPython") == 1
    assert "facts_with_code" not in plan(scan_artifacts(rows(spark), detectors=["rag"]))


def test_one_look_tells_what_two_did(spark):
    """Masks, lines and code facts of one batch that spans several slices are those of looks of their own."""
    groups, bit = in_own_words(GROUPS), _FIRST["code"]
    facts = lambda row: row.facts and row.facts.asDict(True)
    together = {r.path: (r._mask, r.n_lines, r._plain, facts(r)) for r in staged_texts(rows(spark), groups, code_bit=bit).drop("content").collect()}
    apart = rows(spark).withColumn("f", text_facts(F.col("content"), groups))
    apart = code_rules.with_code_facts(apart, has_bit(F.col("f.mask"), bit) | F.col("content").rlike("[^\\x00-\\x7f]"))
    assert together == {r.path: (r.f.mask, r.f.n_lines, r.f.plain, facts(r)) for r in apart.drop("content").collect()}
    assert {path for path, row in together.items() if row[-1]} == {"a.py", "e.py", "i.py", "k.py", "l.pyw"}
    assert [c["func"] for c in together["k.py"][-1]["calls"]] == ["eval"]


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.getAll.get(BATCH)
    spark.conf.unset(BATCH)
    yield
    spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def largest_batch(texts):
    @arrow_udf("long")
    def batch_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch), pa.int64())

    return texts.select(batch_bytes("content").alias("b")).agg(F.max("b")).first()[0]


@pytest.mark.parametrize("scan", [scan_artifacts, lambda texts: scan_chunks(texts.withColumn("part", F.lit(0)), detectors=["secrets"])])
def test_batches_do_not_grow_with_the_partition(spark, unset, scan):
    """A partition of 24 MB reaches Python in batches of about 4 MB once a scan is made, not in one."""
    texts = spark.range(0, 6000, 1, 1).select(F.concat("id", F.lit(".txt")).alias("path"), F.lit("t").alias("target"), F.repeat(F.lit("abc "), 1000).alias("content"))
    assert largest_batch(texts) > 20e6
    scan(texts)
    assert largest_batch(texts) < 6e6


def test_a_batch_size_of_the_caller_stays(spark, unset):
    spark.conf.set(BATCH, "1m")
    scan_artifacts(rows(spark))
    assert spark.conf.get(BATCH) == "1m"
