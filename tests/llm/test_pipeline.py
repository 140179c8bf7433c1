import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus import plain, words
from wardspark.llm import surrogates
from wardspark.llm.byte_bpe import encoding
from test_simhash import brute_fingerprint, classes
from test_winnowing import brute as contamination

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, toxic ones, copies, contaminated ones and personal data."""
    draw, rows, labels = random.Random(6), [], []
    for i in range(300):
        line = ["".join(draw.choice(["an", "er", "th", "on", "re", "ing"]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(30, 80))]
        if i % 5 == 0:
            for _ in range(4):
                line[draw.randrange(len(line))] = draw.choice(["vexnub", "grolfic"])
        labels.append((i, int(i % 5 == 0)))
        rows.append((i, " ".join(line)))
    rows += [(1000 + i, rows[i + 1][1]) for i in range(0, 40, 5)]
    rows += [(2000 + i, rows[i + 1][1] + " " + BENCH) for i in range(0, 40, 5)]
    rows += [(3000, rows[1][1] + " write to joe.77@mail.example.com"), (3001, None), (3002, ""), (1, rows[1][1]), (3003, BENCH), (None, rows[2][1] + " plus")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages_equal_brute_force(spark, folder):
    path, rows = folder
    left = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = [(r.doc_id, r.text) for r in left.collect()]
        left = corpus_pipeline.written(stage(spark, left, path), "test-stage")
        assert left.columns == corpus_pipeline.COLUMNS
        after = plain((r.doc_id, r.text) for r in left.collect())
        if name == "toxicity":
            assert after == plain((i, t) for i, t in before if not {"vexnub", "grolfic"} & set(words(t)))
        if name == "simhash":
            top = classes({brute_fingerprint(t) for _, t in before}, lambda a, b: bin(a ^ b).count("1") <= 2)
            least = {}
            for i, t in before:
                c = top[brute_fingerprint(t)]
                least[c] = min((i is None, i or 0), least.get(c, (True, 0)))
            assert sorted((i is None, i or 0) for i, _ in after) == sorted(least.values())
        if name == "decontamination":
            bad = {r[0] for r in contamination(before, [(1, BENCH)]) if r[-1]}
            assert bad and after == plain((i, t) for i, t in before if i not in bad)
        if name == "surrogates":
            assert after == plain((i, None if t is None else surrogates.replace(t, corpus_pipeline.KEY, {})[0]) for i, t in before)
            assert not any("joe.77@" in (t or "") for _, t in after)


def test_run(spark, folder):
    path, _ = folder
    final = corpus_pipeline.run(spark, path).collect()
    library = encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    assert final and all(r.n_tokens == len(r.ids) for r in final)
    assert all("vexnub" not in library.decode(r.ids) for r in final)


def test_empty_table(spark, folder, tmp_path):
    path, _ = folder
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
