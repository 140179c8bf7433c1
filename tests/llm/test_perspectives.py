from pyspark.sql import functions as F

from corpus import plain
from wardspark.llm.perspectives import rotate, rotation_report

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hello <|end|>"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""), (1, 3, "bob", "tie 漢字"), (1, 300, "ann", "far"),
    (1, None, "bob", "no number"), (2, 0, "system", "alone"), (None, 0, "x|y z", "null id"), (None, 1, None, "who"), (3, 5, "user", "word " * 20_000),
]


def brute(rows, width=256):
    parts, speakers = {}, {}
    for conv, turn, role, text in rows:
        role = role or "unknown"
        part = -1 if turn is None else turn // width
        parts.setdefault((conv, part), []).append((turn if turn is not None else -1, role, text or ""))
        if role != "system":
            speakers.setdefault(conv, set()).add(role)
    for (conv, part), turns in parts.items():
        for speaker in speakers.get(conv, ()):
            text, mask = "", []
            for _, role, said in sorted(turns):
                name = "".join("_" if c in "|<>" or c.isspace() else c for c in role)
                text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user {name}|>\n"
                start = len(text)
                text += said.replace("<|", "< |") + "<|end|>\n"
                if role == speaker:
                    mask.append(f"{start}:{len(text)}")
            yield conv, part, speaker, len(turns), len(mask), len(text), sum(int(m.split(":")[1]) - int(m.split(":")[0]) for m in mask), ",".join(mask), text


def test_equals_brute_force(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("speakers", F.lit("y"))
    assert plain(rotation_report(rotate(table)).drop("piece").collect()) == plain(brute(ROWS))
    assert plain(rotation_report(rotate(table, turns_per_part=2)).drop("piece").collect()) == plain(brute(ROWS, 2))
    assert rotate(table.limit(0)).count() == 0


def test_mask_covers_what_the_speaker_says(spark):
    for r in rotate(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")).collect():
        said = [r.text[s.start : s.end] for s in r["mask"]]
        assert len(said) == r.n_own and all(s.endswith("<|end|>\n") and "<|assistant|>" not in s for s in said)


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    plan = rotation_report(rotate(table))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
