"""Chat formatting by perspective rotation, with Spark functions only.

For every participant of a conversation the whole dialogue is rendered once: with that speaker as the assistant, all others as users
under their names, and the narrator's turns as system text. The mask marks what the assistant says and the sign that ends
it, in code points of the rendered text.

A conversation is cut into parts by turn number (``turns_per_part`` numbers each), so one with a third of all rows is shared by many tasks;
parts follow each other by number. Turns without a number make part -1. A part of more than ``rows_per_piece`` rows (turn numbers may repeat
or be missing) is cut into pieces of so many, numbered from 0 in the same order: no array and no rendered text holds more rows than that.
Equal numbers are ordered by speaker, then text;
repeated rows are all rendered. Null speakers are called ``unknown``, null texts are empty, null conversations are one
conversation. Without a participant besides the narrator there is nothing to render. Marks inside a text are broken up, so no text can
open a turn of its own; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardspark.llm.shared import written

NARRATOR, UNKNOWN = "system", "unknown"
END = "<|end|>\n"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(role, r"[|<>\s]", "_")


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, "<|assistant|>\n").when(role == NARRATOR, "<|system|>\n").otherwise(F.concat(F.lit("<|user "), _name(role), F.lit("|>\n")))


def _in_pieces(rows: DataFrame, rows_per_piece: int) -> DataFrame:
    """``rows`` with ``piece``: 0, or in crowded parts the place among all rows of the part divided by ``rows_per_piece``.

    Only rows of crowded parts are sorted, over all tasks, so a part with a third of all rows is spread; equal rows are told apart by a hash of their place of origin.
    Parts are counted in two steps. There are at most rows / ``rows_per_piece`` crowded ones, so that they can be sent to every task.
    """
    crowded = written(rows.groupBy("_conv", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_piece).select("_conv", "part"), "perspectives-crowded")
    if crowded.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    keys = F.broadcast(crowded.select(F.col("_conv").alias("_c"), F.col("part").alias("_p")))
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))
    order = ["_conv", "part", "turn", "role", "text", "_salt"]
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).join(keys, same, "left_semi").sort(*order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "perspectives-dealt")  # the task in the upper bits, the place in it below
    task = F.shiftright("_at", 33)
    share = dealt.groupBy("_conv", "part", task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_conv", "part").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    offsets = share.select(F.col("_conv").alias("_c"), F.col("part").alias("_p"), "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = dealt.join(F.broadcast(offsets), same & (task == F.col("_task")))  # at most crowded parts + tasks rows
    placed = placed.withColumn("piece", F.floor((F.col("_before") + F.col("_at") - F.col("_first")) / rows_per_piece).cast("long"))
    others = rows.join(keys, same, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    return others.unionByName(placed.select(*others.columns))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_per_part: int = 256, rows_per_piece: int = 1024) -> DataFrame:
    """Per conversation, part, piece and speaker: ``n_turns``, ``n_own``, ``text`` and ``mask`` (start and end of what is to be learnt)."""
    rows = conversations.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    speakers = rows.where(F.col("role") != NARRATOR).groupBy("_conv").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    part = F.coalesce(F.floor(F.col("turn") / turns_per_part).cast("long"), F.lit(-1).cast("long"))
    pieces = _in_pieces(rows.withColumn("part", part), rows_per_piece)
    parts = pieces.groupBy("_conv", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = speakers.withColumnRenamed("_conv", "_other")
    views = parts.join(speakers, F.col("_conv").eqNullSafe(F.col("_other"))).select("_conv", "part", "piece", "turns", F.explode("speakers").alias("speaker"))
    pieces = F.transform("turns", lambda t: F.struct(
        (t.role == F.col("speaker")).alias("own"), _head(t.role, F.col("speaker")).alias("head"), F.concat(_plain(t.text), F.lit(END)).alias("tail")))
    views = views.select("_conv", "part", "piece", "speaker", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, piece: Column) -> Column:
        begin = done["at"] + F.length(piece["head"])
        end = begin + F.length(piece["tail"])
        return F.struct(end.alias("at"), F.when(piece["own"], F.concat(done["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(done["spans"]).alias("spans"))

    return views.select(
        F.col("_conv").alias(conv_col), "part", "piece", "speaker", F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["tail"])), "").alias("text"),
        F.aggregate("pieces", start, step, lambda done: done["spans"]).alias("mask"))


def rotation_report(rotated: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One line per row of :func:`rotate`, in the columns of the SQL twin."""
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return rotated.select(
        conv_col, "part", "piece", "speaker", "n_turns", "n_own", F.length("text").cast("long").alias("n_chars"), masked.alias("n_masked"),
        F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias("mask"), "text")


#: The same in SQL, over a table ``conversations``.
SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS part FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
cut AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, body) - 1) // 1024 AS piece FROM said),
pieces AS (
  SELECT s.conv_id, part, piece, speaker, row_number() OVER (PARTITION BY s.conv_id, part, piece, speaker ORDER BY turn NULLS FIRST, role, body) AS place, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user ' || regexp_replace(role, '[|<>\\s]', '_', 'g') || '|>' END || chr(10) AS head,
    replace(body, '<|', '< |') || '<|end|>' || chr(10) AS tail
  FROM cut s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, part, piece, speaker ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM pieces)
SELECT conv_id, part, piece, speaker, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own, CAST(max(stop) AS BIGINT) AS n_chars,
  CAST(sum(CASE WHEN own THEN length(tail) ELSE 0 END) AS BIGINT) AS n_masked,
  coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(tail) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) END, ',' ORDER BY place), '') AS mask,
  string_agg(head || tail, '' ORDER BY place) AS text
FROM placed GROUP BY conv_id, part, piece, speaker
"""
