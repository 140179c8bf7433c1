"""Benchmark decontamination by winnowing, with Spark functions only.

Words are hashed; five consecutive hashes make a gram; of every nine consecutive grams the smallest is kept. Two texts that
share thirteen consecutive words share nine grams there, and so the same smallest one: no shared window is missed. Kept
grams of documents and benchmark items meet in a join; around each meeting the words themselves are compared, up to eight to
either side, and runs of thirteen or more are hits. Every shared window holds a kept gram, so these runs together cover
exactly the words that lie in shared windows.

Items of fewer than thirteen words are windows of their own length; documents look those lengths up at every place.

Before the join, grams pass a bit map of the benchmark's grams. Its size is fixed, whatever the size of the benchmark (more items
only let more grams through to the join), so it may travel with the plan. Texts are read once and never shuffled:
only candidates with 21 words of context leave the row.

Null and empty texts have no words: no hits, not contaminated. Items without words are no windows; items with a null id
hit words but are not counted or listed.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardspark.llm.shared import let, text_key, word_array, word_line, written

WINDOW, GRAM = 13, 5
GRAMS = WINDOW - GRAM + 1  # grams in a window
REACH = WINDOW - GRAM  # words to look at on either side of a gram
MAP_BITS = 20


def _ahead(values: Column, n: int) -> Column:
    return F.slice(values, n + 1, F.size(values))


def _combine(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


def _grams(hashes: Column, length: int) -> Column:
    """A hash for every ``length`` consecutive word hashes, in order."""
    mixed = _power(hashes, length, lambda a, b: F.xxhash64(a, b))
    return let(mixed, lambda g: F.slice(g, 1, F.greatest(F.size(g) - (length - 1), F.lit(0))))


def _power(values: Column, length: int, op) -> Column:
    """``op`` over every run of ``length`` values, put together from runs of powers of two; the last runs are cut short."""

    def grow(level: Column, size: int, done: Column | None, have: int, rest: int) -> Column:
        if rest & 1:
            done, have = (level, size) if done is None else (_combine(done, _ahead(level, have), op), have + size)
        rest >>= 1
        if not rest:
            return done
        return let(_combine(level, _ahead(level, size), op), lambda wider: grow(wider, 2 * size, done, have, rest))

    return grow(values, 1, None, 0, length)


def _smallest(grams: Column) -> Column:
    """The different smallest grams of all windows of nine; none if there are fewer grams."""
    mins = _power(grams, GRAMS, lambda a, b: F.least(a, b))
    return F.when(F.size(grams) >= GRAMS, F.array_distinct(let(mins, lambda m: F.slice(m, 1, F.size(grams) - (GRAMS - 1))))).otherwise(F.array().cast("array<bigint>"))


def _spots(words: Column, grams: Column, kept: Column, length: int, reach: int) -> Column:
    """Every place of a kept gram: its hash, its first word, and the words around it."""
    places = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda x: F.array_contains(kept, x.gram))
    full = F.transform(places, lambda x: F.struct(
        F.lit(length).alias("length"), x.gram.alias("gram"), x["at"].alias("at"),
        F.reverse(F.slice(words, F.greatest(x["at"] - reach, F.lit(0)) + 1, F.least(x["at"], F.lit(reach)))).alias("left"),
        F.slice(words, x["at"] + 1, length + reach).alias("right")))
    return F.when(F.size(kept) > 0, full).otherwise(F.array().cast("array<struct<length:int,gram:bigint,at:int,left:array<string>,right:array<string>>>"))


def _bit(gram: Column) -> tuple[Column, Column]:
    """Where a gram stands in the bit map: the word, and the bit in it."""
    slot = gram.bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    return F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")


def _bit_map(fingerprints: DataFrame) -> Column:
    """The benchmark's grams as a bit map of fixed size. At most 2^14 rows of two numbers come to the driver."""
    word, bit = _bit(F.col("gram"))
    rows = fingerprints.select(word.alias("w"), F.expr("shiftleft(1L, cast(gram & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    words = ["0"] * (1 << (MAP_BITS - 6))
    for row in rows:
        words[row.w] = str(row.b)
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>")


def _in_map(bits: Column, gram: Column) -> Column:
    word, bit = _bit(gram)
    return F.getbit(F.get(bits, word), bit) == 1


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, length, gram, left, right): fingerprints of all items with the words around them."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), word_array(word_line(F.col(text_col))).alias("words"))
    hashed = items.where("size(words) > 0").select("item", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    words, hashes = F.col("words"), F.col("hashes")
    long = let(_grams(hashes, GRAM), lambda g: let(_smallest(g), lambda kept: _spots(words, g, kept, GRAM, REACH)))
    # one gram over the whole item
    whole = F.aggregate(F.slice(hashes, 2, F.size(hashes)), F.get(hashes, 0), lambda a, b: F.xxhash64(a, b))
    short = F.array(F.struct(F.size(words).alias("length"), whole.alias("gram"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("left"), words.alias("right")))
    spots = hashed.select("item", (F.size("words") < WINDOW).alias("short"), F.explode(F.when(F.size("words") < WINDOW, short).otherwise(long)).alias("s"))
    return spots.select("item", "short", "s.length", "s.gram", "s.left", "s.right").distinct()


def _whole_grams(hashes: Column, length: int) -> Column:
    """Like :func:`_grams`, folded from the left as for short items."""
    steps = reduce(lambda done, n: F.zip_with(done, _ahead(hashes, n), lambda a, b: F.xxhash64(a, b)), range(1, length), hashes)
    return F.slice(steps, 1, F.greatest(F.size(hashes) - (length - 1), F.lit(0)))


def _equal_run(a: Column, b: Column) -> Column:
    """How many leading words are the same."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return let(same, lambda s: let(F.array_position(s, False), lambda p: F.when(p == 0, F.size(s)).otherwise(p.cast("int") - 1)))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """Per document: id, ``text_key``, ``n_words``, ``n_hit`` (words inside shared windows), ``items`` (ids of items with shared windows, sorted
    as strings) and ``contaminated`` (at least one hit in ``share`` words)."""
    windows = written(benchmark_windows(benchmark, item_col, item_text_col), "benchmark-windows")
    bits = _bit_map(windows)
    lengths = sorted(r.length for r in windows.where("short").select("length").distinct().collect())  # at most twelve

    rows = documents.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("text_key"), word_array(word_line(F.col(text_col))).alias("words"))
    rows = rows.select("_id", "text_key", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    words, hashes = F.col("words"), F.col("hashes")

    def known(grams: Column) -> Column:
        return F.filter(grams, lambda g: _in_map(bits, g))

    found = [let(_grams(hashes, GRAM), lambda g: let(known(_smallest(g)), lambda kept: _spots(words, g, kept, GRAM, REACH)))]
    for length in lengths:
        found.append(_short_spots(words, hashes, length, known))
    scanned = written(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("_id"), "text_key", F.size("words").cast("long").alias("n_words"), F.concat(*found).alias("spots")), "document-windows")

    near = scanned.where("size(spots) > 0").select("row", F.explode("spots").alias("s")).select("row", "s.length", "s.gram", "s.at", F.col("s.left").alias("l"), F.col("s.right").alias("r"))
    met = near.join(windows.withColumn("long", ~F.col("short")), ["length", "gram"])
    back, ahead = _equal_run(F.col("l"), F.col("left")), _equal_run(F.col("r"), F.col("right"))
    runs = met.select("row", "item", "long", "length", "at", back.alias("back"), ahead.alias("ahead"))
    runs = runs.where(F.when(F.col("long"), (F.col("ahead") >= GRAM) & (F.col("back") + F.col("ahead") >= WINDOW)).otherwise(F.col("ahead") >= F.col("length")))
    hits = written(runs.select(
        "row", "item", F.when(F.col("long"), F.col("at") - F.col("back")).otherwise(F.col("at")).alias("start"),
        (F.col("at") + F.when(F.col("long"), F.col("ahead")).otherwise(F.col("length"))).alias("end")).distinct(), "benchmark-hits")

    spans = hits.groupBy("row", "start").agg(F.max("end").alias("end"))
    reached = F.expr("max(end) OVER (PARTITION BY row ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    covered = spans.select("row", "start", "end", F.coalesce(reached, F.lit(0)).alias("reached"))
    counts = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    items = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = scanned.select("row", "_id", "text_key", "n_words").join(counts, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return every.select(
        F.col("_id").alias(id_col), "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def _short_spots(words: Column, hashes: Column, length: int, known) -> Column:
    return let(_whole_grams(hashes, length), lambda g: let(F.array_distinct(known(g)), lambda kept: _spots(words, g, kept, length, 0)))


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
