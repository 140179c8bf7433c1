"""Documents of bounded size.

A report document holds a target's items in one JSON value. A target may hold a large share of all items, so its items are cut, in report order, into parts of at most so many bytes
and rows; the parts of a target one after the other are its report. An item above half the byte bound has a part of its own, so that only such a single item can
make a part larger than the bound. No item is left out.

Where an item stands comes from running sums. A target of one part needs none. The items of larger ones are ranged over all tasks in report order; the sums of a range come from
those of the ranges before it, which are few, and the running sums inside it from its own rows. So no target's items ever meet on one task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardspark.plans.storage import written

MAX_ROWS, MAX_BYTES = 5000, 16 << 20


def in_parts(rows: DataFrame, place: Column, item: Column, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``target, part, items`` of rows with a ``target``: the items in the order of ``place``. Targets without rows are not there."""
    sized = rows.select("target", place.alias("place"), item.alias("item")).withColumn("bytes", F.octet_length(F.to_json("item")) + 1)
    totals = sized.groupBy("target").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).where((F.col("n") > max_rows) | (F.col("size") > max_bytes)).select("target")
    totals = written(totals, "large-targets")
    if totals.isEmpty():
        return _collected(sized.withColumn("part", F.lit(0)))
    small = _collected(sized.join(totals, "target", "left_anti").withColumn("part", F.lit(0)))
    return small.unionByName(_collected(_numbered(sized.join(totals, "target", "left_semi"), max_rows, max_bytes)))


def _collected(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("target", "part").agg(F.array_sort(F.collect_list(F.struct("place", "item")), _by_place).alias("items"))
    return grouped.withColumn("items", F.transform("items", lambda i: i["item"]))


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)


def _numbered(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """The rows with their ``part``."""
    large = F.col("bytes") > max_bytes // 2
    ordered = rows.repartitionByRange("target", "place").sortWithinPartitions("target", "place")
    ordered = written(ordered.select("target", "place", "item", "bytes", large.alias("large"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")), "ranged")
    steps = {"n": F.lit(1), "size": F.when(F.col("large"), 0).otherwise(F.col("bytes")), "alone": F.col("large").cast("int")}
    ranges = ordered.groupBy("target", "range").agg(*[F.sum(value).alias(name) for name, value in steps.items()])
    earlier = Window.partitionBy("target").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("target", "range", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in steps])
    inside = Window.partitionBy("target", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda name: F.coalesce(F.sum(steps[name]).over(inside), F.lit(0)) + F.col(f"{name}_before")
    placed = ordered.join(offsets, ["target", "range"]).withColumns({"_n": running("n"), "_size": running("size"), "_alone": running("alone") + steps["alone"]})
    cut = F.struct(F.col("_alone").alias("alone"), (~F.col("large")).alias("shared"), F.when(F.col("large"), 0).otherwise(F.floor(F.col("_size") / F.lit(max(1, max_bytes - max_bytes // 2)))).alias("bytes"),
                   F.when(F.col("large"), 0).otherwise(F.floor(F.col("_n") / F.lit(max_rows))).alias("rows"))
    placed = written(placed.select("target", "place", "item", cut.alias("cut")), "cut")
    numbers = placed.select("target", "cut").distinct().withColumn("part", F.row_number().over(Window.partitionBy("target").orderBy("cut")) - 1)
    return placed.join(numbers, ["target", "cut"]).drop("cut")


def with_parts(targets: DataFrame, *lists: DataFrame) -> DataFrame:
    """One row per target and part, also for targets without items, with ``parts``, their number; ``lists`` have columns ``target, part``."""
    counts = [rows.select("target", F.col("part").alias("_last")) for rows in lists]
    for more in counts[1:]:
        counts[0] = counts[0].unionByName(more)
    last = counts[0].groupBy("target").agg(F.max("_last").alias("_last"))
    numbered = targets.join(last, "target", "left").withColumn("parts", F.coalesce(F.col("_last") + 1, F.lit(1)).cast("int"))
    return numbered.drop("_last").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
