"""Connected components of a table of links, as rounds of joins and aggregates."""

from pyspark.sql import DataFrame, functions as F

from wardspark.llm.shared import written


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges that point from the larger node ``u`` to the smaller ``v``.

    Large star: every larger neighbour of a node moves to the node's smallest neighbour. Small star: so do the smaller ones,
    and the node itself. Each step keeps the components and brings every node nearer to the least one.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # neighbours above u
    stars = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node with a link to another one; the component is its smallest node.

    ``links`` may hold either direction and repeats. Each round is written to the shared folder, so a lost executor costs
    one round at most; nothing but counts reaches the driver. Null ends and loops are no links.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v").distinct(), "links")
    state = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum"))
    before = edges.select(state.alias("s")).first().s
    for _ in range(max_rounds):
        if not before.n:
            break
        edges = written(_round(edges), "links")
        after = edges.select(state.alias("s")).first().s
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
