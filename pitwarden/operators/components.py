"""Connected components of many small graphs at once (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitwarden.operators.lineage import cut


def connected_components(edges: DataFrame, keys: list[str], a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(keys, node, component): component is the smallest node name it reaches.

    Each round points every neighbour at the smallest one seen, first across larger then
    across smaller neighbours, so paths shrink by a constant factor and the round count is
    logarithmic.  Only minima are aggregated; no neighbour list is built, so a node with very
    many edges costs one partial aggregate per task.
    """
    pairs = edges.select(*keys, F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct()
    state = cut(pairs)
    nodes = state.select(*keys, F.explode(F.array("u", "v")).alias("node")).distinct()
    mark = None
    for _ in range(max_rounds):
        state = cut(_small_star(_large_star(state, keys), keys))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(state.withColumnRenamed("u", "node"), [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("v", "node").alias("component")
    )


def _large_star(state: DataFrame, keys: list[str]) -> DataFrame:
    """Larger neighbours of each node point at the node's smallest neighbour (or itself)."""
    both = state.select(*keys, F.col("u").alias("x"), F.col("v").alias("y")).union(
        state.select(*keys, F.col("v").alias("x"), F.col("u").alias("y"))
    )
    low = both.groupBy(*keys, "x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    hung = both.filter("y > x").join(low, [*keys, "x"])
    return hung.select(*keys, F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(state: DataFrame, keys: list[str]) -> DataFrame:
    """Smaller neighbours of each node, and the node, point at the smallest of them."""
    low = state.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    hung = state.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(*keys, "u", F.col("m").alias("v"))
    return hung.union(own).filter("u <> v").distinct()
