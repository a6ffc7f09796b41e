"""Connected components by hooking to the least neighbour, pointer jumping and contraction.

Every round is stored in the shared folder, so a lost executor costs one round at most.  A round needs only
map-side combined minima and equality joins; a node with very many links is split by the skew join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import store


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root: the least node of the component."""
    edges = store(_both_ways(links))
    labels = None
    while True:
        hooks = store(edges.groupBy("u").agg(F.min("v").alias("least"))
                      .select(F.col("u").alias("node"), F.least("u", "least").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("up"), F.col("root").alias("top"))
            jumped = store(hooks.join(up, F.col("root") == F.col("up")).select(
                "node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("node").alias("old"), F.col("root").alias("new"))
            labels = store(labels.join(step, F.col("root") == F.col("old"), "left").select(
                "node", F.coalesce("new", "root").alias("root")))
        left = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = store(edges.join(left, "u").join(right, "v").filter("ru <> rv")
                      .select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        if edges.isEmpty():
            return labels
