"""Connected components of a table of edges: smallest labels, hooked over edges and shortened by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import discard, materialised


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component for every end of an edge (u, v): the smallest id that can be reached.

    In each round a component takes the smallest label that an edge shows any of its members, then labels point to
    the labels of their labels. The state is two columns of ids, written after each round."""
    both = materialised(
        edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "component-edges"
    )
    labels = materialised(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component")), "component-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        seen = labels.join(near, labels["id"] == near["u"]).select("id", "component", F.least("component", "near").alias("near"))
        # Hooking: the whole component of a row takes the smallest label that one of its rows has seen.
        hooks = seen.groupBy(F.col("component").alias("root")).agg(F.min("near").alias("hook"))
        hooks = materialised(hooks, "component-hooks")
        if hooks.filter("hook < root").isEmpty():
            discard(both, hooks)
            return labels
        once = hooks.select(F.col("root").alias("hook"), F.col("hook").alias("next"))
        twice = hooks.join(once, "hook", "left").select("root", F.least("hook", F.coalesce("next", "hook")).alias("hook"))
        before = labels
        labels = materialised(
            labels.join(twice, labels["component"] == twice["root"]).select("id", F.col("hook").alias("component")), "component-labels"
        )
        discard(before, hooks)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
