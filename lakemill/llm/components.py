"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import durable, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b, both long): root is the component's smallest node.

    Rounds of hooking and pointer jumping on a parent table. Each round every edge is rewritten to its ends'
    parents; a parent takes the smallest parent it meets across an edge, and parents are then followed two
    steps. Edges inside one tree vanish, and the rest are deduplicated, so a node with many links (a hot
    group) shrinks to its distinct links at once, and the aggregations combine before they shuffle. State
    lives in the shared folder, not in lineage. Rows with a null end are no edges; a loop names its node.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    parents = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("parent")), "parents")
    live = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not live.isEmpty():
        # Live edges join roots only; each root hooks to the smallest root beside it.
        hooks = durable(live.groupBy("b").agg(F.min("a").alias("up")).select(F.col("b").alias("node"), "up"), "hooks")
        while True:  # chains of hooks fall to their ends in a logarithmic number of rounds
            h = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = durable(hooks.join(h, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "hooks")
            done = jumped.where("moved").isEmpty()
            forget(hooks)
            hooks = jumped.select("node", "up")
            if done:
                break
        h = hooks.select(F.col("node").alias("parent"), F.col("up").alias("top"))
        new_parents = durable(parents.join(h, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent")), "parents")
        side = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}_top"))
        moved = live.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"))
        new_live = durable(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        for old in (parents, live, hooks):
            forget(old)
        parents, live = new_parents, new_live
    return parents.select("node", F.col("parent").alias("root"))
