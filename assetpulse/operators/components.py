"""Connected components by hooking and shortcutting."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, functions as F

from ..session import forget, materialize, stored


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. ``nodes`` has id, ``edges`` has src and dst.

    Every node points to a parent, at first itself. A round looks at the grandparents of a node's neighbours and lowers
    the pointer of the node, of its parent and past its parent (shortcut) to the smallest seen; the number of rounds
    grows with the logarithm of the longest chain. All lookups are equality joins and grouped minima that combine before
    the shuffle, so a node with very many edges is no hot spot. A round is written to the shared folder once and the
    number of changed pointers is observed while writing.
    """
    both = materialize(
        edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "component-edges"
    )
    pointers, path = nodes.select("id", F.col("id").alias("f"), F.col("id").alias("g")), None
    while True:
        near = (
            both.join(pointers.select(F.col("id").alias("dst"), F.col("g").alias("_g")), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("_g").alias("_m"))
        )
        seen = pointers.join(near, "id", "left").withColumn("_m", F.coalesce("_m", "g"))
        hooks = seen.groupBy(F.col("f").alias("id")).agg(F.min("_m").alias("_h"))
        lowered = (
            seen.join(hooks, "id", "left")
            .select(
                "id", F.least("f", "g", "_m", F.coalesce("_h", "f")).alias("f"), F.col("f").alias("_before"),
                F.col("g").alias("_gbefore"),
            )
            .persist(StorageLevel.MEMORY_AND_DISK)  # both sides of the next join; rebuilt from the last round if lost
        )
        parent = lowered.select(F.col("id").alias("f"), F.col("f").alias("g"))
        changed = Observation()
        moved = lowered.join(parent, "f").observe(
            changed, F.count_if((F.col("f") != F.col("_before")) | (F.col("g") != F.col("_gbefore"))).alias("n")
        )
        before = path
        pointers, path = stored(moved.select("id", "f", "g"), "component-pointers")
        lowered.unpersist()
        forget(nodes.sparkSession, before)  # the round before is in the one just written
        if not changed.get["n"]:
            return pointers.select("id", F.col("f").alias("component"))
