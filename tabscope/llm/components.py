"""Connected components of a graph held in a DataFrame.

Each round gives every node a new random order, lets it point to its least neighbour in that
order (or itself), and contracts the graph along these pointers; what is left shrinks by a
constant factor in expectation, whatever the graph looks like (Bögeholz, Brand and Todor,
"In-database connected component analysis", 2020). Rounds are written to the shared folder.
The pointers of all rounds are then followed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabscope.workspace import materialize

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """``links``: longs ``a, b``. One row ``node, root`` for every node of a link between different
    nodes; nodes have one root exactly if they are connected. No links give no rows."""
    rest = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    pointers: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if rest.isEmpty():
            break
        order = F.xxhash64(F.lit(turn), "to")
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("to")))
        least = both.groupBy("node").agg(F.min(F.struct(order.alias("order"), F.col("to"))).alias("least"))
        own = F.struct(F.xxhash64(F.lit(turn), "node").alias("order"), F.col("node").alias("to"))
        step = materialize(least.select("node", F.least(F.col("least"), own)["to"].alias("root")), "pointers")
        pointers.append(step)
        moved = rest.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b"
        )
        rest = materialize(
            moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links"
        )
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    if not pointers:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = pointers.pop()
    for step in reversed(pointers):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("after"))
        found = step.join(later, "root", "left").select("node", F.coalesce("after", "root").alias("root"))
        found = materialize(found, "roots")
    return found
