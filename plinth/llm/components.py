"""Connected components of a link table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.staging import stage_alone


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, root) pointers to their ends; each pass doubles the distance."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        jumped = stage_alone(
            parents.join(up, "root", "left").select(
                "node", F.coalesce("_next", "root").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")
            ),
            "pointers",
        )
        parents = jumped.select("node", "root")
        if jumped.where("_moved").limit(1).count() == 0:
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b): equal roots are reachable from each other.

    Each round points every node at its least neighbour, follows the pointers and contracts
    the links to the roots; the number of nodes halves at least.
    """
    whole = None
    left = stage_alone(links.select("a", "b").where("a != b").distinct(), "links")
    while left.limit(1).count():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        roots = _roots(least.select("node", F.least("node", "root").alias("root")))
        if whole is None:
            whole = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            whole = stage_alone(
                whole.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots"
            )
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        left = stage_alone(
            left.join(a, "a").join(b, "b").where("_a != _b").select(
                F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
            ).distinct(),
            "links",
        )
    return whole if whole is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
