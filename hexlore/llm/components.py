"""Connected components of a link table by contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexlore.llm.common import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60) -> DataFrame:
    """node, root: each node of links with the one root of its component (a node of it).

    Each round every node takes its least neighbour or itself as parent, parents are followed to the top by pointer
    doubling, and links are drawn anew between tops; at least half the nodes of each component that is left go.
    Doublings grow with the logarithm of the longest descent, rounds with that of the component. All are written to
    the shared checkpoint folder. Links to null, and of a node to itself, link nothing; an empty table gives no rows.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
        jump = cut_lineage(parent.select("node", F.least("node", "p").alias("root")))
        for _ in range(most_rounds):
            up = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            after = cut_lineage(jump.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            jump = after.select("node", "root")
            if after.where("moved").isEmpty():
                break
        if found is None:
            found = jump
        else:
            later = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = cut_lineage(found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        to_a, to_b = (jump.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
