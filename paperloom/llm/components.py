"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first, so that the join reads two plain exchanges and a node of very many neighbours can be split
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(down.groupBy("u").agg(F.min("v").alias("m")), "least")  # as above
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of any order, repeats and loops allowed -> one row (node, root) per node that has an edge to
    another node; ``root`` is the least node reachable.  Every round is written to the shared folder; the rounds end when
    the edge table no longer changes (its count and order-free checksum are compared), about log(nodes) of them.
    An empty edge table gives an empty result.  Raises if ``max_rounds`` do not suffice, so no link is ever lost.
    """
    state = keep(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = keep(_small_star(_large_star(state)), "edges")
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
    raise RuntimeError("components did not settle")
