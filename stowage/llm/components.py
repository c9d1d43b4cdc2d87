"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no neighbourhood is gathered in a task and no
link or label reaches the driver; hubs are split by the adaptive skew join. Each round is
checkpointed, and sized by the number of links that are left. The number of rounds grows with the square of the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut


#: Links in a partition, at least, between two shuffles.
LINKS = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of u links to the least of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    found = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return found.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """edges have a > b: u and its smaller neighbours link to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    found = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
    return found.coalesce(parts).distinct().coalesce(parts)


def _size(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in edges; root is the least node of its component.

    edges: two columns of one orderable type. Self-links and repeated links are allowed; a link with
    a null end is ignored. No edges give no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    own = e.where("a = b")
    e = cut(e.where("a <> b").distinct())
    before = _size(e)
    while True:
        # few links go in few files, however many partitions a shuffle has; a round doesn't add to their number
        parts = max(1, -(-before[0] // LINKS))
        e = cut(_small_star(_large_star(e.coalesce(parts), parts), parts))
        now = _size(e)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select("b", "b")).union(own.select("a", "b")).groupBy("node").agg(F.min("root").alias("root"))
