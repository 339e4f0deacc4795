"""Connected components of a link table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import cut

#: A path of n nodes takes about 2 log2(n) rounds.
MAX_ROUNDS = 100


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link to another.

    Alternates large-star and small-star steps until every link leads from a node to the smallest of its component.
    No group is gathered anywhere: a step joins links with the minimum of their node, so Spark can split a node that
    has very many. Null ends and links to oneself are left out; an empty table has no components.
    """
    a, b = F.col(u), F.col(v)
    edges = cut(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = now
        # large star: what is above a node goes to the least node around it
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("top"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("top").alias("lo")).distinct()
        # small star: what is below a node goes to the least of it
        least = large.groupBy("hi").agg(F.min("lo").alias("top"))
        moved = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("top").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("top").alias("lo")))).alias("e")).select("e.*")
        edges = cut(moved.where("hi <> lo").distinct())
    raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
