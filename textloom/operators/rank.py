"""PageRank and eigenvector centrality as DataFrame iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .graph import Graph


def pagerank(g: Graph, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None, weighted: bool = True) -> DataFrame:
    """id, rank (summing to 1). Dangling mass goes to all nodes. With a tolerance it stops once the summed change is under tolerance * n."""
    n = g.nodes.count()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("rank"))
    e = g.both_ways().select("src", "dst", F.coalesce(F.col("weight"), F.lit(1.0)).alias("w") if weighted else F.lit(1.0).alias("w")).where("w > 0")
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    # co-partitioned by src once; every iteration joins ranks to it
    e = checkpointed(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    dangling = checkpointed(g.nodes.select("id").join(out.select(F.col("src").alias("id")), "id", "left_anti"))
    any_dangling = bool(dangling.take(1))
    rank = checkpointed(g.nodes.select("id", F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        lost = (rank.join(dangling, "id", "left_semi").agg(F.sum("rank")).first()[0] or 0.0) if any_dangling else 0.0
        got = rank.join(e, rank["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = rank.select("id", F.col("rank").alias("old")).join(got, "id", "left").select("id", "old", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        new = checkpointed(new)
        done = tolerance is not None and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance * n
        rank = new.select("id", "rank")
        if done:
            break
    return rank


def eigenvector(g: Graph, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, centrality: power iteration on A + I, unweighted, of length 1; 0 where it doesn't settle."""
    n = g.nodes.count()
    e = checkpointed(g.both_ways().select("src", "dst").distinct())
    x = checkpointed(g.nodes.select("id", F.lit(1.0 / max(1, n)).alias("x")))
    for _ in range(iterations):
        got = x.join(e, x["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("got"))
        new = checkpointed(x.join(got, "id", "left").select("id", F.col("x").alias("old"), (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x")))
        length = (new.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0) or 1.0
        change = new.agg(F.sum(F.abs(F.col("x") / length - F.col("old")))).first()[0] or 0.0
        x = new.select("id", (F.col("x") / length).alias("x"))
        if change < n * tolerance:
            return x.select("id", F.col("x").alias("centrality"))
    return g.nodes.select("id", F.lit(0.0).alias("centrality"))
