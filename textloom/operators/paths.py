"""Shortest paths by frontier joins: distances, closeness, diameter, ego networks, betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .graph import Graph

# A table of up to this many rows (counted) is broadcast in the all-pairs joins; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def distances(g: Graph, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """source, id, distance of all reached nodes, breadth first from each source (default: every node).

    Distances of all pairs are searched between the nodes of Hung's core only; the pairs of nodes hung on them are
    made by joins, so the rows of the result pass through no exchange as long as the core is small.
    """
    if sources is not None or max_depth is not None:
        e = checkpointed(g.both_ways().select("src", "dst").where("src <> dst").distinct())
        return _search(e, (sources if sources is not None else g.nodes).select(F.col("id").alias("source")).distinct(), max_depth)
    h = Hung(g)
    d, n = checkpointed(h.distances()), h.places.count()
    side = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    at = lambda df, *names: df.select("id", "anchor", "up").toDF(*names)
    ends = at(h.places.where("known = 1"), "source", "a", "up").repartition(4 * g.spark.sparkContext.defaultParallelism)
    ends = ends.join(side(d.toDF("a", "b", "between"), d.count()), "a").join(side(at(h.places, "id", "b", "down"), n), "b")
    return ends.select("source", "id", F.when(F.col("source") == F.col("id"), 0).otherwise(F.col("between") + F.col("up") + F.col("down")).alias("distance"))


def _search(e: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth first over e(src, dst) from sources(source) -> source, id, distance."""
    seen = checkpointed(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("distance")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, frontier["id"] == e["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen


class Hung:
    """A graph as a core and the nodes hung on it by a single link.

    places(id, anchor, up, known): every node, the core node it hangs on (itself in the core), its distance to that (0 or 1)
    and whether it is among the graph's nodes or just an end of an edge.
    links(src, dst): both ways between core nodes. Of two nodes that only link with each other, the lesser is the core.
    """

    def __init__(self, g: Graph):
        e = checkpointed(g.both_ways().select("src", "dst").where("src <> dst").distinct())
        single = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("anchor")).where("n = 1").select("src", "anchor")
        other = single.select(F.col("src").alias("anchor"), F.lit(True).alias("single"))
        hung = checkpointed(single.join(other, "anchor", "left").where("single is null or src > anchor").select(F.col("src").alias("id"), "anchor"))
        ids = g.nodes.select("id", F.lit(1).alias("known")).unionByName(e.select(F.col("src").alias("id"), F.lit(0).alias("known"))).groupBy("id").agg(F.max("known").alias("known"))
        self.places = checkpointed(ids.join(hung, "id", "left").select("id", F.coalesce("anchor", "id").alias("anchor"), F.when(F.col("anchor").isNull(), 0).otherwise(1).alias("up"), "known"))
        ids = lambda name: hung.select(F.col("id").alias(name))
        self.links = checkpointed(e.join(ids("src"), "src", "left_anti").join(ids("dst"), "dst", "left_anti").select("src", "dst"))

    def distances(self) -> DataFrame:
        """source, id, distance between core nodes."""
        return _search(self.links, self.places.where("up = 0").select(F.col("id").alias("source")))

    def weights(self) -> DataFrame:
        """id, own, leaves: the core nodes, whether each is known, and how many known nodes hang on it."""
        return self.places.groupBy(F.col("anchor").alias("id")).agg(F.sum(F.col("known") * (1 - F.col("up"))).alias("own"), F.sum(F.col("known") * F.col("up")).alias("leaves"))

    def weighted(self) -> DataFrame:
        """source, id, distance, la, lb, own: core pairs with the leaves at both ends, and whether id is known."""
        w = checkpointed(self.weights())
        d = self.distances().join(w.select(F.col("id").alias("source"), F.col("leaves").alias("la")), "source")
        return d.join(w.select("id", "own", F.col("leaves").alias("lb")), "id")


def path_summary(g: Graph) -> DataFrame:
    """One row: diameter and mean path length of the graph, or of its largest component if it isn't connected."""
    c = g.components()
    best = c.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    part = g.induced(c.join(F.broadcast(best), "component", "left_semi").select("id"))
    a, b, d = F.col("la"), F.col("lb"), F.col("distance")
    own = F.col("source") == F.col("id")
    # a leaf and itself are no pair: two steps and one pair less for each
    steps = d * (1 + a) * (1 + b) + a * (1 + b) + b * (1 + a) - F.when(own, 2 * a).otherwise(0)
    farthest = F.when(own, F.least(a, F.lit(2))).otherwise(d + F.least(a, F.lit(1)) + F.least(b, F.lit(1)))
    s = Hung(part).weighted().agg(F.max(farthest).alias("far"), F.sum(steps).alias("steps"), F.sum((1 + a) * (1 + b) - F.when(own, 1 + a).otherwise(0)).alias("pairs"))
    return s.agg(F.coalesce(F.max("far").cast("int"), F.lit(0)).alias("diameter"), F.round(F.coalesce(F.max(F.try_divide(F.col("steps").cast("double"), "pairs")), F.lit(0.0)), 6).alias("avg_path_length"))


def closeness(g: Graph) -> DataFrame:
    """id, closeness: (reached / total distance) scaled by reached / (n - 1); 0 for isolated nodes."""
    n, h = g.nodes.count(), Hung(g)
    d = h.weighted().groupBy(F.col("source").alias("anchor")).agg(F.sum(F.col("own") + F.col("lb")).alias("all"), F.sum(F.col("distance") * (F.col("own") + F.col("lb")) + F.col("lb")).alias("steps"))
    # a hung node is one step farther from all nodes than its anchor is, but reaches itself in none
    d = h.places.join(d, "anchor").select("id", (F.col("all") - 1).alias("r"), (F.col("steps") + F.col("up") * (F.col("all") - 2)).alias("t"))
    score = F.try_divide(F.col("r"), F.col("t")) * (F.col("r") / F.lit(float(max(1, n - 1))))
    return g.nodes.select("id").join(d, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("closeness"))


def ego_network(g: Graph, node: str, radius: int = 2) -> Graph:
    ids = g.nodes.where(F.col("id") == node).select("id")
    return g.induced(distances(g, ids, radius).select("id"))


def pivots(g: Graph, k: int = 100, seed: str = "42") -> DataFrame:
    """k nodes, the same on every run."""
    return g.nodes.select("id").orderBy(F.md5(F.concat("id", F.lit(seed)))).limit(k)


def betweenness(g: Graph, k: int = 100, seed: str = "42", normalized: bool = True) -> DataFrame:
    """id, betweenness: Brandes' accumulation from k pivots, level by level for all pivots at once, scaled to all nodes."""
    n = g.nodes.count()
    k = min(k, n)
    e = checkpointed(g.both_ways().select("src", "dst").where("src <> dst").distinct())
    front = checkpointed(pivots(g, k, seed).select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma"), F.lit(0).alias("d")))
    levels, seen = [front], front
    while True:
        step = front.join(e, front["id"] == e["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        front = checkpointed(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("d", F.lit(len(levels))))
        if not front.take(1):
            break
        levels.append(front)
        seen = checkpointed(seen.unionByName(front))
    delta = [None] * len(levels)
    zero = F.lit(0.0)
    for i in range(len(levels) - 1, -1, -1):
        here = levels[i].select("source", "id", "sigma")
        if i == len(levels) - 1:
            delta[i] = here.withColumn("delta", zero)
            continue
        child = delta[i + 1].select("source", F.col("id").alias("dst"), F.col("sigma").alias("cs"), F.col("delta").alias("cd"))
        got = here.join(e, here["id"] == e["src"]).join(child, ["source", "dst"]).groupBy("source", "id").agg(F.sum(F.col("sigma") / F.col("cs") * (1 + F.col("cd"))).alias("delta"))
        delta[i] = checkpointed(here.join(got, ["source", "id"], "left").withColumn("delta", F.coalesce("delta", zero)))
    total = None
    for d in delta:
        total = d if total is None else total.unionByName(d)
    # each unordered pair is met from both ends when every node is a pivot
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else 0.5
    sums = total.where("source <> id").groupBy("id").agg((F.sum("delta") * (scale * n / max(1, k))).alias("betweenness"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("betweenness", zero).alias("betweenness"))
