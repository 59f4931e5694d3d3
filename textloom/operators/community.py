"""Communities: label propagation, Louvain, Girvan-Newman, modularity, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import checkpointed
from .graph import Graph
from .paths import Hung, betweenness
from .rank import pagerank


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """id, community. A node takes its neighbours' heaviest label (ties: the least); odd and even ids move in turn, so labels don't swap for ever."""
    e = checkpointed(g.both_ways().where("src <> dst").select("src", "dst", F.lit(1.0).alias("w")))
    labels = checkpointed(g.nodes.select("id", F.col("id").alias("community"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("turn")))
    quiet = 0
    for r in range(rounds):
        votes = e.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b"), F.max("w").alias("top"))
        own = votes.select(F.col("src").alias("id"), "community", F.col("w").alias("own"))
        new = labels.join(best, "id", "left").join(own, ["id", "community"], "left")
        # a node whose label is among the heaviest keeps it
        move = (F.col("turn") == r % 2) & F.col("b").isNotNull() & (F.coalesce("own", F.lit(0.0)) < F.col("top"))
        new = checkpointed(new.select("id", F.when(move, F.col("b.community")).otherwise(F.col("community")).alias("community"), "turn", move.alias("moved")))
        quiet = 0 if new.where("moved").take(1) else quiet + 1
        labels = new.drop("moved")
        if quiet == 2:
            break
    return labels.select("id", "community")


def modularity(g: Graph, partition: DataFrame) -> DataFrame:
    """One row, modularity: sum over communities of inside / m - (degrees / 2m)^2, weighted. partition(id, community)."""
    c = g.group_sums(partition)
    inside = c.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inside"))
    deg = c.select(F.col("ca").alias("community"), "w").unionAll(c.select(F.col("cb").alias("community"), "w")).groupBy("community").agg(F.sum("w").alias("deg"))
    m = g.total_weight()
    part = deg.join(inside, "community", "left").join(F.broadcast(m))
    return part.agg(F.round(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)), F.lit(0.0)), 6).alias("modularity"))


# Links up to which a graph is partitioned in one task (about 200 bytes a link there).
LOCAL_LINKS = 500_000


class _Local:
    """Louvain on a small graph: nodes move one by one, in order of their names, to the neighbour community of greatest gain."""

    def __init__(self, links: list[tuple]):
        self.near: dict = {}
        for a, b, w in links:
            for x, y in ((a, b), (b, a)):  # a loop counts twice in its node's degree
                row = self.near.setdefault(x, {})
                row[y] = row.get(y, 0.0) + w
        self.two_m = sum(map(sum, (r.values() for r in self.near.values())))

    def moved(self) -> dict:
        """node -> community after moves until none gains."""
        degree = {v: sum(r.values()) for v, r in self.near.items()}
        at, total = {v: v for v in self.near}, dict(degree)
        nodes, busy = sorted(self.near), True
        while busy:
            busy = False
            for v in nodes:
                k, to = degree[v], {at[v]: 0.0}
                for u, w in self.near[v].items():
                    if u != v:
                        to[at[u]] = to.get(at[u], 0.0) + w
                total[at[v]] -= k
                best, stay = min((-round(w - k * total[c] / self.two_m, 9), c) for c, w in to.items()), round(to[at[v]] - k * total[at[v]] / self.two_m, 9)
                if -best[0] > stay:
                    at[v], busy = best[1], True
                total[at[v]] += k
        return at

    def partition(self) -> dict:
        """node -> the least node of its community, level by level until nothing gains."""
        names, graph = {v: v for v in self.near}, self
        while True:
            at = graph.moved()
            least: dict = {}
            for v, c in at.items():
                least[c] = min(v, least.get(c, v))
            if len(least) == len(at):
                return names
            names = {v: least[at[c]] for v, c in names.items()}
            # both directions are there, so half of each sum
            sums: dict = {}
            for v, row in graph.near.items():
                for u, w in row.items():
                    key = (least[at[v]], least[at[u]])
                    sums[key] = sums.get(key, 0.0) + w / 2
            graph = _Local([(a, b, w) for (a, b), w in sums.items()])


def _local_louvain(edges: DataFrame) -> DataFrame:
    """edges(src, dst, w), few enough for one task -> v, c."""
    import pyarrow as pa

    def run(batches):
        links = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("src", "dst", "w")), strict=True)]
        found = sorted(_Local(links).partition().items())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["v", "c"])

    return checkpointed(edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), "w").coalesce(1).mapInArrow(run, "v string, c string"))


def louvain(g: Graph, max_levels: int = 10, max_rounds: int = 10, local_links: int = LOCAL_LINKS) -> DataFrame:
    """id, community (its least id). Moves by modularity gain, then contraction, until nothing gains.

    A graph of more than local_links links is coarsened on DataFrames: in a round, half of the nodes (by hash)
    may move, each to the neighbour community of greatest gain (ties: the least); a level ends when both
    halves rest, and one that gains nothing ends the coarsening. What fits local_links (counted) is partitioned in one task.
    Nodes without links stay alone.
    """
    names = g.nodes.select("id", F.col("id").alias("c"))
    edges = checkpointed(g.edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w")).where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    size = edges.count()
    for _ in range(max_levels):
        if size <= local_links:
            break
        lab = _level(edges, max_rounds)
        if lab is None:
            break
        names, edges = _contracted(names, edges, lab)
        size = edges.count()
    if 0 < size <= local_links:
        names, _ = _contracted(names, edges, _local_louvain(edges))
    least = names.groupBy("c").agg(F.min("id").alias("community"))
    return names.join(least, "c").select("id", "community")


def _contracted(names: DataFrame, edges: DataFrame, lab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names(id, c) and edges after each node v has become its community lab(v, c)."""
    names = checkpointed(names.join(lab.select(F.col("v").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")))
    to = lambda end, name: lab.select(F.col("v").alias(end), F.col("c").alias(name))
    return names, checkpointed(edges.join(to("src", "a"), "src").join(to("dst", "b"), "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")))


def _level(edges: DataFrame, max_rounds: int) -> DataFrame | None:
    """v, c: communities by the least of their nodes; None if the moves gain nothing."""
    both = checkpointed(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    k = checkpointed(both.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("k")))
    two_m = k.agg(F.sum("k")).first()[0]

    def quality(lab: DataFrame) -> float:
        x = both.join(lab.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(lab.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst")
        per = x.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("d"))
        return per.agg(F.sum(F.col("i") / two_m - F.pow(F.col("d") / two_m, 2))).first()[0]

    start = lab = k.select("v", F.col("v").alias("c"), F.pmod(F.xxhash64("v"), F.lit(2)).alias("turn"))
    quiet = 0
    for r in range(max_rounds):
        tot = lab.join(k, "v").groupBy("c").agg(F.sum("k").alias("tot"))
        to = both.where("src <> dst").join(lab.select(F.col("v").alias("dst"), F.col("c").alias("nc")), "dst").groupBy(F.col("src").alias("v"), "nc").agg(F.sum("w").alias("w"))
        now = lab.where(F.col("turn") == r % 2).join(k, "v")
        own = now.select("v", F.col("c").alias("nc"), F.lit(0.0).alias("w"))
        choice = to.join(now.select("v"), "v", "left_semi").unionByName(own).groupBy("v", "nc").agg(F.sum("w").alias("w"))
        scored = choice.join(now.select("v", "c", "k"), "v").join(tot.withColumnRenamed("c", "nc"), "nc", "left")
        rest = F.coalesce("tot", F.lit(0.0)) - F.when(F.col("nc") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / two_m, 9)
        best = scored.select("v", "c", "nc", gain.alias("gain")).groupBy("v", "c").agg(F.min(F.struct((-F.col("gain")).alias("g"), "nc")).alias("b"), F.max(F.when(F.col("nc") == F.col("c"), F.col("gain"))).alias("stay"))
        moved = best.where((-F.col("b.g")) > F.col("stay")).select("v", F.col("b.nc").alias("new"))
        nxt = checkpointed(lab.join(moved, "v", "left").select("v", F.coalesce("new", "c").alias("c"), "turn", F.col("new").isNotNull().alias("m")))
        quiet = 0 if nxt.where("m").take(1) else quiet + 1
        lab = nxt.drop("m")
        if quiet == 2:
            break
    if quality(lab) <= quality(start) + 1e-7:
        return None
    least = lab.groupBy("c").agg(F.min("v").alias("least"))
    return checkpointed(lab.join(least, "c").select("v", F.col("least").alias("c")))


# Core nodes up to which the driver counts shortest paths itself; larger cores are dealt out by sources.
LOCAL_SOURCES = 300


def girvan_newman(g: Graph, communities: int = 10) -> DataFrame:
    """id, community: the edge of highest betweenness is removed (ties: the least) until the graph falls into that many parts.

    Each removal needs the shortest paths of the part it splits again. They are counted on Hung's core: a core node stands for
    itself and the nodes hung on it, and the edge of a hung node lies on the paths between that node and all others. The
    driver holds the core's links; of the hung nodes it holds the numbers and the first few that could be cut off.
    """
    h = Hung(g)
    hung = h.places.where("up = 1").select("id", "anchor", F.least("id", "anchor").alias("a"), F.greatest("id", "anchor").alias("b"))
    leaves = {r["anchor"]: r["n"] for r in hung.groupBy("anchor").agg(F.count("*").alias("n")).collect()}
    # each cut of a hung node makes a part, so no anchor loses more than that many
    first = hung.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("a", "b"))).where(F.col("r") <= communities)
    loose: dict = {}
    for r in first.orderBy("anchor", "r").collect():
        loose.setdefault(r["anchor"], []).append((r["a"], r["b"], r["id"]))
    adj: dict = {v: set() for v in leaves}
    for a, b in h.links.collect():
        adj.setdefault(a, set()).add(b)
    alone = h.places.where("up = 0 and known = 1").count() - len(adj)

    def part(v, seen: set) -> list:
        stack, got = [v], set()
        while stack:
            v = stack.pop()
            if v not in got:
                got.add(v)
                stack.extend(adj[v] - got)
        seen |= got
        return sorted(got)

    def best(nodes: list):
        """(-score, edge, hung node or None) of the part's edge to go, or None."""
        size = sum(1 + leaves.get(v, 0) for v in nodes)
        found = [((-_digits(2.0 * (size - 1)), loose[v][0][:2]), loose[v][0][2], v) for v in nodes if loose.get(v)]
        score = _edge_scores(g.spark, {v: adj[v] for v in nodes}, {v: 1 + leaves.get(v, 0) for v in nodes})
        found += [((-_digits(x), e), None, None) for e, x in score.items()]
        return min(found, key=lambda x: x[0]) if found else None

    seen: set = set()
    parts = [(p, best(p)) for v in sorted(adj) if v not in seen for p in [part(v, seen)]]
    cut: list = []
    while alone + len(cut) + len(parts) < communities and any(b for _, b in parts):
        i = min((i for i, (_, b) in enumerate(parts) if b), key=lambda i: parts[i][1][0])
        nodes, ((_, (a, b)), leaf, anchor) = parts.pop(i)
        if leaf is not None:
            loose[anchor].pop(0)
            leaves[anchor] -= 1
            cut.append(leaf)
        else:
            adj[a].discard(b)
            adj[b].discard(a)
        seen = set()
        parts += [(p, best(p)) for v in nodes if v not in seen for p in [part(v, seen)]]
    of = g.spark.createDataFrame([(v, p[0]) for p, _ in parts for v in p] or [("", "")], "anchor string, c string")
    out = g.spark.createDataFrame([(v,) for v in cut] or [(None,)], "id string").withColumn("cut", F.lit(True))
    at = checkpointed(h.places.join(F.broadcast(out), "id", "left").join(of, "anchor", "left").select("id", "known", F.when(F.col("cut"), F.col("id")).otherwise(F.coalesce("c", "id")).alias("c")))
    return at.where("known = 1").select("id", "c").join(at.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community")


def _digits(x: float) -> float:
    """Twelve digits of a score: sums of paths in another order still tie."""
    return float(f"{x:.11e}")


def _edge_scores(spark, adj: dict, weight: dict) -> dict:
    """(a, b) -> paths between all pairs that take the edge, over ordered pairs; a node stands for weight[v] nodes."""
    sources = sorted(adj)
    if len(sources) <= LOCAL_SOURCES:
        return _path_counts(adj, weight, sources)
    near, sc = spark.sparkContext.broadcast((adj, weight)), spark.sparkContext
    try:
        some = sc.parallelize(sources, 4 * sc.defaultParallelism).mapPartitions(lambda s: _path_counts(*near.value, list(s)).items())
        return dict(some.reduceByKey(lambda x, y: x + y).collect())
    finally:
        near.unpersist()


def _path_counts(adj: dict, weight: dict, sources: list) -> dict:
    """Brandes' accumulation on edges from the given sources."""
    score: dict = {}
    for s in sources:
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in sorted(adj[v]):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    sigma[w] = 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    c = sigma[v] / sigma[w] * (weight[w] + delta[w])
                    delta[v] += c
                    key = (v, w) if v < w else (w, v)
                    score[key] = score.get(key, 0.0) + weight[s] * c
    return score


def community_profile(g: Graph, partition: DataFrame, top: int = 5) -> DataFrame:
    """Per community: size, inside and outside edges, density, mean degree and its top nodes by degree."""
    p = partition.select("id", "community")
    c = g.group_sums(p)
    inside = c.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("n").alias("inside"))
    cross = c.where("ca <> cb")
    outside = cross.select(F.col("ca").alias("community"), "n").unionAll(cross.select(F.col("cb").alias("community"), "n")).groupBy("community").agg(F.sum("n").alias("outside"))
    d = g.degrees().select("id", "degree").join(p, "id")
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id")))
    per = ranked.groupBy("community").agg(F.count("*").alias("size"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "id")))), lambda s: s["id"]), ",").alias("top_nodes"))
    n, m = F.col("size"), F.coalesce(F.col("inside"), F.lit(0))
    return per.join(inside, "community", "left").join(outside, "community", "left").select("community", "size", m.alias("inside"), F.coalesce("outside", F.lit(0)).alias("outside"), F.round(F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(F.lit(0.0)), 6).alias("density"), "avg_degree", "top_nodes")


def community_types(g: Graph, partition: DataFrame) -> DataFrame:
    """community, node_type, n: the nodes of each type in each community."""
    return g.nodes.select("id", "node_type").join(partition.select("id", "community"), "id").groupBy("community", "node_type").agg(F.count("*").alias("n"))


def write_metrics(g: Graph, path: str) -> dict[str, str]:
    """The bundle of metric frames, each as JSON lines below `path`."""
    out = {}
    for name, frame in all_metrics(g).items():
        out[name] = f"{path}/{name}"
        frame.write.mode("overwrite").json(out[name])
    return out


def all_metrics(g: Graph) -> dict[str, DataFrame]:
    """The bundle of metric frames, lazily."""
    from . import graph as gr

    return {
        "basic": gr.basic_metrics(g), "statistics": gr.statistics(g), "node_types": gr.node_type_analysis(g), "edge_types": gr.edge_type_analysis(g), "clustering": gr.clustering_summary(g), "assortativity": gr.assortativity(g),
        "degree": gr.degree_centrality(g), "pagerank": pagerank(g), "betweenness": betweenness(g, k=min(100, max(1, g.nodes.count()))), "hubs": gr.hub_profile(g), "type_connectivity": gr.type_connectivity(g),
    }
