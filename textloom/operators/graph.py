"""The property graph: assembly, validation, statistics and sub-graphs.

A graph is two DataFrames, nodes(id, node_type, label, metadata) and edges(id, src, dst,
edge_type, weight, metadata). It is undirected and simple: one edge per unordered pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graph as gx
from ..schemas import ALLOWED_EDGES, EDGE_TYPES, NODE_TYPES
from .components import connected_components


def no_metadata() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def make_nodes(df: DataFrame, node_type: str, id: Column, label: Column, metadata: Column | None = None) -> DataFrame:
    return df.select(id.alias("id"), F.lit(node_type).alias("node_type"), label.alias("label"), (metadata if metadata is not None else no_metadata()).alias("metadata"))


def make_edges(df: DataFrame, edge_type: str, src: Column, dst: Column, weight: Column, kind: str | None = None, metadata: Column | None = None) -> DataFrame:
    """Edge rows with id `{kind}_{src}_{dst}` and the weight rule of their type."""
    return df.select(
        gx.edge_id(kind or edge_type, src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("edge_type"),
        gx.edge_weight(F.lit(edge_type), weight.cast("double")).alias("weight"), (metadata if metadata is not None else no_metadata()).alias("metadata"),
    )


def oriented(edges: DataFrame) -> DataFrame:
    """Edges with src <= dst."""
    return edges.select("id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "edge_type", "weight", "metadata")


def assemble_nodes(parts: list[DataFrame]) -> DataFrame:
    """Node lists in order; the last of an id wins."""
    seq = [p.withColumn("_seq", F.lit(i)) for i, p in enumerate(parts)]
    # maps can't be compared, so the winner is chosen by its place alone
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), seq)
    return both.groupBy("id").agg(F.max_by(F.struct("node_type", "label", "metadata"), F.struct("_seq", "label")).alias("x")).select("id", "x.*")


def assemble_edges(parts: list[DataFrame]) -> DataFrame:
    """Edge lists in order; the last of an unordered pair wins; src <= dst."""
    seq = [p.withColumn("_seq", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), seq)
    c = both.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return c.groupBy("_a", "_b").agg(F.max_by(F.struct("id", "edge_type", "weight", "metadata"), F.struct("_seq", "id", "weight")).alias("x")).select(F.col("x.id").alias("id"), F.col("_a").alias("src"), F.col("_b").alias("dst"), "x.edge_type", "x.weight", "x.metadata")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def persist(self) -> Graph:
        return Graph(self.nodes.persist(), self.edges.persist())

    def both_ways(self) -> DataFrame:
        """src, dst, weight, edge_type in both directions; loops once."""
        e = self.edges.select("src", "dst", "weight", "edge_type")
        return e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type"))

    def typed_edges(self) -> DataFrame:
        """Edges with src_type and dst_type (null where the node is missing)."""
        t = self.nodes.select("id", "node_type")
        return self.edges.join(t.select(F.col("id").alias("src"), F.col("node_type").alias("src_type")), "src", "left").join(t.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type")), "dst", "left")

    def degrees(self) -> DataFrame:
        """id, node_type, degree; isolated nodes have 0."""
        d = self.both_ways().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("id", "node_type").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))

    def induced(self, ids: DataFrame) -> Graph:
        """The sub-graph on ids(id)."""
        i = ids.select("id").distinct()
        e = self.edges.join(i.withColumnRenamed("id", "src"), "src", "left_semi").join(i.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes.join(i, "id", "left_semi"), e)

    def of_type(self, node_type: str) -> Graph:
        return self.induced(self.nodes.where(F.col("node_type") == node_type))

    def edge_induced(self, condition: Column) -> Graph:
        """The edges that fulfil the condition and their endpoints."""
        e = self.edges.where(condition)
        ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
        return Graph(self.nodes.join(ends, "id", "left_semi"), e)

    def components(self) -> DataFrame:
        """id, component (its least id), isolated nodes included."""
        c = connected_components(self.edges.select("src", "dst"))
        return self.nodes.select("id").join(c.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


    # What the operators below ask for; a graph that doesn't hold its edges as rows answers without them.

    def edge_types(self) -> DataFrame:
        """edge_type, n_edges, avg_weight, min_weight, max_weight, std_weight."""
        return self.edges.groupBy("edge_type").agg(F.count("*").alias("n_edges"), *(f("weight").alias(f"{k}_weight") for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))))

    def total_weight(self) -> DataFrame:
        """One number, m; an edge without a weight counts as 1."""
        return self.edges.agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("m"))

    def type_counts(self) -> DataFrame:
        """src_type, dst_type, n: edges by the types of their ends."""
        return self.typed_edges().groupBy("src_type", "dst_type").agg(F.count("*").alias("n"))

    def own_degrees(self) -> DataFrame:
        """id, d: edges to nodes of the same type, where there are any."""
        own = self.typed_edges().where("src_type = dst_type")
        sym = own.select(F.col("src").alias("id")).unionAll(own.where("src <> dst").select(F.col("dst").alias("id")))
        return sym.groupBy("id").agg(F.count("*").alias("d"))

    def doubtful(self) -> Graph:
        """The part whose edges need validation."""
        return self

    def neighbour_types(self, ids: DataFrame) -> DataFrame:
        """id, neighbour_type, n of the given ids."""
        return neighbours(self, ids).groupBy("id", "neighbour_type").agg(F.count("*").alias("n"))

    def degree_correlation(self) -> DataFrame:
        """One number, r: Pearson correlation of the degrees at both ends."""
        d = self.degrees().select("id", F.col("degree").cast("double").alias("degree"))
        e = self.both_ways().select("src", "dst")
        e = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("y")), "dst")
        return e.agg(F.corr("x", "y").alias("r"))

    def triangles(self) -> DataFrame:
        """id, triangles: per node. Edges point from lower to higher degree, so a hub's list stays short."""
        deg = self.degrees().select("id", "degree")
        e = self.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        e = e.join(deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
        up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        o = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
        wedge = o.alias("x").join(o.alias("y"), F.col("x.u") == F.col("y.u")).where("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
        closed = wedge.join(e.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
        return closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))

    def group_sums(self, partition: DataFrame) -> DataFrame:
        """ca, cb, n, w: edges and weight between the communities of partition(id, community); a pair may come in both orders."""
        p = partition.select("id", "community")
        e = self.edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w"))
        e = e.join(p.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(p.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
        return e.groupBy("ca", "cb").agg(F.count("*").alias("n"), F.sum("w").alias("w"))

    def similar_documents(self, top: int) -> DataFrame:
        """src, dst, weight of documents' similarity edges in both directions; the best `top` of each src are among them."""
        e = self.both_ways().where("edge_type = 'similarity'")
        d = self.nodes.where("node_type = 'document'").select("id")
        return e.join(d.withColumnRenamed("id", "src"), "src", "left_semi").join(d.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")

    def similarity_network(self, least: float) -> Graph:
        """The similarity edges of at least that weight and their endpoints."""
        return self.edge_induced((F.col("edge_type") == "similarity") & (F.col("weight") >= least))

    def renamed_edges(self, names: DataFrame) -> DataFrame:
        """src, dst, weight, edge_type with each end replaced by its name of names(id, name), whose order is that of the ids."""
        at = lambda end: names.select(F.col("id").alias(f"_{end}"), F.col("name").alias(end))
        e = self.edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "weight", "edge_type")
        return e.join(at("src"), "_src").join(at("dst"), "_dst").select("src", "dst", "weight", "edge_type")


def density(n: Column, m: Column) -> Column:
    return F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(F.lit(0.0))


def basic_metrics(g: Graph) -> DataFrame:
    d = g.degrees().agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("_deg"), F.max("degree").alias("max_degree"))
    m = g.edge_types().agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"))
    n, e = F.col("n_nodes"), F.col("n_edges")
    return d.join(F.broadcast(m)).select("n_nodes", "n_edges", F.round(density(n, e), 9).alias("density"), F.round(F.try_divide(2.0 * e, n), 6).alias("avg_degree"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"))


def statistics(g: Graph) -> DataFrame:
    """One row: counts by type, density, degrees, components, mean weight per edge type."""
    nodes = g.nodes.agg(*(F.count_if(F.col("node_type") == t).alias(f"n_{t}") for t in NODE_TYPES))
    of = lambda t, c: F.max(F.when(F.col("edge_type") == t, F.col(c)))
    edges = g.edge_types().agg(*(F.coalesce(of(t, "n_edges"), F.lit(0)).alias(f"n_{t}") for t in EDGE_TYPES), *(F.round(of(t, "avg_weight"), 6).alias(f"mean_{t}") for t in EDGE_TYPES))
    comp = g.components().groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("n_components"), F.max("size").alias("largest_component"))
    return basic_metrics(g).join(F.broadcast(nodes)).join(F.broadcast(edges)).join(F.broadcast(comp))


def degree_histogram(g: Graph) -> DataFrame:
    return g.degrees().groupBy("degree").agg(F.count("*").alias("n_nodes"))


def node_type_analysis(g: Graph) -> DataFrame:
    """Per node type: count, share, and degrees and density in the sub-graph of its own type."""
    deg = g.own_degrees()
    m = g.type_counts().where("src_type = dst_type").select(F.col("src_type").alias("node_type"), F.col("n").alias("m"))
    per = g.nodes.join(deg, "id", "left").groupBy("node_type").agg(F.count("*").alias("n_nodes"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum("d"), F.lit(0)).alias("_sum"))
    total = F.sum("n_nodes").over(Window.partitionBy())
    n, e = F.col("n_nodes"), F.coalesce(F.col("m"), F.lit(0))
    return per.join(m, "node_type", "left").select("node_type", "n_nodes", F.round(100.0 * n / total, 6).alias("percent"), F.round(F.col("_sum") / n, 6).alias("avg_degree"), "max_degree", F.round(density(n, e), 9).alias("density"))


def edge_type_analysis(g: Graph) -> DataFrame:
    per = g.edge_types().select("edge_type", "n_edges", *(F.round(f"{k}_weight", 6).alias(f"{k}_weight") for k in ("avg", "min", "max", "std")))
    return per.withColumn("percent", F.round(100.0 * F.col("n_edges") / F.sum("n_edges").over(Window.partitionBy()), 6))


def type_connectivity(g: Graph, double_diagonal: bool = False) -> DataFrame:
    """Edges per unordered pair of node types, in both orders; same-type edges count once (twice if asked for)."""
    t = g.type_counts().select("src_type", "dst_type", "n")
    other = t.where("src_type <> dst_type") if not double_diagonal else t
    return t.union(other.select("dst_type", "src_type", "n")).groupBy("src_type", "dst_type").agg(F.sum("n").alias("n_edges"))


def validate_nodes(g: Graph) -> DataFrame:
    """id and errors of each bad node."""
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id"), F.when(F.coalesce(F.col("label"), F.lit("")) == "", "missing label"), F.when(~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False)), "unknown type"),
    ))
    return g.nodes.select("id", errors.alias("errors")).where(F.size("errors") > 0)


def validate_edges(g: Graph) -> DataFrame:
    """id and errors of each bad edge: endpoints, loop, type, weight, and the types that its kind may join."""
    allowed = g.spark.createDataFrame(list(ALLOWED_EDGES), "src_type string, dst_type string, edge_type string").withColumn("_ok", F.lit(True))
    e = g.doubtful().typed_edges()
    forward = e.join(F.broadcast(allowed), ["src_type", "dst_type", "edge_type"], "left")
    back = allowed.select(F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), "edge_type", F.lit(True).alias("_ok2")).distinct()
    e = forward.join(F.broadcast(back), ["src_type", "dst_type", "edge_type"], "left")
    missing = F.col("src_type").isNull() | F.col("dst_type").isNull()
    errors = F.array_compact(F.array(
        F.when(missing, "missing endpoint"), F.when(F.col("src") == F.col("dst"), "loop"), F.when(~F.coalesce(F.col("edge_type").isin(*EDGE_TYPES), F.lit(False)), "unknown type"),
        F.when((F.col("edge_type") != "cooccurrence") & ((F.col("weight") < 0) | F.col("weight").isNull()), "bad weight"), F.when((F.col("edge_type") == "similarity") & (F.col("weight") > 1), "weight over 1"),
        F.when(~missing & F.coalesce("_ok", "_ok2").isNull(), "types not allowed"),
    ))
    return e.select("id", errors.alias("errors")).where(F.size("errors") > 0)


def validate_graph(g: Graph, level: str = "comprehensive") -> DataFrame:
    """One row: is_valid, errors, warnings, recommendations."""
    s = statistics(g).withColumn("n_bad_nodes", F.lit(validate_nodes(g).count())).withColumn("n_bad_edges", F.lit(validate_edges(g).count()))
    full, strict = F.lit(level in ("comprehensive", "strict")), F.lit(level == "strict")
    kinds = sum((F.when(F.col(f"n_{t}") > 0, 1).otherwise(0) for t in EDGE_TYPES), F.lit(0))
    none = F.lit(None).cast("string")
    errors = F.array_compact(F.array(
        F.when(F.col("n_nodes") == 0, "graph is empty"), F.when(full & (F.col("n_bad_nodes") > 0), "bad nodes"), F.when(full & (F.col("n_bad_edges") > 0), "bad edges"),
        F.when(strict & (kinds < len(EDGE_TYPES)), "required edge types are missing"), none,
    ))
    warnings = F.array_compact(F.array(
        F.when((F.col("n_nodes") > 0) & (F.col("n_edges") == 0), "no edges"), F.when(full & (F.col("n_components") > 1), "not connected"), F.when(full & (F.col("n_document") < 10), "fewer than 10 documents"),
        F.when(full & (F.col("n_document") < 0.1 * F.col("n_nodes")), "few documents among the nodes"), F.when(full & (kinds < 2), "fewer than two edge types"),
        F.when(strict & (F.col("density") > 0.1), "dense"), F.when(strict & (F.col("largest_component") < 0.8 * F.col("n_nodes")), "largest component under 80 %"), none,
    ))
    advice = F.array_compact(F.array(F.when(F.col("n_components") > 1, "lower the similarity thresholds"), F.when(F.col("n_edges") == 0, "check the edge builders"), none))
    return s.select((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"), advice.alias("recommendations"))


def recommendations(g: Graph) -> DataFrame:
    """One row of flags for tuning."""
    s = statistics(g)
    return s.select(
        (F.col("density") < 0.001).alias("sparse"), (F.col("density") > 0.01).alias("dense"), (F.col("n_components") > 0.1 * F.col("n_nodes")).alias("fragmented"), (F.col("max_degree") > 10 * F.col("avg_degree")).alias("has_hubs"),
        (F.col("n_concept") < 100).alias("few_concepts"), (F.col("n_entity") < 0.5 * F.col("n_document")).alias("few_entities"),
    )


def compare(graphs: dict[str, Graph]) -> DataFrame:
    """Basic metrics and components of several graphs, a row each."""
    rows = [statistics(g).select(F.lit(name).alias("graph"), "n_nodes", "n_edges", "density", "avg_degree", "n_components") for name, g in graphs.items()]
    return reduce(DataFrame.unionByName, rows)


def neighbours(g: Graph, ids: DataFrame) -> DataFrame:
    """id, neighbour, neighbour_type, weight of the given ids."""
    e = g.both_ways().join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return e.join(g.nodes.select(F.col("id").alias("dst"), "node_type"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.col("node_type").alias("neighbour_type"), "weight", "edge_type")


def top_hubs(g: Graph, top: int = 10) -> DataFrame:
    return g.degrees().orderBy(F.desc("degree"), "id").limit(top)


def hub_profile(g: Graph, top: int = 10) -> DataFrame:
    """The top hubs with the number of neighbours of each type and their local clustering."""
    hubs = top_hubs(g, top)
    kinds = g.neighbour_types(hubs).groupBy("id").agg(*(F.sum(F.when(F.col("neighbour_type") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in NODE_TYPES))
    return hubs.join(kinds, "id", "left").join(clustering(g).select("id", F.round("clustering", 6).alias("clustering")), "id", "left")


def document_neighbours(g: Graph, top: int = 10) -> DataFrame:
    """Each document's most similar documents by its similarity edges."""
    e = g.similar_documents(top)
    w = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 6)), "dst")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("src", "dst", F.round("weight", 6).alias("weight"), "rank")


def triangles(g: Graph) -> DataFrame:
    return g.triangles()


def clustering(g: Graph) -> DataFrame:
    """id, triangles, clustering (0 under two neighbours)."""
    d = g.degrees().select("id", "degree").join(triangles(g), "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return d.select("id", "degree", "triangles", F.when(pairs > 0, 2.0 * F.col("triangles") / pairs).otherwise(F.lit(0.0)).alias("clustering"))


def clustering_summary(g: Graph) -> DataFrame:
    c = clustering(g)
    return c.agg(F.round(F.avg("clustering"), 6).alias("avg_clustering"), F.round(F.coalesce(F.try_divide(2.0 * F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1))), F.lit(0.0)), 6).alias("transitivity"))


def assortativity(g: Graph) -> DataFrame:
    """Pearson correlation of the degrees at both ends of the edges; 0 where undefined."""
    return g.degree_correlation().select(F.round(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)), 6).alias("assortativity"))


def degree_centrality(g: Graph) -> DataFrame:
    n = F.lit(g.nodes.count())
    return g.degrees().select("id", "node_type", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(0.0)).alias("centrality"))


def min_max(df: DataFrame, c: str) -> DataFrame:
    """c scaled to 0 to 1 over all rows; 0 where all are equal. A two-number aggregate is broadcast, no global window."""
    r = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    return df.join(F.broadcast(r)).withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")
