"""Queries whose cost grew faster than their input."""

import pytest

from textloom.operators import community, paths
from textloom.operators.graph import Graph


def graph(spark, ids, links):
    nodes = spark.createDataFrame([(i, "document", i) for i in ids], "id string, node_type string, label string")
    return Graph(nodes, spark.createDataFrame([(min(x), max(x), 1.0, "x") for x in links], "src string, dst string, weight double, edge_type string"))


@pytest.fixture(scope="module")
def star_ring(spark):
    """A ring of three with 400 nodes hung on it, a pair and a lone node."""
    links = [("r0", "r1"), ("r1", "r2"), ("r0", "r2"), ("p0", "p1")] + [(f"r{i % 3}", f"x{i}") for i in range(400)]
    ids = {v for x in links for v in x} | {"lone"}
    return graph(spark, sorted(ids), links), links, ids


def brute(links, ids):
    near = {v: set() for v in ids}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for s in ids:
        seen, front = {s: 0}, [s]
        for v in front:
            for w in near[v] - seen.keys():
                seen[w] = seen[v] + 1
                front.append(w)
        out[s] = seen
    return out


def test_all_pairs_of_hung_nodes_pass_through_no_search(spark, star_ring, monkeypatch):
    g, links, ids = star_ring
    searched, search = [], paths._search

    def counted(e, sources, *rest):
        searched.append(sources.count())
        return search(e, sources, *rest)

    monkeypatch.setattr(paths, "_search", counted)
    want = brute(links, ids)
    got = {}
    for r in paths.distances(g).collect():
        got.setdefault(r.source, {})[r.id] = r.distance
    assert got == want and searched == [5]
    near = {r.id: r.closeness for r in paths.closeness(g).collect()}
    n = len(ids)
    assert near == pytest.approx({v: (len(d) - 1) / max(1, sum(d.values())) * (len(d) - 1) / (n - 1) for v, d in want.items()})
    far = [d for s in want for v, d in want[s].items() if "r0" in want[s] and v != s]
    assert tuple(paths.path_summary(g).first()) == (max(far), round(sum(far) / len(far), 6))


def test_girvan_newman_is_not_bounded_by_a_node_count(spark, star_ring, monkeypatch):
    g, _, ids = star_ring
    got = {r.id: r.community for r in community.girvan_newman(g, 6).collect()}
    assert set(got) == ids and len(set(got.values())) == 6
    # the ring is cut first; then the least edge of the largest star goes
    alone = [v for v in ids if got[v] == v and list(got.values()).count(v) == 1]
    assert {"lone", "x0"} <= set(alone) and got["x3"] == "r0" and got["x1"] == "r1" and got["p1"] == "p0"
    monkeypatch.setattr(community, "LOCAL_SOURCES", 0)
    assert {r.id: r.community for r in community.girvan_newman(g, 6).collect()} == got


@pytest.fixture(scope="module")
def both_forms(spark):
    """A graph of 260 vectors in three groups, some without one, and the same graph with its edges as rows."""
    import random

    from pyspark.sql import functions as F

    from textloom.operators import similar
    from textloom.operators.graph import make_edges
    from textloom.operators.similar_graph import SimilarGraph

    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], i % 3) for i in range(260)] + [(260, [0.0] * 8, 1), (261, None, 2)]
    doc, con = (lambda c: F.concat(F.lit("doc_"), c)), (lambda c: F.concat(F.lit("con_"), c))
    v = spark.createDataFrame(rows, "id bigint, vector array<float>, g int")
    nodes = spark.createDataFrame([(f"doc_{i}", "document", "d") for i, _, _ in rows] + [(f"con_{i}", "concept", "c") for i in range(3)], "id string, node_type string, label string")

    def links(groups):
        return make_edges(v, "relevance", doc("id"), con("g"), F.lit(0.5)).unionByName(make_edges(groups.where("g1 < g2"), "cooccurrence", con("g1"), con("g2"), F.col("n") / 10))

    old = similar.BLOCK_ROWS, similar.TRIPLE_ROWS
    similar.BLOCK_ROWS, similar.TRIPLE_ROWS = 70, 90
    try:
        g = SimilarGraph(nodes, links, v, 0.5, doc, con)
        yield g, Graph(nodes, spark.createDataFrame(g.edges.collect(), g.edges.schema))
    finally:
        similar.BLOCK_ROWS, similar.TRIPLE_ROWS = old


def close(a, b):
    key = lambda r: [str(round(x, 9)) if isinstance(x, float) else str(x) for x in r]
    a, b = sorted(map(tuple, a), key=key), sorted(map(tuple, b), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert list(x) == [pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for v in y]


def test_a_similarity_graph_gives_what_its_rows_give(spark, both_forms):
    from pyspark.sql import functions as F

    from textloom.operators import export
    from textloom.operators import graph as gr

    g, rows = both_forms
    n = rows.edges.where("edge_type = 'similarity'").count()
    assert n > 1000 and g.all_pairs().first()["n"] == n
    for f in (gr.statistics, gr.node_type_analysis, gr.edge_type_analysis, gr.type_connectivity, gr.clustering, gr.assortativity, gr.hub_profile, gr.document_neighbours, gr.validate_graph, gr.degree_centrality, export.d3_links):
        close(f(g).collect(), f(rows).collect())
    close(g.components().collect(), rows.components().collect())
    close(export.similarity_network(g, 0.8).nodes.select("id").collect(), export.similarity_network(rows, 0.8).nodes.select("id").collect())
    close(g.of_type("document").edges.select("src", "dst").collect(), rows.of_type("document").edges.select("src", "dst").collect())
    part = rows.nodes.select("id", F.concat(F.lit("c"), F.length("id")).alias("community"))
    close(community.modularity(g, part).collect(), community.modularity(rows, part).collect())
    close(community.community_profile(g, part).collect(), community.community_profile(rows, part).collect())


def test_no_pair_leaves_its_block_as_a_row(spark, both_forms, monkeypatch):
    """The sums come without similarity_pairs(), which makes the rows."""
    from textloom.operators import graph as gr
    from textloom.operators import similar

    monkeypatch.setattr(similar, "similarity_pairs", lambda *a: pytest.fail("pairs as rows"))
    g, _ = both_forms
    for f in (gr.statistics, gr.node_type_analysis, gr.clustering_summary, gr.assortativity, gr.hub_profile, gr.document_neighbours, gr.validate_graph, gr.recommendations):
        assert f(g).collect()


def test_scores_are_counted_and_ranked_in_their_blocks(spark, both_forms):
    from textloom.operators import similar, vectors

    g, rows = both_forms
    v = g.vectors.select("id", "vector")
    sims = similar.similarity_pairs(v, 0.5)
    close(similar.distribution(v, 0.5).collect(), vectors.distribution(sims).collect())
    for mode in ("lower_id", "mutual", "union"):
        close(vectors.nearest_pairs(v, 0.5, 4, mode).collect(), vectors.top_neighbours(sims, 4, mode).collect())
    assert similar.top_pairs(v, 0.5, 4).count() < 2 * sims.count()


def test_top_candidates_count_few_grams(spark, monkeypatch):
    """The same rows as counting every gram, from the grams that can be among them; and where nothing can be pruned."""
    import random

    from pyspark.sql import functions as F

    from textloom.operators import concepts, grams

    rnd = random.Random(1)
    words = [f"word{i}" for i in range(400)] + ["the", "of"]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=rnd.randint(0, 60)))) for i in range(400)] + [(400, None), (401, " \n "), (402, "One, ONE word0-x word0")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counted, counts = [], grams._counts
    monkeypatch.setattr(grams, "_counts", lambda *a: counted.append(counts(*a)) or counted[-1])
    for strict in (False, True):
        every = concepts.candidate_counts(d, strict=strict)
        want = [tuple(r) for r in every.orderBy(F.desc("total"), "gram").limit(20).collect()]
        assert [tuple(r) for r in concepts.top_candidates(d, 20, strict).collect()] == want
        assert counted.pop().count() < every.count() / 20
    monkeypatch.setattr(grams, "COMMON_WORDS", 3)
    assert [tuple(r) for r in concepts.top_candidates(d, 20, True).collect()] == want
    monkeypatch.setattr(grams, "MOST_WORDS", 5)
    counted.clear()
    assert [tuple(r) for r in concepts.top_candidates(d, 20, True).collect()] == want and not counted


def test_terms_are_found_without_exploding_the_texts(spark, monkeypatch):
    from textloom.operators import concepts

    d = spark.createDataFrame([(1, "A b a B c"), (2, None), (3, ""), (4, "c"), (5, "b c a b")], "doc_id bigint, text string")
    t = concepts.dictionary(spark, ("a", "a b", "b c a", "x"))
    monkeypatch.setattr(concepts, "BROADCAST_TERMS", -1)
    want = sorted(map(tuple, concepts.occurrences(d, t).collect()))
    monkeypatch.setattr(concepts, "BROADCAST_TERMS", 100)
    monkeypatch.setattr(concepts, "ngrams", lambda *a: pytest.fail("every n-gram as a row"))
    assert sorted(map(tuple, concepts.occurrences(d, t).collect())) == want and len(want) == 7


def test_singular_vectors_come_from_one_pass(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from textloom.operators import vectors

    x = np.round(np.random.default_rng(2).normal(size=(60, 150)) * (np.random.default_rng(3).random((60, 150)) < 0.2), 3)
    rows = [(Vectors.dense(r) if i % 2 else Vectors.sparse(150, [(int(j), float(r[j])) for j in np.flatnonzero(r)]),) for i, r in enumerate(x)]
    v = vectors.leading_vectors(spark.createDataFrame(rows, ["y"]).repartition(3), 150, 10)
    want = np.linalg.svd(x)[2][:10].T
    assert v.shape == (150, 10) and np.allclose(np.abs((v * want).sum(axis=0)), 1.0)
