"""Operators on inputs with known answers."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from textloom import config, schemas
from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import community, concepts, cooccurrence, export, extract, graph, paths, rank, relational, vectors
from textloom.operators.graph import Graph
from textloom.plans import pipeline


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame([("doc_1", "document", "a", {}), ("doc_2", "document", "b", {}), ("sec_1", "section", "c", {})], schemas.NODES)
    edges = spark.createDataFrame([("e1", "doc_1", "doc_2", "similarity", 0.8, {}), ("e2", "doc_1", "sec_1", "hierarchical", 1.0, {})], schemas.EDGES)
    return Graph(nodes, edges)


def test_toy_graph(toy):
    b = graph.basic_metrics(toy).first()
    assert (b.n_nodes, b.n_edges, round(b.density, 6), b.avg_degree, b.max_degree) == (3, 2, 0.666667, 1.333333, 2)
    s = graph.statistics(toy).first()
    assert (s.n_components, s.largest_component, s.mean_similarity) == (1, 3, 0.8)
    assert {r.degree: r.n_nodes for r in graph.degree_histogram(toy).collect()} == {1: 2, 2: 1}
    c = graph.clustering_summary(toy).first()
    assert (c.avg_clustering, c.transitivity) == (0, 0)
    p = paths.path_summary(toy).first()
    assert (p.diameter, p.avg_path_length) == (2, 1.333333)
    once = {(r.src_type, r.dst_type): r.n_edges for r in graph.type_connectivity(toy).collect()}
    twice = {(r.src_type, r.dst_type): r.n_edges for r in graph.type_connectivity(toy, True).collect()}
    assert once["document", "document"] == 1 and twice["document", "document"] == 2 and once["document", "section"] == 1
    assert graph.validate_nodes(toy).count() == graph.validate_edges(toy).count() == 0


def test_centralities(spark, toy):
    pr = {r.id: r["rank"] for r in rank.pagerank(toy, iterations=60, weighted=False).collect()}
    assert math.isclose(sum(pr.values()), 1, abs_tol=1e-9) and pr["doc_1"] == max(pr.values())
    b = {r.id: r.betweenness for r in paths.betweenness(toy).collect()}
    assert b == {"doc_1": 1.0, "doc_2": 0.0, "sec_1": 0.0}
    e = {r.id: r.centrality for r in rank.eigenvector(toy).collect()}
    assert math.isclose(e["doc_1"], math.sqrt(0.5), abs_tol=1e-4)


def test_communities(spark):
    names = [f"n{i}" for i in range(8)]
    pairs = [(a, b) for g in (names[:4], names[4:]) for i, a in enumerate(g) for b in g[i + 1 :]] + [("n0", "n4")]
    g = Graph(spark.createDataFrame([(n, "document", n, {}) for n in names], schemas.NODES), spark.createDataFrame([(f"{a}{b}", a, b, "similarity", 1.0, {}) for a, b in pairs], schemas.EDGES))
    want = {n: "n0" if i < 4 else "n4" for i, n in enumerate(names)}
    assert {r.id: r.community for r in community.louvain(g).collect()} == want
    assert {r.id: r.community for r in community.girvan_newman(g, 2).collect()} == want
    assert set(dict(community.label_propagation(g).collect())) == set(names)
    q = community.modularity(g, spark.createDataFrame(list(want.items()), "id string, community string")).first()[0]
    assert math.isclose(q, 2 * (6 / 13 - (13 / 26) ** 2), abs_tol=1e-6)


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.EDGES))
    assert graph.basic_metrics(g).first().n_nodes == 0 and g.components().count() == 0 and rank.pagerank(g).count() == 0
    assert graph.validate_graph(g).first().errors == ["graph is empty"]


def test_edges_are_simple_and_last_wins(spark):
    a = spark.createDataFrame([("a", "b", 0.2)], "x string, y string, w double")
    one_, two = graph.make_edges(a, "similarity", F.col("x"), F.col("y"), F.col("w")), graph.make_edges(a, "relevance", F.col("y"), F.col("x"), -F.col("w"))
    r = graph.assemble_edges([one_, two]).collect()
    assert [(x.id, x.src, x.dst, x.edge_type, x.weight) for x in r] == [("relevance_b_a", "a", "b", "relevance", 0.0)]
    big = graph.make_edges(a, "similarity", F.col("x"), F.col("y"), F.lit(1.0000002)).first()
    assert big.weight == 1.0


def test_pmi(spark):
    c = cooccurrence.pmi_confidence
    rows = spark.createDataFrame([(4, 6, 5), (2, 4, 10), (5, 5, 5)], "j int, a int, b int").select(c(F.col("j"), F.col("a"), F.col("b")).alias("c"))
    assert [round(r.c, 6) for r in rows.collect()] == [0.9, 0.6, 1.0]
    d = spark.createDataFrame([(1, "x y " * 6), (2, "x q q q q q q q q y q q"), (3, "x y")], "doc_id int, text string")
    p = cooccurrence.pmi_pairs(d, concepts.dictionary(spark, ["x", "y"]), size=10, min_freq=1).first()
    # three windows of the first text and the first of the second hold both terms: every window does
    assert (p.joint, p.total, p.pmi) == (4, 4, 0.0) and p.npmi is None


def test_load_processes(spark):
    ts = datetime.datetime(2024, 1, 1)
    long = "x" * 101
    p = spark.createDataFrame([(1, "n1", "u", long, ts, "processado", "h", 0, ts, ts), (2, "n2", "u", "short", ts, "processado", "h", 0, ts, ts), (3, "n3", "u", long, ts, "coletado", "h", 0, ts, ts)], schemas.PROCESSES)
    m = spark.createDataFrame([(i, 1, "o", "c", "r", "cl", "co", "a", "au", "re", None, "t", ts) for i in (1, 2)], schemas.METADATA)
    c = spark.createDataFrame([(i, 1, "ementa", None, "t", "t", i, ts) for i in (1, 2, 3)], schemas.CONTENT)
    assert [(r.id, r.num_secoes) for r in relational.load_processes(p, m, c).collect()] == [(1, 3)]
    assert [(r.id, r.num_secoes) for r in relational.load_processes(p, m, c, fan_out=True).collect()] == [(1, 6)]
    assert {r.id for r in relational.load_processes(p, m, c, ("processado", "coletado"), include_empty=True).collect()} == {1, 2, 3}
    assert relational.load_sections(c, p.where("id = 2").select("id")).count() == 0


def test_text_functions(spark):
    html = "<div><h1>ACÓRDÃO</h1><p>EMENTA: Este é um <strong>teste</strong> de limpeza de HTML.</p><script>x()</script><style>p{}</style></div>"
    got = one(spark, tx.clean_html("h"), h=html)
    assert got == "ACÓRDÃO EMENTA: Este é um teste de limpeza de HTML." and len(got) == 51
    t = "um\nVício"
    assert one(spark, tx.normalize_unicode("NFC", "space")("t"), t=t) == "um Vício"
    assert one(spark, tx.normalize_unicode("NFKD", "delete")("t"), t=t) == "umVício"
    assert one(spark, tx.proper_name("t"), t="JOÃO  da SILVA e souza") == "João da Silva e Souza"
    assert one(spark, tx.normalize_concept("t"), t="Superior Tribunal de Justiça") == "STJ"
    assert one(spark, tx.normalize_concept("t", False), t="Superior Tribunal de Justiça") == "superior TJ"
    assert one(spark, tx.process_number("t", F.lit("none")), t="x 0001234-56.2023.8.18.0001 y") == "0001234-56.2023.8.18.0001"
    assert one(spark, tx.date_or_null("t"), t="31/02/2024") is None
    assert one(spark, tx.count_of("t", "aa"), t="aaaaa") == 2
    assert one(spark, tx.word_count("t"), t="  ") == 0
    assert tuple(one(spark, tx.hex_to_rgb("t"), t="#1f77b4")) == (31, 119, 180)
    assert one(spark, F.col("t").rlike(tx.concept_pattern("dano moral")), t="os danos morais") and not one(spark, F.col("t").rlike(tx.concept_pattern("dolo")), t="idolo")
    assert one(spark, extract.section_type(F.col("t")), t="Decisão") == "decisao" and one(spark, extract.section_type(F.col("t")), t="x") == "outros"


def test_sections():
    f = extract.SectionFinder()
    body = "direito civil " * 12
    text = "EMENTA: " + body + "\nDISPOSITIVO: ante isso julgo procedente o pedido " + "nos termos da lei " * 10
    kinds = [(s[0], s[1]) for s in f.find(text)]
    assert kinds[0] == ("ementa", 0) and "dispositivo" in {k for k, _ in kinds}
    assert f.find("palavra " * 18) == []
    assert [s[0] for s in f.find("palavra " * 32)] == ["outros"]
    spans = [(s[1], s[2]) for s in f.find(text)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_entities():
    f = extract.EntityFinder()
    found = {(e[3], e[5]) for e in f.find("O Des. João Silva citou a Lei nº 8.078/90, o CDC, o Banco do Brasil e a 2ª Vara Cível")}
    assert {("juiz", "João Silva Citou"), ("lei", "CDC")} & found and ("lei", "Lei nº 8.078/90") in found and any(k == "orgao" for k, _ in found)
    assert f.find("BB") == [] and f.find("CPF: 123.456.789-00") == []
    assert extract.resolve_overlaps([(0, 5, 0.8, "a"), (3, 9, 0.9, "b"), (8, 12, 0.9, "c")]) == [(3, 9, 0.9, "b")]
    assert extract.resolve_overlaps([(0, 5, 0.8, "a"), (3, 9, 0.8, "b")]) == [(0, 5, 0.8, "a")]


def test_entity_frequency(spark):
    e = spark.createDataFrame([(1, "juiz", "A", "João", 0, 1, 0.9), (2, "pessoa", "B", "joão", 0, 1, 0.9), (2, "lei", "CDC", "CDC", 5, 8, 0.8)], "doc_id int, entity_type string, original string, name string, start int, end int, confidence double")
    assert [(r.name, r.entity_type, r.frequency) for r in extract.entity_frequency(e).collect()] == [("joão", "juiz", 2)]
    assert extract.entity_frequency(e, 1, True).count() == 3


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, vector array<double>")
    for rows in (2, 100):
        got = {(r.a, r.b): round(r.score, 6) for r in vectors.similarity_pairs(v, 0.05, rows).collect()}
        assert got == {(1, 2): 0.995037, (2, 3): 0.099504}
    assert [r.id for r in vectors.nearest(v, [0.0, 2.0], 2).collect()] == [3, 2]
    assert one(spark, F.size(vx.unit(F.array(F.lit(3.0), F.lit(4.0)))), t=1) == 2
    c = spark.createDataFrame([("k1", [1.0])], "key string, vector array<double>")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, text string")
    new = vectors.encode_missing(rows, c, lambda texts: [[float(len(t))] for t in texts], "m")
    assert new.count() == 2 and vectors.encode_missing(rows, new, lambda texts: 1 / 0, "m").count() == 0


def test_exports(spark, toy, tmp_path):
    out = export.write_tables(toy, f"file://{tmp_path}/g")
    back = export.read_graph(spark, f"file://{tmp_path}/g")
    assert sorted(map(str, back.edges.collect())) == sorted(map(str, toy.edges.collect())) and set(out) >= {"nodes", "edges_csv"}
    import json
    import xml.etree.ElementTree as et

    for f in (export.write_graphml, export.write_gexf):
        assert et.parse(f(toy, f"{tmp_path}/{f.__name__}.xml")).getroot() is not None
    assert len(json.load(open(export.write_node_link(toy, f"{tmp_path}/n.json")))["links"]) == 2
    assert [tuple(r) for r in export.d3_links(toy).orderBy("target").select("source", "target").collect()] == [(0, 1), (0, 2)]
    assert export.dense_adjacency(toy).orderBy("row").first()["doc_2"] == 0.8
    assert export.export_type(toy, "entity", f"{tmp_path}/none") == ""
    assert export.similarity_network(toy, 0.9).edges.count() == 0 and export.similarity_network(toy, 0.5).nodes.count() == 2


def test_config():
    assert config.config_for_size(100).max_similarity_edges == 20 and config.config_for_size(5000).chunk_size == 500
    assert config.recommended_thresholds(50) == {"similarity": 0.2, "relevance": 0.05, "pmi": 0.3}
    assert not config.validate_result({"load": True}, 0.5, 3)["is_valid"]
    assert config.PRESETS["production"].validation_level == "strict" and len(concepts.all_concepts()) == 56


def test_build(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    terms = concepts.dictionary(spark, ["the", "and", "that", "of the", "de", "la"])
    r = pipeline.build(docs, config.GraphConfig(link_entities=True, document_similarity=0.5), terms)
    kinds = {x.node_type for x in r.graph.nodes.select("node_type").distinct().collect()}
    assert {"document", "section", "concept"} <= kinds and r.summary["is_valid"]
    assert graph.validate_edges(r.graph).count() == 0
    assert r.statistics.first().n_relevance > 0


def test_streaming(spark, sf, tmp_path):
    from textloom.streaming import ingest

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = ingest.dedup_stream(s, "user_id", "ts", "3650 days").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == e.select("user_id").distinct().count()
    q = ingest.windowed_counts(s).writeStream.format("memory").outputMode("complete").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == e.count()


def test_registered_queries_have_unique_tables():
    import __spark_entry__ as e

    assert len(e.queries()) >= 90 and set(e.oracle_sql()) <= set(e.queries())
