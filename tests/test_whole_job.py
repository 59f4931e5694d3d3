"""Registered queries read whole tables and texts."""

import pytest

from textloom.plans import catalogue
from textloom.plans.registry import table


@pytest.fixture(scope="module")
def places(spark, sf, tmp_path_factory):
    """A folder with 80 suppliers, and the links of its place graph."""
    folder = str(tmp_path_factory.mktemp("places"))
    for name in ("region", "nation"):
        table(spark, sf, name).write.parquet(f"{folder}/{name}.parquet")
    rows = [(i, f"s{i}", i * 7 % 25) for i in range(1, 81)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    nations = [(r.n_nationkey, r.n_regionkey) for r in table(spark, sf, "nation").collect()]
    links = {(f"reg_{r}", f"nat_{n}") for n, r in nations} | {(f"nat_{n}", f"nat_{(n + 1) % 25}") for n, _ in nations} | {(f"nat_{n}", f"sup_{s}") for s, _, n in rows}
    return folder, links


def brute_distances(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, front = {s: 0}, [s]
        for v in front:
            for w in near[v] - seen.keys():
                seen[w] = seen[v] + 1
                front.append(w)
        out |= {(s, v): d for v, d in seen.items()}
    return out


def test_place_graph_holds_every_supplier(spark, places):
    folder, links = places
    got = {tuple(sorted((r.row, r.col))) for r in catalogue.QUERIES["adjacency"](spark, folder).collect()}
    assert got == {tuple(sorted(x)) for x in links} and any("sup_80" in x for x in got)
    want = brute_distances(links)
    assert {(r.source, r.id): r.distance for r in catalogue.QUERIES["bfs_paths"](spark, folder).collect()} == want


def test_normalize_unicode_folds_the_whole_text(spark, tmp_path):
    text = "ção " * 200
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.folded for r in catalogue.QUERIES["normalize_unicode"](spark, str(tmp_path)).collect()}
    assert got == {1: "cao " * 200, 2: None}


def test_tfidf_svd_embed_has_the_reference_sizes(spark, sf, monkeypatch):
    import inspect

    from textloom.plans import concept_queries

    signature, seen = inspect.signature(concept_queries.vc.tfidf_svd), {}

    def stand_in(*args, **kwargs):
        seen.update(signature.bind(*args, **kwargs).arguments)
        return spark.createDataFrame([(1, [1.0])], "doc_id bigint, vector array<double>")

    monkeypatch.setattr(concept_queries.vc, "tfidf_svd", stand_in)
    catalogue.QUERIES["tfidf_svd_embed"](spark, sf)
    sizes = {k: seen.get(k, signature.parameters[k].default) for k in ("dimensions", "max_features")}
    assert sizes == {"dimensions": 384, "max_features": 5000}


def test_betweenness_takes_a_hundred_pivots(spark, sf, tmp_path):
    for name in ("region", "nation"):
        table(spark, sf, name).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(i, f"s{i}", i % 25) for i in range(1, 51)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.id: r.betweenness for r in catalogue.QUERIES["betweenness"](spark, str(tmp_path)).collect()}
    # 80 nodes, all of them pivots: exact, so leaves lie on no path and all nations have some
    links = {("reg_" + str(r.n_regionkey), "nat_" + str(r.n_nationkey)) for r in table(spark, sf, "nation").collect()}
    links |= {(f"nat_{i}", f"nat_{(i + 1) % 25}") for i in range(25)} | {(f"nat_{i % 25}", f"sup_{i}") for i in range(1, 51)}
    assert got == pytest.approx(brute_betweenness(links), abs=2e-6)


def brute_betweenness(links):
    dist, near, count = brute_distances(links), {}, {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for s, v in sorted(dist, key=lambda x: dist[x]):
        count[s, v] = 1 if s == v else sum(count[s, w] for w in near[v] if dist[s, w] == dist[s, v] - 1)
    n = len(near)
    total = {v: sum(count[s, v] * count[v, t] / count[s, t] for s in near for t in near if v not in (s, t) and s != t and dist[s, v] + dist[v, t] == dist[s, t]) for v in near}
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_louvain_in_one_task_and_on_tables(spark):
    """Four groups joined by a ring: both ways find partitions of high modularity that cover every node."""
    from textloom.operators import community
    from textloom.operators.graph import Graph

    ids = [f"{g}{i}" for g in "abcd" for i in range(6)] + ["lone"]
    links = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcd" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0), ("d3", "a3", 1.0), ("a0", "a0", 0.5)]
    nodes = spark.createDataFrame([(i, "document", i) for i in ids], "id string, node_type string, label string")
    g = Graph(nodes, spark.createDataFrame(links, "src string, dst string, weight double").selectExpr("least(src, dst) src", "greatest(src, dst) dst", "weight", "'x' edge_type"))
    want = {i: (f"{i[0]}0" if i != "lone" else i) for i in ids}
    assert {r.id: r.community for r in community.louvain(g).collect()} == want
    far = {r.id: r.community for r in community.louvain(g, local_links=0).collect()}
    assert set(far) == set(ids) and far["lone"] == "lone" and all(far[c] == c for c in far.values())
    assert community.modularity(g, spark.createDataFrame(list(far.items()), "id string, community string")).first()[0] > 0.5
    assert community.louvain(Graph(nodes, g.edges.limit(0))).where("id <> community").count() == 0


def test_process_fields_and_sections(spark):
    from pyspark.sql import functions as F

    from textloom.operators import pages

    long = "Voto: " + "uma frase. " * 30_000
    texts = {
        1: "Relator: Des. João Silva \nÓrgão: 2ª Câmara Cível: primeira\nClasse: Apelação (x)\nData: 01/02/2023\nApelante: Maria\nAPELADO Banco\nempréstimo CONSIGNADO",
        2: "EMENTA: " + ("direito civil e contratos. " * 4).strip() + ". fim\n\nPelo exposto, julgo. " + "Condeno o banco ao pagamento de custas e honorários. " * 2,
        3: long,
        4: "x" * 101 + "\n\n short \n\n " + "y" * 5000,
        5: "",
        6: None,
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pages.process_fields(d).collect()}
    assert (got[1].relator, got[1].classe_judicial, got[1].data_publicacao, got[1].autor, got[1].reu, got[1].assunto_principal) == ("Des. João Silva", "Classe: Apelação", "01/02/2023", "Maria", "Banco", "Empréstimo Consignado")
    assert got[1].orgao_julgador == "primeira" and set(got[6].asDict().values()) == {6, None}
    rows = {(r.doc_id, r.ordem): (r.tipo, r.content) for r in pages.content_sections(d).collect()}
    assert rows[2, 1] == ("ementa", ("direito civil e contratos. " * 4).strip()[:-1]) and rows[2, 2][0] == "dispositivo" and rows[2, 2][1].startswith("Condeno")
    assert rows[3, 1] == ("voto", ("uma frase. " * 300)[:3000]) and (3, 2) not in rows
    assert [(rows[4, i][0], len(rows[4, i][1])) for i in (1, 2)] == [("paragrafo_1", 101), ("paragrafo_2", 3000)]
    assert [k for k in rows if k[0] not in (2, 3, 4)] == [(1, 1)] and rows[1, 1] == ("paragrafo_1", texts[1])
    kept = spark.createDataFrame([(list(range(25)),), ([1],), (None,)], "a array<int>").select(pages.last_contexts(F.col("a"))).collect()
    assert [r[0] for r in kept] == [list(range(15, 25)), [1], None]


def test_metrics_and_metadata_are_written(spark, tmp_path):
    import json

    from textloom.operators import community, export
    from textloom.operators.graph import Graph

    nodes = spark.createDataFrame([("a", "document", "A"), ("b", "document", "B"), ("c", "section", "C")], "id string, node_type string, label string")
    edges = spark.createDataFrame([("e1", "a", "b", "similarity", 0.8), ("e2", "a", "c", "hierarchical", 1.0)], "id string, src string, dst string, edge_type string, weight double")
    g = Graph(nodes, edges)
    out = community.write_metrics(g, str(tmp_path / "metrics"))
    assert set(out) == set(community.all_metrics(g)) and spark.read.json(out["basic"]).count() == 1
    row = json.loads(export.graph_metadata(g, "tests", 3, {"k": 5}, ("began", "ended")).first()[0])
    assert row["schema_version"] == "1.0" and row["corpus_size"] == 3 and json.loads(row["configuration"]) == {"k": 5} and row["processing_log"] == ["began", "ended"] and row["statistics"]["n_nodes"] == 3
    types = {(r.community, r.node_type): r.n for r in community.community_types(g, nodes.selectExpr("id", "'x' community")).collect()}
    assert types == {("x", "document"): 2, ("x", "section"): 1}
