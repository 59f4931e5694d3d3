"""Building the graph from documents, end to end, and the command line."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, GraphConfig, config_for_size, validate_result
from ..functions import text as tx
from ..functions.graph import md5_id
from ..lineage import written
from ..operators import concepts as cp
from ..operators import cooccurrence as co
from ..operators import export, extract
from ..operators import graph as gr
from ..operators import vectors as vc
from ..operators.graph import Graph

log = logging.getLogger("textloom")


@dataclass
class BuildResult:
    graph: Graph
    validation: DataFrame
    statistics: DataFrame
    steps: dict[str, bool]
    summary: dict


def prepare(docs: DataFrame, config: GraphConfig, min_chars: int = 100) -> DataFrame:
    """docs(doc_id, text) -> cleaned texts; too short or invalid ones go."""
    normal = tx.normalize_unicode(config.normalization, config.drop_controls)
    return docs.select("doc_id", normal(F.col("text")).alias("text"), F.col("text").alias("raw")).where(F.length("text") >= min_chars)


def build(docs: DataFrame, config: GraphConfig | None = None, dictionary: DataFrame | None = None, vectors: DataFrame | None = None, section_rules=None, entity_rules=None) -> BuildResult:
    """The whole graph of docs(doc_id, text).

    vectors(id, vector): document vectors with id = doc_id; by default TF-IDF with
    singular vectors. A step that has no input makes no rows, it doesn't stop the others.
    """
    spark = docs.sparkSession
    n_raw = docs.count()
    config = config or config_for_size(n_raw)
    steps = {"load": n_raw > 0}
    d = written(prepare(docs, config), "prepared")
    n_docs = d.count()
    clean = d.select("doc_id", "text")
    doc_node = F.concat(F.lit("doc_"), F.col("doc_id"))
    nodes = [gr.make_nodes(d, "document", doc_node, tx.truncated(F.concat(F.lit("document "), F.col("doc_id").cast("string")), 50), F.create_map(F.lit("num_tokens"), tx.word_count("text").cast("string")))]

    # sections keep the line breaks, so they come from the raw texts
    raw = d.select("doc_id", F.col("raw").alias("text"))
    sections = written(extract.extract_sections(raw, **({"rules": section_rules} if section_rules else {})).where("error is null"), "sections")
    nodes.append(gr.make_nodes(sections, "section", F.col("section_id"), F.col("section_type"), F.create_map(F.lit("ordem"), F.col("ordem").cast("string"))))
    steps["sections"] = True

    entities = written(extract.extract_entities(clean, **({"rules": entity_rules} if entity_rules else {})), "entities")
    known = extract.entity_frequency(entities, config.min_entity_frequency).withColumn("id", md5_id("ent_", F.col("name")))
    known = written(known, "entity_nodes")
    nodes.append(gr.make_nodes(known, "entity", F.col("id"), F.col("original"), F.create_map(F.lit("entity_type"), F.col("entity_type"), F.lit("frequency"), F.col("frequency").cast("string"))))
    steps["entities"] = True

    terms = dictionary if dictionary is not None else cp.dictionary(spark, extra=config.extra_concepts)
    table = cp.concept_table(clean, terms, at_most=config.max_discovered)
    if config.max_concepts:
        table = table.orderBy(F.desc("confianca"), "termo").limit(config.max_concepts)
    concepts = written(table.withColumn("term", tx.window_text("termo_original")).withColumn("id", md5_id("con_", F.col("term"))), "concepts")
    nodes.append(gr.make_nodes(concepts, "concept", F.col("id"), F.col("termo"), F.create_map(F.lit("categoria"), F.col("categoria"), F.lit("frequencia"), F.col("frequencia").cast("string"))))
    steps["concepts"] = True
    found = concepts.select("term", F.col("term").alias("termo")).dropDuplicates(["term"]).withColumn("words", F.size(F.split("term", " ")))

    edges = [gr.make_edges(sections, "hierarchical", doc_node, F.col("section_id"), F.lit(1.0), "hier_doc_sec", F.create_map(F.lit("order"), F.col("ordem").cast("string")))]
    if vectors is None and n_docs > 1:
        vectors = vc.tfidf_svd(clean).select(F.col("doc_id").alias("id"), "vector")
    steps["embeddings"] = vectors is not None
    if vectors is not None:
        pairs = vc.nearest_pairs(vectors, config.document_similarity, config.max_similarity_edges, config.similarity_mode)
        edges.append(gr.make_edges(pairs, "similarity", F.concat(F.lit("doc_"), F.col("a")), F.concat(F.lit("doc_"), F.col("b")), F.col("score"), "sim"))
    ids = concepts.select("term", F.col("id").alias("concept"))
    rel = vc.relevance(clean, found, config.relevance_threshold, config.max_relevance_edges).join(F.broadcast(ids), "term")
    edges.append(gr.make_edges(rel, "relevance", doc_node, F.col("concept"), F.col("weight"), "rel", F.create_map(F.lit("tf"), F.col("tf").cast("string"), F.lit("df"), F.col("df").cast("string"), F.lit("idf"), F.round("idf", 6).cast("string"))))
    pmi = co.pmi_pairs(clean, found, config.window_size, config.min_cooccurrence, config.min_concept_frequency).where(F.col("weighted") >= config.pmi_threshold)
    if config.max_cooccurrence_edges:
        pmi = pmi.orderBy(F.desc("weighted"), "c1", "c2").limit(config.max_cooccurrence_edges)
    pmi = pmi.join(F.broadcast(ids.select(F.col("term").alias("c1"), F.col("concept").alias("a"))), "c1").join(F.broadcast(ids.select(F.col("term").alias("c2"), F.col("concept").alias("b"))), "c2")
    edges.append(gr.make_edges(pmi, "cooccurrence", F.col("a"), F.col("b"), F.col("weighted"), "cooc", F.create_map(F.lit("pmi"), F.round("pmi", 6).cast("string"), F.lit("joint"), F.col("joint").cast("string"))))
    if config.link_entities:
        mentions = entities.select("doc_id", F.lower("name").alias("name")).distinct().join(known.select("name", "id"), "name")
        edges.append(gr.make_edges(mentions, "hierarchical", doc_node, F.col("id"), F.lit(1.0), "hier_doc_ent"))
    steps["edges"] = True

    graph = Graph(written(gr.assemble_nodes(nodes), "nodes"), written(gr.assemble_edges(edges), "edges"))
    validation = gr.validate_graph(graph, config.validation_level)
    steps["validation"] = True
    summary = validate_result(steps, n_docs / n_raw if n_raw else 0.0, known.count())
    log.info("built a graph of %d documents", n_docs)
    return BuildResult(graph, validation, gr.statistics(graph), steps, summary)


def main(argv: list[str] | None = None) -> int:
    """spark-submit textloom/plans/pipeline.py --input DOCS.parquet --output FOLDER [--sample N | --limit N] [--preset NAME]"""
    a = argparse.ArgumentParser(description="Build a graph from documents(doc_id, text).")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--sample", type=int, help="that many documents, chosen by a hash of their id")
    a.add_argument("--limit", type=int, help="the first documents by id")
    a.add_argument("--test", action="store_true", help="50 documents")
    a.add_argument("--preset", choices=sorted(PRESETS))
    a.add_argument("--link-entities", action="store_true")
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = spark.read.parquet(o.input).select("doc_id", "text")
    if o.sample:
        docs = vc.hash_sample(docs, F.col("doc_id"), o.sample)
    elif o.limit or o.test:
        docs = docs.orderBy("doc_id").limit(o.limit or 50)
    config = PRESETS[o.preset] if o.preset else None
    if o.link_entities:
        config = replace(config or GraphConfig(), link_entities=True)
    result = build(docs, config)
    export.write_tables(result.graph, o.output)
    result.validation.write.mode("overwrite").json(f"{o.output}/validation")
    return 0 if result.summary["is_valid"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
