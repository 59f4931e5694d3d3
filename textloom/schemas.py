"""Schemas and value domains of the relational inputs and of the graph."""

from __future__ import annotations


NODE_TYPES = ("document", "section", "entity", "concept")
SECTION_TYPES = ("relatorio", "decisao", "dispositivo", "ementa", "voto", "outros")
ENTITY_TYPES = ("juiz", "advogado", "comarca", "lei", "orgao", "pessoa", "outros")
EDGE_TYPES = ("similarity", "relevance", "cooccurrence", "hierarchical")
SIMILARITY_TYPES = ("document_semantic", "section_content", "entity_context")

# (source type, target type, edge type) an edge may have
ALLOWED_EDGES = (
    ("document", "document", "similarity"),
    ("section", "section", "similarity"),
    ("entity", "entity", "similarity"),
    ("document", "concept", "relevance"),
    ("concept", "document", "relevance"),
    ("concept", "concept", "cooccurrence"),
    ("document", "section", "hierarchical"),
    ("section", "entity", "hierarchical"),
    ("document", "entity", "hierarchical"),
    ("section", "concept", "hierarchical"),
)



# Relational inputs, as DDL strings that readers take as they are.
PROCESSES = (
    "id int, numero_processo string, url_original string, html_completo string, data_coleta timestamp_ntz, status_processamento string, "
    "hash_documento string, tentativas int, created_at timestamp_ntz, updated_at timestamp_ntz"
)
METADATA = (
    "id int, processo_id int, orgao_julgador string, orgao_julgador_colegiado string, relator string, classe_judicial string, competencia string, "
    "assunto_principal string, autor string, reu string, data_publicacao date, tipo_decisao string, created_at timestamp_ntz"
)
CONTENT = "id int, processo_id int, tipo_secao string, conteudo_html string, conteudo_texto string, conteudo_limpo string, ordem int, created_at timestamp_ntz"
SCRAPING_LOG = (
    "id int, url string, tipo_operacao string, status string, tentativas int, erro_mensagem string, timestamp_inicio timestamp_ntz, timestamp_fim timestamp_ntz, duracao_segundos decimal(10,2)"
)

NODES = "id string, node_type string, label string, metadata map<string,string>"
EDGES = "id string, src string, dst string, edge_type string, weight double, metadata map<string,string>"
