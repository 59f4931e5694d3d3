"""Configuration of a graph build: thresholds, limits and presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

VALIDATION_LEVELS = ("basic", "comprehensive", "strict")


@dataclass(frozen=True)
class GraphConfig:
    """Thresholds and limits of a build; None switches a limit off.

    The build reads all but section_similarity, entity_similarity, max_section_edges, max_hierarchical_edges (it makes document vectors
    alone and keeps every section), chunk_size (Spark deals the rows) and statuses (for relational.load_processes); callers can.

    normalization: 'NFC' (default), 'NFKC' or 'NFKD'. drop_controls='space' turns
    line breaks into spaces; 'delete' removes them with all control characters.
    similarity_mode: 'lower_id' (a pair is kept if the greater id is among the
    lesser id's neighbours), 'mutual' or 'union'.
    """

    document_similarity: float = 0.3
    section_similarity: float = 0.4
    entity_similarity: float = 0.5
    relevance_threshold: float = 0.1
    pmi_threshold: float = 0.5
    max_similarity_edges: int = 50
    max_section_edges: int = 20
    max_relevance_edges: int | None = None
    max_cooccurrence_edges: int | None = None
    max_hierarchical_edges: int | None = None
    min_entity_frequency: int = 2
    min_concept_frequency: int = 3
    min_cooccurrence: int = 2
    window_size: int = 10
    max_concepts: int | None = None
    max_discovered: int = 75
    chunk_size: int = 1000
    statuses: tuple[str, ...] = ("processado", "pendente")
    normalization: str = "NFC"
    drop_controls: str = "space"
    similarity_mode: str = "lower_id"
    link_entities: bool = False
    validation_level: str = "comprehensive"
    extra_concepts: tuple[str, ...] = field(default_factory=tuple)

    def to_dict(self) -> dict:
        return asdict(self)


PRESETS = {
    "default": GraphConfig(),
    "development": GraphConfig(document_similarity=0.2, section_similarity=0.3, entity_similarity=0.4, relevance_threshold=0.05, pmi_threshold=0.3, max_similarity_edges=10, chunk_size=100, validation_level="basic"),
    "production": GraphConfig(document_similarity=0.4, section_similarity=0.5, entity_similarity=0.6, relevance_threshold=0.15, pmi_threshold=0.7, max_similarity_edges=50, chunk_size=1000, validation_level="strict"),
    "experimental": GraphConfig(document_similarity=0.1, section_similarity=0.2, entity_similarity=0.3, relevance_threshold=0.01, pmi_threshold=0.1, max_similarity_edges=100, chunk_size=500),
}


def recommended_thresholds(n_documents: int) -> dict[str, float]:
    if n_documents < 100:
        s, r, p = 0.2, 0.05, 0.3
    elif n_documents < 1000:
        s, r, p = 0.3, 0.1, 0.5
    else:
        s, r, p = 0.4, 0.15, 0.7
    return {"similarity": s, "relevance": r, "pmi": p}


def config_for_size(n_documents: int) -> GraphConfig:
    if n_documents < 500:
        doc, sec, rel, pmi, edges = 0.25, 0.3, 0.05, 0.3, 20
    elif n_documents < 2000:
        doc, sec, rel, pmi, edges = 0.3, 0.4, 0.1, 0.5, 30
    else:
        doc, sec, rel, pmi, edges = 0.4, 0.5, 0.15, 0.7, 50
    return replace(GraphConfig(), document_similarity=doc, section_similarity=sec, relevance_threshold=rel, pmi_threshold=pmi, max_similarity_edges=edges, chunk_size=min(1000, max(100, n_documents // 10)))


# Steps a complete build reports, for validate_result().
REQUIRED_STEPS = ("load", "sections", "entities", "concepts", "embeddings", "edges", "validation")


def validate_result(steps: dict[str, bool], coverage: float, n_entities: int) -> dict:
    """Missing steps are errors; low coverage and few entities are warnings."""
    errors = [f"step missing: {s}" for s in REQUIRED_STEPS if not steps.get(s)]
    warnings = []
    if coverage < 0.9:
        warnings.append("document coverage below 0.9")
    if n_entities < 100:
        warnings.append("fewer than 100 entities")
    return {"is_valid": not errors, "errors": errors, "warnings": warnings}
