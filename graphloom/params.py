"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults.
@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 128
    chunk_words: int = 512
    retrieval_mode: str = "hybrid"  # or knn
    vector_backend: str = "opensearch"  # or neo4j, hybrid
    top_k: int = 20
    rrf_k: int = 60
    window_size: int = 1
    kg_max_hops: int = 1
    max_query_concepts: int = 5
    reranker_enabled: bool = False
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    related_threshold: int = 5
    max_concepts: int = 200
    mastery_model: str = "bkt"  # or linear
    initial_mastery: float = 0.3
    p_transit: float = 0.1
    p_slip: float = 0.1
    p_guess: float = 0.25
    pagerank_damping: float = 0.85

    def __post_init__(self) -> None:
        if self.retrieval_mode not in ("knn", "hybrid") or self.vector_backend not in ("opensearch", "neo4j", "hybrid") or self.mastery_model not in ("bkt", "linear"):
            raise ValueError("unknown mode")


@dataclass(frozen=True)
class Question:
    """A request; bounds are checked when it is made."""

    text: str
    subject: str | None = None
    use_kg_expansion: bool = True
    use_window_retrieval: bool = True
    window_size: int = 1
    top_k: int = 5

    def __post_init__(self) -> None:
        for ok, what in ((3 <= len(self.text) <= 2000, "question length"), (0 <= self.window_size <= 3, "window_size"), (1 <= self.top_k <= 20, "top_k")):
            if not ok:
                raise ValueError(f"{what} out of range")


SETTINGS = Settings()

# Structural terms that are no concepts.
STOP_CONCEPTS = (
    "data-type", "cnx", "cnx-pi", "review questions", "critical thinking", "critical thinking questions", "self-check questions", "thinking questions",
    "key terms", "summary", "references", "title", "class", "section", "chapter", "introduction", "conclusion", "learning objectives", "figure", "table",
    "link", "image", "eoc", "eob", "data type", "os-teacher", "os-embed", "check-understanding", "module", "content", "term", "page", "note", "exercise",
    "problem", "solution", "abstract", "metadata", "glossary", "index", "appendix", "preface", "answer key", "suggested reading", "further reading",
    "review", "practice", "end-of-chapter", "end-of-module",
)

# Phrases that announce a prerequisite; the group is the concept.
PREREQ_PATTERNS = (
    r"requires? (?:an? )?understanding of (.+?)(?:\.|,|;)",
    r"builds? (?:on|upon) (.+?)(?:\.|,|;)",
    r"prerequisite.{0,20}(.+?)(?:\.|,|;)",
    r"before (?:studying|learning|understanding) (.+?)(?:\.|,|;)",
    r"assumes? (?:knowledge|familiarity) (?:of|with) (.+?)(?:\.|,|;)",
    r"(?:following|after) .{0,30}(?:chapter|section|module) on (.+?)(?:\.|,|;)",
    r"led to (.+?)(?:\.|,|;)",
    r"resulted in (.+?)(?:\.|,|;)",
    r"paved the way for (.+?)(?:\.|,|;)",
    r"was a precursor to (.+?)(?:\.|,|;)",
)
