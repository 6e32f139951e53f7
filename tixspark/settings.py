"""Routing settings (defaults of the reference service) as a frozen dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Fixed values that must equal the reference's defaults.
    embedding_dim: int = 384
    routing_confidence_threshold: float = 0.85
    fast_path_similarity_threshold: float = 0.95
    rag_similarity_threshold: float = 0.70
    rag_top_k: int = 5
    approved_knowledge_sources: tuple[str, ...] = field(
        default=("6StringNinja/synthetic-servicenow-incidents", "curated", "historical", "seed")
    )
    llm_max_input_chars: int = 8000
    llm_max_context_chars: int = 12000
    llm_max_context_items: int = 5
    detector_version: str = "privacy-shield-regex-v1"
    policy_version: str = "enterprise-ticket-policy-v1"

    def __post_init__(self) -> None:
        if self.fast_path_similarity_threshold < self.rag_similarity_threshold:
            raise ValueError("fast_path_similarity_threshold must be >= rag_similarity_threshold")


def split_csv(value: str) -> tuple[str, ...]:
    """Comma list → stripped non-empty items (empty list → ('__none__',))."""
    items = tuple(item.strip() for item in value.split(",") if item.strip())
    return items or ("__none__",)


DEFAULT = Settings()
# The driver's embeddings table has 64-dimensional vectors.
FIXTURE = Settings(embedding_dim=64)
