"""Settings with their defaults; every one can be set by an environment variable ``QUARRY_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Sizes and limits of indexing, retrieval, the loop and evaluation."""

    top_k_dense: int = 30
    top_k_bm25: int = 30
    top_k_hybrid: int = 12
    max_retries: int = 2
    max_hops: int = 2
    use_reranker: bool = False
    chunk_size: int = 1200
    chunk_overlap: int = 150
    batch_size: int = 64
    eval_top_k: int = 10
    page_offset: int = 1
    answer_contexts: int = 6
    answer_characters: int = 1600

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")

    @classmethod
    def from_environment(cls) -> Settings:
        """The defaults, overridden by what the environment sets."""
        found = {}
        for f in fields(cls):
            text = os.environ.get(f"QUARRY_{f.name.upper()}")
            if text is not None:
                found[f.name] = text.strip().lower() in ("1", "true", "yes") if f.type == "bool" else int(text)
        return cls(**found)
