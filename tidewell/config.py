"""Settings that the operators share, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    retrieve_top_k: int = 8
    context_top_k: int = 4
    min_relevance_score: float = 0.35
    rrf_k: int = 60
    max_upload_bytes: int = 25 * 1024 * 1024
    chunk_chars: int = 1400
    overlap_chars: int = 150
    short_section_chars: int = 120
    embed_batch: int = 16
    dimension: int = 64
    lease_minutes: int = 5
    max_attempts: int = 3


SETTINGS = Settings()
