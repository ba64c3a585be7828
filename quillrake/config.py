"""Settings of the ingestion engine; every threshold of the operators in one frozen record."""

from __future__ import annotations

import os
from dataclasses import dataclass

EXTENSIONS = ("pdf", "docx", "html", "htm", "md", "markdown", "txt")


@dataclass(frozen=True)
class Settings:
    target_tokens: int = 128
    max_tokens: int = 512
    min_tokens: int = 80
    overlap_tokens: int = 50
    arabic_overlap_multiplier: float = 1.2
    language_aware_overlap: bool = True
    small_doc_threshold: int = 1_500
    large_doc_threshold: int = 10_000
    full_section_path: bool = False
    partial_extraction: bool = True
    fix_quotes: bool = True
    similarity_threshold: float = 0.85
    max_file_size_mb: int = 20
    embedding_dimension: int = 256
    embedding_batch: int = 32
    force_split_atomic: bool = False
    max_atomic_tokens: int = 1_024

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        found = [f"{n} must be positive" for n in ("target_tokens", "max_tokens", "min_tokens", "max_file_size_mb", "embedding_dimension", "embedding_batch") if getattr(self, n) <= 0]
        if self.min_tokens >= self.max_tokens:
            found.append("min_tokens must be below max_tokens")
        if not 0 <= self.overlap_tokens < self.max_tokens:
            found.append("overlap_tokens must be from 0 to below max_tokens")
        if self.arabic_overlap_multiplier < 1:
            found.append("arabic_overlap_multiplier must be at least 1")
        if self.small_doc_threshold >= self.large_doc_threshold:
            found.append("small_doc_threshold must be below large_doc_threshold")
        if not 0 <= self.similarity_threshold <= 1:
            found.append("similarity_threshold must be from 0 to 1")
        return found

    def overlap(self, language: str) -> int:
        """Tokens of overlap for a language: Arabic takes more, if asked for."""
        return int(self.overlap_tokens * self.arabic_overlap_multiplier) if self.language_aware_overlap and language == "ar" else self.overlap_tokens

    @staticmethod
    def api_key(name: str = "EMBEDDING_API_KEY") -> str | None:
        """A key for a remote embedder: from the environment only, never a default."""
        return os.environ.get(name) or None
