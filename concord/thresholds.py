"""The judgement calls of linking, in one place; any of them can be swept."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # Defaults of the rules.
    text_equality: float = 0.82
    shared_evidence: float = 0.90
    attribution_floor: float = 0.34
    enumeration_min: int = 3
    scale_window: float = 0.18
    top_k: int = 12
    shortlist_factor: int = 6
    shortlist_min: int = 60
    max_postings: int = 4000
    pages_per_chunk: int = 5
    chunk_chars: int = 18_000
    lexical_cluster: float = 0.72
    ingest_budget: int = 140
    relink_budget: int = 60


DEFAULTS = Thresholds()
