"""Tunable constants.  Every operator that depends on the time takes an explicit as_of."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    breaking_hours: int = 8
    breaking_relevance: float = 70.0
    important_relevance: float = 55.0
    developing_hours: int = 48
    verify_window_hours: int = 12
    verify_min_updates: int = 3
    trending_hours: int = 12
    trending_threshold: float = 10.0
    match_hours: int = 72
    similarity: float = 0.42
    title_similarity: float = 0.62
    text_similarity: float = 0.30
    reply_text_similarity: float = 0.20
    post_score: float = 0.34
    stale_source_hours: int = 48
    event_hours: int = 7
    future_minutes: int = 90
    earliest: str = "1993-11-12"
    feed_max: int = 60
