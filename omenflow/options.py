"""Tunables, passed explicitly to operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    dbscan_eps: float = 0.35
    dbscan_min_samples: int = 3
    cluster_min_mentions: int = 3
    near_duplicate_threshold: float = 0.92
    extraction_limit: int | None = 10
    generation_limit: int | None = 5
    questions_per_story: int = 2
    wiki_min_views: int = 10000
    # limits that only apply where the caller sets them
    hn_max_stories: int | None = None
    body_chars: int | None = None
    # newest items a prompt lists: a top-k, as a prompt has to end somewhere
    prompt_headlines: int = 20
    schema_retries: int = 2
    min_resolution_confidence: float = 0.65
    min_source_independence: float = 0.4
    min_timing_reliability: float = 0.4
    max_deadline_days: int = 5 * 365


DEFAULTS = Options()
