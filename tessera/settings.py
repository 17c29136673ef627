"""Knobs that change results, one frozen group each; nothing reads the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Links:
    min_shared: int = 2
    df_cap: float = 1.0  # drop entities in a larger share of active rows; 1.0 is off
    max_per_node: int = 25
    idf_weighted: bool = True
    min_jaccard: float = 0.0
    stoplist: tuple[str, ...] = ("all", "api", "backend", "ing", "space")
    hub_multiplier: float = 1.0
    hub_percentile: float = 0.9


@dataclass(frozen=True)
class Summaries:
    top_k: int = 0
    min_memories: int = 3
    max_contents: int = 20
    max_content_chars: int = 0


@dataclass(frozen=True)
class Notes:
    bonus: float = 0.05
    auto_include_cap: int = 3
    anchor_min_dominance: float = 0.6


@dataclass(frozen=True)
class Documents:
    weight_time: float = 1.0
    weight_path: float = 0.5
    weight_content: float = 0.5
    tau: float = 3600.0
    min_cluster: int = 2
    gap: float = 86400.0
    max_cluster: int = 50
    eps: float = 0.35
    bucket: float = 86400.0
    block_cap: int = 2000
    enabled: bool = True
    by_folder: bool = True
    fallback: bool = True
    fallback_max: int = 8
    label_kind: bool = True


@dataclass(frozen=True)
class Segments:
    enabled: bool = True
    target_turns: int = 25
    min_turns: int = 12
    max_turns: int = 40
    gap_minutes: float = 45.0
    max_segments: int = 0
    prompt_chars: int = 12000  # of a transcript, as a distiller gets it


@dataclass(frozen=True)
class Scoring:
    usefulness_weight: float = 0.3
    staleness_weight: float = 0.2
    recency_max: float = 0.1
    recency_decay: float = 0.01
    useful_step: float = 0.5
    stale_step: float = 1.0
    stale_at: float = 7.0
    archive_at: float = 9.0
    rehabilitate_by: float = 2.0
    cap: float = 10.0


@dataclass(frozen=True)
class Consolidation:
    high_stale: float = 6.0
    high_useful: float = 5.0
    never_accessed_days: int = 7
    archive_days: int = 30
    rehabilitate_days: int = 7
