"""Operator parameters. Defaults are fixed values of the analytics being reproduced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AsrParams:
    max_no_speech: float = 0.6
    min_avg_logprob: float = -1.0
    hard_min_logprob: float = -1.6
    group_pause: float = 1.2
    group_min_seconds: float = 12.0
    group_max_seconds: float = 45.0


@dataclass(frozen=True)
class BoardParams:
    sample_step: float = 1.0
    dilate_iters: int = 1
    static_quantile: float = 0.985
    roi_keep: float = 0.99
    roi_pad: int = 12
    tau_erase: float = 0.010
    tau_jump: float = 0.060
    min_state_seconds: float = 8.0
    min_ink_ratio: float = 0.002

    @property
    def min_state_frames(self) -> int:
        return max(1, int(round(self.min_state_seconds / self.sample_step)))


@dataclass(frozen=True)
class SegmentParams:
    max_features: int | None = None
    window: int = 6
    w_visual: float = 0.6
    w_lexical: float = 0.4
    visual_sigma: float = 20.0
    min_score: float = 0.25
    min_seconds: float = 150.0
    max_seconds: float = 900.0


@dataclass(frozen=True)
class RetrievalParams:
    chunk_words: int = 220
    chunk_overlap: int = 40
    max_features: int | None = None
    top_k: int = 6
    neighbour_radius: int = 1
    max_context_chunks: int = 12
    min_score: float = 0.05
    citation_tolerance: float = 180.0
    dense_weight: float = 0.5


@dataclass(frozen=True)
class PromptParams:
    context_seconds: float = 45.0
    context_words: int = 220
    context_min_overlap: float = 0.3
    keep_confidence: float = 0.35
    max_transcript_words: int = 2500
    max_boards: int = 6
    title_context: int = 8
    wave_size: int = 4
    quiz_chunks_per_group: int = 4
    quiz_words_per_chunk: int = 400
    summary_words: int = 12_000
