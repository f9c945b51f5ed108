"""Explicit schemas of the stored documents and tables."""

from __future__ import annotations

SPAN = "struct<start: double, end: double>"

LECTURE_DOCUMENT = f"""
  source string, title string, duration double, language string, audio_path string, video_path string,
  utterances array<struct<uid: int, span: {SPAN}, text: string, avg_logprob: double, no_speech_prob: double>>,
  boards array<struct<bid: int, span: {SPAN}, key_ts: double, frame_path: string, ink_ratio: double, kind: string,
    latex: string, caption: string, confidence: double>>,
  segments array<struct<sid: int, span: {SPAN}, title: string, utterance_ids: array<int>, board_ids: array<int>,
    boundary_score: double, body: string>>,
  quiz array<struct<question: string, options: array<string>, answer_index: int, explanation: string, ref_ts: double, difficulty: string>>,
  meta struct<timings: map<string, double>, asr: struct<model: string>,
    board_reading: struct<model: string, calls: bigint, input_tokens: bigint, output_tokens: bigint>,
    compose: struct<model: string, calls: bigint, input_tokens: bigint, output_tokens: bigint>>
"""

LEDGER = "kind string, model string, calls bigint, input_tokens bigint, output_tokens bigint"

PACKED_FILE = "run string, name string, content string, length bigint, modified timestamp"

ASR_SEGMENTS = "lecture_id string, seq int, start_s double, end_s double, text string, avg_logprob double, no_speech_prob double"
