"""Queries over the sample tables, grouped by subject."""

from __future__ import annotations

import importlib

SUBJECTS = ("spans", "scalars", "speech", "boards", "segmentation", "retrieval", "prompts", "answers", "cost", "evaluation", "quality", "edges", "streams", "product")


def load_all() -> None:
    for subject in SUBJECTS:
        try:
            importlib.import_module(f"lecturelab.plans.{subject}")
        except ModuleNotFoundError as exc:
            if exc.name != f"lecturelab.plans.{subject}":
                raise
