"""Column helpers over `[start, end]` spans in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_is_valid(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (end >= 0) & (end >= start), F.lit(False))


def span_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    inter = span_overlap(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
