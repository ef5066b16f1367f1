"""What each kind of output needs: how its label is read, how failures are found, how samples are scored for disagreement, how a task is measured."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from quorumlens.functions.text import is_failed_label, is_failed_text, squeeze, top_label
from quorumlens.operators import metrics, votes


@dataclass(frozen=True)
class OutputKind:
    """The label of an output, whether it failed, and the disagreement of a panel."""

    label: Callable[[Column], Column]
    failed: Callable[[Column], Column]
    disagreement: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MetricPair:
    """Rows of a panel scored against the references, and their summary."""

    rows: Callable[[DataFrame], DataFrame]
    summary: Callable[..., DataFrame]


OUTPUT_KINDS = {
    "text": OutputKind(squeeze, is_failed_text, votes.text_disagreement),
    "emotion": OutputKind(top_label, is_failed_label, votes.label_disagreement),
}
METRICS = {"asr": MetricPair(metrics.word_error_rows, metrics.word_error_rate), "fer": MetricPair(metrics.label_rows, metrics.classification_summary)}
