"""Metric registry (UDF3): which metric families exist, which columns each
produces, whether it runs natively or in the shared Arrow UDF, its "equal"
threshold and whether a higher value is better.

Users extend it with :func:`register_native`; a registered builder is any
``(ctx) -> dict[str, Column]`` over the prepared reference / hypothesis
columns, so new native metrics join the same single projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column

from . import metrics as M

# --- fixed values that must equal the evaluated system's behaviour ---------
# Metric families in their configuration order, and the default active set.
ALL_METRICS = ["jaccard_similarity", "bleu_score",
               "word_error_rate", "precision", "recall"]
DEFAULT_METRICS = ["bleu_score", "word_error_rate", "precision", "recall"]
# ---------------------------------------------------------------------------


@dataclass
class MetricSpec:
    name: str
    kind: str  # "native" | "python"
    columns: list[str]
    higher_is_better: bool = True
    threshold_key: str | None = None
    threshold: float | None = None
    build: Callable[["PairContext"], dict[str, Column]] | None = None
    python_fields: list[str] = field(default_factory=list)
    of_sizes: bool = False  # native, from set sizes and characters alone


@dataclass
class PairContext:
    ref: Column
    hyp: Column
    ref_words: Column
    hyp_words: Column
    ref_set: Column
    hyp_set: Column
    thresholds: dict
    common: Column | None = None  # size of the sets' intersection, where it is a column
    ref_chars: Column | None = None  # characters of the texts
    hyp_chars: Column | None = None


REGISTRY: dict[str, MetricSpec] = {}


def register(spec: MetricSpec) -> None:
    REGISTRY[spec.name] = spec


def register_native(name: str, build, columns=None, higher_is_better: bool = True, threshold: float | None = None,
                    of_sizes: bool = False) -> None:
    """Add a native metric.  ``of_sizes`` says that it reads no more of its context
    than the texts' characters and can so be had from batches too.  With ``threshold`` (or one passed for its name when
    scoring) an ``equal_<name>`` flag is computed too: at least the threshold,
    at most it where lower is better."""
    register(MetricSpec(name, "native", columns or [name], higher_is_better, name if threshold is not None else None,
                        threshold, build, of_sizes=of_sizes))


def equal_flag(spec: MetricSpec, score: Column, thresholds: dict) -> Column | None:
    """The flag of a score against its family's threshold, if it has one."""
    limit = thresholds.get(spec.threshold_key or spec.name, spec.threshold)
    if limit is None:
        return None
    return M.at_least(score, limit) if spec.higher_is_better else score <= limit


def flag_name(spec: MetricSpec) -> str:
    return f"equal_{spec.threshold_key or spec.name}"


register(MetricSpec("jaccard_similarity", "native", ["jaccard_similarity", "equal_jaccard"],
                    threshold_key="jaccard",
                    build=lambda c: {
                        "jaccard_similarity": M.jaccard(c.ref_set, c.hyp_set, c.common),
                    }))
register(MetricSpec("bleu_score", "python", ["bleu_score"], python_fields=["bleu_score"]))
# Word error rate runs in the shared Arrow UDF (bit-parallel edit distance):
# the pure-Catalyst form (tokens mapped to private code points, then the
# builtin character Levenshtein) is exact but its per-token lookups run in
# the interpreted lambda evaluator, ~60x slower.  It stays available as
# ``word_error_rate_native`` for plans that must not leave the JVM.
register(MetricSpec("word_error_rate", "python", ["word_error_rate"], higher_is_better=False,
                    python_fields=["word_error_rate"]))
register(MetricSpec("word_error_rate_native", "native", ["word_error_rate_native"], higher_is_better=False,
                    build=lambda c: {"word_error_rate_native": M.word_error_rate(c.ref_words, c.hyp_words)}))
register(MetricSpec("precision", "native", ["precision"],
                    build=lambda c: {"precision": M.precision(c.ref_set, c.hyp_set, c.common)}))
register(MetricSpec("recall", "native", ["recall"],
                    build=lambda c: {"recall": M.recall(c.ref_set, c.hyp_set, c.common)}))

# The score column of each family (what summaries and rankings aggregate).
PRIMARY_COLUMN = {
    "jaccard_similarity": "jaccard_similarity",
    "bleu_score": "bleu_score",
    "word_error_rate": "word_error_rate",
    "precision": "precision",
    "recall": "recall",
}


def higher_is_better(metric: str) -> bool:
    spec = REGISTRY.get(metric)
    return True if spec is None else spec.higher_is_better
