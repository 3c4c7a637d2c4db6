"""Rows-only queries (no SQL twin) checked against brute force on sf0.001."""

import numpy as np
import pytest

from inkgauge.plans import catalog as C
from inkgauge.plans import score as S


def _distance(a, b):
    """Word edit distance, a row of the table at a time."""
    at = np.arange(len(b) + 1)
    b, row = np.array(b, object), at.copy()
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))]) if len(b) else np.array([i])
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


@pytest.fixture(scope="module")
def pairs(spark, sf001):
    p = S.long_pairs(C.evaluation_input(spark, sf001), flag_repetition=False)
    return {(r["id"], r["method"]): (r["ref"], r["hyp"]) for r in p.select("id", "method", "ref", "hyp").collect()}


def test_wer_three_ways(spark, sf001, pairs):
    rows = C.set_scores(spark, sf001, ["word_error_rate", "word_error_rate_native"]).collect()
    assert len(rows) == 2040
    for r in rows:
        ref, hyp = pairs[(r["id"], r["method"])]
        a, b = ref.split(), hyp.split()
        want = None if not a else _distance(a, b) / len(a)
        assert r["word_error_rate"] == r["word_error_rate_native"] == want
