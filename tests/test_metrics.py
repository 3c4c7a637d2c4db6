"""Metric goldens and properties (MET1-MET14, SCL16-SCL18)."""

import random

import pytest

from pyspark.sql import functions as F

from inkgauge.functions import metrics as M
from inkgauge.functions import pymetrics as P
from inkgauge.plans import score as S


def _pairs(spark, pairs):
    return spark.createDataFrame([(str(i), "m", i, a, b) for i, (a, b) in enumerate(pairs)],
                                 "id string, method string, ordinal long, ref string, hyp string")


def test_wer_goldens(spark):
    pairs = [("the cat sat", "the cut sat on"), ("x y z x", "z y x"), ("a b c", ""), ("", "a b")]
    out = S.with_metrics(_pairs(spark, pairs), ["word_error_rate", "word_error_rate_native"]).orderBy("ordinal")
    rows = out.collect()
    exp = [2 / 3, 0.5, 1.0, None]
    assert [r["word_error_rate"] for r in rows] == exp
    assert [r["word_error_rate_native"] for r in rows] == exp


def test_bitparallel_matches_dp():
    def dp(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            prev = cur
        return prev[-1]
    rnd = random.Random(7)
    for _ in range(500):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 90))]
        assert P.word_edit_distance(a, b) == dp(a, b)


def test_set_metric_properties(spark):
    rnd = random.Random(3)
    words = "a b c d e f g".split()
    pairs = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8))),
              " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8)))) for _ in range(60)]
    fwd = S.with_metrics(_pairs(spark, pairs), ["precision", "recall", "jaccard_similarity"]).orderBy("ordinal").collect()
    rev = S.with_metrics(_pairs(spark, [(b, a) for a, b in pairs]), ["precision", "recall", "jaccard_similarity"]) \
        .orderBy("ordinal").collect()
    for f, r, (a, b) in zip(fwd, rev, pairs):
        assert f["precision"] == r["recall"]
        assert f["jaccard_similarity"] == r["jaccard_similarity"]
        sa, sb = set(a.split()), set(b.split())
        assert f["recall"] == (len(sa & sb) / len(sa) if sa else 0.0)
    same = S.with_metrics(_pairs(spark, [("a b c", "a b c")]), ["precision", "recall", "jaccard_similarity"]).first()
    assert (same["precision"], same["recall"], same["jaccard_similarity"], same["equal_jaccard"]) == (1.0, 1.0, 1.0, True)


def test_repetition_flag(spark):
    four = "a b c " * 4 + "d"
    three = "a b c " * 3 + "d"
    df = spark.createDataFrame([(four,), (three,), ("",)], "t string")
    rows = df.select(M.has_repetition(F.col("t")).alias("r"), M.repeated_text_flag(F.col("t")).alias("f")).collect()
    assert [r["r"] for r in rows] == [True, False, False]
    assert [r["f"] for r in rows] == [1, 0, 0]


def test_bleu_definition():
    assert P.bleu("", "a") == 0.0
    assert P.bleu("the cat", "dog") == 0.0
    assert P.bleu("a b c d e", "a b c d e") == 1.0
    # one-word hypothesis: only unigram precision, brevity penalty exp(1 - 3/1)
    import math
    assert abs(P.bleu("a b c", "a") - math.exp(1 - 3) * math.exp(math.log(1.0) / 4)) < 1e-12


def test_bleu_matches_a_dictionary_count(spark):
    import math
    from collections import Counter

    def plain(ref, hyp):
        if not ref or not hyp:
            return 0.0
        logs, inc = [], 1
        for n in range(1, 5):
            h, r = (Counter(zip(*[x[k:] for k in range(n)])) for x in (hyp, ref))
            m, d = sum((h & r).values()), max(1, len(hyp) - n + 1)
            if n == 1 and not m:
                return 0.0
            if m == 0 and len(hyp) > 1:
                p, inc = math.log(len(hyp)) / (2 ** inc * 5) / d, inc + 1
            else:
                p = m / d
            logs += [math.log(p) / 4] if p > 0 else []
        return (1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))) * math.exp(sum(logs))

    rnd = random.Random(11)
    for _ in range(200):
        texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.choice([0, 1, 2, 3, 5, 40]))) for _ in range(rnd.randint(2, 6))]
        got = P.bleu_scores(texts[0], texts[1:])
        want = [plain(texts[0].split(), t.split()) for t in texts[1:]]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)), (texts, got, want)
    # pairs of several documents in one batch, references repeated apart
    pairs = [("a b c d", "a b x d"), ("a b c d", "a b c d"), ("q r", "q"), ("a b c d", "d c b a"), (None, "a"), ("a", None)]
    rows = S.with_metrics(_pairs(spark, pairs), ["bleu_score"]).orderBy("ordinal").collect()
    assert all(abs(r["bleu_score"] - plain((a or "").split(), (b or "").split())) < 1e-12 for r, (a, b) in zip(rows, pairs))


def test_native_word_edit_distance_bands_and_limit(spark, monkeypatch):
    rnd = random.Random(5)
    pairs = [(" ".join(rnd.choice("abcdefgh") for _ in range(n)), " ".join(rnd.choice("abcdefgh") for _ in range(m)))
             for n, m in ((0, 5), (5, 0), (40, 41), (120, 3), (700, 90), (60, 60))]
    df = _pairs(spark, pairs).select("ref", "hyp", M.word_edit_distance(M.words(F.col("ref")), M.words(F.col("hyp"))).alias("d"))
    assert [r["d"] for r in df.collect()] == [P.word_edit_distance(a.split(), b.split()) for a, b in pairs]
    monkeypatch.setattr(M, "LAST_CODE", M.FIRST_CODE + M.SURROGATES[1] + 3)
    small = _pairs(spark, [("a b c d e", "a")]).select(M.word_edit_distance(M.words(F.col("ref")), M.words(F.col("hyp"))).alias("d"))
    with pytest.raises(Exception, match="code points"):
        small.collect()


def test_python_metrics_single_arrow_node(spark):
    df = S.with_metrics(_pairs(spark, [("a b", "a c")]),
                        ["bleu_score", "word_error_rate"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    native = S.with_metrics(_pairs(spark, [("a b", "a c")]), ["precision", "recall", "jaccard_similarity"])
    assert "ArrowEvalPython" not in native._jdf.queryExecution().executedPlan().toString()
