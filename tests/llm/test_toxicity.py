import itertools
import random

import numpy as np
import pytest

from inkgauge.llm import toxicity
from inkgauge.llm.common import prepare
from inkgauge.llm.queries import op10_toxicity, table

from .util import ODD_ROWS, docs


def brute_segments(s):
    """Recursively: the best (then longest, then first) segment, left and right of it."""
    def best(a, b):
        found = [(sum(s[i:j]), i, j) for i, j in itertools.combinations(range(a, b + 1), 2)]
        top = max(found, key=lambda x: (x[0], x[2] - x[1]), default=(0,))
        if top[0] <= 0:
            return []
        return best(a, top[1]) + [top] + best(top[2], b)
    return best(0, len(s))


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    s = np.array([rng.uniform(-2, 1.5) for _ in range(18)])
    got, want = toxicity.segments(s), brute_segments(s.tolist())
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert np.allclose([x[0] for x in got], [x[0] for x in want])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert len(got) > 500 and right / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)] + [(None, 1), (101, None), (101, 1)], "doc_id long, toxic int")
    rows = [(i, f"fine words here {i} " + ("nastyword badword nastyword" if i % 2 else "good stuff")) for i in range(100, 140)]
    rows += ODD_ROWS
    got = toxicity.score_toxicity(docs(spark, rows), labels, carry=("key", "text")).collect()
    assert len(got) == len(rows)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if (r["doc_id"] or 0) >= 100)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (1, 2, 3)) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    none = toxicity.score_toxicity(docs(spark, rows), labels.limit(0)).collect()
    assert len(none) == len(rows) and {r["predicted"] for r in none} == {0}
    assert toxicity.score_toxicity(docs(spark, []).limit(0), labels).collect() == []


def best_runs(scores, offset=0):
    """All maximal-scoring segments by definition: the best run, then those left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return best_runs(scores[:a], offset) + [(best, offset + a, offset + b)] + best_runs(scores[b:], offset + b)


def test_odds_and_score_against_plain_python(spark):
    import math
    import zlib
    from collections import Counter

    sf = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r[0]: r[1] or "" for r in documents.select("doc_id", "text").collect()}
    toxic = {r[0]: r[1] for r in labels.select("doc_id", "toxic").collect() if r[0] in texts and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5}
    words = {i: [w for w in ("".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in texts[i])).split(" ") if w]
             for i in texts}
    clean_n, toxic_n = Counter(), Counter()
    for i, y in toxic.items():
        for f in {g for w in set(words[i]) for g in (w, "^" + w[:5], "^" + w[:4])}:
            (toxic_n if y else clean_n)[f] += 1
    base = (sum(toxic.values()) + 0.5) / (len(toxic) + 1)
    logit = lambda p: math.log(p / (1 - p))
    rate = lambda f, parent: (toxic_n[f] + 5 * parent) / (toxic_n[f] + clean_n[f] + 5)
    want = {}
    for f in set(clean_n) | set(toxic_n):
        if clean_n[f] + toxic_n[f] >= 5:
            w = f.removeprefix("^")
            p4 = rate("^" + w[:4], base)
            p5 = rate("^" + w[:5], p4)
            want[f] = logit(rate(f, p5) if f[0] != "^" else p4 if len(w) <= 4 else p5) - logit(base)
    prepare(spark)
    model = toxicity.fit(documents, labels)
    assert set(model.odds) == set(want) and all(abs(model.odds[f] - x) < 1e-9 for f, x in want.items()) and len(want) > 500
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(documents, labels).collect()}
    some = [i for i in texts if len(words[i]) <= 250][:150] + [i for i, y in toxic.items() if y and len(words[i]) <= 250][:20]
    for i in some:
        s = [next((want[f] for f in (w, "^" + w[:5], "^" + w[:4]) if f in want), 0.0) - toxicity.DRIFT for w in words[i]]
        chance = math.log(max(model.k * len(s), 1e-300)) if s else 0.0
        evidence = [x for x in (model.lam * run - chance for run, _, _ in best_runs(s)) if x >= -math.log(toxicity.MAX_E)]
        score = 1 / (1 + math.exp(-(model.a + model.b * math.log1p(sum(evidence)))))
        assert abs(got[i]["score"] - score) < 1e-3 and got[i]["n_passages"] == len(evidence) and got[i]["predicted"] == int(score >= 0.5)
    assert any(got[i]["n_passages"] for i in some)
