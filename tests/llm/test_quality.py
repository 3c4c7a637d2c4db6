import math
import re
from collections import Counter

from inkgauge.llm import quality
from inkgauge.llm.queries import op6_quality

from .util import ODD_ROWS, docs


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered)), len(lines), len(set(words))


def brute_votes(counts, n_lines, n_distinct):
    n, chars, symbols, dup, repeat = counts
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    return (vote(n < 50, n >= 100), vote(chars < 3 * n or chars > 12 * n, 4 * n <= chars <= 9 * n), vote(symbols * 10 > n, symbols * 50 <= n),
            vote(dup * 10 > n_lines * 3, dup * 20 <= n_lines), vote(repeat * 10 > n * 3, repeat * 10 <= n), vote(n_distinct * 5 < n, n_distinct * 3 >= n))


def brute_em(patterns):
    n_rules, share = 6, quality.GOOD / (quality.GOOD + quality.BAD)
    acc = [quality.RIGHT / (quality.RIGHT + quality.WRONG)] * n_rules
    good = lambda v: 1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc)))))
    for _ in range(quality.ROUNDS):
        q = {v: good(v) for v in patterns}
        share_new = (sum(n * q[v] for v, n in patterns.items()) + quality.GOOD) / (sum(patterns.values()) + quality.GOOD + quality.BAD)
        acc = [min(max((sum(n * (q[v] if v[j] > 0 else 1 - q[v]) for v, n in patterns.items() if v[j]) + quality.RIGHT)
                       / (sum(n for v, n in patterns.items() if v[j]) + quality.RIGHT + quality.WRONG), 0.5), 0.99) for j in range(n_rules)]
        share = share_new
    return {v: good(v) for v in patterns}


def check(got, texts):
    brute = [brute_counts(t) for t in texts]
    votes = [brute_votes(*b) for b in brute]
    p = brute_em(Counter(votes))
    want = Counter()
    for (counts, _, _), v in zip(brute, votes):
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want[(*counts, failed, not failed and p[v] >= 0.5)] += 1
    assert Counter(tuple(r)[1:8] for r in got) == want


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op6_quality(spark, sf).collect()
    check(got, [r[1] for r in rows])
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    good = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1 and r["n_words"] >= 50]
    bad = [r["kept"] for r in got if labels.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_odd_rows(spark):
    rows = ODD_ROWS + [(20, "a b c a b c"), (21, "a a a a"), (22, "x y"), (23, "a b c d"), (24, "l1 x\nl1 x\n\n\nl2\n l1 x")]
    got = quality.judge_quality(docs(spark, rows)).collect()
    check(got, [t for _, t in rows])
    assert quality.judge_quality(docs(spark, []).limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf001):
    plan = op6_quality(spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
