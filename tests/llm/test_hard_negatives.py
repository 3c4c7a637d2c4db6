import math

import numpy as np
import pytest
from inkgauge.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, id string, v string, leaf string, square string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, lab, *["x"] * 5) for i, e, lab in rows], SCHEMA).repartition(3)


def ints(e):
    return [math.floor(256 * float(np.float32(x))) for x in e]


def brute(rows, every=100):
    part = [(i, lab, ints(e)) for i, e, lab in rows if i is not None and lab is not None and e is not None
            and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (ai, al, av) in enumerate(part):
        if ai % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, bv)), bi, b, bl) for b, (bi, bl, bv) in enumerate(part) if b != a)
        for s, pi, _, _ in [x for x in scored if x[3] == al][:5]:
            ok = [x for x in scored if x[3] != al and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(ai, pi, k + 1, x[1], -s, -x[0]) for k, x in enumerate(ok)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


SMALL = dict(sample_rows=300, arity=4, leaf_sample=20, block_rows=50)


def clustered(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    v = centers[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dim))
    return [(int(i), [float(np.float32(x)) for x in v[i] / np.linalg.norm(v[i])], int(rng.integers(0, 3))) for i in range(n)]


def test_against_brute_force(spark):
    for rows in (clustered(700), [(i, e, lab) for i, e, lab in clustered(500, 16, 2)]):
        want = brute(rows, 20)
        assert got(H.mine(frame(spark, rows), anchor_every=20, **SMALL)) == want and len(want) > 100
    # one leaf, one block; more leaves than rows need
    assert got(H.mine(frame(spark, rows), anchor_every=20)) == want
    assert got(H.mine(frame(spark, rows), anchor_every=20, sample_rows=500, arity=3, leaf_sample=2, block_rows=7)) == want


def test_hot_vector_ties_and_repeated_rows(spark):
    rows = clustered(300)
    hot = rows[0][1]
    rows += [(1000 + i, hot, i % 3) for i in range(200)] + [(100, rows[100][1], 1), (100, rows[100][1], 1), (100, hot, 2)]
    assert got(H.mine(frame(spark, rows), **SMALL)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 0.5], 1), (100, None, 1), (100, [1.0, 0.5], None), (200, [1.0, None], 1), (200, [nan, 1.0], 1), (200, [inf, 1.0], 1),
            (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.8], 2), (3, [], 2), (4, [0.7, 0.7, 0.7], 2), (5, [-1.0, -1.0], 1), (6, [0.99, 0.5], 2),
            (-100, [0.0, 0.0], 1), (7, [0.1, 0.1], 3), (300, [-0.5, -0.5], 9), (8, [1.1, 0.5], 2)]
    want = brute(rows)
    assert got(H.mine(frame(spark, rows), **SMALL)) == want and want
    assert H.mine(frame(spark, rows).limit(0)).count() == 0
    assert H.mine(frame(spark, rows[:6])).count() == 0
    assert H.mine(frame(spark, [(0, [1.0], 1)])).collect() == []
    with pytest.raises(ValueError):
        H.mine(frame(spark, [(0, [1e9], 1), (1, [1e9], 1)]))


def test_ranges_rule_subtrees_out_and_never_a_hit(spark):
    rows = np.floor(256 * np.array([e for _, e, _ in clustered(1500)]))
    longest = (rows ** 2).sum(1).max()
    lift = H._lift((rows ** 2).sum(1), longest)
    nodes, leaves = H.fit(rows[:400], lift[:400], 6, 25)
    for n in nodes:
        n.lo, n.hi = (np.full((len(n.points),) * 2, x) for x in (np.inf, -np.inf))

    def seen(n, j, d):
        n.lo[:, j], n.hi[:, j] = np.minimum(n.lo[:, j], d.min(0)), np.maximum(n.hi[:, j], d.max(0))

    leaf = H.route(nodes, rows, lift, seen)
    q = rows[::50]
    scores = q @ rows.T
    hi = np.sort(scores, 1)[:, -2]
    lo = np.ceil(0.8 * hi)
    radius = lambda s: np.sqrt(np.maximum((q ** 2).sum(1) + longest - 2 * s, 0))[:, None]
    goes = H.reached(nodes, leaves, q, radius(hi), radius(lo))
    for i in range(len(q)):
        inside = (scores[i] >= lo[i]) & (scores[i] <= hi[i])
        assert goes[i, leaf[inside]].all()
    assert goes.mean() < 0.6  # most of the tree is eliminated
    assert not H.reached(nodes, leaves, q, radius(lo) + 1, radius(lo)).any()
