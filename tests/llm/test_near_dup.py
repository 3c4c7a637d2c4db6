import random

import numpy as np

from inkgauge.llm import near_dup
from inkgauge.llm.components import connected_components
from inkgauge.llm.queries import op3_near_dup

from .util import ODD_ROWS, docs


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1)) if w else frozenset()


def brute(rows, n=3, similarity=(85, 100)):
    """Components over all pairs that share a shingle, by their full sets."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                holders.setdefault(x, []).append(k)
    pairs = {(a, b) for own in holders.values() if len(own) > 1 for a in own for b in own if a < b}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        if similarity[1] * len(x & y) >= similarity[0] * len(x | y):
            p, q = sorted((find(i), find(j)))
            parent[q] = p
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(not r[3] for r in want) > 50
    assert got(op3_near_dup(spark, sf)) == want


def families(rng, edits):
    """Chains and stars of texts whose neighbours are about as similar as asked."""
    vocabulary, rows, n = [f"w{i}" for i in range(2000)], [], 0
    for size in (2, 3, 40, 150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        for k in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, int(edits * len(words))))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if k % 2:
                base = words  # a chain: far members are linked through others only
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_borderline_families_lose_no_link(spark):
    rng = random.Random(11)
    rows = families(rng, 0.03) + [(i + 1000, t) for i, t in families(rng, 0.05)] + ODD_ROWS
    rows = [(i if i is None or i >= 10 else i + 5000, t) for i, t in rows]
    rows += [(777, rows[0][1]), (777, rows[-30][1]), (778, "One Two"), (779, "one\ttwo"), (780, "one two three")]
    for n, similarity in ((3, (85, 100)), (5, (80, 100))):
        assert got(near_dup.near_duplicates(docs(spark, rows), shingle=n, similarity=similarity)) == brute(rows, n, similarity)


def test_members_halfway_to_the_hub_lose_no_link(spark):
    """Pairs linked with each other, one of them at similarity 0.4 to 0.65 to a
    hub that shares buckets with both, whatever their sketches say."""
    rng = random.Random(23)
    rows, n = [], 0
    for family in range(12):
        word = lambda k: f"f{family}w{k}"  # noqa: B023, E731
        base = [word(i) for i in range(220)]
        for k in range(8):  # the hub and its close copies
            rows.append((n := n + 1, " ".join(base[:220 - k])))
        for m in range(6):
            cut = rng.randint(45, 95)
            far = base[:220 - cut] + [f"x{family}m{m}i{i}" for i in range(cut)]
            other = far[:-rng.randint(1, 22)]
            rows += [(n := n + 1, " ".join(far)), (n := n + 1, " ".join(other))]
    want = brute(rows)
    sets = {i: shingles(t, 3) for i, t in rows}
    middle = [len(sets[i] & sets[1]) / len(sets[i] | sets[1]) for i, _ in rows[:20]]
    assert sum(0.4 < x < 0.65 for x in middle) >= 6 and len({r[2] for r in want}) > 12
    assert got(near_dup.near_duplicates(docs(spark, rows))) == want


def test_empty(spark):
    assert near_dup.near_duplicates(docs(spark, []).limit(0)).collect() == []
    assert got(near_dup.near_duplicates(docs(spark, [(1, None), (None, "a b c")]))) == [(1, 0, 1, True), (None, 1, None, True)]


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 900, np.uint64)
    a, b, c = (np.concatenate([common, rng.integers(0, 2**63, 50, np.uint64)]) for _ in range(3))
    x, y, z = near_dup.odd_sketches(near_dup.min_hashes([a, b, rng.integers(0, 2**63, 900, np.uint64)])).view(np.uint64)
    bits = lambda p, q: int(np.bitwise_count(p ^ q).sum())
    estimate = 1 + 256 / 400 * np.log(1 - 2 * bits(x, y) / 256)
    assert abs(estimate - 0.9) < 0.1 and bits(x, z) > near_dup.MAX_XOR


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    random.Random(1).shuffle(links)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
