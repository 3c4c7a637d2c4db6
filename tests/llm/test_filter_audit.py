import itertools
import math
import re

from inkgauge.llm import filter_audit as A

from .util import ODD_ROWS, docs


def failed(text, doc, first):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {x for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                                          100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)),
                                          doc is not None and first.get(t, doc) < doc)) if bad}


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id -> (quality, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = {}
    for i, t, lang in rows:
        parts.setdefault(lang or "", []).append((failed(t, i, first), *[x == 1 for x in labels.get(i, (0, 0))]))
    out = []
    for part, own in parts.items():
        found = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                found.append([part, order, step, len(left), len(gone), sum(f in x[0] for x in own) - len(gone),
                              sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        for r in found:
            out.append((*r, sum(x[4] for x in found if x[1][x[2] - 1] == r[1][r[2] - 1])))
    return sorted(out)


ROWS = ODD_ROWS + [(20, "Ab c " * 60 + "#"), (21, "Ab c " * 60 + "#"), (21, "Ab c " * 60 + "#"), (None, "Ab c " * 60 + "#"), (9, "Ab c " * 60 + "#"),
                   (22, " ".join(f"w{i}" for i in range(400))), (23, " ".join(f"w{i}" for i in range(400))), (24, "ÀÉ x " * 300),
                   (25, " ".join(f"W{i}" for i in range(250))), (26, "a b " * 100_000), (27, "x|y")]


def frame(spark, rows):
    out = docs(spark, [r[:2] for r in rows])
    return out.selectExpr("doc_id", "text", "case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else 'x' || doc_id % 4 end lang",
                          "key part", "key mask", "key own", "key first", "key digest", "key doc", "key good")


def test_against_brute_force(spark):
    labels = [(20, 1, 0), (20, 0, 1), (22, 1, None), (24, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (4, 5, 0)]
    known = {20: (1, 1), 22: (1, 0), 24: (0, 1), 7: (1, 1)}
    lab = spark.createDataFrame([(*r, "x", "x") for r in labels], "doc_id long, quality int, toxic int, part string, n string")
    lang = lambda i: None if i is None else None if i % 4 == 0 else "" if i % 4 == 1 else f"x{i % 4}"
    fr = frame(spark, ROWS)
    got = sorted(tuple(r) for r in A.audit_filters(fr, lab).collect())
    # a null id has no remainder: the SQL expression falls through to null
    want = brute([(i, t, lang(i)) for i, t in ROWS], known)
    assert got == want and len({r[0] for r in got}) == 3
    assert A.audit_filters(fr.limit(0), lab).count() == 0
    assert len(A.audit_filters(fr, lab.limit(0)).collect()) == len(want)


def test_intervals_are_the_orders(spark):
    for k in range(1, 6):
        filters = "ABCDE"[:k]
        orders = [A.order_at(r, filters) for r in range(math.factorial(k))]
        assert orders == sorted(map("".join, itertools.permutations(filters)))
        for mask in range(1, 1 << k):
            bad = {x for i, x in enumerate(filters) if mask >> i & 1}
            for step in range(1, k + 1):
                want = {r for r, o in enumerate(orders) if o[step - 1] in bad and not bad & set(o[:step - 1])}
                got = [r for m, s, a, b in A.intervals(filters) if (m, s) == (mask, step) for r in range(a, b)]
                assert sorted(got) == sorted(want)


def test_largest_group_is_the_masks_of_a_part(spark):
    """Copies of one text are counted before they are shuffled."""
    rows = [(i, "same text") for i in range(3000)]
    counts = {(r["part"], r["mask"]): r["n"] for r in A.mask_counts(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert counts == {("en", 1): 1, ("en", 17): 2999}
