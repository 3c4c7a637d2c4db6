import random

from inkgauge.llm import decontamination
from inkgauge.llm.queries import op7_decontamination

from .util import ODD_ROWS, docs


def shingles(text, n=5):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            a, b = shingles(t), shingles(x)
            if b and 100 * len(a & b) >= 80 * len(b):
                out.add((d, i, len(b), len(a & b)))
    return out


def test_planted_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(1, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "tiny item"), (None, text(20)), (5, text(30))]
    rows = [(i, text(rng.randint(0, 400))) for i in range(30)]
    for k, (_, x) in enumerate(items):
        words = (x or "").split()
        for cut in (0.0, 0.1, 0.2, 0.3):
            keep = words[: len(words) - int(cut * len(words))]
            rows.append((100 + 10 * k + int(cut * 10), f"{text(50)} {' '.join(keep).upper()}\n{text(900)}"))
    rows += [(900, "tiny  ITEM"), (900, "tiny  ITEM")] + [r for r in ODD_ROWS if r[0] is not None]
    own = {}
    for i, x in items:
        own.setdefault((i, x))
    got = decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    # two items share id 5: the better containment is the pair's
    want = {}
    for d, i, n, s in brute(rows, list(own)):
        want[d, i] = max(want.get((d, i), 0), s / n)
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in got.collect()} == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs(spark, rows[:3]), empty).collect() == []
    assert decontamination.contaminated(docs(spark, []).limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_without_broadcast(spark, sf001, monkeypatch):
    want = sorted(map(tuple, op7_decontamination(spark, sf001).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, op7_decontamination(spark, sf001).collect())) == want


def test_no_python_in_the_plan(spark, sf001):
    plan = op7_decontamination(spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_key_bitmap_loses_no_key(spark):
    rows = spark.range(200_000).selectExpr("if(id % 7 = 0, null, id) id", "xxhash64(id, 5) th", "id n")
    keys = rows.where("n % 400 = 3").selectExpr("id c_id", "th c_th")
    near, clean = decontamination._split(rows, keys)
    assert near.join(keys, decontamination._same_key(), "left_semi").count() == keys.count() == 500
    assert clean.join(keys, decontamination._same_key(), "left_semi").count() == 0
    assert near.count() + clean.count() == 200_000 and near.count() < 520
    none = decontamination._split(rows, keys.limit(0))
    assert [x.count() for x in none] == [0, 200_000]


def test_results_do_not_depend_on_the_bitmap(spark, sf001, monkeypatch):
    frame, items = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.contaminated(frame, items).collect()))
    kept = sorted(r["doc_id"] for r in decontamination.drop_contaminated(frame, items).collect())
    assert kept == sorted({r["doc_id"] for r in frame.collect()} - {r[0] for r in want})
    monkeypatch.setattr(decontamination, "KEY_BITS", 1)  # every row may be a key
    assert sorted(map(tuple, decontamination.contaminated(frame, items).collect())) == want
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(frame, items).collect()) == kept


def test_dropping_keeps_columns_and_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    frame = docs(spark, ODD_ROWS + [(None, item), (1, "x " + item.upper()), (1, "other words")]).withColumnRenamed("pos", "th").withColumnRenamed("n", "c_id")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.drop_contaminated(frame, items)
    assert left.columns == frame.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, ODD_ROWS + [(1, "other words")]))
    assert decontamination.drop_contaminated(frame.limit(0), items).collect() == []
    assert decontamination.drop_contaminated(frame, items.limit(0)).count() == len(ODD_ROWS) + 3
