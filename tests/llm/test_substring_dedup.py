import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from inkgauge.llm import substring_dedup
from inkgauge.llm.common import split_words
from inkgauge.llm.substring_dedup import dedup_substrings

from .util import ODD_ROWS, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    source = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - n + 1):
                k = tuple(w[p:p + n])
                source[k] = min(source.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - n + 1):
            if i is not None and source.get(tuple(w[p:p + n]), i) < i:
                gone |= set(range(p, p + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == brute(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, WORD.findall(t or ""))
    repeats = {i for i in texts if sum(j == i for j, _ in rows) > 1}
    for r in got:  # every span's words stand at its source coordinates
        for s in r["spans"]:
            assert s["source_id"] < r["doc_id"]
            if not repeats & {s["source_id"], r["doc_id"]}:
                n = s["end"] - s["start"]
                assert texts[r["doc_id"]][s["start"]:s["end"]] == texts[s["source_id"]][s["source_start"]:s["source_start"] + n]


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(dedup_substrings(df), rows)


def test_planted_passages(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]  # few words: chance repeats of cores, branching paths
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (12, 13, 14, 25, 60, 200)] + [["a"] * 40, ["x", "y"] * 20]
    rows = []
    for i in range(60):
        words = text(rng.randint(0, 40))
        for p in rng.sample(passages, 3):
            cut = rng.randint(0, 5)
            words += p[cut:] + text(rng.randint(0, 12))
        rows.append((rng.randint(10, 400), " ".join(words)))
    rows = list(dict(rows).items())
    rows += [(500, rows[3][1]), (501, rows[3][1]), (9, rows[3][1] + " tail"), (None, rows[3][1]), (502, rows[4][1]), (502, rows[4][1])]
    rows += ODD_ROWS
    check(dedup_substrings(docs(spark, rows)), rows)
    assert dedup_substrings(docs(spark, []).limit(0)).collect() == []


def test_paths_do_not_depend_on_their_surroundings():
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    cut = lambda texts: substring_dedup.Cut(*split_words(pa.array([" ".join(t) for t in texts])))
    one = cut([words])
    two = cut([["z"] * 30, ["q"] * 9 + words + ["r"] * 9, [], ["k"] * 13])
    inner = set(zip(one.minimizer[1:-1], one.content[1:-1]))
    assert inner <= set(zip(two.minimizer, two.content)) and len(inner) > 10


def test_words_are_the_ascii_ones():
    texts = [None, "", " \n ", "a", " a\tb\x0bc\x0c\rd ", "x\u00a0y\x1cz \u2003", "  two  gaps  "]
    words, first = split_words(pa.array(texts))
    got = [words.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


def test_hot_passage_meets_as_one_row_a_task(spark):
    """A passage in each of 6,000 documents: no task is dealt many of its rows."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"r{rng.randint(0, 10**9)}" for _ in range(5)) + " " + passage) for i in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    paths = df.mapInArrow(substring_dedup._paths, "m bigint, c bigint, id bigint, pos bigint, src bigint, kind int")
    met = paths.where(F.col("kind").isin(substring_dedup.SENT, substring_dedup.WORD))
    assert met.groupBy("m").count().agg({"count": "max"}).first()[0] < 100 and paths.where("kind = 1").count() > 6000
    got = dedup_substrings(df, "id").select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
