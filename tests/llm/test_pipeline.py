import hashlib
from collections import Counter

import corpus_pipeline
from inkgauge.llm.common import prepare

from .test_decontamination import brute as brute_leaks
from .test_lines_urls import brute_lines
from .test_near_dup import brute as brute_groups
from .test_packing import check as check_packing
from .util import ODD_ROWS, docs

SF = "/root/testdata/sf0.01"


def run_stages(spark, frame):
    out = []
    for _, step in corpus_pipeline.STAGES:
        frame = step(spark, frame, SF).persist()
        out.append(frame)
    return out


def text_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def check(spark, frame):
    start = text_rows(frame)
    stages = run_stages(spark, frame)
    assert [tuple(x.columns) for x in stages[:-1]] == [corpus_pipeline.COLUMNS] * 4
    toxic, lines, near, leaks = map(text_rows, stages[:4])
    assert Counter(toxic) <= Counter(start)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((i, sha(t)) for i, t in lines), key=repr) == sorted(((r[0], r[3]) for r in brute_lines(toxic)), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[1].collect())
    gone = {r[0] for r in brute_groups(lines, 5, (80, 100)) if not r[3]}
    assert Counter(near) == Counter((i, t) for i, t in lines if i not in gone)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    numbered = list(enumerate(t for _, t in near))
    leaked = {d for d, *_ in brute_leaks(numbered, items)}
    assert Counter(leaks) == Counter(r for k, r in enumerate(near) if k not in leaked)
    return toxic, leaks, stages[4]


def test_stages_against_brute_force(spark):
    prepare(spark)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, left, packed = check(spark, frame)
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()}
    stay = {i for i, _ in toxic}
    # 400 labels, 50 of them toxic: few, but clean documents stay
    assert sum(i in stay for i, t in labels.items() if not t) >= 0.99 * sum(not t for t in labels.values())
    assert sum(i not in stay for i, t in labels.items() if t) >= 0.6 * sum(labels.values())
    check_packing(packed.collect(), dict(left))


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "packing"]


def test_odd_rows(spark):
    prepare(spark)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = ODD_ROWS + [(None, item), (50, item), (51, "x " + item.upper()), (None, "z " * 9 + "end")]
    frame = docs(spark, rows).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars", "id", "key", "h")
    _, left, packed = check(spark, frame)
    assert (None, item) not in left and 50 not in dict(left) and any(i is None for i, _ in left)
    assert len({r["doc_id"] for r in packed.collect()}) == len({i for i, _ in left})
    assert [x.count() for x in run_stages(spark, frame.limit(0))] == [0] * 5
