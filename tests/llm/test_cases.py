"""Very long texts and clashing column names, for every operator at once."""

import hashlib

import pytest
from inkgauge.llm import decontamination, licenses, line_dedup, near_dup, packing, quality, secrets, substring_dedup, toxicity, url_reputation
from inkgauge.llm.common import prepare
from inkgauge.llm.queries import public_tokenizer
from pyspark.sql import functions as F

from .test_lines_urls import brute_lines
from .test_near_dup import brute as brute_groups
from .test_packing import check as check_packing
from .test_substring_dedup import brute as brute_substrings
from .util import docs

LONG = [(1, " ".join(f"w{i % 977}" for i in range(120_000))), (2, "x" * 300_000), (3, "same " * 60_000),
        (4, "\n".join(["a line of more than forty characters, repeated often"] * 3000)), (5, None), (6, "short one"), (6, "short one")]
CLASH = ["id", "text", "key", "host", "th", "item", "h", "n", "good", "label", "s", "words"]


def clashing(df, keep):
    """``df`` with columns that bear the operators' inner names."""
    return df.select(*keep, *[F.lit("clash").alias(c) for c in CLASH if c not in keep])


@pytest.fixture(scope="module")
def long_docs(spark):
    prepare(spark)
    return docs(spark, LONG)


def test_long_texts_against_brute_force(spark, long_docs):
    sub = substring_dedup.dedup_substrings(long_docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, sub), key=repr) == brute_substrings(LONG)
    lines = line_dedup.dedup_lines(long_docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, lines), key=repr) == sorted(brute_lines(LONG), key=repr)
    groups = near_dup.near_duplicates(long_docs).collect()
    assert sorted(map(tuple, groups), key=repr) == sorted(brute_groups(LONG), key=repr)
    unique = [r for r in LONG[:-1]]
    check_packing(packing.pack(docs(spark, unique), public_tokenizer()).collect(), dict(unique))


def test_long_texts_are_scanned_whole(spark, long_docs):
    tail = " password = hunter22 x Released under the MIT License"
    rows = [(i, (t or "") + tail) for i, t in LONG[:4]]
    found = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    notices = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, t in rows:
        assert found[i]["n_assign"] == 1 and "mit" in notices[i]["labels"]
        at = t.rindex("password")
        assert found[i]["base_sha256"] == hashlib.sha256(f"assign:{at}:{at + len('password = hunter22')}".encode()).hexdigest()
    judged = {r["doc_id"]: r for r in quality.judge_quality(long_docs).collect()}
    assert judged[1]["n_words"] == 120_000 and judged[3]["base_failed"] and judged[2]["word_chars"] == 300_000


def test_clashing_columns_of_every_table(spark, long_docs):
    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    pages, labels, items = read("pages"), read("labels"), read("benchmark")
    plain = url_reputation.judge_urls(pages, labels).collect()
    odd = url_reputation.judge_urls(clashing(pages, ["page_id", "url"]), clashing(labels, ["doc_id", "quality"])).collect()
    assert sorted(map(tuple, odd), key=repr) == sorted(map(tuple, plain), key=repr)
    text = read("documents").select("doc_id", "text")
    plain = decontamination.contaminated(text, items).collect()
    odd = decontamination.contaminated(clashing(text, ["doc_id", "text"]), clashing(items, ["item_id", "text"])).collect()
    assert sorted(map(tuple, odd), key=repr) == sorted(map(tuple, plain), key=repr) and plain
    plain = toxicity.score_toxicity(text, labels).select("doc_id", "predicted", F.round("score", 9)).collect()
    odd = toxicity.score_toxicity(clashing(text, ["doc_id", "text"]), clashing(labels, ["doc_id", "toxic"])).select(
        "doc_id", "predicted", F.round("score", 9)).collect()
    assert sorted(map(tuple, odd), key=repr) == sorted(map(tuple, plain), key=repr)


def test_url_plan_has_no_python(spark):
    sf = "/root/testdata/sf0.001"
    out = url_reputation.judge_urls(*[spark.read.parquet(f"{sf}/{n}.parquet") for n in ("pages", "labels")])
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
