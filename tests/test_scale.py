"""Work that must not grow faster than the input: what the joins, the metrics
and the readers of quoted files move and repeat."""

import random

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as TX
from inkgauge.functions.pymetrics import word_edit_distance, word_error_rates
from inkgauge.plans import catalog as C
from inkgauge.sources import delimited as DL
from inkgauge.sources import derived


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_text_a_side_crosses_the_merge(spark, sf001):
    below = _plan(C.evaluation_input(spark, sf001)).split("Join Inner")[1]
    assert "replace(" not in below and "translate(" not in below


def test_late_method_texts_equal_the_merged_tables(spark):
    docs = spark.createDataFrame([(0, "oil **b** [x] the tion"), (13, "a b c d e f"), (17, None), (50, "eau ou ing ment"), (50, "x"),
                                  (None, "no id")], "doc_id long, text string")
    from inkgauge.plans import score as S
    whole = S.merge_inputs(derived.primary_table(docs), derived.bart_table(docs))
    late = derived.method_texts(S.merge_inputs(derived.primary_sources(docs), derived.bart_sources(docs)))
    assert whole.columns == late.columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, late.collect()))
    assert whole.count() == 13  # 0 and 50 come twice on the right, 50 on the left as well


def test_word_sets_meet_once_for_all_metrics(spark, sf001):
    p = _plan(C.set_scores(spark, sf001))
    assert "array_intersect" not in p and "array_union" not in p
    assert p.count("concat(_rs") == 1


@pytest.mark.parametrize("text", ["a correct this ocr: b", "CORRECT THIS OCR x", "correct thıs ocr x", "correct thiſ OCR: x",
                                  "corrcorrect this ocrect this ocr: x", "correct  this ocr", "é plain", ""])
def test_guarded_phrases_are_deleted_as_by_the_patterns_alone(spark, text):
    c = F.col("t")
    alone = c
    for p in TX.DEFAULT_PHRASES:
        alone = F.regexp_replace(alone, "(?iu)" + TX.java_quote(p), "")
    r = spark.createDataFrame([(text,)], "t string").select(TX.delete_phrases(c).alias("a"), alone.alias("b")).first()
    assert r["a"] == r["b"]


def _slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_with_equal_ends_and_unknown_words():
    r = random.Random(5)
    for _ in range(500):
        a = [str(r.randint(0, 4)) for _ in range(r.randint(0, 30))]
        b = a[:r.randint(0, 30)] + [str(r.randint(0, 6)) for _ in range(r.randint(0, 12))] + a[r.randint(0, 30):]
        assert word_edit_distance(a, b) == _slow_distance(a, b)
        if a:
            assert word_error_rates(" ".join(a), [" ".join(b)]) == [_slow_distance(a, b) / len(a)]


def test_numbering_lines_shuffles_nothing(spark, tmp_path):
    rows = [(i, "\n".join(f'q"{j}' * (j % 3) for j in range(i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    from inkgauge.sinks.writers import write_quoted_csv
    from inkgauge.sources.files import read_delimited
    path = str(tmp_path / "csv")
    write_quoted_csv(df, path)
    plan = DL._numbered_lines(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # records cross blocks
    try:
        got = {(int(r["k"]), r["v"] or "") for r in read_delimited(spark, path, na_tokens=[]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
    assert got == set(rows)


def test_many_files_are_read_in_few_tasks_from_many_folders(spark, tmp_path):
    import os

    from inkgauge.sinks import writers as W
    from inkgauge.sources import files as FS
    n, out = 600, str(tmp_path / "out")
    rows = spark.range(n).select(F.concat("id", F.lit(".model")).alias("file_name"), F.concat(F.lit("é "), "id").alias("text"))
    assert W.write_named_files(rows, out, folders=W.MANY_FOLDERS).count() == n
    # folders enough for a listing by tasks, about as many files in each
    held = [len(os.listdir(f"{out}/{d}")) for d in os.listdir(out)]
    assert 32 < len(held) <= W.MANY_FOLDERS and sum(held) == n and max(held) < n // 10
    back = FS.read_sidecars(spark, out, ".model")
    assert {(r["file_name"], r["text"], r["error"]) for r in back.collect()} == {(f"{i}.model", f"é {i}", None) for i in range(n)}
    for df in (FS.list_images(spark, out), back):
        assert "Coalesce" in df._jdf.queryExecution().executedPlan().toString()
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out).select("path")
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    assert named.rdd.getNumPartitions() > most >= FS._in_few_tasks(named).rdd.getNumPartitions()


@pytest.mark.parametrize("text", ["\x1c　 **a** <|begin_of_text|>b[x_1] \n\x85 ", "<|start_header_id|>u\n<|end_header_id|>t<|eot_id|>", "**", " ​ ", "[a b]**[é]*"])
def test_markup_and_space_by_bytes_as_by_patterns(spark, text):
    alone = F.col("t")
    for p in TX.MARKUP_PATTERNS:
        alone = F.regexp_replace(alone, p, "")
    alone = F.regexp_replace(alone, f"^[{TX.PY_SPACE_CLASS}]+|[{TX.PY_SPACE_CLASS}]+$", "")
    r = spark.createDataFrame([(text,)], "t string").select(TX.clean_markup(F.col("t")).alias("a"), alone.alias("b")).first()
    assert r["a"] == r["b"] == r["b"].strip()


@pytest.mark.parametrize("rows", [
    [("1", "correct this ocr: A b, c\x85d", "a-b  c\u00e9"), ("2", None, "x"), ("3", "x", None), ("3", "", "")],
    [("a", "C:\\new \\u00e9t\u00e9 b", "c new \u00e9t\u00e9"), ("b", "\\", "a\\"), ("c", "\u0141\\u0141 a", "\u0141a"), (None, "b \\n a", "a b")],
    [("o", "correct th\u0131s OCR q", "q CORRECT \u212a thi\u017f ocr"), ("p", "correct thi\u017f ocr: r", "r"), ("q", "corrcorrect this ocrect this ocr: x", "x"),
     ("r", "\u00df\u00aa\u00b5 \u20ac \x1ca\u3000b", "\u00df \u00b2 a b")],
])
def test_sets_counted_in_batches_as_natively(spark, rows):
    from inkgauge.plans import score as S
    wide = spark.createDataFrame(rows, "id string, transcription string, pyte_ocr string").withColumn("BART_untuned", F.col("transcription"))
    native = S.score(wide, metrics=C.SET_METRICS, flag_repetition=False).select("id", "method", "ordinal", *C.SET_METRICS, "equal_jaccard")
    batches = S.score(wide, metrics=C.SET_METRICS, batches=True)
    assert batches.columns == native.columns
    assert sorted(map(repr, batches.collect())) == sorted(map(repr, native.collect()))
    with pytest.raises(ValueError, match="ASCII"):
        S.score(wide, metrics=C.SET_METRICS, batches=True, phrases=["\u00e9"])


def test_set_reports_normalise_no_text_and_shuffle_only_the_merge(spark, sf001):
    for q in (C.q_precision_recall, C.q_jaccard):
        p = _plan(q(spark, sf001))
        assert p.count("ArrowEvalPython") == 1 and "array_distinct" not in p and " {2,}" not in p
    assert "ArrowEvalPython" in _plan(C.set_values(spark, sf001))


def test_moments_and_quantiles_read_the_values_once(spark):
    import numpy as np

    from inkgauge.operators import stats
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    r = random.Random(3)
    rows = [(g, r.choice([1e9 + r.random(), 1e9, float("nan"), None])) for g in ("a", "b", None) for _ in range(200)]
    rows += [("one", 2.5), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, value double").repartition(3).mapInArrow(tell, "g string, value double")
    got = {x["g"]: x for x in stats.describe(df, ["g"]).collect()}
    assert seen.value == len(rows) and set(got) == {"a", "b", None, "one", "none", "nan"}
    for g in ("a", "b", None):
        xs = [v for k, v in rows if k == g and v is not None and v == v]
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(xs), min(xs), max(xs))
        assert abs(got[g]["mean"] - np.mean(xs)) < 1e-6 and abs(got[g]["std_dev"] - np.std(xs, ddof=1)) < 1e-6
    assert (got["one"]["n"], got["one"]["mean"], got["one"]["std_dev"], got["one"]["median"]) == (1, 2.5, None, 2.5)
    assert all((got[g]["n"], got[g]["mean"], got[g]["median"]) == (0, None, None) for g in ("none", "nan"))
