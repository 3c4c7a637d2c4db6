"""What the findings of round 4 ask for: plans, results and sizes on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.operators import histograms as H
from inkgauge.plans import catalog as C
from inkgauge.plans import score as S


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variants_leave_no_scoring_in_a_filter(spark, tmp_path):
    spark.createDataFrame([("1", "a b", "a"), ("2", None, "b")], "id string, x string, y string").write.parquet(f"{tmp_path}/t")
    wide = spark.read.parquet(f"{tmp_path}/t")
    scored = wide.select("id", *[(F.length(F.regexp_replace(c, "b", "")) / 2.0).alias(f"{c}_s") for c in ("x", "y")])
    v = H.with_variants(scored, ["x", "y"], ["s"])
    plan = _optimized(v.where(F.col("value").isNotNull() & ~F.isnan("value")))
    # the only test is the one on the value: none on the array of scores, at the scan
    assert plan.count("Filter") == 1 and "Filter (size(" not in plan
    got = {(r["id"], r["variant"], r["method"], r["value"]) for r in v.collect()}
    assert got == {("1", "include_null", "x", 1.0), ("1", "include_null", "y", 0.5), ("1", "exclude_null", "x", 1.0),
                   ("1", "exclude_null", "y", 0.5), ("2", "include_null", "x", None), ("2", "include_null", "y", 0.0)}


def test_compressed_csv_comes_back_without_a_shuffle_of_its_lines(spark, tmp_path, monkeypatch):
    from inkgauge.sinks import writers as W
    from inkgauge.sources import delimited as DL
    from inkgauge.sources.files import read_delimited
    rows = [(str(i), ["a\nb", "q \"x\"\n\n,", "", None, "\\n \\", "one line"][i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v string").coalesce(1)
    monkeypatch.setattr(W, "COMPRESSED_ROWS", 7)
    for name, how in (("plain", {}), ("packed", {"compression": "gzip"})):
        W.write_quoted_csv(df, f"{tmp_path}/{name}", **how)
        back = read_delimited(spark, f"{tmp_path}/{name}", na_tokens=[])
        assert sorted((r["k"], r["v"] or "") for r in back.collect()) == sorted((k, v or "") for k, v in rows)
        found = DL.records(spark, f"{tmp_path}/{name}")
        kept = [f for f in found.inputFiles() if "csv_records" in f]
        # all records are put together where they are read: no piece is left to be gathered
        assert kept and spark.read.parquet(*kept).where("not whole").count() == 0
    held = [p.name for p in (tmp_path / "packed").iterdir() if p.name.startswith("part")]
    assert len(held) == 9 and all(n.endswith(".csv.gz") for n in held)


@pytest.mark.parametrize("rows", [
    [("1", "correct this ocr: A b, c\x85d a b c a b c", "a-b  c\u00e9 a b c"), ("2", None, "x"), ("3", "x", None), ("3", "", ""), ("4", "a b c d e f", " A b c  d e f. ")],
    [("a", "C:\\new \\u00e9t\u00e9 b", "c new \u00e9t\u00e9"), ("b", "\\", "a\\"), ("c", "\u0141\\u0141 a", "\u0141a"), (None, "b \\n a", "a b"), ("d", "x \\u0130\u0661_ y", "x \u0130\u0661_ y")],
    [("o", "correct th\u0131s OCR q", "q CORRECT \u212a thi\u017f ocr"), ("q", "corrcorrect this ocrect this ocr: x", "x"),
     ("r", "\u00df\u00aa\u00b5 \u20ac \x1ca\u3000b", "\u00df \u00b2 a b"), ("s", "\u00b5\u00aa\u00ba\u00b9\u00bc a", "\u00b5\u00aa\u00ba\u00b9\u00bc b")],
])
def test_all_report_metrics_from_batches_as_natively(spark, rows):
    metrics = [*C.REPORT_METRICS, "word_error_rate"]
    wide = spark.createDataFrame(rows, "id string, transcription string, pyte_ocr string").withColumn("BART_untuned", F.col("transcription"))
    for some in (metrics, ["bleu_score"], ["word_error_rate"], ["length_error_rate", "recall"]):
        batches = S.score(wide, metrics=some, batches=True)
        native = S.score(wide, metrics=some, flag_repetition=False).select(*batches.columns)
        assert [(f.name, f.dataType) for f in batches.schema] == [(f.name, f.dataType) for f in native.schema]
        assert sorted(map(repr, batches.collect())) == sorted(map(repr, native.collect()))
    with pytest.raises(ValueError, match="texts"):
        S.score(wide, metrics=["word_error_rate_native"], batches=True)


def test_ngrams_beyond_64_bits_are_counted_exactly():
    import random
    from collections import Counter

    from inkgauge.functions.pymetrics import clipped_counts
    r = random.Random(1)
    for top in (2, 50, 10**5):  # with the last, four words have no number of 64 bits
        texts = [np.array([r.choice((0, 1, top, r.randrange(top + 1))) for _ in range(r.randrange(0, 40))], np.int64) for _ in range(6)]
        ref = np.array([0, 1, top, 0, 1, top, top, 1], np.int64)
        grams = lambda t, n: Counter(zip(*(t.tolist()[i:] for i in range(n))))
        want = [[(grams(h, n) & grams(ref, n)).total() for n in (1, 2, 3, 4)] for h in texts]
        assert clipped_counts(ref, texts).tolist() == want


def test_reports_with_bleu_normalise_no_text_natively(spark, sf001):
    for df in (C.q_bleu(spark, sf001), C.q_wer(spark, sf001), C.set_values(spark, sf001, C.REPORT_METRICS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "array_distinct" not in plan and " {2,}" not in plan


def test_folded_bytes_are_lower_case_word_characters():
    import re

    from inkgauge.functions.pymetrics import fold_bytes_table
    table, deleted = fold_bytes_table()
    kept = bytes(range(256)).translate(table, deleted).decode("latin-1")
    assert kept == kept.lower() and re.fullmatch(r"[\w ]+", kept)


def test_word_error_rate_by_bounds_is_the_edit_distance():
    import random

    from inkgauge.functions.pymetrics import _distance_by_bounds, rates_of_words, word_edit_distance
    r, met = random.Random(2), 0
    for _ in range(800):
        a = [str(r.randint(0, r.choice((1, 9)))) for _ in range(r.randint(1, 25))]
        b = [w if r.random() < 0.8 else r.choice(("new", "0", "1")) for w in a]
        b = r.choice((b, [w for w in a if r.random() < 0.7], b[1:], a[::-1], b + a[:2]))
        assert rates_of_words(a, [b, a, []]) == [word_edit_distance(a, b) / len(a), 0.0, 1.0]
        number = {w: i for i, w in enumerate({*a, *b})}
        met += _distance_by_bounds(*(np.array([number[w] for w in t], np.int64) for t in (a, b))) is not None
    assert 100 < met < 800  # both ways were taken


def test_many_files_are_listed_a_group_of_folders_at_a_time(spark, tmp_path, monkeypatch):
    import os

    from inkgauge.sinks import writers as W
    from inkgauge.sources import files as FS
    monkeypatch.setattr(W, "FOLDER_FILES", 4)
    monkeypatch.setattr(FS, "BATCH_FILES", 100)
    out, n = str(tmp_path / "out"), 400
    rows = spark.range(n).select(F.concat("id", F.lit(".bmp")).alias("file_name"), F.when(F.col("id") % 9 > 0, F.unhex(F.concat(
        F.lit(C.derived.BMP_HEADER), F.lit("00112233445566778899AABB")))).otherwise(F.unhex(F.lit("FF"))).alias("content"))
    W.write_named_files(rows, out, value="content", folders=W.MANY_FOLDERS)
    assert 64 < len(os.listdir(out)) <= 100  # a folder for four files
    groups = FS._folder_batches(spark, out)
    held = [sum(len(os.listdir(f)) for f in g) for g in groups]
    assert len(groups) >= 4 and sum(held) == n and max(held) <= 100
    asked = []
    monkeypatch.setattr(FS, "_in_few_tasks", lambda df: asked.append(len(df.inputFiles())) or df)
    batches = [FS.read_sidecars(spark, out, ".bmp"), FS.list_images(spark, out), FS.load_images(spark, out), FS.load_images(spark, out, fallback=True)]
    assert asked and max(asked) <= 100
    monkeypatch.setattr(FS, "BATCH_FILES", 10**6)
    assert FS._folder_batches(spark, out) == [[out]]
    whole = [FS.read_sidecars(spark, out, ".bmp"), FS.list_images(spark, out), FS.load_images(spark, out), FS.load_images(spark, out, fallback=True)]
    for a, b in zip(batches, whole):
        assert a.schema == b.schema and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    # files beside folders, and folders without files, are read as before
    open(f"{out}/one.bmp", "w").close()
    assert FS._folder_batches(spark, out) == [[out]]
