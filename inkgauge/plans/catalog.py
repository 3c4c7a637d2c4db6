"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's tables (or what Spark derives from them) in
full; none caps rows except where a limit *is* the operator (``head_sample``,
``sample_k``).  ``CATALOG`` is what ``__spark_entry__.queries()`` exposes;
the DuckDB twins live in :mod:`inkgauge.plans.catalog_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.registry import register_native
from ..functions import text as TX
from ..operators import histograms as H
from ..operators import joins as J
from ..operators import project as PR
from ..operators import sampling as SM
from ..operators import stats
from ..sources import derived
from ..session import materialize, scratch_dir, written
from ..sinks import writers as W
from ..sources import files as FS
from ..sources.tables import table
from ..streaming import incremental as INC
from . import dataset as D
from . import score as S

SET_METRICS = ["precision", "recall", "jaccard_similarity"]
METRIC_KEYS = ["metric", "method", "ordinal"]

# A metric of the caller's own (UDF3): how far the length is off, as a share of
# the reference; lower is better, and nothing bounds it by 1.
register_native("length_error_rate", lambda c: {"length_error_rate": F.when(
    c.ref_chars > 0, F.abs(c.hyp_chars - c.ref_chars) / c.ref_chars)},
    higher_is_better=False, threshold=0.05, of_sizes=True)
REPORT_METRICS = [*SET_METRICS, "bleu_score", "length_error_rate"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def evaluation_input(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """The merged wide table: primary inputs joined with the BART outputs.

    Each side brings one text to the join; the methods' texts, ten times as
    much, are made from them behind it and never shuffled or sorted.  A table in few files or row groups is read by as few tasks; ``partitions``
    deals its rows to that many before the text work (default: as read)."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.repartition(partitions) if partitions else docs
    return derived.method_texts(S.merge_inputs(derived.primary_sources(docs), derived.bart_sources(docs)))


def set_scores(spark, sf_dir, metrics=SET_METRICS, partitions: int | None = None, **kw) -> DataFrame:
    if not kw.get("batches"):
        kw["flag_repetition"] = False
    return S.score(evaluation_input(spark, sf_dir, partitions), metrics=metrics, **kw)


def set_values(spark, sf_dir, metrics=SET_METRICS, partitions: int | None = None) -> DataFrame:
    """Long metric values, computed where they are read: for reports that read
    them once (counted values, one aggregate), from Arrow batches where all of
    the metrics can be had so."""
    return S.metric_values(set_scores(spark, sf_dir, metrics, partitions, batches=S.in_batches(metrics)), metrics)


def kept_values(spark, sf_dir, metrics=SET_METRICS, partitions: int | None = None) -> DataFrame:
    """The same, materialised once, for reports with several passes (the list of
    metrics and the means)."""
    return materialize(set_values(spark, sf_dir, metrics, partitions))


def _r(c: str, places: int = 9):
    return F.round(F.col(c), places).alias(c)


# ------------------------------------------------------------------ scoring

def q_score_summary(spark, sf_dir):
    """Flagship: normalise, set metrics, BLEU, AGG1 summary."""
    return stats.summary_statistics(set_values(spark, sf_dir, REPORT_METRICS))


def q_precision_recall(spark, sf_dir):
    scored = set_scores(spark, sf_dir, ["precision", "recall"], batches=True)
    return scored.select("id", "method", "ordinal", "precision", "recall")


def q_jaccard(spark, sf_dir):
    scored = set_scores(spark, sf_dir, ["jaccard_similarity"], batches=True)
    return scored.select("id", "method", "ordinal", "jaccard_similarity", "equal_jaccard")


def q_wer(spark, sf_dir):
    scored = set_scores(spark, sf_dir, ["word_error_rate"], batches=True)
    return scored.select("id", "method", "ordinal", "word_error_rate")


def q_bleu(spark, sf_dir):
    scored = set_scores(spark, sf_dir, ["bleu_score"], batches=True)
    return scored.select("id", "method", "ordinal", _r("bleu_score"))


def q_equal_flags(spark, sf_dir):
    scored = set_scores(spark, sf_dir, ["jaccard_similarity"], batches=True)
    return scored.groupBy("method", "ordinal").agg(
        F.count_if(F.col("equal_jaccard")).alias("equal_jaccard"), F.count(F.lit(1)).alias("rows"))


def q_repeated_text(spark, sf_dir):
    wide = evaluation_input(spark, sf_dir)
    ref = wide.select("id", TX.normalize_text(F.col("transcription")).alias("ref"))
    return ref.select("id", M.repeated_text_flag(F.col("ref")).alias("repeated_text"))


def q_char_uniqueness(spark, sf_dir):
    n = TX.normalize_text(F.col("text"))
    d = documents(spark, sf_dir).select("doc_id", n.alias("t"))
    chars = F.regexp_extract_all(F.col("t"), F.lit("(?s)."), 0)
    return d.select("doc_id", F.length("t").cast("long").alias("length"),
                    F.size(F.array_distinct(chars)).cast("long").alias("distinct_chars"),
                    M.low_uniqueness(F.col("t")).alias("low_uniqueness"))


def q_normalize_utf8(spark, sf_dir):
    return TX.normalize_columns(documents(spark, sf_dir), {"normalized": F.col("text")}, keep=["doc_id"], mode="utf8")


def q_normalize_legacy(spark, sf_dir):
    return TX.normalize_columns(documents(spark, sf_dir), {"normalized": F.col("text")}, keep=["doc_id"])


def q_truncate(spark, sf_dir):
    """SCL9, the only query that cuts: normalised texts at the length limit."""
    n = TX.normalize_columns(documents(spark, sf_dir), {"normalized": F.col("text")}, keep=["doc_id"],
                             max_chars=TX.DEFAULT_MAX_CHARS)
    return n.select("doc_id", "normalized", F.length("normalized").cast("long").alias("length"))


def q_clean_markup(spark, sf_dir):
    sc = derived.sidecars(documents(spark, sf_dir))
    return sc.select("file_name", TX.clean_markup(F.col("text")).alias("cleaned"))


def q_extract_response(spark, sf_dir):
    d = documents(spark, sf_dir)
    full = derived.echoed_output(F.col("lang"), F.col("text"))
    return d.select("doc_id", TX.extract_response(full, derived.PROMPT).alias("response"))


def q_count_marker(spark, sf_dir):
    sc = derived.sidecars(documents(spark, sf_dir))
    return sc.select("file_name", TX.count_marker(F.col("text"), derived.IMAGE_TOKEN).alias("image_tokens"),
                     TX.count_marker(F.col("text"), derived.EOT).alias("eot_tokens"))


# ------------------------------------------------------------------ joins

def q_merge_overlap(spark, sf_dir):
    return evaluation_input(spark, sf_dir)


def q_attach_sidecar(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return J.attach_sidecar(docs.select(F.col("doc_id").cast("string").alias("id")),
                            derived.sidecars(docs), "vision_base")


def q_assemble_table(spark, sf_dir):
    """DSP9: the complete table - truth plus three engines' sidecar outputs
    (model markup cleaned), keyed by image name."""
    docs = documents(spark, sf_dir)
    t = F.col("text")
    name = F.col("doc_id").cast("string")
    sc = (derived.sidecars(docs)
          .unionByName(docs.select(F.concat(name, F.lit(".jpg.pyte")).alias("file_name"),
                                   F.translate(t, "oil", "011").alias("text")))
          .unionByName(docs.where(F.col("lang") != "de")
                       .select(F.concat(name, F.lit(".jpg.gpt")).alias("file_name"), t.alias("text"))))
    rows = docs.select(F.concat(name, F.lit(".jpg")).alias("id"), F.col("text").alias("transcription"))
    engines = {".jpg.model": "vision_base", ".jpg.pyte": "pyte_ocr", ".jpg.gpt": "chatgpt_ocr"}
    # keys are image names: strip only the engine part of each suffix
    engines = {k[len(".jpg"):]: v for k, v in engines.items()}
    return J.assemble_sidecars(rows, sc, engines, clean={"vision_base": TX.clean_markup})


def q_outcome_counts(spark, sf_dir):
    return stats.outcome_counts(q_attach_sidecar(spark, sf_dir))


def q_reject_missing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    images = derived.image_listing(table(spark, sf_dir, "labels"))
    return J.missing_images(docs.select(F.col("doc_id").cast("string").alias("id")), images)


def q_resume_pending(spark, sf_dir):
    images = derived.image_listing(table(spark, sf_dir, "labels"))
    outputs = derived.sidecars(documents(spark, sf_dir))
    return J.pending(images, outputs)


def q_fillna_dropna(spark, sf_dir):
    p = derived.primary_table(documents(spark, sf_dir))
    return p.dropna(subset=["pyte_ocr"]).fillna("").select("id", "pyte_ocr", "chatgpt_ocr", "vision_base")


def q_coerce_numeric(spark, sf_dir):
    ev = derived.raw_run_times(table(spark, sf_dir, "events"))
    num = F.expr("try_cast(raw_value as double)")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"),
                                        F.count_if(num.isNull()).alias("non_numeric"),
                                        F.round(F.sum(num), 6).alias("total"))


# ------------------------------------------------------------------ aggregates

def q_hist10(spark, sf_dir):
    return H.percent_histogram(set_values(spark, sf_dir, REPORT_METRICS), METRIC_KEYS)


def q_hist20(spark, sf_dir):
    h = H.equal_width_histogram(set_values(spark, sf_dir), METRIC_KEYS, 20)
    return h.select(*METRIC_KEYS, "bin", "count", _r("bin_start"), _r("bin_end"))


def q_hist30_density(spark, sf_dir):
    h = H.equal_width_histogram(set_values(spark, sf_dir), METRIC_KEYS, 30, density=True)
    return h.select(*METRIC_KEYS, "bin", "count", _r("bin_start"), _r("bin_end"), _r("density", 6))


def q_kde(spark, sf_dir):
    k = H.kde_curve(set_values(spark, sf_dir), METRIC_KEYS)
    return k.select(*METRIC_KEYS, "point", _r("x"), _r("density", 6))


def q_boxplot(spark, sf_dir):
    return _boxes(set_values(spark, sf_dir, REPORT_METRICS), METRIC_KEYS)


def _boxes(values, keys):
    b = H.box_stats(values, keys)
    return b.select(*keys, "n", _r("q1"), _r("median"), _r("q3"), _r("whisker_low"), _r("whisker_high"), "outliers")


BOX_SCORES = ["jaccard_similarity", "recall"]


def variant_values(spark, sf_dir) -> DataFrame:
    """Scores of the three engines, missing where an engine has no text, with
    and without the incomplete rows."""
    wide = evaluation_input(spark, sf_dir).select("id", "transcription", *ANALYSIS_METHODS)
    scored = S.score_wide(wide, ANALYSIS_METHODS, BOX_SCORES)
    held = scored.select("id", *[F.when(F.col(m).isNotNull(), F.col(f"{m}_{c}")).alias(f"{m}_{c}")
                                 for m in ANALYSIS_METHODS for c in BOX_SCORES])
    return H.with_variants(held, ANALYSIS_METHODS, BOX_SCORES)


def q_boxplot_variants(spark, sf_dir):
    """AGG8: boxes over all rows and over complete rows only."""
    return _boxes(variant_values(spark, sf_dir), ["variant", *METRIC_KEYS])


def q_box_outliers(spark, sf_dir):
    """AGG8: the outlier rows of both variants, with the side they are on."""
    out = H.box_outliers(materialize(variant_values(spark, sf_dir)), ["variant", *METRIC_KEYS])
    return out.select("id", "variant", *METRIC_KEYS, _r("value"), "side")


def q_mean_bar(spark, sf_dir):
    m = stats.mean_by_method(kept_values(spark, sf_dir), derived.METHODS)
    return m.select("metric", "method", "ordinal", _r("mean_pct"))


def q_top_bottom_rank(spark, sf_dir):
    r = stats.rank_methods(set_values(spark, sf_dir, REPORT_METRICS))
    return r.select(*METRIC_KEYS, _r("mean"), "rank_desc", "rank_asc", "best_rank", "top_k", "bottom_k")


def q_runtime_stats(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds"))
    s = stats.runtime_stats(ev, ["event_type"])
    return s.select("event_type", "count", _r("min"), _r("max"), _r("mean"), _r("median"), _r("stdev"),
                    _r("total", 6))


def q_chart_labels(spark, sf_dir):
    """SCL15 / SCL19: plot titles and labels - metric title, "method
    (Median: x.xx)" legend entries and "xx.x%" bar labels."""
    d = stats.describe(set_values(spark, sf_dir), METRIC_KEYS, probs={"median": 0.5})
    return d.select(*METRIC_KEYS, TX.metric_title(F.col("metric")).alias("title"),
                    F.concat(F.col("method"), F.lit(" (Median: "), TX.py_format(F.col("median"), ".2f"),
                             F.lit(")")).alias("median_label"),
                    F.concat(TX.py_format(F.col("mean") * 100, ".1f"), F.lit("%")).alias("bar_label"))


def q_rollup_design(spark, sf_dir):
    r = stats.design_rollup(set_values(spark, sf_dir))
    return r.select("metric", "family", "metal", "size", _r("mean"), "n", F.col("level").cast("long").alias("level"))


# ------------------------------------------------------------------ ordering / limits / reshape

def q_head_sample(spark, sf_dir, n: int = 50):
    wide = evaluation_input(spark, sf_dir)
    return SM.head(wide, n, [F.col("id").cast("long")]).select("id", "transcription", "pyte_ocr", "BART_untuned")


def q_sample_k(spark, sf_dir, k: int = 20):
    docs = documents(spark, sf_dir)
    return SM.sample_k(docs.select(F.col("doc_id").cast("string").alias("id"), "lang"), "id", k)


def q_order_methods(spark, sf_dir):
    vals = set_values(spark, sf_dir, ["precision"])
    return (vals.groupBy("ordinal", "method").agg(F.count(F.lit(1)).alias("pairs"))
            .orderBy("ordinal"))


def q_latest_by_time(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_event_id"),
                                     F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', max(ts))").alias("latest_ts"))


def q_unpivot(spark, sf_dir):
    wide = evaluation_input(spark, sf_dir)
    long = wide.unpivot(["id"], derived.METHODS, "method", "text")
    return long.select("id", "method", F.length("text").cast("long").alias("n_chars"))


def q_pivot_wide(spark, sf_dir):
    scored = set_scores(spark, sf_dir, ["precision"])
    return S.wide_scores(scored, derived.METHODS, ["precision"])


# ------------------------------------------------------------------ training data

def _chat_records(spark, sf_dir):
    return D.chat_records(documents(spark, sf_dir), derived.image_listing(table(spark, sf_dir, "labels")))


def q_chat_records(spark, sf_dir):
    recs = _chat_records(spark, sf_dir)
    return D.flatten_records(recs)


def q_split_sizes(spark, sf_dir):
    recs = _chat_records(spark, sf_dir)
    return recs.groupBy("split").agg(F.count(F.lit(1)).alias("records"))


def q_prompt_records(spark, sf_dir):
    """SRC9 + JOIN7: the instruction comes from a prompt file (here written
    from the first ``benchmark`` item), read whole and stripped, and is
    attached to every record as a scalar subquery."""
    path = scratch_dir(spark, "prompt")
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select("text")
    first.coalesce(1).write.text(path)
    prompt = FS.read_prompt(spark, path)
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    return J.with_prompt(rows, prompt, "user_content")


def q_split_rows(spark, sf_dir):
    """SMP2 rows: every chat record's split (exact 80/20, seeded)."""
    recs = _chat_records(spark, sf_dir)
    return recs.select("id", "split")


def q_reprompt(spark, sf_dir):
    recs = _chat_records(spark, sf_dir)
    return D.flatten_records(D.reprompt(recs)).drop("split")


def q_chat_template(spark, sf_dir):
    recs = _chat_records(spark, sf_dir)
    return recs.select("id", D.apply_template(F.col("messages")).alias("templated"))


def q_conversation_turns(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", D.template_turn(F.col("role"), F.col("text")).alias("segment"))


def q_collate_labels(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", derived.token_ids(F.col("text"), D.IMAGE_ID).alias("ids"))
    c = D.collate(rows, "doc_id", "ids")
    return c.select("doc_id", "batch", "padded_len", "n_masked", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def q_parse_structured(spark, sf_dir):
    docs = documents(spark, sf_dir)
    js = derived.structured_json(docs, table(spark, sf_dir, "labels"))
    return D.explode_structured(D.parse_structured(js))


def q_structured_linked(spark, sf_dir):
    js = derived.structured_json(documents(spark, sf_dir), table(spark, sf_dir, "labels"), linked=True)
    return D.explode_linked(D.parse_structured(js))


def q_report_blocks(spark, sf_dir):
    return D.report_blocks(derived.model_runs(documents(spark, sf_dir)), "file", "output", "seconds")


# ------------------------------------------------------------------ sources / sinks

def q_csv_roundtrip(spark, sf_dir):
    """SNK1 -> SRC1: the merged table through the quoted CSV layout and back
    (quotes, backslashes, newlines and pandas' missing tokens)."""
    path = scratch_dir(spark, "merged_csv")
    W.write_quoted_csv(evaluation_input(spark, sf_dir), path, compression="gzip")
    return FS.read_delimited(spark, path)


def q_typed_head(spark, sf_dir, n: int = 100):
    """SNK2 -> SRC2 + SRC4: run times written as a plain CSV in event order,
    read back with typed columns (``try_cast``) and the first ``n`` rows in
    file order."""
    path = scratch_dir(spark, "runtimes_csv")
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("string").alias("seconds"))
    W.write_plain_csv(ev.orderBy("event_id"), path)
    head = FS.read_head(spark, path, n, unescape_backslash=False, multi_line=False)
    return head.select(F.expr("try_cast(event_id as bigint)").alias("event_id"), "event_type",
                       F.expr("try_cast(seconds as double)").alias("seconds"))


def q_sample_csv(spark, sf_dir, n: int = 50):
    """SNK7: the first ``n`` merged rows (explicit order) written as a quoted
    CSV, read back."""
    path = scratch_dir(spark, "sample_csv")
    wide = evaluation_input(spark, sf_dir).select("id", "transcription", "BART_untuned")
    W.write_sample(wide, path, n, [F.col("id").cast("long"), F.col("transcription")])
    return FS.read_delimited(spark, path)


def q_sidecar_roundtrip(spark, sf_dir):
    """SNK3 -> SRC5 -> SCL12: one named file per image output, written in two
    phases, read back whole and cleaned."""
    path = scratch_dir(spark, "sidecars")
    W.write_named_files(derived.sidecars(documents(spark, sf_dir)), path, folders=W.MANY_FOLDERS)
    back = FS.read_sidecars(spark, path, ".model")
    return back.select("file_name", TX.clean_markup(F.col("text")).alias("cleaned"))


def _sidecar_run(spark, sf_dir):
    """E4 as one run: sidecar files (some of them broken) attached to the
    documents, written with their outcomes; the table and the counters."""
    docs = documents(spark, sf_dir)
    path = scratch_dir(spark, "sidecar_files")
    W.write_named_files(derived.broken_sidecars(docs), path, value="body", folders=W.MANY_FOLDERS)
    found = FS.read_sidecars(spark, path, ".model", max_bytes=derived.LARGE_SIDECAR)
    rows = J.attach_outcomes(docs.select(F.col("doc_id").cast("string").alias("id")), found, "vision_base")
    return stats.run_with_outcomes(rows, scratch_dir(spark, "attached"), [J.ATTACHED, J.MISSING, J.UNREADABLE])


def q_sidecar_errors(spark, sf_dir):
    """SRC5 + AGG11: the run's error list, one row per file that is missing,
    too large or no UTF-8."""
    table_, _ = _sidecar_run(spark, sf_dir)
    return table_.where(F.col("status") != J.ATTACHED).select("id", "vision_base", "status", "message")


def q_run_counters(spark, sf_dir):
    """AGG11: the same run's counters, taken in the pass that writes it."""
    table_, counts = _sidecar_run(spark, sf_dir)
    return table_.sparkSession.createDataFrame([counts], "total long, attached long, missing long, unreadable long")


def _tolerant(spark, sf_dir):
    path = scratch_dir(spark, "bad_lines")
    derived.bad_lines(documents(spark, sf_dir)).write.text(path)
    return FS.read_tolerant(spark, path, "|", columns=derived.BAD_LINE_COLUMNS, header=False)


def q_tolerant_scan(spark, sf_dir):
    """SRC3: a quoted file with long and short records, by pandas' rule."""
    return _tolerant(spark, sf_dir)[0]


def q_tolerant_counts(spark, sf_dir):
    """SRC3: what the scan saw, skipped and padded, counted while it is written."""
    rows, seen = _tolerant(spark, sf_dir)
    written(rows, "tolerant_rows")
    return spark.createDataFrame([seen.get], "records long, skipped long, padded long")


def _image_folder(spark, sf_dir):
    path = scratch_dir(spark, "images")
    files = derived.image_files(documents(spark, sf_dir))
    other = files.limit(0).unionByName(spark.range(1).select(F.lit("readme.txt").alias("file_name"), F.encode(F.lit("x"), "UTF-8").alias("content")))
    W.write_named_files(files.unionByName(other), path, value="content", folders=W.MANY_FOLDERS)
    return path


def q_image_files(spark, sf_dir):
    """SNK3 -> SRC6, SRT1: image files listed by any spelling of their
    extension, nothing else."""
    return FS.list_images(spark, _image_folder(spark, sf_dir)).select("file_name", "length")


def _pixels(images):
    return images.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "height", "width", "channels",
                         F.length("data").alias("n_bytes"), F.substring(F.hex("data"), 1, derived.PIXELS * 6).alias("first"), "valid")


def q_image_pixels(spark, sf_dir):
    """SRC7: decoded RGB pixels; files that are no images are dropped."""
    return _pixels(FS.load_images(spark, _image_folder(spark, sf_dir)))


def q_image_fallback(spark, sf_dir):
    """SRC8: the same with a black image in place of what cannot be decoded."""
    return _pixels(FS.load_images(spark, _image_folder(spark, sf_dir), fallback=True))


def q_summary_roundtrip(spark, sf_dir):
    """SNK6 -> SRC2: the summary table as plain CSV, read back with types."""
    path = scratch_dir(spark, "summary_csv")
    W.write_plain_csv(stats.summary_statistics(set_values(spark, sf_dir)), path)
    numbers = ["mean", "median", "std_dev", "min", "max", "p25", "p75"]
    return FS.read_typed(spark, path, {"ordinal": "bigint", **dict.fromkeys(numbers, "double")})


def q_decode_escapes(spark, sf_dir):
    """SCL3: texts spelled with escapes, decoded."""
    spelled = documents(spark, sf_dir).select("doc_id", derived.escaped_text(F.col("text")).alias("t"))
    return spelled.select("doc_id", TX.decode_escapes(F.col("t"), "utf8").alias("decoded"))


def q_prompt_default(spark, sf_dir):
    """SRC10 + JOIN7: without a prompt file every record gets the default."""
    prompt = FS.read_prompt(spark, scratch_dir(spark, "no_prompt"), default=derived.PROMPT)
    return J.with_prompt(documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id")), prompt, "user_content")


def q_chat_json_roundtrip(spark, sf_dir):
    """SNK4 -> SRC11: chat records as JSON per split, read back by split."""
    path = scratch_dir(spark, "chat_json")
    recs = _chat_records(spark, sf_dir)
    W.write_chat_json(recs, path)
    back = FS.read_chat_dataset(spark, {"train": f"{path}/split=train", "test": f"{path}/split=test"})
    m = F.col("messages")
    return back.select(m[0]["role"].alias("user_role"), m[0]["content"].alias("user_content"),
                       m[1]["role"].alias("assistant_role"), m[1]["content"].alias("assistant_content"),
                       F.col("images")[0].alias("image"), "split")


ANALYSIS_METHODS = ["pyte_ocr", "chatgpt_ocr", "vision_base"]


def q_analysis_summary(spark, sf_dir):
    """E5: scored table -> '|' quoted CSV -> all-string re-read -> AGG2; a
    method without a text has no scores."""
    wide = evaluation_input(spark, sf_dir).select("id", "transcription", *ANALYSIS_METHODS)
    cols = ["jaccard_similarity", "recall", "equal_jaccard"]
    scored = S.score_wide(wide, ANALYSIS_METHODS, cols[:2])
    out = scored.select("id", *[F.when(F.col(m).isNotNull(), F.col(f"{m}_{c}")).alias(f"{m}_{c}") for m in ANALYSIS_METHODS for c in cols])
    path = scratch_dir(spark, "scored_csv")
    W.write_quoted_csv(out, path, sep="|")
    a = stats.analysis_summary(FS.read_delimited(spark, path, sep="|"), ANALYSIS_METHODS, *cols)
    return a.select("variant", "method", "ordinal", _r("avg_first"), _r("median_first"), _r("avg_second"), _r("median_second"),
                    "matches", "legacy_matches", "total_entries", "non_numeric_first", "non_numeric_second")


def q_exact_match_incl_excl(spark, sf_dir):
    """AGG9: threshold-match counts with and without rows that lack a score."""
    return q_analysis_summary(spark, sf_dir).select("variant", "method", "ordinal", "matches", "total_entries")


# ------------------------------------------------------------------ incremental runs

def q_incremental(spark, sf_dir):
    """STR1: model outputs arrive in two drops; two availableNow runs on one
    checkpoint clean each of them exactly once."""
    docs = documents(spark, sf_dir)
    src, out, ck = (scratch_dir(spark, n) for n in ("incoming", "transcribed", "transcribe_ckpt"))
    sc = derived.sidecars(docs).withColumn("_d", F.expr("cast(regexp_extract(file_name, '^([0-9]+)', 1) as long)"))
    for drop in (0, 1):
        sc.where(F.col("_d") % 2 == drop).drop("_d").write.mode("append").json(src)
        INC.run_available(spark, src, INC.SIDECAR_SCHEMA, INC.clean_transform(), out, ck, fmt="json")
    return spark.read.parquet(out).select("file_name", "cleaned")


def _scoring_run(spark, sf_dir):
    """STR2: sidecars in two drops, truth in two others that come later: the
    first run finds no truth, the second scores what it can, the third, without
    new sidecars, retries the pending ones."""
    docs = documents(spark, sf_dir).where(F.col("doc_id") % 23 != 0)  # some truth never comes
    src, truth, state = (scratch_dir(spark, n) for n in ("sidecars_in", "truth_in", "scoring_state"))
    part = lambda df, c, n: df.withColumn("_d", F.expr(f"cast({c} as long) % {n}"))
    sc = part(derived.sidecars(documents(spark, sf_dir)), "regexp_extract(file_name, '^([0-9]+)', 1)", 2)
    known = part(derived.primary_table(docs).select("id", "transcription"), "id", 3)
    job = INC.IncrementalScoring(spark, state)
    schema = known.drop("_d").schema
    known.limit(0).drop("_d").write.json(truth)
    counts = []
    for sidecars, rows in ((sc.where("_d = 0"), None), (sc.where("_d = 1"), known.where("_d = 0")), (None, known.where("_d > 0"))):
        if sidecars is not None:
            sidecars.drop("_d").write.mode("append").json(src)
        if rows is not None:
            rows.drop("_d").write.mode("append").json(truth)
        counts.append(job.run(src, truth, schema))
    return job, counts


def q_incremental_scoring(spark, sf_dir):
    return _scoring_run(spark, sf_dir)[0].scored().select("id", "precision", "recall")


def q_scoring_progress(spark, sf_dir):
    """STR2: scored and unmatched sidecars after each of the three runs."""
    counts = _scoring_run(spark, sf_dir)[1]
    return spark.createDataFrame([(i + 1, c["scored"], c["pending"]) for i, c in enumerate(counts)], "run long, scored long, pending long")


# ------------------------------------------------------------------ subsets, previews, profiles

METALS = {1: "gold", 0: "silver"}
SUBSET_SIZES = [100, 1000, 10000]


def q_nested_subsets(spark, sf_dir):
    """SMP3: nested 100 / 1,000 / 10,000 subsets per metal (gold = labelled
    quality 1, silver = 0), seeded."""
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality") == 1, F.lit("gold")).otherwise(F.lit("silver")).alias("metal"))
    out = SM.nested_subsets(lab, "id", SUBSET_SIZES, group="metal")
    return out.select("id", "metal", F.array_join(F.col("subsets").cast("array<string>"), ",").alias("subsets"))


def q_preview_records(spark, sf_dir, n: int = 3):
    """LIM3: the first evaluation (test split) records with a load check:
    the image exists in the listing and the answer is non-empty."""
    recs = _chat_records(spark, sf_dir).where(F.col("split") == "test")
    head = SM.head(recs, n, [F.col("id").cast("long")]).withColumn("image", F.col("images")[0])
    listed = derived.image_listing(table(spark, sf_dir, "labels")).distinct().withColumn("listed", F.lit(True))
    return head.join(listed, head["image"] == listed["file_name"], "left").select(
        "id", "image", (F.length(F.col("messages")[1]["content"]) > 0).alias("has_answer"),
        F.coalesce("listed", F.lit(False)).alias("image_listed"))


def q_profile(spark, sf_dir):
    """PRJ11: row count / columns / types of the merged evaluation table."""
    return PR.profile(PR.require_columns(evaluation_input(spark, sf_dir), ["id", "transcription"]), "merged")


def q_scored_table(spark, sf_dir):
    """E1 output: merged inputs + normalised texts + repeated-text flag +
    per-method set metrics, wide, row-local."""
    return S.score_wide(evaluation_input(spark, sf_dir), derived.METHODS, SET_METRICS)


def q_duplicate_ids(spark, sf_dir):
    """Q9: ids that the merge multiplied (null-safe key, duplicates kept)."""
    m = evaluation_input(spark, sf_dir)
    return m.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def q_wer_undefined(spark, sf_dir):
    """Q5: per method, pairs whose word error rate is undefined (empty
    reference) - counted instead of failing the job."""
    scored = set_scores(spark, sf_dir, ["word_error_rate"], batches=True)
    return scored.groupBy("method", "ordinal").agg(
        F.count_if(F.col("word_error_rate").isNull()).alias("wer_undefined"), F.count(F.lit(1)).alias("pairs"))


CATALOG = {
    "score_summary": q_score_summary,
    "precision_recall": q_precision_recall,
    "jaccard": q_jaccard,
    "wer": q_wer,
    "bleu": q_bleu,
    "equal_flags": q_equal_flags,
    "repeated_text": q_repeated_text,
    "char_uniqueness": q_char_uniqueness,
    "normalize_utf8": q_normalize_utf8,
    "normalize_legacy": q_normalize_legacy,
    "truncate": q_truncate,
    "clean_markup": q_clean_markup,
    "extract_response": q_extract_response,
    "count_marker": q_count_marker,
    "merge_overlap": q_merge_overlap,
    "attach_sidecar": q_attach_sidecar,
    "outcome_counts": q_outcome_counts,
    "reject_missing": q_reject_missing,
    "resume_pending": q_resume_pending,
    "fillna_dropna": q_fillna_dropna,
    "coerce_numeric": q_coerce_numeric,
    "hist10": q_hist10,
    "hist20": q_hist20,
    "hist30_density": q_hist30_density,
    "kde": q_kde,
    "boxplot": q_boxplot,
    "boxplot_variants": q_boxplot_variants,
    "box_outliers": q_box_outliers,
    "mean_bar": q_mean_bar,
    "top_bottom_rank": q_top_bottom_rank,
    "runtime_stats": q_runtime_stats,
    "rollup_design": q_rollup_design,
    "head_sample": q_head_sample,
    "sample_k": q_sample_k,
    "order_methods": q_order_methods,
    "latest_by_time": q_latest_by_time,
    "unpivot": q_unpivot,
    "pivot_wide": q_pivot_wide,
    "chat_records": q_chat_records,
    "split_sizes": q_split_sizes,
    "reprompt": q_reprompt,
    "chat_template": q_chat_template,
    "conversation_turns": q_conversation_turns,
    "collate_labels": q_collate_labels,
    "parse_structured": q_parse_structured,
    "structured_linked": q_structured_linked,
    "report_blocks": q_report_blocks,
    "csv_roundtrip": q_csv_roundtrip,
    "sidecar_roundtrip": q_sidecar_roundtrip,
    "image_files": q_image_files,
    "image_pixels": q_image_pixels,
    "image_fallback": q_image_fallback,
    "summary_roundtrip": q_summary_roundtrip,
    "decode_escapes": q_decode_escapes,
    "prompt_default": q_prompt_default,
    "sidecar_errors": q_sidecar_errors,
    "run_counters": q_run_counters,
    "tolerant_scan": q_tolerant_scan,
    "tolerant_counts": q_tolerant_counts,
    "chat_json_roundtrip": q_chat_json_roundtrip,
    "analysis_summary": q_analysis_summary,
    "exact_match_incl_excl": q_exact_match_incl_excl,
    "incremental": q_incremental,
    "incremental_scoring": q_incremental_scoring,
    "scoring_progress": q_scoring_progress,
    "nested_subsets": q_nested_subsets,
    "preview_records": q_preview_records,
    "profile": q_profile,
    "scored_table": q_scored_table,
    "typed_head": q_typed_head,
    "duplicate_ids": q_duplicate_ids,
    "wer_undefined": q_wer_undefined,
    "split_rows": q_split_rows,
    "assemble_table": q_assemble_table,
    "chart_labels": q_chart_labels,
    "sample_csv": q_sample_csv,
    "prompt_records": q_prompt_records,
}
