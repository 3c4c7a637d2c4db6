"""End-to-end scoring plan (trace E1).

wide table (one row per image, one column per OCR method)
  -> [JOIN1 merge of two inputs, left wins on overlapping columns]
  -> normalise the human transcription once per row, flag repeated text
  -> unpivot methods to long rows (id, method, text)   (Expand: no shuffle)
  -> normalise every method text
  -> one projection of all native metrics + one Arrow UDF for Python ones

After the (optional) merge everything is row-local: no shuffle, so the plan
scales with the number of executors.  Rows are long ``(id, method)`` pairs,
so a very long document spreads its ten methods over ten rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.pymetrics import PAIR_SIZES, REF_SIZES, pair_numbers, python_metrics, set_sizes
from ..functions.registry import DEFAULT_METRICS, REGISTRY, PairContext, equal_flag, flag_name
from ..functions.text import DEFAULT_PHRASES, fold_escaped, normalize_columns
from ..sources.derived import METHODS


def method_ordinal(methods: list[str]) -> F.Column:
    """Configured position of each method (a literal map: no join)."""
    pairs = []
    for i, m in enumerate(methods):
        pairs += [F.lit(m), F.lit(i)]
    return F.element_at(F.create_map(*pairs), F.col("method")).cast("long")


def merge_inputs(left: DataFrame, right: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """JOIN1: equi-join on ``key`` where null keys match each other and
    duplicate keys multiply; on overlapping columns the left side wins.

    One null-safe shuffle join: a single exchange a side, whose skewed
    partitions (many null or repeated ids) AQE splits.
    """
    overlap = [c for c in right.columns if c in set(left.columns) and c != key]
    r = right.drop(*overlap).withColumnRenamed(key, "_rkey")
    return left.join(r, left[key].eqNullSafe(r["_rkey"]), how).drop("_rkey")


def long_pairs(wide: DataFrame, methods: list[str] = METHODS, truth: str = "transcription", key: str = "id",
               max_chars: int | None = None, phrases=DEFAULT_PHRASES, mode: str = "legacy",
               flag_repetition: bool = True) -> DataFrame:
    """``(id, method, ordinal, ref, hyp[, repeated_text])`` with normalised
    reference and hypothesis.  Methods absent from ``wide`` are skipped.

    Every text is normalised in the wide row and only then unpivoted: the
    Expand node keeps the normalisation in the projection below it, so each
    text is normalised exactly once however many metrics read it.
    """
    present = [m for m in methods if m in wide.columns]
    cols = {"ref": F.col(truth)}
    cols.update({m: F.col(m).cast("string") for m in present})
    base = normalize_columns(wide.withColumnRenamed(key, "id"), cols, keep=["id"], max_chars=max_chars,
                             phrases=phrases, mode=mode)
    if flag_repetition:
        base = base.withColumn("repeated_text", M.repeated_text_flag(F.col("ref"), max_chars))
    # Reference tokens once per row, not once per (row, method) pair.
    base = base.withColumn("_rw", M.words(F.col("ref"))).withColumn("_rs", F.array_distinct("_rw"))
    ids = ["id", "ref", "_rw", "_rs"] + (["repeated_text"] if flag_repetition else [])
    long = base.unpivot(ids, present, "method", "hyp")
    return long.withColumn("ordinal", method_ordinal(methods))


def with_metrics(pairs: DataFrame, metrics: list[str] = DEFAULT_METRICS, thresholds: dict | None = None) -> DataFrame:
    """Add the active metric columns (PRJ8 / MET15) to a pairs frame."""
    th = dict(M.DEFAULT_THRESHOLDS)
    th.update(thresholds or {})
    unknown = [m for m in metrics if m not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    ref, hyp = F.col("ref"), F.col("hyp")
    ctx = PairContext(ref, hyp, F.col("_rw"), F.col("_hw"), F.col("_rs"), F.col("_hs"), th, F.col("_common"),
                      F.length(ref), F.length(hyp))
    # Tokens once, reused by every native metric (avoid re-splitting); the
    # reference tokens usually arrive precomputed from ``long_pairs``.
    df = pairs if "_rw" in pairs.columns else pairs.withColumn("_rw", M.words(ref))
    df = df if "_rs" in df.columns else df.withColumn("_rs", F.array_distinct("_rw"))
    df = df.withColumn("_hw", M.words(hyp)).withColumn("_hs", F.array_distinct("_hw"))
    df = df.withColumn("_common", M.common_size(F.col("_rs"), F.col("_hs")))
    native = {}
    py_fields = []
    for m in metrics:
        spec = REGISTRY[m]
        if spec.kind == "native":
            native.update(spec.build(ctx))
        else:
            py_fields += spec.python_fields
    if native:
        df = df.withColumns(native)
    if py_fields:
        df = df.withColumn("_py", python_metrics(ref, hyp, py_fields))
        df = df.withColumns({f: F.col("_py." + f) for f in py_fields}).drop("_py")
    flags = {}
    for m in metrics:
        if (flag := equal_flag(REGISTRY[m], F.col(m), th)) is not None:
            flags[flag_name(REGISTRY[m])] = flag
    if flags:
        df = df.withColumns(flags)
    return df.drop("_rw", "_hw", "_rs", "_hs", "_common")


SET_RATIOS = ("precision", "recall", "jaccard_similarity")


def in_batches(metrics: list[str]) -> bool:
    """Can :func:`metrics_in_batches` compute all of them?"""
    return all(m in SET_RATIOS or REGISTRY[m].kind == "python" or REGISTRY[m].of_sizes for m in metrics)


def metrics_in_batches(wide: DataFrame, methods: list[str], metrics: list[str], truth: str = "transcription",
                       key: str = "id", phrases=DEFAULT_PHRASES, thresholds: dict | None = None) -> DataFrame:
    """:func:`score` for set metrics, BLEU, word error rate and metrics of sizes,
    without the texts: ``(id, method, ordinal, <metrics>, <flags>)``.

    They need no normalised text, only its words: whole rows go through Arrow
    batches that fold a text's bytes by one table, and only numbers (the sizes of
    the sets, scores) come back.  Texts with escapes are folded natively before."""
    if any(not p.isascii() or "\\" in p for p in phrases):
        raise ValueError("phrases must be ASCII without backslashes; use score without batches")
    if not in_batches(metrics):
        raise ValueError(f"{metrics}: some need the texts; use score without batches")
    th = dict(M.DEFAULT_THRESHOLDS)
    th.update(thresholds or {})
    present = [m for m in methods if m in wide.columns]
    cols = {"ref": F.col(truth)}
    cols.update({m: F.col(m).cast("string") for m in present})
    staged = fold_escaped(wide.withColumnRenamed(key, "id"), cols, ["id"], phrases)
    texts = F.col("ref"), [F.col(m) for m in present]
    fields = [f for m in metrics for f in REGISTRY[m].python_fields]
    if set(metrics) <= set(SET_RATIOS):
        counted = staged.select("id", set_sizes(*texts, phrases).alias("_n"))
        at = lambda i: {"ref": F.col("_n")[0], "hyp": F.col("_n")[2 * i + 1], "common": F.col("_n")[2 * i + 2]}
    else:
        counted = staged.select("id", pair_numbers(*texts, phrases, fields, any(m in SET_RATIOS for m in metrics)).alias("_p"))
        counted = counted.select("id", F.col("_p.sizes").alias("_n"), *[F.col(f"_p.{f}").alias(f"_f_{f}") for f in fields])
        at = lambda i: {"ref": F.col("_n")[0], "ref_chars": F.col("_n")[1],
                        **{c: F.col("_n")[REF_SIZES + PAIR_SIZES * i + j] for j, c in enumerate(("hyp", "common", "hyp_chars"))},
                        **{f: F.col(f"_f_{f}")[i] for f in fields}}
    pairs = [F.struct(F.lit(m).alias("method"), F.lit(methods.index(m)).cast("long").alias("ordinal"),
                      *[c.alias(f"_{k}") for k, c in at(i).items()]) for i, m in enumerate(present)]
    long = counted.select("id", F.inline(F.array(*pairs)))
    found = M.ratios_of_sizes(F.col("_ref"), F.col("_hyp"), F.col("_common")) | {f: F.col(f"_{f}") for f in fields}
    none = F.lit(None)
    ctx = PairContext(none, none, none, none, none, none, th, F.col("_common"), F.col("_ref_chars"), F.col("_hyp_chars"))
    for m in metrics:
        if REGISTRY[m].of_sizes:
            found.update(REGISTRY[m].build(ctx))
    wanted = [c for m in metrics for c in (REGISTRY[m].columns if REGISTRY[m].of_sizes else [m])]
    df = long.select("id", "method", "ordinal", *[found[c].alias(c) for c in wanted])
    flags = {flag_name(REGISTRY[m]): f for m in metrics if (f := equal_flag(REGISTRY[m], F.col(m), th)) is not None}
    return df.withColumns(flags) if flags else df


def score(wide: DataFrame, methods: list[str] = METHODS, metrics: list[str] = DEFAULT_METRICS,
          batches: bool = False, **kw) -> DataFrame:
    """Long scored table: one row per (id, method) with metric columns.  With
    ``batches`` the metrics are computed in Arrow batches of whole rows and the
    texts, which only they read, are left out."""
    if batches:
        return metrics_in_batches(wide, methods, metrics, **kw)
    pair_kw = {k: kw.pop(k) for k in ("truth", "key", "max_chars", "phrases", "mode", "flag_repetition") if k in kw}
    return with_metrics(long_pairs(wide, methods, **pair_kw), metrics, **kw)


def metric_values(scored: DataFrame, metrics: list[str], keys=("id", "method", "ordinal")) -> DataFrame:
    """Melt metric columns to ``(keys..., metric, value DOUBLE)`` (Expand)."""
    present = [m for m in metrics if m in scored.columns]
    cast = scored.select(*keys, *[F.col(m).cast("double").alias(m) for m in present])
    return cast.unpivot(list(keys), present, "metric", "value")


def wide_scores(scored: DataFrame, methods: list[str], columns: list[str], key: str = "id") -> DataFrame:
    """RSH3: ``<method>_<column>`` wide layout via pivot over the known
    method list (shuffles on ``key``; prefer the long form at scale)."""
    present = [c for c in columns if c in scored.columns]
    g = scored.groupBy(key).pivot("method", methods)
    out = g.agg(*[F.first(c).alias(c) for c in present])
    if len(present) == 1:
        out = out.withColumnsRenamed({m: f"{m}_{present[0]}" for m in methods})
    return out


def score_wide(wide: DataFrame, methods: list[str] = METHODS, metrics: list[str] = DEFAULT_METRICS,
               truth: str = "transcription", key: str = "id", max_chars: int | None = None,
               phrases=DEFAULT_PHRASES, mode: str = "legacy", thresholds: dict | None = None) -> DataFrame:
    """The scored wide table of trace E1 (RSH3 without a pivot): the input
    columns, ``normalized_transcription``, ``normalized_<m>``,
    ``repeated_text`` and ``<m>_<metric>`` for every method - all computed
    inside the row, so the plan has no shuffle beyond the input's own."""
    th = dict(M.DEFAULT_THRESHOLDS)
    th.update(thresholds or {})
    present = [m for m in methods if m in wide.columns]
    cols = {"normalized_transcription": F.col(truth)}
    cols.update({f"normalized_{m}": F.col(m).cast("string") for m in present})
    keep = list(wide.columns)
    df = normalize_columns(wide, cols, keep=keep, max_chars=max_chars, phrases=phrases, mode=mode)
    ref = F.col("normalized_transcription")
    df = df.withColumn("repeated_text", M.repeated_text_flag(ref, max_chars))
    # Token arrays get their own projection so every metric reads a column.
    toks = {"_rw": M.words(ref)}
    toks.update({f"_hw_{m}": M.words(F.col(f"normalized_{m}")) for m in present})
    df = df.withColumns(toks)
    df = df.withColumns({"_rs": F.array_distinct("_rw"),
                         **{f"_hs_{m}": F.array_distinct(f"_hw_{m}") for m in present}})
    df = df.withColumns({f"_common_{m}": M.common_size(F.col("_rs"), F.col(f"_hs_{m}")) for m in present})
    out = {}
    py_fields = [f for m in metrics if REGISTRY[m].kind == "python" for f in REGISTRY[m].python_fields]
    for m in present:
        hyp = F.col(f"normalized_{m}")
        ctx = PairContext(ref, hyp, F.col("_rw"), F.col(f"_hw_{m}"), F.col("_rs"), F.col(f"_hs_{m}"), th,
                          F.col(f"_common_{m}"), F.length(ref), F.length(hyp))
        for name in metrics:
            spec = REGISTRY[name]
            if spec.kind == "native":
                out.update({f"{m}_{k}": v for k, v in spec.build(ctx).items()})
        if py_fields:
            out[f"_py_{m}"] = python_metrics(ref, hyp, py_fields)
    df = df.withColumns(out)
    flat = {}
    for m in present:
        for f in py_fields:
            flat[f"{m}_{f}"] = F.col(f"_py_{m}.{f}")
        for name in metrics:
            if (flag := equal_flag(REGISTRY[name], F.col(f"{m}_{name}"), th)) is not None:
                flat[f"{m}_{flag_name(REGISTRY[name])}"] = flag
    if flat:
        df = df.withColumns(flat)
    helpers = ["_rw", "_rs"] + [f"_{k}_{m}" for m in present for k in ("hw", "hs", "common")]
    return df.drop(*helpers, *[f"_py_{m}" for m in present if py_fields])
