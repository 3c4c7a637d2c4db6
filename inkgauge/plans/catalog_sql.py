"""DuckDB SQL twins of :mod:`inkgauge.plans.catalog` (the correctness oracle).

Keys missing here are queries with no practical SQL form (sequence matching,
word edit distance in DuckDB's byte-based functions, Python predictors);
they are covered by hand goldens and brute-force tests instead.
"""

from __future__ import annotations

import math

from .. import oracle as O
from ..functions.text import DEFAULT_MAX_CHARS, PY_WORD_CLASS
from ..operators.histograms import KDE_GRID, PERCENT_EDGES, WHISKER_IQR, percent_bin_labels
from ..operators.stats import DESIGN_PATTERN
from ..sources.derived import (BAD_IMAGE_EVERY, PIXELS, BOS, BROKEN_EVERY, LARGE_SIDECAR, LONG_LINE, SHORT_LINE, CORRUPT_EVERY, EOT, HDR_END, HDR_START, IMAGE_TOKEN, METHODS, NO_SIDECAR_EVERY,
                               PROMPT)
from .dataset import IGNORE_INDEX, IMAGE_ID, PAD_ID, REPORT_RULE, SPLIT_SEED, TRAIN_RATIO

q = O.q
SET_METRICS = ["precision", "recall", "jaccard_similarity"]
KEYS = "metric, method, ordinal"


def scored_sets() -> str:
    return O.set_metrics_select(O.long_pairs())


def values() -> str:
    return O.unpivot_metrics(scored_sets(), SET_METRICS)


REPORT_METRICS = [*SET_METRICS, "bleu_score", "length_error_rate"]


def report_values() -> str:
    """Set metrics, BLEU and length error of all pairs (the pairs once)."""
    own = (f"SELECT *, CASE WHEN length(ref) > 0 THEN abs(length(hyp) - length(ref)) / length(ref) END AS length_error_rate "
           f"FROM ({O.set_metrics_select('SELECT * FROM pairs')})")
    return (f"WITH pairs AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM ({O.long_pairs()})), "
            f"b AS MATERIALIZED ({_bleu('pairs')}), "
            f"scores AS (SELECT s.*, b.bleu_score FROM ({own}) s JOIN b ON s.pid = b.pid) "
            + O.unpivot_metrics("SELECT * FROM scores", REPORT_METRICS))


def over_report_values(sql: str) -> str:
    """``sql`` with the report's values as the table ``report_values``."""
    return f"WITH report_values AS MATERIALIZED ({report_values()}) {sql}"


def r9(e: str, alias: str, places: int = 9) -> str:
    return f"round({e}, {places}) AS {alias}"


def clean_values(source: str | None = None) -> str:
    return f"SELECT {KEYS}, value FROM ({source or values()}) WHERE value IS NOT NULL AND NOT isnan(value)"


REPORT = "SELECT * FROM report_values"


# ------------------------------------------------------------------ scoring

def sql_score_summary():
    return over_report_values(O.summary(REPORT))


def sql_precision_recall():
    return f"SELECT id, method, ordinal, precision, recall FROM ({scored_sets()})"


def sql_jaccard():
    return (f"SELECT id, method, ordinal, jaccard_similarity, jaccard_similarity >= 0.93 AS equal_jaccard "
            f"FROM ({scored_sets()})")


def sql_bleu():
    return (f"WITH pairs AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM ({O.long_pairs()})) "
            f"SELECT id, method, ordinal, {r9('bleu_score', 'bleu_score')} FROM pairs JOIN ({_bleu('pairs')}) USING (pid)")


def _bleu(pairs_table: str) -> str:
    tok = q(f"[{PY_WORD_CLASS}]+")
    pairs = (f"SELECT pid, regexp_extract_all(lower(ref), {tok}) AS r, regexp_extract_all(lower(hyp), {tok}) AS h "
             f"FROM {pairs_table}")
    grams = lambda side: (
        f"SELECT pid, n, array_to_string(list_slice({side}, i, i + n - 1), ' ') AS g FROM "
        f"(SELECT pid, {side}, n, unnest(range(1, len({side}) - n + 2)) AS i FROM p, "
        f"(SELECT unnest(range(1, 5)) AS n) ns)")
    m = [f"coalesce(max(CASE WHEN n = {k} THEN m END), 0)" for k in range(1, 5)]
    body = (
        f"WITH p AS ({pairs}), "
        f"hc AS (SELECT pid, n, g, count(*) AS c FROM ({grams('h')}) GROUP BY ALL), "
        f"rc AS (SELECT pid, n, g, count(*) AS c FROM ({grams('r')}) GROUP BY ALL), "
        f"mm AS (SELECT hc.pid, hc.n, sum(least(hc.c, coalesce(rc.c, 0))) AS m FROM hc "
        f"LEFT JOIN rc ON hc.pid = rc.pid AND hc.n = rc.n AND hc.g = rc.g GROUP BY ALL), "
        f"agg AS (SELECT p.pid, any_value(len(h)) AS c, any_value(len(r)) AS rl, "
        + ", ".join(f"{m[k - 1]} AS m{k}" for k in range(1, 5))
        + " FROM p LEFT JOIN mm ON p.pid = mm.pid GROUP BY p.pid), "
        "z AS (SELECT *, (m2 = 0)::INT AS z2, (m2 = 0)::INT + (m3 = 0)::INT AS z3, "
        "(m2 = 0)::INT + (m3 = 0)::INT + (m4 = 0)::INT AS z4 FROM agg), "
        "pp AS (SELECT *, " + ", ".join(
            f"CASE WHEN m{k} = 0 THEN CASE WHEN c > 1 THEN (1 / (power(2, {('z' + str(k)) if k > 1 else 1}) * 5 "
            f"/ ln(c))) / greatest(1, c - {k} + 1) ELSE 0 END ELSE m{k} / greatest(1, c - {k} + 1) END AS p{k}"
            for k in range(1, 5)) + " FROM z) "
        "SELECT pid, CASE WHEN c = 0 OR rl = 0 OR m1 = 0 THEN 0.0 ELSE "
        "(CASE WHEN c > rl THEN 1.0 ELSE exp(1 - rl / c) END) * exp("
        + " + ".join(f"CASE WHEN p{k} > 0 THEN ln(p{k}) / 4 ELSE 0 END" for k in range(1, 5))
        + ") END AS bleu_score FROM pp")
    return body


def sql_equal_flags():
    return (f"SELECT method, ordinal, count_if(jaccard_similarity >= 0.93) AS equal_jaccard, count(*) AS rows "
            f"FROM ({scored_sets()}) GROUP BY method, ordinal")


def _repetition(t: str) -> str:
    marker = "... [truncated]"
    core = f"CASE WHEN ends_with({t}, {q(marker)}) THEN substring({t}, 1, length({t}) - {len(marker)}) ELSE {t} END"
    toks = f"regexp_extract_all({core}, {q(f'[{PY_WORD_CLASS}]+')})"
    phrases = (f"list_sort(list_transform(range(0, len(tk) // 3), lambda i: "
               f"tk[3 * i + 1] || ' ' || tk[3 * i + 2] || ' ' || tk[3 * i + 3]))")
    return (f"list_transform([{toks}], lambda tk: list_transform([{phrases}], lambda ph: "
            f"len(list_filter(range(1, len(ph) - 2), lambda i: ph[i] = ph[i + 3])) > 0)[1])[1]")


def _chars(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, '') END)"


def _low_unique(t: str) -> str:
    return f"(CASE WHEN length({t}) > 0 THEN len(list_distinct({_chars(t)})) / length({t}) < 0.4 ELSE false END)"


def sql_repeated_text():
    return (f"SELECT id, (({_repetition('n')}) AND {_low_unique('n')})::INTEGER AS repeated_text FROM "
            f"(SELECT id, {O.normalize('transcription')} AS n FROM ({O.merged_table()}))")


def sql_char_uniqueness():
    return (f"SELECT doc_id, length(n)::BIGINT AS length, len(list_distinct({_chars('n')}))::BIGINT AS distinct_chars, "
            f"{_low_unique('n')} AS low_uniqueness FROM "
            f"(SELECT doc_id, {O.normalize('text')} AS n FROM documents)")


def sql_normalize_utf8():
    return f"SELECT doc_id, {O.normalize('text', 'utf8')} AS normalized FROM documents"


def sql_normalize_legacy():
    return f"SELECT doc_id, {O.normalize('text', 'legacy')} AS normalized FROM documents"


def _sidecars() -> str:
    return (f"SELECT CAST(doc_id AS VARCHAR) || '.jpg.model' AS file_name, {O.raw_model_output('text')} AS text "
            f"FROM documents WHERE doc_id % {NO_SIDECAR_EVERY} <> 0")


def sql_clean_markup():
    return f"SELECT file_name, {O.clean_markup('text')} AS cleaned FROM ({_sidecars()})"


def _echoed() -> str:
    return (f"CASE WHEN lang = 'en' THEN {q(PROMPT)} || text "
            f"WHEN lang = 'fr' THEN {q('assistant' + chr(10) + chr(10) + PROMPT)} || text ELSE text END")


def _extract(full: str) -> str:
    pos = f"instr({full}, {q(PROMPT)})"
    return O.strip_py(f"CASE WHEN {pos} > 0 THEN substring({full}, {pos} + {len(PROMPT)}) ELSE {full} END")


def sql_extract_response():
    return f"SELECT doc_id, {_extract('f')} AS response FROM (SELECT doc_id, {_echoed()} AS f FROM documents)"


def sql_count_marker():
    def cnt(tok):
        return f"((length(text) - length(replace(text, {q(tok)}, ''))) // {len(tok)})::BIGINT"
    return f"SELECT file_name, {cnt(IMAGE_TOKEN)} AS image_tokens, {cnt(EOT)} AS eot_tokens FROM ({_sidecars()})"


# ------------------------------------------------------------------ joins

def sql_merge_overlap():
    return O.merged_table()


def _attach() -> str:
    return (f"SELECT d.id, coalesce({O.clean_markup('s.text')}, '') AS vision_base, "
            f"CASE WHEN s.file_name IS NULL THEN 'missing' ELSE 'attached' END AS status "
            f"FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d "
            f"LEFT JOIN ({_sidecars()}) s ON d.id || '.jpg.model' = s.file_name")


def sql_attach_sidecar():
    return _attach()


def sql_outcome_counts():
    return f"SELECT status, count(*) AS count FROM ({_attach()}) GROUP BY status"


def _images() -> str:
    return "SELECT CAST(doc_id AS VARCHAR) || '.jpg' AS file_name FROM labels"


def sql_reject_missing():
    return (f"SELECT id, trim(id) || '.jpg' AS image_file FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d "
            f"WHERE NOT EXISTS (SELECT 1 FROM ({_images()}) i WHERE i.file_name = trim(d.id) || '.jpg')")


def sql_resume_pending():
    return (f"SELECT file_name AS image_file FROM ({_images()}) i WHERE NOT EXISTS "
            f"(SELECT 1 FROM ({_sidecars()}) s WHERE s.file_name = i.file_name || '.model')")


def sql_fillna_dropna():
    return (f"SELECT id, coalesce(pyte_ocr, '') AS pyte_ocr, coalesce(chatgpt_ocr, '') AS chatgpt_ocr, "
            f"coalesce(vision_base, '') AS vision_base FROM ({O.primary_table()}) WHERE pyte_ocr IS NOT NULL")


def sql_coerce_numeric():
    raw = "CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END"
    return (f"SELECT event_type, count(*) AS rows, count_if(TRY_CAST(raw AS DOUBLE) IS NULL) AS non_numeric, "
            f"round(sum(TRY_CAST(raw AS DOUBLE)), 6) AS total FROM (SELECT event_type, {raw} AS raw FROM events) "
            f"GROUP BY event_type")


# ------------------------------------------------------------------ aggregates

def sql_hist10():
    edges = "[" + ", ".join(f"{float(e)}" for e in PERCENT_EDGES) + "]"
    labels = ["underflow"] + percent_bin_labels() + ["overflow"]
    binned = (f"SELECT {KEYS}, CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN len(list_filter({edges}, lambda e: e <= value * 100)) END AS b "
              f"FROM report_values")
    counts = ", ".join(f"count_if(b = {i})" for i in range(len(labels)))
    lab = "[" + ", ".join(q(x) for x in labels) + "]"
    return over_report_values(f"SELECT {KEYS}, unnest(range({len(labels)})) AS bin, unnest({lab}) AS label, unnest([{counts}]) AS count "
                              f"FROM ({binned}) GROUP BY {KEYS}")


def _edge(i: str, bins: int) -> str:
    return f"(CASE WHEN {i} = {bins} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {float(bins)}) + lo END)"


def _equal_width(bins: int, density: bool) -> str:
    rng = (f"SELECT {KEYS}, count(value) AS n, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 "
           f"ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END "
           f"AS hi FROM ({clean_values()}) GROUP BY {KEYS}")
    guess = f"CAST(least(greatest(floor((value - lo) / ((hi - lo) / {float(bins)})), 0), {bins - 1}) AS INTEGER)"
    j = f"SELECT v.value, r.*, {guess} AS g FROM ({clean_values()}) v JOIN ({rng}) r USING ({KEYS})"
    idx = (f"CASE WHEN value < {_edge('g', bins)} THEN g - 1 WHEN g < {bins - 1} AND value >= {_edge('g + 1', bins)} "
           f"THEN g + 1 ELSE g END")
    binned = f"SELECT {KEYS}, lo, hi, n, {idx} AS b FROM ({j})"
    counts = ", ".join(f"count_if(b = {i})" for i in range(bins))
    stacked = (f"SELECT {KEYS}, lo, hi, n, unnest(range({bins})) AS bin, unnest([{counts}]) AS count "
               f"FROM ({binned}) GROUP BY {KEYS}, lo, hi, n")
    cols = f"{KEYS}, bin, count, {r9(_edge('bin', bins), 'bin_start')}, {r9(_edge('bin + 1', bins), 'bin_end')}"
    if density:
        cols += (f", round(CAST(count AS DOUBLE) / ({_edge('bin + 1', bins)} - {_edge('bin', bins)}) / n, 6) "
                 f"AS density")
    return f"SELECT {cols} FROM ({stacked})"


def sql_hist20():
    return _equal_width(20, False)


def sql_hist30_density():
    return _equal_width(30, True)


def sql_kde():
    g = KDE_GRID
    params = (f"SELECT {KEYS}, count(value) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx "
              f"FROM ({clean_values()}) GROUP BY {KEYS}")
    params = f"SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM ({params}) WHERE n > 1 AND sd > 0"
    distinct = f"SELECT {KEYS}, value, count(*) AS w FROM ({clean_values()}) GROUP BY {KEYS}, value"
    x = f"(CASE WHEN k = {g - 1} THEN mx ELSE CAST(k AS DOUBLE) * ((mx - mn) / {float(g - 1)}) + mn END)"
    contrib = (f"SELECT {KEYS}, n, h, k, {x} AS x, w * exp(-0.5 * (({x} - value) / h) * (({x} - value) / h)) AS c "
               f"FROM (SELECT d.*, p.n, p.h, p.mn, p.mx, unnest(range({g})) AS k FROM ({distinct}) d "
               f"JOIN ({params}) p USING ({KEYS}))")
    norm = repr(math.sqrt(2 * math.pi))
    return (f"SELECT {KEYS}, k AS point, round(x, 9) AS x, round(sum(c) / (n * h * {norm}), 6) AS density "
            f"FROM ({contrib}) GROUP BY {KEYS}, k, x, n, h")


def _fences(keys: str, clean: str) -> str:
    qs = (f"SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
          f"quantile_cont(value, 0.75) AS q3 FROM ({clean}) GROUP BY {keys}")
    return f"SELECT *, q1 - {WHISKER_IQR} * (q3 - q1) AS flo, q3 + {WHISKER_IQR} * (q3 - q1) AS fhi FROM ({qs})"


def _boxes(keys: str, clean: str) -> str:
    inside = "(value >= flo AND value <= fhi)"
    agg = (f"SELECT {keys}, q1, median, q3, count(value) AS n, min(CASE WHEN {inside} THEN value END) AS lo, "
           f"max(CASE WHEN {inside} THEN value END) AS hi, count_if(NOT {inside}) AS outliers "
           f"FROM ({clean}) v JOIN ({_fences(keys, clean)}) f USING ({keys}) GROUP BY {keys}, q1, median, q3")
    return (f"SELECT {keys}, n, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, "
            f"round(CASE WHEN lo IS NULL OR lo > q1 THEN q1 ELSE lo END, 9) AS whisker_low, "
            f"round(CASE WHEN hi IS NULL OR hi < q3 THEN q3 ELSE hi END, 9) AS whisker_high, outliers FROM ({agg})")


def sql_boxplot():
    return over_report_values(_boxes(KEYS, clean_values(REPORT)))


VARIANT_KEYS = "variant, metric, method, ordinal"


def _variants() -> str:
    """Both variants as the table ``v``; ``rid`` numbers the merged rows."""
    methods = ["pyte_ocr", "chatgpt_ocr", "vision_base"]
    rows = f"SELECT row_number() OVER () AS rid, * FROM ({O.merged_table()})"
    pairs = (f"SELECT rid, id, method, ordinal, raw IS NOT NULL AS present, {O.normalize('transcription')} AS ref, "
             f"{O.normalize('raw')} AS hyp FROM (SELECT rid, id, transcription, unnest([{', '.join(map(q, methods))}]) AS method, "
             f"unnest(range({len(methods)})) AS ordinal, unnest([{', '.join(methods)}]) AS raw FROM ({rows}))")
    scored = (f"SELECT rid, id, method, ordinal, unnest(['jaccard_similarity', 'recall']) AS metric, "
              f"unnest([CASE WHEN present THEN jaccard_similarity END, CASE WHEN present THEN recall END]) AS value "
              f"FROM ({O.set_metrics_select(pairs)})")
    return (f"WITH s AS MATERIALIZED ({scored}), whole AS (SELECT rid FROM s GROUP BY rid HAVING count(value) = {2 * len(methods)}), "
            f"v AS MATERIALIZED (SELECT 'include_null' AS variant, * FROM s UNION ALL "
            f"SELECT 'exclude_null', s.* FROM s JOIN whole USING (rid)), clean AS (SELECT * FROM v WHERE value IS NOT NULL) ")


def sql_boxplot_variants():
    return _variants() + _boxes(VARIANT_KEYS, "SELECT * FROM clean")


def sql_box_outliers():
    return (_variants() + f"SELECT id, {VARIANT_KEYS}, round(value, 9) AS value, CASE WHEN value < flo THEN 'low' ELSE 'high' END AS side "
            f"FROM clean JOIN ({_fences(VARIANT_KEYS, 'SELECT * FROM clean')}) USING ({VARIANT_KEYS}) WHERE value < flo OR value > fhi")


def sql_mean_bar():
    names = "[" + ", ".join(q(m) for m in METHODS) + "]"
    full = (f"SELECT metric, unnest({names}) AS method, unnest(range({len(METHODS)})) AS ordinal "
            f"FROM (SELECT DISTINCT metric FROM ({values()}))")
    means = f"SELECT metric, method, avg(value) * 100 AS m FROM ({values()}) GROUP BY metric, method"
    return (f"SELECT f.metric, f.method, f.ordinal, round(coalesce(m.m, 0.0), 9) AS mean_pct FROM ({full}) f "
            f"LEFT JOIN ({means}) m ON f.metric = m.metric AND f.method = m.method")


def sql_top_bottom_rank():
    means = f"SELECT {KEYS}, avg(value) AS mean FROM report_values GROUP BY {KEYS}"
    ranked = (f"SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC NULLS LAST, ordinal) AS rank_desc, "
              f"row_number() OVER (PARTITION BY metric ORDER BY mean ASC NULLS LAST, ordinal) AS rank_asc, "
              f"count(*) OVER (PARTITION BY metric) AS nm FROM ({means})")
    return over_report_values(f"SELECT {KEYS}, round(mean, 9) AS mean, rank_desc, rank_asc, "
            f"CASE WHEN metric IN ('word_error_rate', 'length_error_rate') THEN rank_asc ELSE rank_desc END AS best_rank, "
            f"rank_desc <= 3 AS top_k, rank_desc > nm - 3 AS bottom_k FROM ({ranked})")


def sql_runtime_stats():
    return ("SELECT event_type, count(value) AS count, round(min(value), 9) AS min, round(max(value), 9) AS max, "
            "round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, "
            "round(coalesce(stddev_samp(value), 0.0), 9) AS stdev, round(sum(value), 6) AS total "
            "FROM events GROUP BY event_type")


def sql_rollup_design():
    p = q(DESIGN_PATTERN)
    d = (f"SELECT metric, value, regexp_extract(method, {p}, 1) AS family, "
         f"nullif(regexp_extract(method, {p}, 2), '') AS metal, "
         f"CAST(nullif(regexp_extract(method, {p}, 3), '') AS BIGINT) AS size FROM ({values()})")
    return (f"SELECT metric, family, metal, size, round(avg(value), 9) AS mean, count(value) AS n, "
            f"CAST(grouping(metric, family, metal, size) AS BIGINT) AS level FROM ({d}) "
            f"GROUP BY ROLLUP (metric, family, metal, size) HAVING metric IS NOT NULL")


# ------------------------------------------------------------------ ordering / limits / reshape

def sql_head_sample():
    return (f"SELECT id, transcription, pyte_ocr, BART_untuned FROM ({O.merged_table()}) "
            f"ORDER BY CAST(id AS BIGINT) LIMIT 50")


def sql_sample_k():
    return (f"SELECT id, lang FROM (SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents) "
            f"ORDER BY md5('{SPLIT_SEED}:' || id), id LIMIT 20")


def sql_order_methods():
    return f"SELECT ordinal, method, count(*) AS pairs FROM ({values()}) WHERE metric = 'precision' GROUP BY ALL"


def sql_latest_by_time():
    return ("SELECT user_id, arg_max(event_id, {'ts': ts, 'e': event_id}) AS latest_event_id, epoch_us(max(ts)) AS latest_ts "
            "FROM events GROUP BY user_id")


def sql_unpivot():
    names = "[" + ", ".join(q(m) for m in METHODS) + "]"
    vals = "[" + ", ".join(METHODS) + "]"
    return (f"SELECT id, method, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT id, unnest({names}) AS method, "
            f"unnest({vals}) AS t FROM ({O.merged_table()}))")


def sql_pivot_wide():
    cols = ", ".join(f"max(CASE WHEN method = {q(m)} THEN precision END) AS {m}_precision" for m in METHODS)
    return f"SELECT id, {cols} FROM ({scored_sets()}) GROUP BY id"


# ------------------------------------------------------------------ training data

def _records() -> str:
    base = (f"SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents d WHERE text IS NOT NULL AND EXISTS "
            f"(SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) || '.jpg' = trim(CAST(d.doc_id AS VARCHAR)) || '.jpg')")
    ranked = (f"SELECT *, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || id), id) - 1 AS rk, "
              f"count(*) OVER () AS n FROM ({base})")
    return (f"SELECT id, 'user' AS user_role, {q(PROMPT)} AS user_content, 'assistant' AS assistant_role, "
            f"{O.strip_py('text')} AS assistant_content, 'images/' || trim(id) || '.jpg' AS image, "
            f"CASE WHEN rk < floor(n * {TRAIN_RATIO}) THEN 'train' ELSE 'test' END AS split FROM ({ranked})")


def sql_chat_records():
    return _records()


def sql_split_sizes():
    return f"SELECT split, count(*) AS records FROM ({_records()}) GROUP BY split"


def sql_reprompt():
    return (f"SELECT id, user_role, {q(PROMPT + IMAGE_TOKEN)} AS user_content, assistant_role, assistant_content, "
            f"image FROM ({_records()})")


def _turn(role: str, content: str) -> str:
    return f"{q(HDR_START)} || {role} || {q(HDR_END + chr(10) + chr(10))} || {content} || {q(EOT)}"


def sql_chat_template():
    return (f"SELECT id, {q(BOS)} || {_turn(q('user'), 'user_content')} || {_turn(q('assistant'), 'assistant_content')} "
            f"AS templated FROM ({_records()})")


def sql_conversation_turns():
    return f"SELECT conv_id, turn, {_turn('role', 'text')} AS segment FROM conversations"


def sql_collate_labels():
    ids = (f"list_concat([{IMAGE_ID}::BIGINT], list_transform(list_filter(string_split(text, ' '), "
           f"lambda w: w <> ''), lambda w: length(w)::BIGINT))")
    ranked = f"SELECT doc_id, {ids} AS ids, row_number() OVER (ORDER BY doc_id) - 1 AS rk FROM documents"
    b = (f"SELECT doc_id, ids, CAST(floor(rk / 4) AS BIGINT) AS batch FROM ({ranked})")
    p = (f"SELECT doc_id, batch, ids, CAST(max(len(ids)) OVER (PARTITION BY batch) AS BIGINT) AS padded_len FROM ({b})")
    padded = f"list_concat(ids, list_transform(range(padded_len - len(ids)), lambda x: {PAD_ID}::BIGINT))"
    labels = (f"list_transform({padded}, lambda x: CASE WHEN x = {PAD_ID} OR x = {IMAGE_ID} THEN {IGNORE_INDEX} "
              f"ELSE x END)")
    return (f"SELECT doc_id, batch, padded_len, CAST(len(list_filter(lb, lambda x: x = {IGNORE_INDEX})) AS BIGINT) "
            f"AS n_masked, array_to_string(lb, ',') AS labels FROM (SELECT doc_id, batch, padded_len, {labels} AS lb "
            f"FROM ({p}))")


def _json_escape(x: str) -> str:
    for old, new in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def sql_parse_structured():
    def field(name, value):
        return f"'{{\"field_name\": \"{name}\", \"value\": \"' || {_json_escape(value)} || '\"}}'"
    js = (f"'{{\"ocr_text\": \"' || {_json_escape('text')} || '\", \"summary\": \"' || "
          f"{_json_escape('concat_ws(' + q(' ') + ', lang, ' + q('letter from') + ', source)')} "
          f"|| '\", \"sections\": [{{\"section_name\": \"metadata\", \"fields\": [' || "
          f"{field('language', 'lang')} || ', ' || {field('source', 'source')} || ', ' || "
          f"{field('quality', 'coalesce(quality, ' + q('unknown') + ')')} || "
          f"']}}, {{\"section_name\": \"content\", \"fields\": [' || {field('chars', 'CAST(n_chars AS VARCHAR)')} "
          f"|| ']}}]}}'")
    docs = (f"SELECT d.*, CAST(l.quality AS VARCHAR) AS quality FROM documents d "
            f"LEFT JOIN labels l ON d.doc_id = l.doc_id")
    full = f"SELECT doc_id, {js} AS js FROM ({docs})"
    cut = (f"SELECT doc_id, CASE WHEN doc_id % {CORRUPT_EVERY} = 0 THEN substring(js, 1, length(js) // 2) ELSE js END "
           f"AS j FROM ({full})")
    typ = '{"sections": [{"section_name": "VARCHAR", "fields": [{"field_name": "VARCHAR", "value": "VARCHAR"}]}]}'
    parsed = (f"SELECT doc_id, NOT json_valid(j) AS corrupt, CASE WHEN json_valid(j) THEN "
              f"json_transform(j, {q(typ)}).sections END AS secs FROM ({cut})")
    s = (f"SELECT doc_id, corrupt, unnest(CASE WHEN secs IS NULL OR len(secs) = 0 THEN [NULL] ELSE secs END) AS s "
         f"FROM ({parsed})")
    f = (f"SELECT doc_id, corrupt, s.section_name AS section_name, unnest(CASE WHEN s.fields IS NULL OR "
         f"len(s.fields) = 0 THEN [NULL] ELSE s.fields END) AS f FROM ({s})")
    return f"SELECT doc_id, corrupt, section_name, f.field_name AS field_name, f.value AS value FROM ({f})"


def sql_structured_linked():
    """Every value that the documents' answers hold, straight from the columns
    that they were written from (cut answers hold none)."""
    doc, chars = "CAST(doc_id AS VARCHAR)", "CAST(n_chars AS VARCHAR)"
    groups = [  # level, attributes of its one element in the order of the prompt
        ("personal_information", dict(name="source", date_of_birth=None, social_security_no=None, employee_no=None, id_no=doc, rp_certificate_no=None)),
        ("dates", dict(date=doc, category="'letter'")),
        ("monetary_amounts", dict(amount=chars, category="'chars'")),
        ("relationships", dict(entity1="source", relationship="'wrote'", entity2="lang")),
        ("medical_information", dict(info="lang", category="'none'")),
        ("family_information", dict(name="source", relationship="'self'", event="'letter'")),
        ("employment_history", dict(date=doc, position_description="'writer'", division=None, department=None, location="source", rate_of_pay=None,
                                    remarks=None)),
        ("employment_events", dict(date=doc, location=None, incident="'letter'", action_taken=None)),
        ("metadata", dict(document_type="'letter'", period=None, context="source")),
        ("sentiment", dict(value="coalesce(quality, 'unknown')")),
        ("document_specific_information", dict(value=chars)), ("other", dict(value=doc))]
    rows = [(level, 0, name, 0, value) for level, attributes in groups for name, value in attributes.items()]
    rows += [("employment_events", 0, "reference_numbers", i, v) for i, v in enumerate((doc, chars))]
    rows += [("geographical_information", i, "value", 0, v) for i, v in enumerate(("source", "lang"))]
    cells = ", ".join(f"{{'level': {q(level)}, 'pos': {pos}, 'name': {q(name)}, 'item': {item}, 'value': {value or 'NULL::VARCHAR'}}}"
                      for level, pos, name, item, value in rows)
    docs = (f"SELECT d.*, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
            f"WHERE d.doc_id % {CORRUPT_EVERY} <> 0")
    fixed = f"SELECT doc_id, unnest([{cells}]) AS v FROM ({docs})"
    words = (f"SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT *, list_filter(string_split(text, ' '), "
             f"lambda x: regexp_matches(x, '^[A-Z]')) AS w FROM ({docs}))")
    head = "doc_id, 0 AS section_pos, 'metadata' AS section_name, 0 AS field_pos, 'language' AS field_name"
    return (f"SELECT {head}, v.level AS level, v.pos AS pos, v.name AS name, v.item AS item, v.value AS value FROM ({fixed}) "
            f"UNION ALL SELECT {head}, 'named_entities', pos, 'entity', 0, word FROM ({words}) "
            f"UNION ALL SELECT {head}, 'named_entities', pos, 'type', 0, lang FROM ({words})")


def sql_report_blocks():
    secs = "CAST(n_chars // 1000 AS VARCHAR) || '.' || lpad(CAST(n_chars % 1000 AS VARCHAR), 3, '0')"
    ranked = (f"SELECT *, row_number() OVER (ORDER BY doc_id) AS idx, count(*) OVER () AS n, "
              f"{_echoed()} AS f FROM documents")
    block = (f"'Image ' || CAST(idx AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ': ' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || "
             f"'.jpg' || chr(10) || 'Time: ' || {secs} || 's' || chr(10) || {_extract('f')} || chr(10) || "
             f"{q(REPORT_RULE)}")
    return f"SELECT idx, {block} AS block FROM ({ranked})"


def sql_csv_roundtrip():
    from ..sources.files import NA_TOKENS
    toks = ", ".join(q(t) for t in NA_TOKENS)
    cols = ["id", "transcription"] + METHODS
    sel = ", ".join(f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}" for c in cols)
    return f"SELECT {sel} FROM ({O.merged_table()})"


def sql_sidecar_roundtrip():
    return sql_clean_markup()


def _image_rows() -> str:
    name = "lpad(CAST(doc_id AS VARCHAR), 12, '0') || CASE WHEN doc_id % 2 = 0 THEN '.bmp' ELSE '.BMP' END"
    # pixels are stored blue, green, red
    d = "upper(md5(text))"
    rgb = " || ".join(f"substr({d}, {6 * i + 5}, 2) || substr({d}, {6 * i + 3}, 2) || substr({d}, {6 * i + 1}, 2)" for i in range(PIXELS))
    return f"SELECT {name} AS file_name, doc_id % {BAD_IMAGE_EVERY} <> 0 AS valid, {rgb} AS rgb FROM documents WHERE text IS NOT NULL"


def sql_image_files():
    return f"SELECT file_name, CASE WHEN valid THEN {54 + 3 * PIXELS} ELSE 8 END::BIGINT AS length FROM ({_image_rows()})"


def sql_image_pixels():
    return (f"SELECT file_name, 1 AS height, {PIXELS} AS width, 3 AS channels, {3 * PIXELS} AS n_bytes, rgb AS first, valid "
            f"FROM ({_image_rows()}) WHERE valid")


def sql_image_fallback():
    return (f"SELECT file_name, CASE WHEN valid THEN 1 ELSE 224 END AS height, CASE WHEN valid THEN {PIXELS} ELSE 224 END AS width, "
            f"3 AS channels, CASE WHEN valid THEN {3 * PIXELS} ELSE 224 * 224 * 3 END AS n_bytes, "
            f"CASE WHEN valid THEN rgb ELSE repeat('0', {6 * PIXELS}) END AS first, valid FROM ({_image_rows()})")


def sql_summary_roundtrip():
    return O.summary(values())


def sql_decode_escapes():
    return "SELECT doc_id, text AS decoded FROM documents"


def sql_prompt_default():
    return f"SELECT CAST(doc_id AS VARCHAR) AS id, {q(PROMPT)} AS user_content FROM documents"


def _sidecar_outcomes() -> str:
    name = "CAST(doc_id AS VARCHAR) || '.jpg.model'"
    raw = O.raw_model_output("text")
    size = f"strlen({raw}) + CASE WHEN doc_id % {BROKEN_EVERY} = 0 THEN 1 ELSE 0 END"
    error = (f"CASE WHEN {size} > {LARGE_SIDECAR} THEN 'too large: ' || CAST({size} AS VARCHAR) || ' bytes' "
             f"WHEN doc_id % {BROKEN_EVERY} = 0 THEN 'not UTF-8' END")
    return (f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % {NO_SIDECAR_EVERY} = 0 THEN '' "
            f"ELSE coalesce('Error reading file: ' || ({error}), {raw}) END AS vision_base, "
            f"CASE WHEN doc_id % {NO_SIDECAR_EVERY} = 0 THEN 'missing' WHEN ({error}) IS NOT NULL THEN 'unreadable' ELSE 'attached' END AS status, "
            f"CASE WHEN doc_id % {NO_SIDECAR_EVERY} = 0 THEN 'File ' || {name} || ' does not exist. Leaving the cell empty.' "
            f"WHEN ({error}) IS NOT NULL THEN 'Error reading ' || {name} || ': ' || ({error}) END AS message FROM documents")


def sql_sidecar_errors():
    return f"SELECT * FROM ({_sidecar_outcomes()}) WHERE status <> 'attached'"


def sql_run_counters():
    return (f"SELECT count(*) AS total, " + ", ".join(f"count_if(status = '{x}') AS {x}" for x in ("attached", "missing", "unreadable"))
            + f" FROM ({_sidecar_outcomes()})")


def sql_tolerant_scan():
    from ..sources.files import NA_TOKENS
    toks = ", ".join(q(t) for t in NA_TOKENS)
    cut = f"doc_id % 10 = {SHORT_LINE}"
    cols = {"id": "CAST(doc_id AS VARCHAR)", "lang": "lang", "source": f"CASE WHEN {cut} THEN NULL ELSE source END",
            "text": f"CASE WHEN {cut} THEN NULL ELSE text END"}
    sel = ", ".join(f"CASE WHEN {v} IN ({toks}) THEN NULL ELSE {v} END AS {c}" for c, v in cols.items())
    return f"SELECT {sel} FROM documents WHERE doc_id % 10 <> {LONG_LINE}"


def sql_tolerant_counts():
    return (f"SELECT count(*) AS records, count_if(doc_id % 10 = {LONG_LINE}) AS skipped, "
            f"count_if(doc_id % 10 = {SHORT_LINE}) AS padded FROM documents")


def sql_chat_json_roundtrip():
    return (f"SELECT user_role, user_content, assistant_role, assistant_content, image, split "
            f"FROM ({_records()})")


def sql_analysis_summary():
    methods = ["pyte_ocr", "chatgpt_ocr", "vision_base"]
    pairs = (f"SELECT method, ordinal, raw IS NOT NULL AS present, {O.normalize('transcription')} AS ref, "
             f"{O.normalize('raw')} AS hyp FROM (SELECT transcription, unnest([{', '.join(map(q, methods))}]) AS method, "
             f"unnest(range({len(methods)})) AS ordinal, unnest([{', '.join(methods)}]) AS raw FROM ({O.merged_table()}))")
    return (f"WITH s AS (SELECT method, ordinal, CASE WHEN present THEN jaccard_similarity END AS a, "
            f"CASE WHEN present THEN recall END AS b FROM ({O.set_metrics_select(pairs)})), "
            f"v AS (SELECT 'include_null' AS variant, * FROM s UNION ALL "
            f"SELECT 'exclude_null', * FROM s WHERE a IS NOT NULL AND b IS NOT NULL), "
            f"c AS (SELECT method, count(*) FILTER (WHERE a IS NULL) AS non_numeric_first, "
            f"count(*) FILTER (WHERE b IS NULL) AS non_numeric_second FROM s GROUP BY method) "
            f"SELECT variant, method, ordinal, {r9('avg(a)', 'avg_first')}, {r9('quantile_cont(a, 0.5)', 'median_first')}, "
            f"{r9('avg(b)', 'avg_second')}, {r9('quantile_cont(b, 0.5)', 'median_second')}, "
            f"count(*) FILTER (WHERE a >= 0.93) AS matches, count(*) AS legacy_matches, count(*) AS total_entries, "
            f"any_value(non_numeric_first) AS non_numeric_first, any_value(non_numeric_second) AS non_numeric_second "
            f"FROM v JOIN c USING (method) GROUP BY variant, method, ordinal")


def sql_exact_match_incl_excl():
    return f"SELECT variant, method, ordinal, matches, total_entries FROM ({sql_analysis_summary()})"


def sql_incremental():
    return sql_clean_markup()


def sql_truncate():
    return (f"SELECT doc_id, n AS normalized, length(n)::BIGINT AS length FROM "
            f"(SELECT doc_id, {O.normalize('text', max_chars=DEFAULT_MAX_CHARS)} AS n FROM documents)")


def sql_incremental_scoring():
    s = (f"SELECT CAST(doc_id AS VARCHAR) AS id, {O.normalize('text')} AS ref, "
         f"{O.normalize(O.clean_markup(O.raw_model_output('text')))} AS hyp FROM documents "
         f"WHERE doc_id % {NO_SIDECAR_EVERY} <> 0 AND doc_id % 23 <> 0")
    return f"SELECT id, precision, recall FROM ({O.set_metrics_select(s)})"


def sql_scoring_progress():
    have = f"SELECT doc_id, doc_id % 23 <> 0 AS comes FROM documents WHERE doc_id % {NO_SIDECAR_EVERY} <> 0"
    runs = {1: ("doc_id % 2 = 0", "false"), 2: ("true", "comes AND doc_id % 3 = 0"), 3: ("true", "comes")}
    return " UNION ALL ".join(f"SELECT {n} AS run, count_if({known}) AS scored, count_if(({there}) AND NOT ({known})) AS pending FROM ({have})"
                              for n, (there, known) in runs.items())


def sql_nested_subsets():
    ranked = (f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'gold' ELSE 'silver' END AS metal "
              f"FROM labels")
    ranked = (f"SELECT *, row_number() OVER (PARTITION BY metal ORDER BY md5('{SPLIT_SEED}:' || id), id) - 1 AS rk "
              f"FROM ({ranked})")
    return (f"SELECT id, metal, array_to_string(list_filter([100, 1000, 10000], lambda s: rk < s), ',') AS subsets "
            f"FROM ({ranked})")


def sql_preview_records():
    return (f"SELECT id, image, length(assistant_content) > 0 AS has_answer, "
            f"EXISTS (SELECT 1 FROM labels WHERE CAST(doc_id AS VARCHAR) || '.jpg' = image) AS image_listed "
            f"FROM ({_records()}) WHERE split = 'test' ORDER BY CAST(id AS BIGINT) LIMIT 3")


def sql_profile():
    from ..sources.derived import BART_EDITS
    cols = ["id", "transcription", "pyte_ocr", "chatgpt_ocr", "vision_base", "BART_untuned"] + list(BART_EDITS)
    schema = ",".join(f"{c}:string" for c in cols)
    return (f"SELECT 'merged' AS name, count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns, "
            f"{q(schema)} AS schema FROM ({O.merged_table()})")


def sql_scored_table():
    norm = ", ".join(f"{O.normalize(m)} AS normalized_{m}" for m in METHODS)
    base = (f"SELECT *, {O.normalize('transcription')} AS normalized_transcription, {norm} "
            f"FROM ({O.merged_table()})")
    sets = ", ".join(f"list_distinct({O.words('normalized_' + m)}) AS hs_{m}" for m in METHODS)
    withsets = f"SELECT *, list_distinct({O.words('normalized_transcription')}) AS rs, {sets} FROM ({base})"
    metrics = []
    for m in METHODS:
        hs, inter = f"hs_{m}", f"len(list_intersect(rs, hs_{m}))"
        metrics += [
            f"CASE WHEN len({hs}) > 0 THEN {inter} / len({hs}) ELSE 0.0 END AS {m}_precision",
            f"CASE WHEN len(rs) > 0 THEN {inter} / len(rs) ELSE 0.0 END AS {m}_recall",
            f"CASE WHEN len(rs) + len({hs}) > 0 THEN {inter} / (len(rs) + len({hs}) - {inter}) ELSE 0.0 END "
            f"AS {m}_jaccard_similarity",
        ]
    jac = ", ".join(f"{m}_jaccard_similarity >= 0.93 AS {m}_equal_jaccard" for m in METHODS)
    rep = f"(({_repetition('normalized_transcription')}) AND {_low_unique('normalized_transcription')})::INTEGER"
    scored = f"SELECT *, {', '.join(metrics)}, {rep} AS repeated_text FROM ({withsets})"
    drop = ", ".join(["rs"] + [f"hs_{m}" for m in METHODS])
    return f"SELECT * EXCLUDE ({drop}), {jac} FROM ({scored})"


def sql_typed_head():
    return "SELECT event_id, event_type, value AS seconds FROM events ORDER BY event_id LIMIT 100"


def sql_duplicate_ids():
    return f"SELECT id, count(*) AS copies FROM ({O.merged_table()}) GROUP BY id HAVING count(*) > 1"


def sql_wer_undefined():
    return (f"SELECT method, ordinal, count_if(len({O.words('ref')}) = 0) AS wer_undefined, count(*) AS pairs "
            f"FROM ({O.long_pairs()}) GROUP BY method, ordinal")


def sql_split_rows():
    return f"SELECT id, split FROM ({_records()})"


def sql_assemble_table():
    return (f"SELECT CAST(doc_id AS VARCHAR) || '.jpg' AS id, text AS transcription, "
            f"CASE WHEN doc_id % {NO_SIDECAR_EVERY} <> 0 THEN {O.clean_markup(O.raw_model_output('text'))} ELSE '' END "
            f"AS vision_base, translate(text, 'oil', '011') AS pyte_ocr, "
            f"CASE WHEN lang <> 'de' THEN text ELSE '' END AS chatgpt_ocr FROM documents")


def sql_chart_labels():
    title = ("array_to_string(list_transform(string_split(replace(metric, '_', ' '), ' '), "
             "lambda w: upper(w[1]) || lower(w[2:])), ' ')")
    agg = f"SELECT {KEYS}, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM ({values()}) GROUP BY {KEYS}"
    return (f"SELECT {KEYS}, {title} AS title, method || ' (Median: ' || printf('%.2f', median) || ')' AS median_label, "
            f"printf('%.1f', mean * 100) || '%' AS bar_label FROM ({agg})")


def sql_sample_csv():
    from ..sources.files import NA_TOKENS
    toks = ", ".join(q(t) for t in NA_TOKENS)
    cols = ["id", "transcription", "BART_untuned"]
    sel = ", ".join(f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}" for c in cols)
    return (f"SELECT {sel} FROM (SELECT id, transcription, BART_untuned FROM ({O.merged_table()}) "
            f"ORDER BY CAST(id AS BIGINT), transcription LIMIT 50)")


def sql_prompt_records():
    first = "(SELECT text FROM benchmark ORDER BY item_id LIMIT 1)"
    return f"SELECT CAST(doc_id AS VARCHAR) AS id, {O.strip_py(first)} AS user_content FROM documents"


SQL = {name[len("sql_"):]: fn for name, fn in globals().items() if name.startswith("sql_") and callable(fn)}
