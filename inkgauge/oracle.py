"""DuckDB twins of the Spark plans, for the side-by-side correctness check.

These builders emit plain SQL over the driver's parquet views.  They mirror
the *semantics* of the Spark code (same derivations, same regex classes,
same definitions of each metric); they are verification code, not part of
the engine.
"""

from __future__ import annotations

from .functions.text import DEFAULT_PHRASES, TRUNCATION_MARKER
from .sources.derived import (BART_EDITS, BOS, CORRECTION_PREFIX, DUPLICATE_EVERY, EOT, HDR_END, HDR_START,
                              IMAGE_TOKEN, METHODS, NO_SIDECAR_EVERY, NULL_EVERY, PROMPT)

SPACE = ("\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
         "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
WORD = "\\p{L}\\p{N}_"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2_quote(s: str) -> str:
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in s)


def strip_py(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + SPACE + ']+|[' + SPACE + ']+$')}, '', 'g')"


def mojibake(x: str) -> str:
    """UTF-8 bytes of each character re-read as Latin-1 characters."""
    u = "unicode(c)"
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE "
            f"WHEN {u} < 128 THEN c "
            f"WHEN {u} < 2048 THEN chr(192 + {u} // 64) || chr(128 + {u} % 64) "
            f"WHEN {u} < 65536 THEN chr(224 + {u} // 4096) || chr(128 + ({u} // 64) % 64) || chr(128 + {u} % 64) "
            f"ELSE chr(240 + {u} // 262144) || chr(128 + ({u} // 4096) % 64) || chr(128 + ({u} // 64) % 64) "
            f"|| chr(128 + {u} % 64) END), '')")


def normalize(x: str, mode: str = "legacy", max_chars: int | None = None, phrases=DEFAULT_PHRASES) -> str:
    e = f"coalesce({x}, '')"
    for p in phrases:
        e = f"regexp_replace({e}, {q('(?i)' + re2_quote(p))}, '', 'g')"
    if mode == "legacy":
        e = mojibake(e)
    e = f"strip_accents(lower({e}))"
    e = f"regexp_replace({e}, {q('[^' + WORD + SPACE + ']')}, '', 'g')"
    e = f"trim(regexp_replace({e}, {q('[' + SPACE + ']+')}, ' ', 'g'))"
    if max_chars is None:
        return e
    keep = max_chars - len(TRUNCATION_MARKER)
    # A one-element lambda binds the normalised text to a name (``let``).
    return (f"list_transform([{e}], lambda n: CASE WHEN length(n) > {max_chars} THEN substring(n, 1, {keep}) "
            f"|| {q(TRUNCATION_MARKER)} ELSE n END)[1]")


def clean_markup(x: str) -> str:
    pats = ["<\\|begin_of_text\\|>", "(?s)<\\|start_header_id\\|>.*?<\\|end_header_id\\|>",
            "(?s)<\\|image\\|>.*?<\\|eot_id\\|>", "<\\|eot_id\\|>", "\\*\\*", "\\[[" + WORD + "]+\\]"]
    e = x
    for p in pats:
        e = f"regexp_replace({e}, {q(p)}, '', 'g')"
    return strip_py(e)


def raw_model_output(x: str) -> str:
    head = f"{BOS}{HDR_START}user{HDR_END}\n\n{IMAGE_TOKEN}{PROMPT}{EOT}{HDR_START}assistant{HDR_END}\n\n"
    return f"({q(head)} || {x} || {q(EOT)})"


def inner_loss(x: str) -> str:
    """Every fifth word is missing."""
    parts = f"string_split({x}, ' ')"
    return f"array_to_string(list_filter({parts}, lambda w, i: i % 5 <> 0), ' ')"


def primary_table() -> str:
    return (f"SELECT CAST(doc_id AS VARCHAR) AS id, text AS transcription, "
            f"CASE WHEN doc_id % {NULL_EVERY} <> 0 THEN translate(text, 'oil', '011') END AS pyte_ocr, "
            f"CASE WHEN doc_id % {NULL_EVERY} <> 0 THEN {inner_loss('text')} END AS chatgpt_ocr, "
            f"CASE WHEN doc_id % {NO_SIDECAR_EVERY} <> 0 THEN {clean_markup(raw_model_output('text'))} ELSE '' END "
            f"AS vision_base FROM documents")


def _edits(x: str, edits) -> str:
    for old, new in edits:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def bart_table() -> str:
    cols = (f"CAST(doc_id AS VARCHAR) AS id, text || ' [bart copy]' AS transcription, "
            f"{q(CORRECTION_PREFIX)} || text AS BART_untuned, "
            + ", ".join(f"{_edits('text', e)} AS {m}" for m, e in BART_EDITS.items()))
    return (f"SELECT {cols} FROM documents UNION ALL "
            f"SELECT {cols} FROM documents WHERE doc_id % {DUPLICATE_EVERY} = 0")


def merged_table() -> str:
    bart_cols = ", ".join(f"b.{m}" for m in BART_EDITS) + ", b.BART_untuned"
    return (f"SELECT p.*, {bart_cols} FROM ({primary_table()}) p JOIN ({bart_table()}) b "
            f"ON p.id IS NOT DISTINCT FROM b.id")


def long_pairs(mode: str = "legacy", methods=METHODS) -> str:
    names = ", ".join(q(m) for m in methods)
    vals = ", ".join(methods)
    return (f"SELECT id, ref, method, ordinal, {normalize('raw', mode)} AS hyp FROM ("
            f"SELECT id, {normalize('transcription', mode)} AS ref, "
            f"unnest([{names}]) AS method, unnest(range({len(methods)})) AS ordinal, "
            f"unnest([{vals}]) AS raw FROM ({merged_table()}))")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def set_metrics_select(pairs_sql: str) -> str:
    """precision / recall / jaccard over word sets of each pair."""
    return (f"SELECT *, CASE WHEN len(hs) > 0 THEN len(list_intersect(rs, hs)) / len(hs) ELSE 0.0 END AS precision, "
            f"CASE WHEN len(rs) > 0 THEN len(list_intersect(rs, hs)) / len(rs) ELSE 0.0 END AS recall, "
            f"CASE WHEN len(rs) + len(hs) > 0 THEN len(list_intersect(rs, hs)) / "
            f"(len(rs) + len(hs) - len(list_intersect(rs, hs))) ELSE 0.0 END AS jaccard_similarity "
            f"FROM (SELECT *, list_distinct({words('ref')}) AS rs, list_distinct({words('hyp')}) AS hs "
            f"FROM ({pairs_sql}))")


def unpivot_metrics(scored_sql: str, metrics: list[str]) -> str:
    names = ", ".join(q(m) for m in metrics)
    vals = ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics)
    return (f"SELECT id, method, ordinal, unnest([{names}]) AS metric, unnest([{vals}]) AS value "
            f"FROM ({scored_sql})")


def summary(values_sql: str) -> str:
    """AGG1 twin: whole-number percentages, half-to-even."""
    stats = {
        "mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std_dev": "stddev_samp(value)",
        "min": "min(value)", "max": "max(value)", "p25": "quantile_cont(value, 0.25)",
        "p75": "quantile_cont(value, 0.75)",
    }
    cols = ", ".join(f"round_even({e} * 100, 0) AS \"{k}\"" for k, e in stats.items())
    return f"SELECT metric, method, ordinal, {cols} FROM ({values_sql}) GROUP BY metric, method, ordinal"
