"""Evaluation inputs derived from the ``documents`` table.

The evaluated workflow scores OCR "methods" against a human transcription.
The driver's data has one text per document, so every method column is a
deterministic function of that text (character noise, a lost tail, chat
markup, an instruction echo with repetition, systematic word errors).  Each
derivation is a plain Column expression with a DuckDB twin in
``inkgauge.oracle`` so the same table can be rebuilt in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_markup

# --- fixed values that must equal the evaluated system's behaviour ---------
# The ten OCR methods scored against the human transcription, in order.
METHODS = [
    "pyte_ocr", "chatgpt_ocr", "vision_base",
    "BART_untuned", "BART_gold_100", "BART_gold_1000", "BART_gold_10000",
    "BART_silver_100", "BART_silver_1000", "BART_silver_10000",
]
# Chat-template spellings of the vision model's generation format.
BOS = "<|begin_of_text|>"
HDR_START = "<|start_header_id|>"
HDR_END = "<|end_header_id|>"
EOT = "<|eot_id|>"
IMAGE_TOKEN = "<|image|>"
# ---------------------------------------------------------------------------

# Our own fixture choices (not reference values).
PROMPT = "Transcribe the handwritten letter in this image exactly as written."
CORRECTION_PREFIX = "correct this ocr: "
# (old, new) substitutions per BART variant: better-trained variants make
# fewer systematic errors.
BART_EDITS = {
    "BART_gold_100": [("tion", "toin"), ("ment", "mnet"), ("eau", "aeu")],
    "BART_gold_1000": [("tion", "toin"), ("ment", "mnet")],
    "BART_gold_10000": [("tion", "toin")],
    "BART_silver_100": [(" the ", " teh "), ("ou", "uo"), ("ing", "nig")],
    "BART_silver_1000": [(" the ", " teh "), ("ou", "uo")],
    "BART_silver_10000": [(" the ", " teh ")],
}
NULL_EVERY = 17      # pyte_ocr / chatgpt_ocr missing for doc_id % 17 = 0
NO_SIDECAR_EVERY = 13  # no model output file for doc_id % 13 = 0
DUPLICATE_EVERY = 50   # right-hand table repeats doc_id % 50 = 0


def raw_model_output(text: Column, prompt: str = PROMPT) -> Column:
    """What the generation loop writes when special tokens are kept."""
    return F.concat(
        F.lit(f"{BOS}{HDR_START}user{HDR_END}\n\n{IMAGE_TOKEN}{prompt}{EOT}{HDR_START}assistant{HDR_END}\n\n"),
        text, F.lit(EOT))


def _edits(c: Column, edits) -> Column:
    for old, new in edits:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def inner_loss(c: Column) -> Column:
    """Every fifth word is missing."""
    return F.array_join(F.filter(F.split(c, " "), lambda w, i: (i + 1) % 5 != 0), " ")


def primary_columns(text: Column, doc_id: Column) -> dict[str, Column]:
    """The three engines' texts of a document."""
    missing = (doc_id % NULL_EVERY) == 0
    ocr = text
    for old, new in zip("oil", "011"):  # no digit is replaced in turn
        ocr = F.replace(ocr, F.lit(old), F.lit(new))
    return {"pyte_ocr": F.when(~missing, ocr), "chatgpt_ocr": F.when(~missing, inner_loss(text)),
            "vision_base": F.when((doc_id % NO_SIDECAR_EVERY) != 0, clean_markup(raw_model_output(text))).otherwise(F.lit(""))}


def bart_columns(text: Column) -> dict[str, Column]:
    """The seven BART variants' texts of a document."""
    return {"BART_untuned": F.concat(F.lit(CORRECTION_PREFIX), text)} | {m: _edits(text, e) for m, e in BART_EDITS.items()}


def primary_table(documents: DataFrame) -> DataFrame:
    """``id, transcription, pyte_ocr, chatgpt_ocr, vision_base`` (all strings)."""
    engines = primary_columns(F.col("text"), F.col("doc_id"))
    return documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("transcription"),
                            *[c.alias(m) for m, c in engines.items()])


def bart_table(documents: DataFrame) -> DataFrame:
    """``id, transcription (altered), BART_*``; some ids appear twice."""
    return _bart_rows(documents, bart_columns(F.col("text")))


def _bart_rows(documents: DataFrame, columns: dict[str, Column]) -> DataFrame:
    cols = [F.col("doc_id").cast("string").alias("id"), F.concat("text", F.lit(" [bart copy]")).alias("transcription"),
            *[c.alias(m) for m, c in columns.items()]]
    base = documents.select(*cols)
    dups = documents.where((F.col("doc_id") % DUPLICATE_EVERY) == 0).select(*cols)
    return base.unionByName(dups)


def primary_sources(documents: DataFrame) -> DataFrame:
    """The rows of :func:`primary_table` before their engines' texts are made."""
    return documents.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_doc"), F.col("text").alias("transcription"))


def bart_sources(documents: DataFrame) -> DataFrame:
    """The rows of :func:`bart_table` before their variants' texts are made."""
    return _bart_rows(documents, {"_bart": F.col("text")})


def method_texts(merged: DataFrame) -> DataFrame:
    """The methods' texts of merged :func:`primary_sources` and
    :func:`bart_sources`, each from its own side's text."""
    made = primary_columns(F.col("transcription"), F.col("_doc")) | bart_columns(F.col("_bart"))
    return merged.select("id", "transcription", *[made[m].alias(m) for m in METHODS])


def sidecars(documents: DataFrame, suffix: str = ".model") -> DataFrame:
    """``(file_name, text)`` as a whole-text sidecar scan would return them:
    one raw model output per image that has been processed."""
    return (documents.where((F.col("doc_id") % NO_SIDECAR_EVERY) != 0)
            .select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg" + suffix)).alias("file_name"),
                    raw_model_output(F.col("text")).alias("text")))


BROKEN_EVERY = 19   # sidecar files with a byte that is no UTF-8 for doc_id % 19 = 0
LARGE_SIDECAR = 20_000  # sidecar files above this are refused


def broken_sidecars(documents: DataFrame) -> DataFrame:
    """``(file_name, body)``: the sidecars as bytes, some with a stray byte."""
    s = sidecars(documents).withColumn("_d", F.expr("cast(regexp_extract(file_name, '^(-?[0-9]+)', 1) as long)"))
    body = F.encode(F.col("text"), "UTF-8")
    return s.select("file_name", F.when(F.col("_d") % BROKEN_EVERY == 0, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body).alias("body"))


BAD_LINE_COLUMNS = ["id", "lang", "source", "text"]
LONG_LINE, SHORT_LINE = 3, 7  # doc_id % 10: one field too many, the last two missing


def bad_lines(documents: DataFrame, sep: str = "|") -> DataFrame:
    """``(value)``: a quoted record per document, some with a wrong number of fields."""
    def quoted(c):
        c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""'))
        return F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.pmod(F.col("doc_id"), F.lit(10))
    fields = [quoted(c) for c in (F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("text"))]
    return documents.select(F.when(kind == LONG_LINE, F.concat_ws(sep, *fields, F.lit('"one | too many"')))
                            .when(kind == SHORT_LINE, F.concat_ws(sep, *fields[:2])).otherwise(F.concat_ws(sep, *fields)).alias("value"))


def echoed_output(lang: Column, text: Column, prompt: str = PROMPT) -> Column:
    """Model output that echoes the prompt: as a prefix (English), after a
    role header (French), or not at all (other languages)."""
    return (F.when(lang == "en", F.concat(F.lit(prompt), text))
            .when(lang == "fr", F.concat(F.lit("assistant\n\n" + prompt), text))
            .otherwise(text))


def token_ids(text: Column, image_id: int) -> Column:
    """Token ids of a text as the test data has none: an image id, then one
    number per word (its length)."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.concat(F.array(F.lit(image_id).cast("long")), F.transform(words, lambda w: F.length(w).cast("long")))


def model_runs(documents: DataFrame) -> DataFrame:
    """``(file, output, seconds)``: a run per document, in thousandths of a
    second per character."""
    return documents.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg")).alias("file"),
                            echoed_output(F.col("lang"), F.col("text")).alias("output"),
                            (F.col("n_chars") / 1000).alias("seconds"))


BAD_IMAGE_EVERY = 29  # image files that are no image for doc_id % 29 = 0
PIXELS = 4            # width of the one-row test images
#: A bitmap's header: 54 bytes before the pixels, 24 bits a pixel, one row.
BMP_HEADER = "424D" + "42000000" + "00000000" + "36000000" + "28000000" + "04000000" + "01000000" + "0100" + "1800" + "00" * 24


def image_files(documents: DataFrame) -> DataFrame:
    """``(file_name, content)``: a bitmap per document whose pixels are its
    text's digest, with mixed spellings of the extension; some are no images."""
    digest = F.substring(F.md5(F.col("text")), 1, PIXELS * 6)
    bmp = F.unhex(F.concat(F.lit(BMP_HEADER), digest))
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.when(F.col("doc_id") % 2 == 0, ".bmp").otherwise(".BMP"))
    return documents.where(F.col("text").isNotNull()).select(
        name.alias("file_name"), F.when(F.col("doc_id") % BAD_IMAGE_EVERY == 0, F.encode(F.lit("no image"), "UTF-8")).otherwise(bmp).alias("content"))


def escaped_text(c: Column) -> Column:
    """A text as its source code would spell it (backslashes doubled twice:
    one doubling is undone before escapes are read)."""
    for old, new in [("\\", "\\\\\\\\"), ("\n", "\\n"), ("\t", "\\x09"), ("'", "\\'"), ("e", "\\145"), ("é", "\\u00e9")]:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def image_listing(labels: DataFrame, ext: str = ".jpg") -> DataFrame:
    """The image files that exist: one per labelled document (``file_name``
    as a ``binaryFile`` listing would report it)."""
    return labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(ext)).alias("file_name"))


def raw_run_times(events: DataFrame) -> DataFrame:
    """Run times as the string column of a re-read CSV: error rows carry a
    non-numeric marker."""
    return events.select("event_type", F.when(F.col("event_type") == "error", F.lit("n/a"))
                         .otherwise(F.col("value").cast("string")).alias("raw_value"))


CORRUPT_EVERY = 11  # structured outputs cut short for doc_id % 11 = 0


def json_escape(c: Column) -> Column:
    for old, new in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def linked_information() -> Column:
    """All levels of the prompt's linked information, from the tables' columns."""
    lang, source, chars, doc = F.col("lang"), F.col("source"), F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    words = F.filter(F.split(F.col("text"), " "), lambda w: w.rlike("^[A-Z]"))  # the capitalised words
    def row(**values):
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])
    return F.to_json(row(
        personal_information=row(name=source, id_no=doc),
        named_entities=F.transform(words, lambda w: row(entity=w, type=lang)),
        dates=F.array(row(date=doc, category="letter")),
        monetary_amounts=F.array(row(amount=chars, category="chars")),
        relationships=F.array(row(entity1=source, relationship="wrote", entity2=lang)),
        medical_information=F.array(row(info=lang, category="none")),
        family_information=F.array(row(name=source, relationship="self", event="letter")),
        employment_history=F.array(row(date=doc, position_description="writer", location=source)),
        employment_events=F.array(row(date=doc, incident="letter", reference_numbers=F.array(doc, chars))),
        geographical_information=F.array(source, lang), document_specific_information=F.array(chars), other=F.array(doc),
        metadata=row(document_type="letter", context=source), sentiment=F.coalesce(F.col("quality"), F.lit("unknown"))))


def structured_json(documents: DataFrame, labels: DataFrame, linked: bool = False) -> DataFrame:
    """``(doc_id, json)``: a structured-extraction answer per document in the
    prompt's schema (ocr_text, summary, sections -> fields, with ``linked``
    the first field's linked information), built by string concatenation; every 11th answer is cut short (corrupt)."""
    lab = labels.select("doc_id", F.col("quality").cast("string").alias("quality"))
    d = documents.join(lab, "doc_id", "left")
    def field(name, value, more=F.lit("")):
        return F.concat(F.lit('{"field_name": "' + name + '", "value": "'), json_escape(value), F.lit('"'), more, F.lit("}"))
    more = F.concat(F.lit(', "linked_information": '), linked_information()) if linked else F.lit("")
    js = F.concat(
        F.lit('{"ocr_text": "'), json_escape(F.col("text")),
        F.lit('", "summary": "'), json_escape(F.concat_ws(" ", F.col("lang"), F.lit("letter from"), F.col("source"))),
        F.lit('", "sections": [{"section_name": "metadata", "fields": ['),
        field("language", F.col("lang"), more), F.lit(", "), field("source", F.col("source")), F.lit(", "),
        field("quality", F.coalesce(F.col("quality"), F.lit("unknown"))),
        F.lit(']}, {"section_name": "content", "fields": ['),
        field("chars", F.col("n_chars").cast("string")),
        F.lit("]}]}"))
    full = d.select("doc_id", js.alias("_js"))
    return full.select("doc_id", F.when(F.col("doc_id") % CORRUPT_EVERY == 0,
                                        F.expr("substring(_js, 1, length(_js) div 2)"))
                       .otherwise(F.col("_js")).alias("json"))
