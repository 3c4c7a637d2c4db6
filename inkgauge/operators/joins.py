"""Joins of the evaluation workflow (JOIN1-JOIN7).

Every join here relates two tables that both grow with the data (rows vs
sidecar outputs vs image listings), so none is broadcast on a file-size
estimate: they are shuffle joins on the key, which AQE may still turn into
a broadcast once a side's *measured* size is under its threshold, and whose
skewed keys AQE splits.  The prompt (JOIN7) is a scalar subquery, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_markup

SIDECAR_SUFFIX = ".jpg.model"


def attach_sidecar(rows: DataFrame, sidecars: DataFrame, column: str, key: str = "id",
                   suffix: str = SIDECAR_SUFFIX, clean: bool = True) -> DataFrame:
    """JOIN2: left lookup of each row's sidecar text by file name; absent ->
    '' with ``status = 'missing'`` (else ``'attached'``)."""
    text = clean_markup(F.col("text")) if clean else F.col("text")
    sc = sidecars.select(F.col("file_name").alias("_file"), text.alias("_text"))
    j = rows.join(sc, F.concat(F.col(key), F.lit(suffix)) == F.col("_file"), "left")
    return j.select(*[F.col(c) for c in rows.columns],
                    F.coalesce(F.col("_text"), F.lit("")).alias(column),
                    F.when(F.col("_file").isNull(), F.lit("missing")).otherwise(F.lit("attached")).alias("status"))


ATTACHED, MISSING, UNREADABLE = "attached", "missing", "unreadable"


def attach_outcomes(rows: DataFrame, sidecars: DataFrame, column: str, key: str = "id", suffix: str = SIDECAR_SUFFIX) -> DataFrame:
    """JOIN2 with errors as values: ``sidecars`` has ``file_name, text, error``
    (SRC5).  Adds the text (what could not be read says so in its place, an
    absent file leaves it empty), ``status`` and ``message``."""
    sc = sidecars.select(F.col("file_name").alias("_file"), F.col("text").alias("_text"), F.col("error").alias("_error"))
    name = F.concat(F.col(key), F.lit(suffix))
    j = rows.join(sc, name == F.col("_file"), "left")
    status = F.when(F.col("_file").isNull(), MISSING).when(F.col("_error").isNotNull(), UNREADABLE).otherwise(ATTACHED)
    message = (F.when(status == MISSING, F.concat(F.lit("File "), name, F.lit(" does not exist. Leaving the cell empty.")))
               .when(status == UNREADABLE, F.concat(F.lit("Error reading "), name, F.lit(": "), F.col("_error"))))
    text = (F.when(status == UNREADABLE, F.concat(F.lit("Error reading file: "), F.col("_error")))
            .otherwise(F.coalesce(F.col("_text"), F.lit(""))))
    return j.select(*[F.col(c) for c in rows.columns], text.alias(column), status.alias("status"), message.alias("message"))


def _image_name(key: Column, ext: str) -> Column:
    return F.concat(F.trim(key), F.lit(ext))


def with_images(rows: DataFrame, images: DataFrame, key: str = "id", ext: str = ".jpg") -> DataFrame:
    """JOIN3: keep rows whose image file exists (left semi)."""
    im = images.select(F.col("file_name").alias("_file"))
    return rows.join(im, _image_name(F.col(key), ext) == F.col("_file"), "left_semi")


def missing_images(rows: DataFrame, images: DataFrame, key: str = "id", ext: str = ".jpg") -> DataFrame:
    """JOIN4: the reject list - rows whose image file is absent (left anti)."""
    im = images.select(F.col("file_name").alias("_file"))
    return (rows.join(im, _image_name(F.col(key), ext) == F.col("_file"), "left_anti")
            .select(F.col(key), _image_name(F.col(key), ext).alias("image_file")))


def pending(images: DataFrame, outputs: DataFrame, suffix: str = ".model") -> DataFrame:
    """JOIN5 / JOIN6: images without an output file yet (resume / claim
    exclusion across runs)."""
    out = outputs.select(F.col("file_name").alias("_out"))
    return (images.join(out, F.concat(F.col("file_name"), F.lit(suffix)) == F.col("_out"), "left_anti")
            .select(F.col("file_name").alias("image_file")))


def with_prompt(rows: DataFrame, prompt: DataFrame, column: str = "prompt") -> DataFrame:
    """JOIN7: attach the single prompt to every row as a scalar subquery
    (evaluated once, no join; more than one prompt row is an error)."""
    return rows.withColumn(column, prompt.select(F.col(prompt.columns[0])).scalar())


def assemble_sidecars(rows: DataFrame, sidecars: DataFrame, engines: dict, key: str = "id",
                      clean: dict | None = None) -> DataFrame:
    """DSP9: attach every engine's sidecar text as its own column.

    ``sidecars`` holds ``(file_name, text)`` for all engines; ``engines`` maps
    a file-name suffix (e.g. ``.jpg.model``) to the output column.  Instead
    of one join per engine, the sidecars are tagged with their column, pivoted
    to one row per key over the known columns (one shuffle), then joined to
    the rows once (left: absent outputs are '').  ``clean`` optionally maps a
    column to a Column -> Column cleaner applied before the pivot.
    """
    clean = clean or {}
    tag = None
    for suffix, col in engines.items():
        cond = F.col("file_name").endswith(suffix)
        tag = F.when(cond, F.lit(col)) if tag is None else tag.when(cond, F.lit(col))
    tagged = sidecars.select("file_name", "text", tag.alias("_engine")).where(F.col("_engine").isNotNull())
    stripped = F.col("file_name")
    for suffix in engines:
        stripped = F.when(F.col("file_name").endswith(suffix),
                          F.expr(f"substring(file_name, 1, length(file_name) - {len(suffix)})")).otherwise(stripped)
    text = F.col("text")
    for col, fn in clean.items():
        text = F.when(F.col("_engine") == col, fn(F.col("text"))).otherwise(text)
    keyed = tagged.select(stripped.alias("_key"), "_engine", text.alias("text"))
    wide = keyed.groupBy("_key").pivot("_engine", list(engines.values())).agg(F.first("text"))
    j = rows.join(wide, rows[key] == wide["_key"], "left").drop("_key")
    return j.fillna("", subset=list(engines.values()))
