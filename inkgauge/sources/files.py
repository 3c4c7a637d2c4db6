"""File sources: delimited tables, whole-text sidecars, prompts, images and
chat datasets (SRC1-SRC12).

Each is a Spark reader with an explicit schema; nothing is read on the
driver except the one-line prompt scalar.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from . import delimited as DL
from . import json_arrays as JA

# --- fixed values that must equal the evaluated system's behaviour ---------
# Strings pandas reads as missing by default (its na_values list).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Image extensions accepted by the transcription loop (any letter case).
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff"]
# ---------------------------------------------------------------------------


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names from the header line (a one-line, one-task read)."""
    first = spark.read.option("header", False).option("sep", sep).option("quote", '"').option("escape", '"') \
        .csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path}: empty file, no header")
    return [c if c is not None else f"_c{i}" for i, c in enumerate(first[0])]


def _cleaned(df: DataFrame, columns: list[str], na_tokens, unescape_backslash: bool) -> DataFrame:
    """Doubled backslashes undone, missing-value tokens to null."""
    out = []
    for c in columns:
        v = F.col(f"`{c}`")
        if unescape_backslash:
            v = F.replace(v, F.lit("\\\\"), F.lit("\\"))
        if na_tokens:
            v = F.when(v.isin(list(na_tokens)), F.lit(None).cast("string")).otherwise(v)
        out.append(v.alias(c))
    return df.select(*out)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None,
                   na_tokens=NA_TOKENS, unescape_backslash: bool = True, multi_line: bool = True) -> DataFrame:
    """SRC1: all-string delimited scan (never inferSchema).

    Quoting follows the writer of the evaluated scripts: fields quoted with
    ``"``, embedded quotes doubled, backslashes escaped by doubling; so the
    reader uses ``escape='"'`` and undoes ``\\\\`` afterwards.  pandas'
    missing-value tokens become null.  Quoted fields may hold line breaks: the
    records are found in parallel (:mod:`.delimited`), however large a file is.
    ``multi_line=False`` is the plain line reader for files whose fields have
    none, ``unescape_backslash=False`` reads plain CSV.  A record with too few
    fields is padded with nulls, one with too many keeps the first.  A missing
    path raises ``AnalysisException``.
    """
    cols = columns or _header(spark, path, sep)
    if multi_line:
        df = DL.parsed(DL.data_records(spark, path), cols, sep)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
              .option("escape", '"').option("emptyValue", "").csv(path))
    return _cleaned(df, cols, na_tokens, unescape_backslash)


def read_tolerant(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None,
                  na_tokens=NA_TOKENS, unescape_backslash: bool = True, header: bool = True) -> tuple[DataFrame, Observation]:
    """SRC3: :func:`read_delimited` that skips records with too many fields, and
    the counts of what it saw (``records``, ``skipped``, ``padded``).  Without a
    ``header`` line in the files, ``columns`` names the fields."""
    cols = columns or _header(spark, path, sep)
    rows, seen = DL.tolerant(spark, path, cols, sep, header)
    return _cleaned(rows, cols, na_tokens, unescape_backslash), seen


def read_typed(spark: SparkSession, path: str, types: dict, sep: str = ",", **kw) -> DataFrame:
    """SRC2: plain delimited scan (splittable) with columns coerced by
    ``try_cast`` (bad -> null)."""
    df = read_delimited(spark, path, sep, **{"unescape_backslash": False, "multi_line": False} | kw)
    if not df.columns:
        raise ValueError(f"{path}: no columns")
    return df.select(*[F.expr(f"try_cast(`{c}` as {types[c]})").alias(c) if c in types else F.col(f"`{c}`")
                       for c in df.columns])


def read_head(spark: SparkSession, path: str, n: int, sep: str = ",", **kw) -> DataFrame:
    """SRC4: the first ``n`` data rows in file order.  Spark splits files
    arbitrarily, so file order is made explicit with the input file and
    the row position inside it before the limit."""
    df = read_delimited(spark, path, sep, **kw)
    pos = df.withColumn("_file", F.input_file_name()).withColumn("_pos", F.monotonically_increasing_id())
    return pos.orderBy("_file", "_pos").limit(n).drop("_file", "_pos")


def _in_few_tasks(files: DataFrame) -> DataFrame:
    """A scan of many small files in no more tasks than a shuffle has.

    Spark counts every file as ``spark.sql.files.openCostInBytes`` (4 MB), so a
    task gets 32 files at most and a million files 30,000 tasks, which take
    longer to start than to read.  Rows are read one by one, however many files
    a task has."""
    spark = files.sparkSession
    return files.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


#: Files that the driver holds the names of at a time (about a kilobyte each).
BATCH_FILES = 128_000


def _count_files(batches, below: bool):
    """The folders in each path, or with ``below`` the files under it; files that
    lie in it are counted under no name.  Hidden names are left out, as Spark does."""
    import pyarrow as pa
    from pyarrow import fs

    from ..sinks.writers import _open

    for batch in batches:
        rows = []
        for root, name in zip(*(batch.column(c).to_pylist() for c in ("root", "name"))):
            system, base = _open(f"{root}/{name}" if name else root)
            found = system.get_file_info(fs.FileSelector(base, recursive=below))
            files = sum(x.type == fs.FileType.File for x in found)
            if below:
                rows.append((root, name, files))
            else:
                rows += [(root, None, files), *((root, x.base_name, 0) for x in found if x.type == fs.FileType.Directory and x.base_name[0] not in "_.")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["root", "name", "files"])


def _folder_batches(spark: SparkSession, root: str) -> list[list[str]]:
    """The folders in ``root`` in groups of about ``BATCH_FILES`` files, counted by
    tasks; ``[[root]]`` where there are no more, where files lie beside folders, and
    for stores that Python workers have no access to."""
    from ..sinks.writers import _open

    whole = [[root]]
    try:
        _open(root)
    except Exception:  # pyarrow's own kinds of errors, by store
        return whole
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if any(ch in root for ch in "*?[]{}\\") or not store.exists(path) or store.getFileStatus(path).isFile():
        return whole
    schema = "root string, name string, files bigint"
    level = spark.createDataFrame([(root.rstrip("/"), None)], "root string, name string").coalesce(1)
    inside = level.mapInArrow(functools.partial(_count_files, below=False), schema).collect()
    names = sorted(r["name"] for r in inside if r["name"])
    if any(r["files"] for r in inside) or len(names) < 2 or any(ch in n for n in names for ch in "*?[]{}\\,"):
        return whole
    each = spark.createDataFrame([(root.rstrip("/"), n) for n in names], "root string, name string")
    each = each.repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism))
    groups, held = [], BATCH_FILES
    for r in sorted(each.mapInArrow(functools.partial(_count_files, below=True), schema).collect()):
        if held + r["files"] > BATCH_FILES:
            groups, held = [*groups, []], 0
        groups[-1].append(f"{r['root']}/{r['name']}")
        held += r["files"]
    return groups if len(groups) > 1 else whole


def _by_batches(spark: SparkSession, root: str, read) -> DataFrame:
    """``read`` of a folder of files.  Spark's file sources keep all names on the
    driver while a frame lives: very many files are read a group of folders at a
    time into one table."""
    groups = _folder_batches(spark, root)
    if len(groups) == 1:
        return read(root)
    path, schema = scratch_dir(spark, "files"), None
    for folders in groups:
        part = read(folders)
        schema = schema or part.schema
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_sidecars(spark: SparkSession, root: str, suffix: str, max_bytes: int = 64 << 20) -> DataFrame:
    """SRC5: ``(file_name, text, error, path)``, one row per file ending with
    ``suffix`` under ``root`` (recursively), whole file as one value.

    A file that cannot be read as text is a row, not a failed job: ``text`` is
    null and ``error`` says why (too large, unreadable, not UTF-8).  The
    listing alone names all files; contents are read with damaged files left
    out, and only up to ``max_bytes`` (the filter reaches the scan).  A file of
    no bytes is no row: Spark's file sources skip it, so a join sees it as
    absent, with the same empty text."""
    return _by_batches(spark, root, lambda paths: _sidecars(spark, paths, suffix, max_bytes))


def _sidecars(spark: SparkSession, root, suffix: str, max_bytes: int) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}"))
    listed = _in_few_tasks(files.load(root).select("path", "length"))
    held = (files.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
            .where(F.col("length") <= max_bytes).select(F.col("path").alias("_path"), "content"))
    j = listed.join(_in_few_tasks(held), F.col("path") == F.col("_path"), "left")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = (F.when(F.col("length") > max_bytes, F.concat(F.lit("too large: "), F.col("length"), F.lit(" bytes")))
             .when(F.col("content").isNull(), F.lit("unreadable")).when(text.isNull(), F.lit("not UTF-8")))
    return j.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.when(error.isNull(), text).alias("text"),
                    error.alias("error"), "path")


def read_prompt(spark: SparkSession, path: str, strip: bool = True, default: str | None = None) -> DataFrame:
    """SRC9 / SRC10: the prompt as a one-row DataFrame ``(prompt)``; with
    ``default`` a missing file yields the default instead of an error."""
    from ..functions.text import strip_py
    try:
        df = spark.read.format("text").option("wholetext", True).load(path)
    except AnalysisException as e:
        if default is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(F.lit(default).alias("prompt"))
    v = strip_py(F.col("value")) if strip else F.col("value")
    return df.select(v.alias("prompt"))


def image_glob(extensions=IMAGE_EXTENSIONS) -> str:
    """Case-insensitive glob: ``*.{[jJ][pP][gG],...}``."""
    parts = ["".join(f"[{ch.lower()}{ch.upper()}]" for ch in ext) for ext in extensions]
    return "*.{" + ",".join(parts) + "}"


def list_images(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """SRC6: image files under ``root`` (any case of the known extensions):
    ``path, file_name, modificationTime, length[, content]``, sorted by name
    (SRT1)."""
    cols = [F.col("path"), F.element_at(F.split(F.col("path"), "/"), -1).alias("file_name"),
            F.col("modificationTime"), F.col("length")]
    if with_content:
        cols.append(F.col("content"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", image_glob()).option("recursiveFileLookup", True)
    return _by_batches(spark, root, lambda paths: _in_few_tasks(files.load(paths).select(*cols))).orderBy("file_name", "path")


#: Channels of the image source (blue first) to red, green, blue, as hexadecimal digits.
_TO_RGB = {1: ("(..)", "$1$1$1"), 3: ("(..)(..)(..)", "$3$2$1"), 4: ("(..)(..)(..)..", "$3$2$1")}


def load_images(spark: SparkSession, root: str, fallback: bool = False) -> DataFrame:
    """SRC7 / SRC8: decoded RGB images (``data``: three bytes a pixel, row by
    row).  Unreadable files are dropped (SRC7) or, with ``fallback``, kept as a
    224 x 224 black image (SRC8)."""
    files = (spark.read.format("image").option("dropInvalid", not fallback)
             .option("pathGlobFilter", image_glob()).option("recursiveFileLookup", True))
    df = _by_batches(spark, root, lambda paths: _in_few_tasks(files.load(paths)))
    img = F.col("image")
    bad = img.height < 0
    black = F.unhex(F.lit("00" * (224 * 224 * 3)))
    data = F.lit(None).cast("binary")
    for n, (pattern, order) in _TO_RGB.items():
        data = F.when(img.nChannels == n, F.unhex(F.regexp_replace(F.hex(img.data), pattern, order))).otherwise(data)
    return df.select(img.origin.alias("path"), F.when(bad, 224).otherwise(img.height).alias("height"),
                     F.when(bad, 224).otherwise(img.width).alias("width"), F.lit(3).alias("channels"),
                     F.when(bad, black).otherwise(data).alias("data"), (~bad).alias("valid"))


def latest_file(listing: DataFrame, group: list[str] | None = None) -> DataFrame:
    """SRT3: newest file (arg-max of modification time) overall or per group."""
    g = listing.groupBy(*(group or []))
    return g.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                 F.max("modificationTime").alias("modificationTime"))


CHAT_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("images", T.ArrayType(T.StringType())),
])


def read_chat_dataset(spark: SparkSession, paths: dict, arrays: bool = False) -> DataFrame:
    """SRC11: named splits of a chat dataset (JSON lines, or with ``arrays``
    files that hold one JSON array each, however large: their elements are
    found in parallel) with an explicit schema, tagged with ``split``."""
    out = None
    for split, path in paths.items():
        if arrays:
            found = JA.array_objects(spark, path)
            df = found.select(F.from_json("element", CHAT_SCHEMA).alias("r")).select("r.*")
        else:
            df = spark.read.schema(CHAT_SCHEMA).json(path)
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def image_name(key: Column, ext: str = ".jpg") -> Column:
    """PRJ7: key -> file name (trimmed key + extension)."""
    return F.concat(F.trim(key), F.lit(ext))
