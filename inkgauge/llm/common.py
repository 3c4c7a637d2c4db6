"""Helpers shared by the training-data operators.

Text work inside tasks runs on bounded slices of Arrow batches, so a task
holds a few megabytes of words at a time whatever the batch size is; a
single long document is the only thing that can make a slice larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Java / RE2 class of the word separators: space, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
SLICE_BYTES = 4 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    cuts the lineage, survives lost executors, and every later reader prunes
    columns instead of recomputing the text work."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(id_col: str, text_col: str):
    """A long that tells rows with a null id apart (null ids belong to no
    document, so each text stands alone); 0 for every real id."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.lit(0).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``limit`` bytes of
    ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        block = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a slice as UTF-8 bytes; null reads as empty.  ``bytes``
    methods split, strip and lower by ASCII rules only, which is what the
    operators' word and line definitions ask for."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts of a string column in a row (by ASCII white
    space; null has none), and where each text's words begin and end."""
    split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    words, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    return words.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[ends - ends[0]]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; equal ones are hashed once."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]


class WordIndex(dict):
    """word -> small integer, with one computed value per distinct word.

    The table is emptied between slices once it holds ``limit`` words, so its
    memory is bounded whatever the vocabulary of the corpus is."""

    def __init__(self, values, dtype, limit: int = 250_000):
        super().__init__()
        self.values_of, self.dtype, self.limit = values, dtype, limit
        self.fresh: list[bytes] = []
        self.table = np.empty(0, dtype)

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The value of every word, as an array."""
        if len(self) > self.limit:
            self.clear()
            self.table = np.empty(0, self.dtype)
        index = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            new = np.fromiter(self.values_of(self.fresh), self.dtype, len(self.fresh))
            self.table = np.concatenate([self.table, new])
            self.fresh = []
        return self.table[index]


def hashed_words(limit: int = 250_000) -> WordIndex:
    """A :class:`WordIndex` of 64-bit word hashes."""
    return WordIndex(lambda words: map(xxhash.xxh3_64_intdigest, words), np.uint64, limit)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (by its first word)."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:count + i]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)


def prepare(spark) -> None:
    """Ship the package and bound Arrow batches by bytes (texts differ in
    length by five orders of magnitude)."""
    from ..session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def let(value, body):
    """``body(value)`` with ``value`` evaluated once per row: a lambda that
    names an outer expression would compute it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text):
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")
