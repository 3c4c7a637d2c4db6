"""Incremental runs with Structured Streaming (STR1 / STR2).

The evaluated workflow re-ran transcription over a growing folder, skipping
items whose output file existed and holding lock files so concurrent jobs
would not collide.  Here a file-source stream with a checkpoint gives the
same guarantee declaratively: each input file is processed exactly once
across restarts, ``trigger(availableNow=True)`` drains what is there and
stops, and the checkpoint (on shared storage) replaces the lock files.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics as M
from ..functions.text import clean_markup, java_quote, normalize_text
from ..session import materialize


def run_available(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
                  output: str, checkpoint: str, fmt: str = "json", max_files_per_trigger: int | None = None) -> dict:
    """Process every not-yet-seen file under ``source`` once, append the
    results to the Parquet table at ``output``; returns the last progress."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = transform(reader.load(source))
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress or {}


SIDECAR_SCHEMA = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("text", T.StringType())])


def clean_transform():
    """STR1: raw model outputs -> cleaned texts (stateless, so append mode)."""
    def t(sidecars: DataFrame) -> DataFrame:
        return sidecars.select("file_name", clean_markup(F.col("text")).alias("cleaned"))
    return t


TRUTH_COLUMNS = T.StructType([T.StructField("id", T.StringType()), T.StructField("ref", T.StringType())])
HYP_COLUMNS = T.StructType([T.StructField("id", T.StringType()), T.StructField("hyp", T.StringType())])
SCORED_COLUMNS = T.StructType([T.StructField("id", T.StringType()), T.StructField("precision", T.DoubleType()),
                               T.StructField("recall", T.DoubleType())])
#: Versions that one stream batch may be followed by (retries without new sidecars).
RETRIES = 1_000_000


class IncrementalScoring:
    """STR2: sidecars and truth arrive in any order; every sidecar is scored
    once, as soon as its truth is there.

    ``state`` is a folder on shared storage.  New truth is normalised once, by
    a stream of its own, and appended to ``truth``.  Each batch of sidecars is
    cleaned, put together with those still ``pending`` and joined with the
    truth: what matches goes to ``scored``, the rest (an anti join) is the next
    version of ``pending``.  A run without new sidecars retries the pending
    ones.  A batch or retry always writes the same version, so that one that is
    run again after a failure replaces what it wrote instead of adding to it.
    A null id never matches and stays pending; truth that repeats an id scores
    its sidecars once for each."""

    def __init__(self, spark: SparkSession, state: str, suffix: str = ".jpg.model", mode: str = "legacy"):
        self.spark, self.state, self.suffix, self.mode = spark, state.rstrip("/"), suffix, mode

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        """A state table, empty while nothing has been written."""
        versioned = schema if name == "truth" else T.StructType([*schema.fields, T.StructField("version", T.LongType())])
        try:
            return self.spark.read.schema(versioned).parquet(f"{self.state}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], versioned)

    def _latest(self, before: int) -> int:
        found = self._table("pending", HYP_COLUMNS).where(F.col("version") < before).agg(F.max("version")).first()[0]
        # an empty version has no rows to tell of it: its marker is a row without id and text
        return -1 if found is None else found

    def pending(self, before: int = 2 ** 62) -> DataFrame:
        """Sidecars without truth so far."""
        rows = self._table("pending", HYP_COLUMNS).where(F.col("version") == self._latest(before))
        return rows.where("hyp is not null").select("id", "hyp")

    def scored(self) -> DataFrame:
        return self._table("scored", SCORED_COLUMNS).drop("version")

    def _settle(self, new: DataFrame, version: int) -> None:
        todo = materialize(self.pending(version).unionByName(new))
        truth = self._table("truth", TRUTH_COLUMNS)
        j = todo.join(truth, "id")
        rs, hs = F.array_distinct(M.words(F.col("ref"))), F.array_distinct(M.words(F.col("hyp")))
        j.select("id", M.precision(rs, hs).alias("precision"), M.recall(rs, hs).alias("recall")).write.mode("overwrite").parquet(
            f"{self.state}/scored/version={version}")
        marker = self.spark.range(1).select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("hyp"))
        todo.join(truth.select("id"), "id", "left_anti").unionByName(marker).write.mode("overwrite").parquet(
            f"{self.state}/pending/version={version}")

    def run(self, sidecars: str, truth: str, truth_schema: T.StructType, fmt: str = "json", key: str = "id",
            text: str = "transcription") -> dict:
        """Take in what has come to both folders; returns the counts of scored
        and pending sidecars so far."""
        read = self.spark.readStream.format(fmt)
        known = read.schema(truth_schema).load(truth).select(
            F.col(key).cast("string").alias("id"), normalize_text(F.col(text), mode=self.mode).alias("ref"))
        (known.writeStream.format("parquet").option("checkpointLocation", f"{self.state}/checkpoints/truth")
         .option("path", f"{self.state}/truth").outputMode("append").trigger(availableNow=True).start().awaitTermination())
        arrived = self.spark.readStream.format(fmt).schema(SIDECAR_SCHEMA).load(sidecars).select(
            F.regexp_replace("file_name", java_quote(self.suffix) + "$", "").alias("id"),
            normalize_text(clean_markup(F.col("text")), mode=self.mode).alias("hyp"))
        batches = []

        def settle(batch: DataFrame, batch_id: int) -> None:
            batches.append(batch_id)
            self._settle(batch, batch_id * RETRIES)

        (arrived.writeStream.foreachBatch(settle).option("checkpointLocation", f"{self.state}/checkpoints/sidecars")
         .trigger(availableNow=True).start().awaitTermination())
        if not batches:
            last = self._latest(2 ** 62)
            if last >= 0:
                self._settle(self.spark.createDataFrame([], HYP_COLUMNS), last + 1)
        return {"scored": self.scored().count(), "pending": self.pending().count()}
