"""Records of quoted delimited files, found in parallel.

A quoted field may hold line breaks, so a line says nothing about records until
the quotes before it are counted.  Files are read as lines by Spark's own
splittable text reader; the counting is done per file block and put together:

1. Inside a block, every line gets the parity of the quotes before it and its
   record number for either state that the block may begin in.
2. A block's parity and its record counts are one row; running over the blocks
   of a file they give each block's true state and the block in which its first
   lines' record began.
3. The task that reads a block puts the lines of its records together; only the
   pieces of records that lie in several blocks are gathered, by file, block and
   number of the record.

The files are read twice, for the blocks' states and for the records, both before
:func:`records` returns, so with the same blocks.  The records are written once and
only the pieces are shuffled.  A compressed file is one block.

A block is what one task reads (``spark.sql.files.maxPartitionBytes``), so one
large file gives as many tasks as it has blocks.  A field with an unclosed quote
takes in the rest of its file, as it does for any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

QUOTE = '"'


def _number_lines(batches):
    """Running counts of each block's lines, which one task reads in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    key, parity, begun = None, 0, [0, 0]
    for batch in batches:
        quotes = pc.count_substring(batch.column("value"), QUOTE).to_numpy(zero_copy_only=False).astype(np.int32)
        files, blocks = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
        new = np.ones(len(quotes), bool)
        if len(quotes):
            same = pc.equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
            new[1:] = (blocks[1:] != blocks[:-1]) | ~same
        odd, rec = np.zeros(len(quotes), np.int32), [np.zeros(len(quotes), np.int64) for _ in (0, 1)]
        starts = np.flatnonzero(new).tolist()
        for at, end in zip(starts, [*starts[1:], len(quotes)]):
            here = (files[at].as_py(), int(blocks[at]))
            if here != key:
                key, parity, begun = here, 0, [0, 0]
            own = quotes[at:end]
            after = (parity + np.cumsum(own)) % 2
            odd[at:end] = np.concatenate([[parity], after[:-1]])
            for s in (0, 1):
                rec[s][at:end] = begun[s] + np.cumsum(odd[at:end] == s)
                begun[s] = int(rec[s][end - 1])
            parity = int(after[-1])
        added = {"quotes": quotes, "odd": odd, "rec_0": rec[0], "rec_1": rec[1]}
        yield pa.record_batch([*batch.columns, *map(pa.array, added.values())], names=[*batch.schema.names, *added])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with, per block: ``odd`` (parity of the quotes before the line),
    ``rec_0`` / ``rec_1`` (records begun so far if the block begins outside /
    inside quotes).  A block's lines are read in order by one task, which counts
    as it reads: nothing is shuffled or sorted."""
    return _lines(spark, path).mapInArrow(_number_lines, "file string, block bigint, pos bigint, value string, quotes int, odd int, rec_0 bigint, rec_1 bigint")


def _block_counts(batches):
    """Quotes and records of each block, a row for every batch that holds lines of it."""
    import numpy as np
    import pyarrow as pa

    for batch in _number_lines(batches):
        files, blocks = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
        starts = _run_starts(files, blocks)
        ends = [*starts[1:], batch.num_rows]
        quotes, rec_0, rec_1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("quotes", "rec_0", "rec_1"))
        own = {"quotes": np.array([quotes[a:b].sum(dtype=np.int64) for a, b in zip(starts, ends)], np.int64),
               **{n: np.array([r[b - 1] for b in ends], np.int64) for n, r in (("n_0", rec_0), ("n_1", rec_1)) if batch.num_rows}}
        if batch.num_rows:
            yield pa.record_batch([files.take(pa.array(starts)), pa.array(blocks[starts]), *map(pa.array, own.values())], names=["file", "block", *own])


def _run_starts(files, *numbers) -> list[int]:
    """Where the file or one of the numbers differs from the row before."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.ones(len(files), bool)
    if len(files):
        new[1:] = ~pc.equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
        for x in numbers:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def _join_lines(batches):
    """Lines that follow each other in one record as one text; ``whole`` where
    they are all of the record.  What begins before or ends after the lines that
    this task reads stays a piece."""
    import pyarrow as pa

    types = {"file": pa.string(), "block": pa.int64(), "rec": pa.int64(), "pos": pa.int64(), "whole": pa.bool_(), "value": pa.string()}
    held, out = None, []  # held: file, block, rec, position, whole beginning, texts, next position, closed

    def done():
        out.append((*held[:4], held[4] and held[7], "\n".join(held[5])))

    def ready():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=[*types])

    for batch in batches:
        files = batch.column("file")
        block, rec, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "rec", "pos"))
        begins, closed = (batch.column(c).to_pylist() for c in ("begins", "closed"))
        texts = batch.column("value").to_pylist()
        starts = _run_starts(files, block, rec)
        for at, end in zip(starts, [*starts[1:], len(texts)]):
            key = (files[at].as_py(), int(block[at]), int(rec[at]))
            first = int(pos[at])
            if held and held[:3] == key and held[6] == first:
                held = (*held[:5], held[5] + texts[at:end], int(pos[end - 1]) + 1, closed[end - 1])
            else:
                if held:
                    done()
                held = (*key, first, begins[at], texts[at:end], int(pos[end - 1]) + 1, closed[end - 1])
        if out:
            yield ready()
            out.clear()
    if held:
        done()
        yield ready()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, rec, record``: one row per record, the place it begins
    at, and its text with line breaks.  The first record of a file is at
    block 0, rec 1."""
    counts = _lines(spark, path).mapInArrow(_block_counts, "file string, block bigint, quotes bigint, n_0 bigint, n_1 bigint")
    blocks = written(counts, "csv_blocks").groupBy("file", "block").agg((F.sum("quotes") % 2).alias("parity"), F.max("n_0").alias("n_0"), F.max("n_1").alias("n_1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = blocks.withColumn("state", (F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2).cast("int"))
    n = F.when(F.col("state") == 0, F.col("n_0")).otherwise(F.col("n_1"))
    # the record that a block's first lines go on with: the last one begun before
    state = state.withColumn("begun", F.when(n > 0, F.struct("block", n.alias("rec"))))
    state = state.withColumn("open", F.last("begun", ignorenulls=True).over(earlier))
    state = state.select(F.col("file").alias("s_file"), F.col("block").alias("s_block"), "state", "open")
    # one row a block of ``spark.sql.files.maxPartitionBytes``, so the lines stay where they are
    lines = _numbered_lines(spark, path)
    met = lines.join(F.broadcast(state), (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block")))
    rec = F.when(F.col("state") == 0, F.col("rec_0")).otherwise(F.col("rec_1"))
    met = met.select("file", "pos", "value", (F.col("odd") == F.col("state")).alias("begins"),
                     ((F.col("odd") + F.col("quotes")) % 2 == F.col("state")).alias("closed"),
                     F.when(rec > 0, F.col("block")).otherwise(F.col("open.block")).alias("block"),
                     F.when(rec > 0, rec).otherwise(F.col("open.rec")).alias("rec"))
    joined = written(met.mapInArrow(_join_lines, "file string, block bigint, rec bigint, pos bigint, whole boolean, value string"), "csv_records")
    single = joined.where("whole").select("file", "block", "rec", F.col("value").alias("record"))
    parts = joined.where(~F.col("whole")).groupBy("file", "block", "rec").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l"))
    several = parts.select("file", "block", "rec", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(several)


def field_count(record: Column, sep: str) -> Column:
    """Fields of a record: separators outside quotes, and one."""
    outside = F.regexp_replace(record, f"{QUOTE}[^{QUOTE}]*+(?:{QUOTE}|$)", "")
    return (F.length(outside) - F.length(F.replace(outside, F.lit(sep), F.lit("")))) / len(sep) + 1


def data_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Records without each file's header and without blank lines; a carriage
    return before the line break belongs to the break."""
    found = records(spark, path)
    if header:
        found = found.where(~((F.col("block") == 0) & (F.col("rec") == 1)))
    return found.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("record") != "")


def parsed(found: DataFrame, columns: list[str], sep: str) -> DataFrame:
    """The fields of each record as string columns (missing ones null)."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    ddl = ", ".join(f"{f.name} string" for f in schema)
    row = F.from_csv("record", F.lit(ddl), {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "emptyValue": "",
                                            "nullValue": "", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
                                            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return found.select(row.alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])


def tolerant(spark: SparkSession, path: str, columns: list[str], sep: str, header: bool = True) -> tuple[DataFrame, Observation]:
    """SRC3: pandas' rule for bad lines.  Records with more fields than the
    header are skipped, those with fewer padded with nulls.  The observation
    counts ``records``, ``skipped`` and ``padded`` in the pass that reads the
    rows (filled once an action has run)."""
    counted = data_records(spark, path, header).withColumn("fields", field_count(F.col("record"), sep))
    width, seen = F.lit(len(columns)), Observation()
    counted = counted.observe(seen, F.count(F.lit(1)).alias("records"), F.count_if(F.col("fields") > width).alias("skipped"),
                              F.count_if(F.col("fields") < width).alias("padded"))
    return parsed(counted.where(F.col("fields") <= width), columns, sep), seen
