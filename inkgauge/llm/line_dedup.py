"""Line deduplication: explode normalised lines, hash, count distinct
documents per hash, drop lines over the threshold, reassemble by position.

Key hashes are 128 bits wide.  Counting is pre-aggregated before each
shuffle and the join back to the lines is an ordinary shuffle join that AQE
can split, so a line that a third of all documents hold is no hot task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, slices, stage, texts

BLANKS = b" \t\n\x0b\x0c\r"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, ASCII-lowered line; None when short."""
    line = line.strip(BLANKS)
    if len(line) < min_chars or (not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for doc, null_key, text in zip(batch["id"].to_pylist(), batch["null_key"].to_pylist(), texts(batch)):
            found = {k for line in set(text.split(b"\n")) if (k := _key(line, min_chars))}
            out += [(doc, null_key, k) for k in found]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                               pa.array(cols[2], pa.binary())], names=["id", "null_key", "line_key"])


def _reassemble(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total, dropped, kept = [], [], []
        for text, drop in zip(texts(batch), batch["drop"].to_pylist()):
            lines = text.split(b"\n")
            if drop:
                gone = set(drop)
                stay = [x for x in lines if _key(x, min_chars) not in gone]
            else:
                stay = lines
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        yield pa.record_batch(
            [batch["id"], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string()),
             pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())] + [batch[c] for c in batch.schema.names[4:]],
            names=["id", "n_lines", "n_dropped", "kept_text", "kept_sha256", *batch.schema.names[4:]])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_dropped``, ``kept_text``,
    ``kept_sha256`` and the columns named in ``carry``.

    A line's key (stripped, A-Z lowered) of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold loses all its lines but
    those of the largest id.  Null or empty text is one empty line.  A null id counts as no document, but its
    lines go like any other's; repeated rows of one id count once and are
    each returned: where theirs is the largest id, all of them keep the line.
    Texts are split whole, whatever their length; columns that are not carried
    are ignored whatever their names; an empty table gives no rows."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), doc_key(id_col, text_col).alias("null_key"),
                       F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    lines = stage(base.select("id", "null_key", "text").mapInArrow(
        functools.partial(_keys, min_chars=min_chars), "id bigint, null_key bigint, line_key binary"), "line_keys")
    # written, so that the join below exchanges both sides itself and AQE may split a hot line
    common = stage(lines.groupBy("line_key").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"))
                   .where(F.col("n") >= min_docs).select("line_key", "last"), "common_lines")
    drops = (lines.join(common, "line_key").where(F.col("id").isNull() | (F.col("id") < F.col("last")))
             .groupBy(F.col("id").alias("drop_id"), F.col("null_key").alias("drop_null"))
             .agg(F.collect_set("line_key").alias("drop")))
    rows = base.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("null_key") == F.col("drop_null")), "left")
    rows = rows.select("id", "null_key", "text", "drop", *[f"_{i}" for i in range(len(carry))])
    extra = [f"`_{i}` {rows.schema[f'_{i}'].dataType.simpleString()}" for i in range(len(carry))]
    out = rows.mapInArrow(functools.partial(_reassemble, min_chars=min_chars),
                          ", ".join(["id bigint, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string", *extra]))
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept_text", "kept_sha256",
                      *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])
