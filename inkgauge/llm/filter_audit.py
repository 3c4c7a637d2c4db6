"""Interaction of filters over all their orders, by difference arrays.

1. One pass over the texts gives every document a mask of the filters it fails
   by itself and the digest of its text; the duplicate filter follows from the
   smallest id per digest.  Counts per (part, mask) are all that is left: at
   most ``2 ** 5`` rows a part, summed before they are shuffled.
2. The orders that begin with the same letters are one interval of
   lexicographic (Lehmer) ranks.  A mask is removed at step ``s`` exactly in
   the orders that begin with ``s - 1`` filters it passes and one it fails, so
   each mask covers a few intervals per step.  Its count is added where an
   interval begins and taken off where it ends; the prefix sum over the ranks
   is the number removed at that step in every order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage, texts

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 3, b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters A to D of each text as bits 0 to 3, and the text's digest."""
    for batch in slices(batches):
        raw = texts(batch)
        points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        own, digest = np.zeros(len(raw), np.int32), []
        for i, text in enumerate(raw):
            words = text.split()
            n, symbols = len(words), text.translate(None, SYMBOLS)
            upper = len(text) - len(text.translate(None, UPPER))
            own[i] = ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PCT * n) << 1
                      | (100 * upper > MAX_UPPER_PCT * int(points[i])) << 2 | (len(symbols) < len(text)) << 3)
            digest.append(hashlib.sha256(text).digest())
        yield pa.record_batch([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(own),
                               pa.array(digest, pa.binary())],
                              names=[*[c for c in batch.schema.names if c != "text"], "own", "digest"])


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents per set of failed filters."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("text"))
    facts = stage(rows.mapInArrow(_facts, "doc bigint, part string, own int, digest binary"), "filter_facts")
    # copies only: the smallest id of a text that more than one id has
    first = stage(facts.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                  .where(F.col("first") < F.col("last")).select(F.col("digest").alias("copied"), "first"), "filter_first")
    known = stage(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("labelled"))
                  .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "filter_labels")
    late = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    # both sides grow with the corpus, and written tables look smaller than they are: never broadcast
    masked = (facts.join(first.hint("merge"), facts["digest"] == first["copied"], "left")
              .join(known.hint("merge"), F.col("doc") == F.col("labelled"), "left"))
    mask = (F.col("own") + F.when(late, 16).otherwise(0)).alias("mask")
    return masked.groupBy("part", mask).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic"))


def intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): where in the
    lexicographic order of all permutations a document that fails exactly
    ``mask`` is removed at ``step``."""
    k, out = len(filters), []

    def descend(prefix: tuple[int, ...], start: int) -> None:
        """``prefix``: filters applied so far; ``start``: rank of the first order that begins with them."""
        size = math.factorial(k - len(prefix) - 1)
        for digit, letter in enumerate(x for x in range(k) if x not in prefix):
            first = start + digit * size
            free = [x for x in range(k) if x not in prefix and x != letter]
            for rest in range(1 << len(free)):
                mask = 1 << letter | sum(1 << x for i, x in enumerate(free) if rest >> i & 1)
                out.append((mask, len(prefix) + 1, first, first + size))
            if free:
                descend((*prefix, letter), first)

    descend((), 0)
    return merged(out)


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Neighbouring intervals of one mask and step as one."""
    out: list[tuple[int, int, int, int]] = []
    for mask, step, a, b in sorted(found):
        if out and out[-1][:2] == (mask, step) and out[-1][3] == a:
            out[-1] = (mask, step, out[-1][2], b)
        else:
            out.append((mask, step, a, b))
    return out


def order_at(rank: int, filters: str = FILTERS) -> str:
    """The permutation of a lexicographic rank, by its Lehmer digits."""
    left, out = list(filters), ""
    for k in range(len(filters), 0, -1):
        digit, rank = divmod(rank, math.factorial(k - 1))
        out += left.pop(digit)
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, order and step from ``part, mask, n, good, toxic``."""
    spark, k = counts.sparkSession, len(filters)
    ranks = math.factorial(k)
    measures = ("n", "good", "toxic")
    # both tables follow from the number of filters alone
    ends = spark.createDataFrame([(m, s, r, sign) for m, s, a, b in intervals(filters) for r, sign in ((a, 1), (b, -1)) if r < ranks],
                                 "mask int, step int, rank int, sign int")
    orders = spark.createDataFrame([(r, order_at(r, filters)) for r in range(ranks)], "rank int, filter_order string")
    changes = (counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank")
               .agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in measures]))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fail_{x}") for i, x in enumerate(filters)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{x}") for i, x in enumerate(filters)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), *fails, *alone)
    grid = (totals.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)))))
    by_rank = Window.partitionBy("part", "step").orderBy("rank")
    dense = grid.join(changes, ["part", "step", "rank"], "left").join(F.broadcast(orders), "rank")
    at = dense.select("part", "filter_order", "step", "total", *[f"{p}_{x}" for x in filters for p in ("fail", "only")],
                      F.substring(F.col("filter_order"), F.col("step"), F.lit(1)).alias("letter"),
                      *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(by_rank).alias(f"lost_{c}") for c in measures])
    own = lambda p: F.coalesce(*[F.when(F.col("letter") == x, F.col(f"{p}_{x}")) for x in filters])
    so_far = F.sum("lost_n").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    whole = F.sum("lost_n").over(Window.partitionBy("part", "letter"))
    long = lambda c, name: c.cast("long").alias(name)
    return at.select("part", "filter_order", "step", long(F.col("total") - so_far, "kept"), long(F.col("lost_n"), "removed"),
                     long(own("fail") - F.col("lost_n"), "redundant"), long(own("only"), "unique_fails"),
                     long(F.col("lost_good"), "good_lost"), long(F.col("lost_toxic"), "toxic_lost"), long(whole, "shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: what is removed, kept and lost.

    A null text is empty; a null part counts with the empty one.  A null id is
    no smaller than any other, so it fails E for nobody and has no label.
    Repeated rows are documents of their own: equal ids are not smaller than
    each other.  Several labels of an id: good or toxic if one of them says so;
    null labels say nothing.  Texts are read whole; extra columns are ignored
    whatever their names; an empty table gives no rows."""
    return audit(stage(mask_counts(docs, labels, id_col, text_col, part_col), "mask_counts"))
