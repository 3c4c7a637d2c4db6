"""Limits, samples and exact splits (LIM1-3, SMP1-3).

A limit here is always the operator itself (a preview, a sample of k), and
always over an explicit order so the result is reproducible.  Exact-size
splits use the distributed rank of :mod:`inkgauge.operators.quantiles`
(no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import counted_order, covers, rank_within_groups

DEFAULT_SEED = 42


def head(df: DataFrame, n: int, order: list) -> DataFrame:
    """LIM1 / LIM2: first ``n`` rows in ``order`` (TakeOrderedAndProject:
    per-partition top-n, then one merge of n * partitions rows)."""
    return df.orderBy(*order).limit(n)


def seeded_key(key: str, seed: int = DEFAULT_SEED) -> Column:
    """Deterministic pseudo-random order: md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_k(df: DataFrame, key: str, k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """SMP1: a seeded random sample of at most ``k`` rows (top-k by hash)."""
    return df.withColumn("_h", seeded_key(key, seed)).orderBy("_h", key).limit(k).drop("_h")


def exact_split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = DEFAULT_SEED,
                names=("train", "test")) -> DataFrame:
    """SMP2: seeded shuffle, then the first ``int(n * ratio)`` rows go to the
    first split - exact sizes, unlike ``randomSplit``.

    Only hashes and keys are ranked: the row at the cut (one row to the driver)
    tells every other row its side, so the rows themselves never move.  Copies
    of the key at the cut are divided by their rank among themselves."""
    order = ["_h", key]
    keyed = df.withColumn("_h", seeded_key(key, seed))
    cut = F.floor(F.col("_n") * F.lit(float(ratio)))
    at = counted_order(keyed.select(*order), [], order).where(covers(cut)).withColumn("_keep", cut - F.col("_below")).first()
    if at is None:  # nothing, or all of it goes to the first split
        return df.withColumn("split", F.lit(names[0]))
    own = F.struct(F.col("_h"), F.col(key))
    edge = F.struct(F.lit(at["_h"]).alias("_h"), F.lit(at[key]).cast(df.schema[key].dataType).alias(key))
    first, second = F.lit(names[0]), F.lit(names[1])
    split = F.when(own < edge, first).otherwise(second)
    if not at["_keep"]:
        return keyed.withColumn("split", split).drop("_h")
    same = own.eqNullSafe(edge)
    divided = rank_within_groups(keyed.where(same), [], order).withColumn(
        "split", F.when(F.col("_rank") < at["_keep"], first).otherwise(second)).drop("_rank", "_n")
    return keyed.where(~same).withColumn("split", split).unionByName(divided).drop("_h")


def nested_subsets(df: DataFrame, key: str, sizes: list[int], group: str | None = None,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """SMP3: nested fixed-size subsets (e.g. 100 / 1000 / 10000) per group:
    a row belongs to every size above its seeded rank."""
    keys = [group] if group else []
    ranked = rank_within_groups(df.withColumn("_h", seeded_key(key, seed)), keys, ["_h", key])
    return (ranked.withColumn("subsets", F.filter(F.array(*[F.lit(s) for s in sizes]),
                                                  lambda s: F.col("_rank") < s))
            .drop("_h", "_rank", "_n"))
