"""Exact quantiles and exact global ranks over counted values.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a ``row_number`` window puts a whole group in one
task.  With a handful of (method, metric) groups over billions of rows
either would pin a group - possibly a third of the data - to one executor.

Here a value and its repeats are one row ``(group, value, count)``: the count
is summed on the map side, so a value that most rows hold costs one row per
task.  The counted values are range-partitioned on ``(group, value)`` and
written once with their partition number; the counts before a value are a
running sum inside its (partition, group) block plus the sums of the blocks
before it.  A value covers the ranks from there up to its count, so quantiles
pick the few values that cover the needed ranks, and splits need no more than
the value at the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def counted_values(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``(keys..., _v, _c)``: the distinct non-null, non-NaN values of each
    group with the number of rows that hold them."""
    v = F.col(value).cast("double").alias("_v")
    return df.select(*keys, v).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))


def _null_safe(left: DataFrame, right: DataFrame, names: list[str], prefix: str) -> Column:
    test = F.lit(True)
    for k in names:
        test = test & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return test


def cumulated(counted: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``_below`` (rows of the group before this value) and ``_n`` (rows of
    the group) to counted values, one row each with its count ``_c``.

    The range-partitioned table is written once: range bounds are sampled per
    execution, so two executions need not cut the values alike."""
    n = partitions or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counted.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    placed = written(placed, "counted_values")
    inside = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("_upto", F.sum("_c").over(inside))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    blocks = placed.groupBy("_pid", *keys).agg(F.sum("_c").alias("_sum"))
    # a group has at most one block per range partition
    blocks = blocks.select(F.col("_pid").alias("_b_pid"), *[F.col(k).alias(f"_b_{k}") for k in keys],
                           (F.sum("_sum").over(group.orderBy("_pid")) - F.col("_sum")).alias("_offset"),
                           F.sum("_sum").over(group).alias("_n"))
    same = (running["_pid"] == blocks["_b_pid"]) & _null_safe(running, blocks, keys, "_b_")
    joined = running.join(blocks, same).drop("_b_pid", *[f"_b_{k}" for k in keys])
    return joined.withColumn("_below", F.col("_offset") + F.col("_upto") - F.col("_c")).drop("_pid", "_upto", "_offset")


def covers(rank: Column) -> Column:
    """Is ``rank`` (0-based) one of this value's?"""
    return (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_c"))


def quantiles_of_counted(counted: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """:func:`exact_quantiles` of :func:`counted_values`."""
    ranked = cumulated(counted, keys, ["_v"])
    ends = {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        ends[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))
    needed = F.lit(False)
    for lo, hi, _ in ends.values():
        needed = needed | covers(lo) | covers(hi)
    aggs = []
    for name, (lo, hi, frac) in ends.items():
        lo_v, hi_v = (F.max(F.when(covers(r), F.col("_v"))) for r in (lo, hi))
        aggs.append((lo_v + (hi_v - lo_v) * F.first(frac)).alias(name))
    return ranked.where(needed).groupBy(*keys).agg(*aggs)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Per group, linear-interpolated quantiles (pandas / ``quantile_cont``
    definition) of the non-null, non-NaN ``value``; one row per group with
    one column per entry of ``probs`` (name -> probability)."""
    return quantiles_of_counted(counted_values(df, keys, value), keys, probs)


def counted_order(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Distinct ``(keys, order)`` tuples of ``df`` with ``_c``, ``_below`` and ``_n``."""
    return cumulated(df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_c")), keys, order, partitions)


def rank_within_groups(df: DataFrame, keys: list[str], order: list[str],
                       partitions: int | None = None) -> DataFrame:
    """Add ``_rank`` (0-based, exact, ties broken by a row hash) and ``_n``
    (group size) ordered by ``order`` within each ``keys`` group.

    Only keys, order values and an 8-byte row hash are ranked; the rows
    themselves meet their rank in one join.  Rows that agree in all of these
    are numbered among themselves."""
    tagged = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    names = list(dict.fromkeys([*keys, *order, "_tie"]))
    ranked = counted_order(tagged.select(*names), list(keys), [c for c in names if c not in keys], partitions)
    ranked = ranked.withColumnsRenamed({c: f"_r_{c}" for c in names})
    own = Window.partitionBy(*names).orderBy(F.lit(0))
    joined = tagged.join(ranked, _null_safe(tagged, ranked, names, "_r_")).drop(*[f"_r_{c}" for c in names])
    nth = F.when(F.col("_c") > 1, F.row_number().over(own) - 1).otherwise(0)
    return joined.withColumn("_rank", F.col("_below") + nth).drop("_tie", "_c", "_below")
