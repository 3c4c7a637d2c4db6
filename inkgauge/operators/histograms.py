"""Histogram, density, KDE and box-plot tables (the data behind every plot).

All of them aggregate counted values ``(keys..., value, count)``: repeats of a
value are summed on the map side, written once and then read for the group's
parameters (min, max, n, std, quartiles) and for the counts.  The parameters
have one row per group; how they meet the values is left to measured sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .quantiles import _null_safe, counted_values, quantiles_of_counted

# --- fixed values that must equal the evaluated system's behaviour ---------
# Percent histogram: edges 0, 10, ..., 100 with [lo, hi) bins, so exactly
# 100 % (and anything above, e.g. a word error rate over 1) is in no bin.
PERCENT_EDGES = list(range(0, 101, 10))
# Density curves: 200 grid points between the group's min and max, Scott's
# rule bandwidth (sample std * n^(-1/5)), Gaussian kernel.
KDE_GRID = 200
# Box plots: whiskers reach the furthest point within 1.5 IQR of the box.
WHISKER_IQR = 1.5
# ---------------------------------------------------------------------------


def percent_bin_labels() -> list[str]:
    e = PERCENT_EDGES
    return [f"{e[i]}-{e[i + 1]}%" for i in range(len(e) - 1)]


def percent_histogram(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """AGG4: counts of ``value * 100`` in the ten ``[lo, hi)`` bins per group,
    zero bins included, plus ``underflow`` / ``overflow`` rows (bin 0 and 11)
    so that the bins + overflow add up to the non-null count.  A group without
    any value keeps its bins, all zero.

    The bin index is the number of literal edges <= v (not ``width_bucket``,
    which misplaces values one ulp below an edge).
    """
    v = F.col(value).cast("double")
    pct = v * 100
    edges = F.array(*[F.lit(float(e)) for e in PERCENT_EDGES])
    # a missing value is in no bin, but its group keeps its row of zeros
    binned = values.select(*keys, F.when(v.isNotNull() & ~F.isnan(v), F.size(F.filter(edges, lambda e: e <= pct))).alias("bin"))
    labels = ["underflow"] + percent_bin_labels() + ["overflow"]
    # One conditional count per bin: every group gets all bins (zero-filled)
    # from a single partial/final aggregation, no join with a bin table.
    counts = binned.groupBy(*keys).agg(*[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(len(labels))])
    stack = F.array(*[F.struct(F.lit(i).cast("long").alias("bin"), F.lit(lab).alias("label"),
                               F.col(f"b{i}").alias("count")) for i, lab in enumerate(labels)])
    return counts.select(*keys, F.inline(stack))


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy ``linspace(lo, hi, bins + 1)[i]``: ``i * step + lo``, last = hi."""
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i == bins, hi).otherwise(i.cast("double") * step + lo)


def _meet(counted: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Counted values with their group's parameters (a null key is a group)."""
    renamed = params.withColumnsRenamed({k: f"_p_{k}" for k in keys})
    return counted.join(renamed, _null_safe(counted, renamed, keys, "_p_")).drop(*[f"_p_{k}" for k in keys])


def _group_range(counted: DataFrame, keys: list[str]) -> DataFrame:
    r = counted.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.sum("_c").alias("_n"))
    same = F.col("_min") == F.col("_max")
    return r.select(*keys, "_n",
                    F.when(same, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
                    F.when(same, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_hi"))


def equal_width_histogram(values: DataFrame, keys: list[str], bins: int, value: str = "value",
                          density: bool = False) -> DataFrame:
    """AGG5 / AGG6: ``bins`` equal-width bins over each group's min..max,
    numpy semantics (``[e_i, e_i+1)``, last bin closed; min = max widens the
    range by 0.5 each side).  With ``density`` the height is
    ``count / width / n`` as numpy's ``density=True``.
    """
    counted = written(counted_values(values, keys, value), "histogram_values")
    j = _meet(counted, _group_range(counted, keys), keys)
    lo, hi = F.col("_lo"), F.col("_hi")
    guess = F.least(F.greatest(F.floor((F.col("_v") - lo) / ((hi - lo) / F.lit(float(bins)))), F.lit(0)),
                    F.lit(bins - 1)).cast("int")
    idx = (F.when(F.col("_v") < _edge(guess, lo, hi, bins), guess - 1)
           .when((guess < bins - 1) & (F.col("_v") >= _edge(guess + 1, lo, hi, bins)), guess + 1)
           .otherwise(guess))
    binned = j.select(*keys, "_lo", "_hi", "_n", "_c", idx.alias("bin"))
    counts = binned.groupBy(*keys, "_lo", "_hi", "_n").agg(
        *[F.sum(F.when(F.col("bin") == i, F.col("_c")).otherwise(0)).alias(f"b{i}") for i in range(bins)])
    stack = F.array(*[F.struct(F.lit(i).cast("long").alias("bin"), F.col(f"b{i}").alias("count"))
                      for i in range(bins)])
    out = counts.select(*keys, "_lo", "_hi", "_n", F.inline(stack))
    b = F.col("bin")
    out = out.withColumns({"bin_start": _edge(b, lo, hi, bins), "bin_end": _edge(b + 1, lo, hi, bins)})
    if density:
        out = out.withColumn("density", F.col("count").cast("double") / (F.col("bin_end") - F.col("bin_start"))
                             / F.col("_n"))
    return out.drop("_lo", "_hi", "_n")


def kde_curve(values: DataFrame, keys: list[str], value: str = "value", grid: int = KDE_GRID,
              resolution: float | None = None) -> DataFrame:
    """AGG7: Gaussian KDE (Scott bandwidth) evaluated on ``grid`` points from
    the group's min to max.

    Each counted value (0.0, 1.0 and common fractions are one row each) adds
    to ``grid`` sums of one partial aggregation: nothing is multiplied by the
    grid, and a task ships one row per group.  Groups with fewer than 2 values
    or zero spread have no curve.  ``resolution`` rounds values to its
    multiples first, which bounds the distinct values by range / resolution.
    """
    counted = written(counted_values(values, keys, value), "kde_values")
    mean = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"),
                                      F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    off = F.col("_v") - F.col("_mean")
    spread = _meet(counted, mean, keys).groupBy(*keys, "_n", "_min", "_max").agg(
        F.sqrt(F.sum(F.col("_c") * off * off) / (F.col("_n") - 1)).alias("_sd"))
    params = spread.where((F.col("_n") > 1) & (F.col("_sd") > 0)).withColumn(
        "_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).drop("_sd")
    if resolution is not None:
        counted = counted.groupBy(*keys, (F.round(F.col("_v") / resolution) * resolution).alias("_v")).agg(F.sum("_c").alias("_c"))
    lo, hi = F.col("_min"), F.col("_max")

    def at(k: int) -> Column:
        return hi if k == grid - 1 else F.lit(float(k)) * ((hi - lo) / F.lit(float(grid - 1))) + lo

    def weight(k: int) -> Column:
        z = (at(k) - F.col("_v")) / F.col("_h")
        return F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias(f"k{k}")

    sums = _meet(counted, params, keys).groupBy(*keys, "_n", "_h", "_min", "_max").agg(*[weight(k) for k in range(grid)])
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    points = F.array(*[F.struct(F.lit(k).cast("long").alias("point"), at(k).alias("x"), (F.col(f"k{k}") / norm).alias("density"))
                       for k in range(grid)])
    return sums.select(*keys, F.inline(points))


def _fences(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and the fences ``_flo`` / ``_fhi``, one row per group."""
    q = quantiles_of_counted(counted, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = WHISKER_IQR * (F.col("q3") - F.col("q1"))
    return q.withColumns({"_flo": F.col("q1") - reach, "_fhi": F.col("q3") + reach})


def box_stats(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """AGG8: quartiles (linear), IQR whiskers at 1.5 IQR (furthest data point
    inside the fence), outlier count, per group.  For boxes with and without
    incomplete rows, ``keys`` holds the ``variant`` of :func:`with_variants`."""
    counted = written(counted_values(values, keys, value), "box_values")
    j = _meet(counted, _fences(counted, keys), keys)
    inside = (F.col("_v") >= F.col("_flo")) & (F.col("_v") <= F.col("_fhi"))
    agg = j.groupBy(*keys, "q1", "median", "q3").agg(
        F.sum("_c").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"))
    # A whisker never ends inside the box (matplotlib's rule).
    return (agg.withColumn("whisker_low", F.when(F.col("_lo").isNull() | (F.col("_lo") > F.col("q1")), F.col("q1"))
                           .otherwise(F.col("_lo")))
            .withColumn("whisker_high", F.when(F.col("_hi").isNull() | (F.col("_hi") < F.col("q3")), F.col("q3"))
                        .otherwise(F.col("_hi")))
            .drop("_lo", "_hi"))


def box_outliers(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The outlier rows themselves, all columns, with ``side`` (low / high).

    Fences come from counted values and are written (one row per group), so
    the join with the rows is one that Spark may split or turn into a broadcast
    by measured size; ``values`` is read twice."""
    fences = written(_fences(counted_values(values, keys, value), keys).select(*keys, "_flo", "_fhi"), "fences")
    v = F.col(value).cast("double")
    side = F.when(v < F.col("_flo"), "low").when(~F.isnan(v) & (v > F.col("_fhi")), "high")
    return _meet(values, fences, keys).withColumn("side", side).where(F.col("side").isNotNull()).drop("_flo", "_fhi")


def with_variants(wide: DataFrame, methods: list[str], scores: list[str], key: str = "id") -> DataFrame:
    """AGG8's input: ``(key, variant, metric, method, ordinal, value)`` from the
    ``<method>_<score>`` columns of a scored table.

    ``include_null`` has all rows of the table; ``exclude_null`` the complete
    ones, where no method lacks any of the scores.  The mask belongs to the
    whole row and is set before the row is taken apart, so nothing is joined."""
    columns = [f"{m}_{s}" for m in methods for s in scores]
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns}
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    variants = F.when(whole, F.array(F.lit("include_null"), F.lit("exclude_null"))).otherwise(F.array(F.lit("include_null")))
    cells = F.array(*[F.struct(F.lit(s).alias("metric"), F.lit(m).alias("method"), F.lit(i).cast("long").alias("ordinal"),
                               F.col(f"{m}_{s}").alias("value")) for i, m in enumerate(methods) for s in scores])
    numbers = wide.select(key, *[number[c].alias(c) for c in columns])
    rows = numbers.select(key, F.explode(variants).alias("variant"), *columns)
    # The array is made where it is taken apart: of an array column Spark infers that
    # it is not empty, and pushes that test, all scoring in it, down to the scan.
    return rows.select(key, "variant", F.inline(cells))
