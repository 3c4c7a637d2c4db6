"""Exact quantiles / ranks, histograms, KDE, box plots, summaries (AGG*)."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from inkgauge.operators import histograms as H
from inkgauge.operators import sampling as SM
from inkgauge.operators import stats
from inkgauge.operators.quantiles import counted_values, cumulated, exact_quantiles, rank_within_groups
from inkgauge.session import written


def _values(spark, data):
    return spark.createDataFrame(data, "g string, value double")


def test_exact_quantiles_vs_numpy_with_skew(spark):
    rnd = random.Random(1)
    data = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)]  # one dominant group, many ties
    data += [("b", rnd.random()) for _ in range(7)] + [("c", 0.25)]
    df = _values(spark, data).repartition(5)
    q = {r["g"]: r for r in exact_quantiles(df, ["g"], "value", {"p25": 0.25, "med": 0.5, "p75": 0.75}).collect()}
    for g in ("hot", "b", "c"):
        xs = np.array([v for k, v in data if k == g])
        for name, p in (("p25", 25), ("med", 50), ("p75", 75)):
            assert math.isclose(q[g][name], float(np.percentile(xs, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_rank_is_exact_and_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1000).alias("v"))
    r = rank_within_groups(df.repartition(6), ["g"], ["v"]).collect()
    by = {}
    for row in r:
        by.setdefault(row["g"], []).append((row["v"], row["_rank"], row["_n"]))
    for g, rows in by.items():
        rows.sort()
        assert [x[1] for x in rows] == list(range(len(rows)))
        assert all(x[2] == len(rows) for x in rows)


def test_percent_histogram_edges(spark):
    vals = [0.0, 0.0999, 0.1, 0.999, 1.0, 1.3, None]
    df = spark.createDataFrame([("m", v) for v in vals], "method string, value double")
    h = {r["bin"]: r["count"] for r in H.percent_histogram(df, ["method"]).collect()}
    assert [h[i] for i in range(1, 11)] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert h[11] == 2 and h[0] == 0
    assert sum(h.values()) == 6


def test_equal_width_matches_numpy(spark):
    rnd = random.Random(4)
    xs = [rnd.random() for _ in range(500)] + [0.5] * 20
    df = _values(spark, [("g", x) for x in xs])
    for bins in (20, 30):
        rows = sorted(H.equal_width_histogram(df, ["g"], bins, density=True).collect(), key=lambda r: r["bin"])
        counts, edges = np.histogram(np.array(xs), bins=np.histogram_bin_edges(np.array(xs), bins))
        dens, _ = np.histogram(np.array(xs), bins=edges, density=True)
        assert [r["count"] for r in rows] == counts.tolist()
        assert all(math.isclose(r["density"], d, rel_tol=1e-9) for r, d in zip(rows, dens))
    single = H.equal_width_histogram(_values(spark, [("g", 2.0)] * 3), ["g"], 20).collect()
    assert sum(r["count"] for r in single) == 3


def test_kde_matches_formula(spark):
    rnd = random.Random(8)
    xs = [rnd.gauss(0, 1) for _ in range(200)]
    rows = sorted(H.kde_curve(_values(spark, [("g", x) for x in xs]), ["g"]).collect(), key=lambda r: r["point"])
    a = np.array(xs)
    h = a.std(ddof=1) * len(a) ** (-0.2)
    grid = np.linspace(a.min(), a.max(), 200)
    ref = np.exp(-0.5 * ((grid[:, None] - a[None, :]) / h) ** 2).sum(1) / (len(a) * h * math.sqrt(2 * math.pi))
    assert len(rows) == 200
    assert all(math.isclose(r["density"], d, rel_tol=1e-9) for r, d in zip(rows, ref))


def test_box_stats(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = H.box_stats(_values(spark, [("g", x) for x in xs]), ["g"]).first()
    q1, q3 = np.percentile(xs, 25), np.percentile(xs, 75)
    assert (row["q1"], row["q3"]) == (q1, q3)
    assert row["whisker_high"] == 4.0 and row["outliers"] == 1


def test_summary_rounding_half_even(spark):
    df = spark.createDataFrame([("m", "x", 0, 0.125), ("m", "x", 0, 0.125), ("m", "y", 1, 0.135), ("m", "y", 1, 0.135)],
                               "metric string, method string, ordinal long, value double")
    rows = {r["method"]: r for r in stats.summary_statistics(df).collect()}
    assert rows["x"]["mean"] == 12.0   # 12.5 -> 12
    assert rows["y"]["mean"] == 14.0   # 13.5 (0.135 * 100 in binary) -> 14


def test_runtime_stats_single_run(spark):
    df = spark.createDataFrame([("a", 2.0)], "k string, seconds double")
    r = stats.runtime_stats(df, ["k"]).first()
    assert (r["count"], r["stdev"], r["median"], r["total"]) == (1, 0.0, 2.0, 2.0)


def test_analysis_summary_match_counts(spark):
    df = spark.createDataFrame([("0.95", "0.96", "True"), ("0.5", "x", "False"), (None, "0.10", "False")],
                               "m_a string, m_b string, m_eq string")
    rows = {r["variant"]: r for r in stats.analysis_summary(df, ["m"], "a", "b", "eq").collect()}
    inc, exc = rows["include_null"], rows["exclude_null"]
    assert inc["matches"] == 1 and inc["legacy_matches"] == 3
    # the counters are of the full frame, whatever the variant drops
    assert [r["non_numeric_second"] for r in (inc, exc)] == [r["non_numeric_first"] for r in (inc, exc)] == [1, 1]
    assert exc["total_entries"] == 1 and exc["median_first"] == 0.95


def test_hot_value_is_one_row_per_task(spark):
    # two thirds of 400,000 rows hold one value, without any column to tell them apart
    df = spark.range(0, 400_000, 1, 8).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 < 2, F.lit(1.0))
                                              .otherwise(F.rand(3)).alias("value"))
    counted = counted_values(df, ["g"])
    assert "Exchange" in counted._jdf.queryExecution().executedPlan().toString()
    rows = cumulated(counted, ["g"], ["_v"], 8)
    per_task = [r["n"] for r in written(rows.withColumn("p", F.spark_partition_id()), "t").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per_task) < 140_000 and rows.agg(F.max("_c")).first()[0] > 130_000
    q = {r["g"]: r for r in exact_quantiles(df, ["g"], "value", {"a": 0.1, "m": 0.5}).collect()}
    xs = {g: np.array([r["value"] for r in df.where(F.col("g") == g).collect()]) for g in (0, 1)}
    for g in (0, 1):
        assert q[g]["m"] == 1.0 and math.isclose(q[g]["a"], float(np.percentile(xs[g], 10)), rel_tol=1e-12)


def test_null_groups_and_values(spark):
    df = _values(spark, [(None, 1.0), (None, 3.0), ("a", None), ("b", float("nan")), ("b", 2.0)])
    assert {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "value", {"m": 0.5}).collect()} == {None: 2.0, "b": 2.0}
    hist = H.percent_histogram(_values(spark, [("a", None), ("b", 0.05)]), ["g"]).collect()
    assert {(r["g"], r["bin"]): r["count"] for r in hist if r["count"]} == {("b", 1): 1} and len(hist) == 24
    assert {r["g"] for r in H.equal_width_histogram(df, ["g"], 4).collect()} == {None, "b"}


def test_box_variants_mask_whole_rows(spark):
    wide = spark.createDataFrame([("1", 0.1, 0.5), ("2", 0.2, None), ("3", 0.3, float("nan")), ("3", 0.4, 0.6), (None, 9.0, 0.5)],
                                 "id string, a_s double, b_s double")
    v = H.with_variants(wide, ["a", "b"], ["s"])
    excl = sorted((r["method"], r["value"]) for r in v.where("variant = 'exclude_null'").collect())
    assert excl == [("a", 0.1), ("a", 0.4), ("a", 9.0), ("b", 0.5), ("b", 0.5), ("b", 0.6)]
    box = {(r["variant"], r["method"]): r for r in H.box_stats(v, ["variant", "method"]).collect()}
    assert box["include_null", "a"]["n"] == 5 and box["exclude_null", "a"]["n"] == 3 and box["include_null", "b"]["n"] == 3
    out = H.box_outliers(v, ["variant", "method"]).collect()
    assert [(r["id"], r["variant"], r["method"], r["value"], r["side"]) for r in out] == [(None, "include_null", "a", 9.0, "high")]


def test_split_and_rank_with_repeated_keys(spark):
    df = spark.createDataFrame([(str(i % 7), f"payload {i}") for i in range(200)], "id string, text string").repartition(4)
    out = SM.exact_split(df, "id", 0.8)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 160, "test": 40}
    assert sorted(r["text"] for r in out.collect()) == sorted(f"payload {i}" for i in range(200))
    assert SM.exact_split(df.limit(0), "id").count() == 0
    assert SM.exact_split(df, "id", 1.0).where("split = 'test'").count() == 0
    plan = SM.exact_split(spark.range(1000).selectExpr("cast(id as string) id", "'x' text"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the rows themselves are not dealt anew
    same = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3, "v string")
    assert sorted(r["_rank"] for r in rank_within_groups(same, [], ["v"]).collect()) == list(range(53))


def test_added_metric_with_threshold_and_direction(spark):
    from inkgauge.functions.registry import REGISTRY, register_native
    from inkgauge.plans import score as S
    register_native("extra_words", lambda c: {"extra_words": F.size(c.hyp_words) - F.size(c.ref_words)}, higher_is_better=False, threshold=1)
    try:
        pairs = spark.createDataFrame([("1", "m", 0, "a b", "a b c"), ("2", "m", 0, "a", "a b c d")],
                                      "id string, method string, ordinal long, ref string, hyp string")
        rows = S.with_metrics(pairs, ["extra_words"]).orderBy("id").collect()
        assert [(r["extra_words"], r["equal_extra_words"]) for r in rows] == [(1, True), (3, False)]
        assert [r["equal_extra_words"] for r in S.with_metrics(pairs, ["extra_words"], {"extra_words": 5}).collect()] == [True, True]
        ranked = stats.rank_methods(spark.createDataFrame([("extra_words", "x", 0, 3.0), ("extra_words", "y", 1, 1.0)],
                                                          "metric string, method string, ordinal long, value double"))
        assert {r["method"]: r["best_rank"] for r in ranked.collect()} == {"x": 2, "y": 1}
    finally:
        del REGISTRY["extra_words"]


def test_approximate_modes(spark):
    rnd = random.Random(9)
    xs = [rnd.random() for _ in range(2000)]
    df = _values(spark, [("g", x) for x in xs])
    approx = stats.describe(df, ["g"], exact=False).first()
    assert abs(approx["median"] - float(np.percentile(xs, 50))) < 0.01
    exact = {r["point"]: r["density"] for r in H.kde_curve(df, ["g"]).collect()}
    coarse = {r["point"]: r["density"] for r in H.kde_curve(df, ["g"], resolution=1e-4).collect()}
    assert max(abs(exact[k] - coarse[k]) for k in exact) < 1e-2
