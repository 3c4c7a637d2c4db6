"""Plan checks: the scale properties the design relies on."""

import pytest
from pyspark.sql import functions as F

from inkgauge.operators.quantiles import rank_within_groups
from inkgauge.operators.sampling import exact_split
from inkgauge.plans import catalog as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_has_only_the_join_shuffles(spark, sf001):
    # beyond the broadcast threshold, which the small test table is under
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    p = _plan(C.set_scores(spark, sf001, ["precision", "recall", "jaccard_similarity"]))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning") == 2        # one per join side
    assert "rangepartitioning" not in p and "BroadcastExchange" not in p
    assert "Expand" in p                                      # unpivot, no shuffle


def test_scan_reads_only_needed_columns(spark, sf001):
    p = _plan(C.q_normalize_legacy(spark, sf001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_native_metrics_add_no_python(spark, sf001):
    p = _plan(C.set_scores(spark, sf001, ["precision", "recall", "jaccard_similarity"]))
    assert "Python" not in p and "Arrow" not in p


@pytest.mark.parametrize("partitions", [4, 32])
def test_ranks_are_exact_whatever_range_bounds_are_sampled(spark, partitions):
    # more rows than the range sampler looks at, with a payload column
    df = spark.range(400_000).selectExpr("id % 3 g", "pmod(xxhash64(id), 1000) v", "repeat(cast(id as string), 5) payload")
    for _ in range(2):
        r = rank_within_groups(df, ["g"], ["v"], partitions)
        got = r.groupBy("g").agg(F.count_distinct("_rank").alias("d"), F.max("_rank").alias("m"), F.max("_n").alias("n")).collect()
        assert len(got) == 3 and all(x["d"] == x["n"] == x["m"] + 1 for x in got)
    s = exact_split(df.withColumn("key", F.col("payload")), "key").groupBy("split").count().collect()
    assert dict(map(tuple, s)) == {"train": 320_000, "test": 80_000}
