"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is fully materialised with the ``noop`` sink (all columns, all
rows computed, nothing collected to the driver).  ``value`` is the sum of
the per-query wall times after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkgauge.operators import histograms as H, stats as ST  # noqa: E402
from inkgauge.plans import catalog as C  # noqa: E402
from inkgauge.session import build_session  # noqa: E402


def headline(spark, sf_dir, partitions):
    """``documents`` is one row group, so its rows are dealt to ``partitions``
    tasks before the scoring plans' text work; the workloads are those of the
    earlier rounds (set metrics in the reports)."""
    return {
        # native set metrics + word error rate over documents x 10 methods
        "score_native": lambda: C.set_scores(spark, sf_dir, ["precision", "recall", "jaccard_similarity",
                                                              "word_error_rate"], partitions),
        # the evaluated scripts' active set: BLEU, WER, precision, recall
        "score_default": lambda: C.set_scores(spark, sf_dir, ["bleu_score", "word_error_rate", "precision",
                                                               "recall"], partitions),
        "summary_stats": lambda: ST.summary_statistics(C.kept_values(spark, sf_dir, partitions=partitions)),
        "hist10": lambda: H.percent_histogram(C.set_values(spark, sf_dir, partitions=partitions), C.METRIC_KEYS),
        "normalize": lambda: C.q_normalize_legacy(spark, sf_dir),
        "clean_markup": lambda: C.q_clean_markup(spark, sf_dir),
        "chat_records_split": lambda: C.q_chat_records(spark, sf_dir),
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(4 * cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = headline(spark, sf_dir, 4 * cpus)
    # warm-up: JVM JIT, Python workers, file listing
    C.q_precision_recall(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, build in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
