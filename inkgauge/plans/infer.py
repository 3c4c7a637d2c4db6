"""Distributed batch inference with a pluggable predictor (DSP6 / DSP7, E2).

``make_predictor`` is a picklable zero-argument factory returning
``predict(contents: list[bytes], prompt: str) -> list[str]``.  It is called
once per Python worker (the loaded model is cached there), each task feeds
it micro-batches of ``batch_size`` items from its Arrow batches, and a batch
that raises is retried item by item so only the failing items are marked
``error`` - one bad image never fails the job.  Output rows are
``(key, output, seconds, status, error)``; the per-item seconds feed
:func:`inkgauge.operators.stats.runtime_stats`.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import BOS, EOT, HDR_END, HDR_START, IMAGE_TOKEN

OUTPUT_SCHEMA = "key string, output string, seconds double, status string, error string"
_PREDICTORS: dict = {}


def _predictor(factory):
    p = _PREDICTORS.get(factory)
    if p is None:
        p = _PREDICTORS[factory] = factory()
    return p


def infer(items: DataFrame, make_predictor, prompt: str, key: str = "path", content: str = "content",
          batch_size: int = 4) -> DataFrame:
    """Run the predictor over ``items(key, content)``."""
    def run(batches):
        predict = _predictor(make_predictor)
        for pdf in batches:
            keys, outs, secs, status, errors = [], [], [], [], []
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                ks, cs = list(chunk["key"]), list(chunk["content"])
                t0 = time.perf_counter()
                try:
                    res = list(predict(cs, prompt))
                    if len(res) != len(cs):
                        raise ValueError("predictor returned a different number of outputs")
                    per = (time.perf_counter() - t0) / len(cs)
                    for k, r in zip(ks, res):
                        keys.append(k), outs.append(r), secs.append(per), status.append("success"), errors.append(None)
                except Exception:  # noqa: BLE001 - isolate the failing item(s)
                    for k, c in zip(ks, cs):
                        t1 = time.perf_counter()
                        try:
                            r, st, er = predict([c], prompt)[0], "success", None
                        except Exception as e:  # noqa: BLE001
                            r, st, er = None, "error", f"{type(e).__name__}: {e}"
                        keys.append(k), outs.append(r), secs.append(time.perf_counter() - t1)
                        status.append(st), errors.append(er)
            yield pd.DataFrame({"key": keys, "output": outs, "seconds": secs, "status": status, "error": errors})

    src = items.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return src.mapInPandas(run, OUTPUT_SCHEMA)
