"""Toxic passages by maximum-scoring segments.

* Token log-odds: over a bounded sample of labelled documents, a word's
  share of toxic documents is smoothed by a Dirichlet prior centred on its
  5-letter prefix, that on its 4-letter prefix, that on the class balance.
* Every text is scanned once: word scores less a drift, all maximal-scoring
  segments in linear time (a stack over the positive words).
* Extreme-value calibration: for ungapped segments of clean text the best
  score of n words follows exp(-K n exp(-lambda S)); lambda solves
  E[exp(lambda s)] = 1 over clean words, K is its maximum likelihood given
  the clean documents' best scores.  The excess of each significant segment
  over its chance level adds up to the document's evidence, and a logistic
  fit on the labelled sample turns it into the score.

The fitted model is a small table bounded by the sample; scoring is a
row-wise pass over all documents without any shuffle.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, slices, stage, texts

#: Words: ASCII letters (lowered), digits and all non-ASCII characters.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SAMPLE_DOCS = 20_000   # labelled documents that the model is fitted on
MIN_DOCS = 5           # training documents that a feature must occur in
PRIOR = 5.0            # weight of the Dirichlet prior, in documents
DRIFT = 1.5            # taken off every word's log-odds
MAX_E = 0.05           # expected chance segments up to which a passage is significant


def fold(doc_id):
    """Fold 0 is held out; the calibration scores fold 4 by the log-odds of
    folds 1 to 3, so it sees words as new texts have them.  The final
    log-odds are those of folds 1 to 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id):
    """True for the fifth of the documents that labels are never learned from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def features(word: str) -> tuple[str, str, str]:
    return word, "^" + word[:5], "^" + word[:4]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of ``scores``: each
    is contained in no better one and has only positive prefixes and
    suffixes.  Linear: every positive word is pushed and merged once."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    low, high, start, link = [], [], [], []
    end: list[int] = []
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first, j = i, len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= right:
                break
            left, first = low[j], start[j]  # the earlier segment is a prefix of a better one
            del low[j:], high[j:], start[j:], end[j:], link[j:]
            j = len(low) - 1
        low.append(left), high.append(right), start.append(first), end.append(i + 1), link.append(j)
    return [(h - lo, s, e) for lo, h, s, e in zip(low, high, start, end)]


@dataclass
class Model:
    """Log-odds by feature, and the calibration of segment scores."""

    odds: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    a: float = -30.0
    b: float = 0.0

    def word(self, word: bytes) -> float:
        w, p5, p4 = features(word.decode("utf-8", "replace"))
        for f in (w, p5, p4):
            if (s := self.odds.get(f)) is not None:
                return s - DRIFT
        return -DRIFT

    def index(self) -> WordIndex:
        return WordIndex(lambda words: map(self.word, words), np.float32)

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float, list[tuple[float, int, int]]]:
        """Summed excess over the chance level of ``n`` words, and the significant passages."""
        chance = math.log(max(self.k * n, 1e-300)) if n else 0.0
        kept = [(self.lam * s - chance, a, b) for s, a, b in found if self.lam * s - chance >= -math.log(MAX_E)]
        return sum(x[0] for x in kept), kept

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.a + self.b * math.log1p(evidence)))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each feature: clean and toxic, in the first folds and in the checked one."""
    for batch in slices(batches):
        seen = Counter()
        for text, toxic, check in zip(texts(batch), batch["toxic"].to_pylist(), batch["check"].to_pylist()):
            own = {f for w in set(text.translate(WORD_BYTES).split()) for f in features(w.decode("utf-8", "replace"))}
            seen.update((f, toxic + 2 * check) for f in own)
        names = sorted({f for f, _ in seen})
        yield pa.record_batch([pa.array(names, pa.string()), *[pa.array([seen[f, k] for f in names], pa.int64()) for k in range(4)]],
                              names=["feature", "clean", "toxic", "clean_check", "toxic_check"])


def log_odds(seen: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Smoothed log-odds of each feature (clean, toxic documents) against ``base``."""
    @functools.cache
    def rate(f: str, parent: float) -> float:
        clean, toxic = seen.get(f, (0, 0))
        return (toxic + PRIOR * parent) / (clean + toxic + PRIOR)

    logit, out = lambda p: math.log(p / (1 - p)), {}
    for f, n in seen.items():
        if sum(n) >= MIN_DOCS:
            word = f.removeprefix("^")
            p4 = rate("^" + word[:4], base)
            p5 = rate("^" + word[:5], p4)
            out[f] = logit(rate(f, p5) if f[0] != "^" else p4 if f == "^" + word[:4] else p5) - logit(base)
    return out


def _profile(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Per training document: words, segment scores; and its words' score histogram."""
    table = model.index()
    for batch in slices(batches):
        out = []
        for text, toxic in zip(texts(batch), batch["toxic"].to_pylist()):
            s = table.look_up(text.translate(WORD_BYTES).split())
            bins, counts = np.unique(np.round(s * 10).astype(np.int64), return_counts=True)
            out.append((toxic, len(s), [x[0] for x in segments(s) if x[0] > 1], bins.tolist(), counts.tolist()))
        cols = list(zip(*out))
        yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64())),
                               pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))],
                              names=["toxic", "n", "found", "bins", "counts"])


def _lambda(bins: dict[int, int]) -> float:
    """The positive root of E[exp(lambda s)] = 1 (scores in tenths)."""
    s = np.array(sorted(bins), float) / 10
    p = np.array([bins[k] for k in sorted(bins)], float)
    p /= p.sum()
    if s.max(initial=-1) <= 0 or (p * s).sum() >= 0:
        return 4.0  # no clean word scores at all in a small sample
    low, high = 1e-3, 8.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 500))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Penalised logistic regression on one value, by Newton steps."""
    w, z = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def _cut(x: np.ndarray, y: np.ndarray) -> float:
    """Where the fewest documents fall on the wrong side: the middle of the
    widest such gap between neighbouring values."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    gaps = [(wrong[i], x[i - 1] - x[i], (x[i - 1] + x[i]) / 2) for i in range(1, len(x)) if x[i] > x[i - 1]]
    return float(min(gaps)[2]) if gaps else math.log1p(5.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents (smallest id hashes)
    outside the held-out fifth.  Null ids and labels are never used; an id
    with several labels is toxic if any says so.  Without any labelled
    document the model scores everything 0."""
    known = (labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(label_id)))
             .groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")))
    # at most sample_docs (id, label) pairs: a proven bound for the broadcast
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = stage(rows.join(F.broadcast(known), "id").select((fold(F.col("id")) == 4).alias("check"), "text", "toxic"), "toxic_sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size:
        return Model()
    base = (size.get(1, 0) + 0.5) / (sum(size.values()) + 1)
    names = ["clean", "toxic", "clean_check", "toxic_check"]
    counts = (sample.mapInArrow(_count, "feature string, " + ", ".join(f"{c} bigint" for c in names)).groupBy("feature")
              .agg(*[F.sum(c).alias(c) for c in names]).where(f"{' + '.join(names)} >= {MIN_DOCS}"))
    counted = [tuple(r) for r in counts.collect()]  # bounded by the sample
    model = Model(log_odds({f: (c, t) for f, c, t, _, _ in counted}, base))
    found = sample.where("check").select("text", "toxic").mapInArrow(
        functools.partial(_profile, model=model), "toxic int, n bigint, found array<double>, bins array<bigint>, counts array<bigint>")
    found = stage(found, "toxic_profile")
    clean = found.where("toxic = 0").select(F.explode(F.map_from_arrays("bins", "counts")).alias("bin", "n"))
    bins = {r["bin"]: int(r["n"]) for r in clean.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    if bins:
        model.lam = _lambda(bins)
    docs_found = [(r["toxic"], r["n"], r["found"]) for r in found.select("toxic", "n", "found").collect()]  # sample rows
    chance = sum(n * math.exp(-min(700.0, model.lam * max(s, default=0.0))) for toxic, n, s in docs_found if not toxic)
    model.k = max(1e-9, sum(1 for t, n, _ in docs_found if not t and n) / chance) if chance else 1.0
    x = np.array([math.log1p(model.evidence(n, [(v, 0, 0) for v in s])[0]) for _, n, s in docs_found])
    y = np.array([t for t, _, _ in docs_found], float)
    # a pseudo-document of either kind keeps the fit sane when a class is missing
    x, y = np.concatenate([x, [0.0, math.log1p(50.0)]]), np.concatenate([y, [0.0, 1.0]])
    model.b = max(_logistic(x, y)[1], 0.1)
    model.a = -model.b * _cut(x, y)
    model.odds = log_odds({f: (c + cc, t + tc) for f, c, t, cc, tc in counted}, base)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = model.index()
    for batch in slices(batches):
        out = []
        for text in texts(batch):
            s = table.look_up(text.translate(WORD_BYTES).split())
            evidence, kept = model.evidence(len(s), segments(s))
            best = max(kept, default=(0, None, None))
            out.append((model.score(evidence), len(kept), best[1], best[2]))
        cols = list(zip(*out))
        score = pa.array(cols[0], pa.float64())
        yield pa.record_batch([*[batch[c] for c in batch.schema.names], score, pa.array([int(x >= 0.5) for x in cols[0]], pa.int32()),
                               *[pa.array(c, pa.int64()) for c in cols[1:]]],
                              names=[*batch.schema.names, "score", "predicted", "n_passages", "top_start", "top_end"])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id: str = "doc_id", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``,
    ``n_passages``, ``top_start``, ``top_end`` (words of the best passage)
    and the columns named in ``carry``.

    Null or empty texts have no passage and the lowest score; a null id is
    not held out; repeated rows score alike; an empty table gives no rows.
    Of passages with the same score the latest is the best; an id with several
    labels is toxic if one says so.  Texts are scanned whole, whatever their
    length; columns that are not carried are ignored whatever their names."""
    model = fit(docs, labels, id_col, text_col, label_id, label_col, sample_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       held_out(F.col(id_col)).alias("held"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    out = rows.mapInArrow(functools.partial(_score, model=model),
                          kinds + ", score double, predicted int, n_passages bigint, top_start bigint, top_end bigint")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "score", "predicted", "n_passages",
                      "top_start", "top_end", *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])
