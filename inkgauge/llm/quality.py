"""Quality filter by weak supervision.

Rules vote keep (+1), drop (-1) or abstain (0) on each document's counts.
Expectation-maximisation over the counts of vote patterns (3 ** rules at
most, whatever the corpus size) estimates each rule's accuracy and the
share of good documents; a document stays while its posterior probability
of being good is at least ``MIN_POSTERIOR``.  DataFrame expressions only:
the loop is one ``aggregate`` over the pattern table's single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, stage, word_array

SYMBOLS = r"[^#*$%&|<>]+"
ROUNDS = 30
MIN_POSTERIOR = 0.5
#: Pseudo-votes of each rule: right and wrong; and good and bad documents.
RIGHT, WRONG, GOOD, BAD = 80.0, 20.0, 8.0, 2.0


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that stand at least twice.

    A sort of (32 hash bits, position) in one long finds windows that may
    repeat; only those are compared by their words."""
    upper = lambda x: F.shiftright(x, 32)

    def covered(w: Column) -> Column:
        last = F.size(w) - 3
        packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 32).bitwiseOR(i.cast("long")))
        may = let(F.sort_array(packed), lambda s: F.filter(s, lambda x, k: (
            (F.coalesce(upper(F.get(s, k - 1)) == upper(x), F.lit(False)))
            | (F.coalesce(upper(F.get(s, k + 1)) == upper(x), F.lit(False))))))
        exact = F.transform(may, lambda x: let(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), lambda i: F.struct(
            F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("at"))))
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        again = let(F.sort_array(exact), lambda s: F.filter(
            s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))))
        places = F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
        return F.when(last >= 1, F.size(F.array_distinct(places)).cast("long")).otherwise(F.lit(0).cast("long"))

    return let(words, covered)


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts that the rules judge; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), text.alias("text"), word_array(F.col(text_col)).alias("words"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return words.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACES + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        repeat_words(F.col("words")).alias("n_repeat_words"))


def rules() -> list[Column]:
    """Votes: +1 keep, -1 drop, 0 abstain."""
    n = F.col("n_words")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return [
        vote(n < 50, n >= 100),
        vote((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n), (F.col("word_chars") >= 4 * n) & (F.col("word_chars") <= 9 * n)),
        vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 <= n),
        vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, F.col("n_dup_lines") * 20 <= F.col("n_lines")),
        vote(F.col("n_repeat_words") * 10 > n * 3, F.col("n_repeat_words") * 10 <= n),
        vote(F.col("n_distinct") * 5 < n, F.col("n_distinct") * 3 >= n),
    ]


def _posterior(votes: Column, share: Column, accuracy: Column) -> Column:
    """P(good | votes): every vote adds its rule's log-odds of being right."""
    odds = F.aggregate(
        F.zip_with(votes, accuracy, lambda v, a: v * F.log(a / (1 - a))),
        F.log(share / (1 - share)), lambda total, x: total + x)
    return 1 / (1 + F.exp(-odds))


def fit_accuracies(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """``patterns`` (votes, n) -> one row: ``share`` of good documents and
    each rule's ``accuracy``, by expectation-maximisation."""
    one = patterns.agg(F.collect_list(F.struct(F.col("votes"), F.col("n").cast("double").alias("n"))).alias("patterns"))
    total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda t, r: t + value(r))

    def step(state: Column, _) -> Column:
        weighed = F.transform("patterns", lambda p: F.struct(
            p["votes"].alias("votes"), p["n"].alias("n"), _posterior(p["votes"], state["share"], state["accuracy"]).alias("good")))

        def update(rows: Column) -> Column:
            def accuracy(j: Column) -> Column:
                right = total(rows, lambda r: r["n"] * F.when(F.get(r["votes"], j) > 0, r["good"])
                              .when(F.get(r["votes"], j) < 0, 1 - r["good"]).otherwise(0.0))
                cast = total(rows, lambda r: r["n"] * F.abs(F.get(r["votes"], j)))
                return F.least(F.greatest((right + RIGHT) / (cast + RIGHT + WRONG), F.lit(0.5)), F.lit(0.99))
            share = (total(rows, lambda r: r["n"] * r["good"]) + GOOD) / (total(rows, lambda r: r["n"]) + GOOD + BAD)
            return F.struct(share.alias("share"), F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), accuracy).alias("accuracy"))
        return let(weighed, update)

    start = F.struct(F.lit(GOOD / (GOOD + BAD)).alias("share"),
                     F.array(*[F.lit(RIGHT / (RIGHT + WRONG))] * n_rules).alias("accuracy"))
    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).select("m.*")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the counts, ``base_failed``, ``kept`` and
    the posterior ``p_good``.

    Null or empty text has no words and fails the base rules; null ids and
    repeated rows are judged like any other, and texts with the same votes
    alike; an empty table gives no rows.  Texts are counted whole, whatever
    their length; other columns are ignored whatever their names."""
    votes = F.array(*[v.cast("double") for v in rules()])
    counts = stage(document_counts(docs, id_col, text_col), "quality_counts")
    # 3 ** rules patterns at most
    patterns = counts.groupBy(votes.alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    model = fit_accuracies(patterns, len(rules()))
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    rated = counts.join(F.broadcast(model)).withColumn("p_good", _posterior(votes, F.col("share"), F.col("accuracy")))
    return rated.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & (F.col("p_good") >= MIN_POSTERIOR)).alias("kept"), "p_good")
