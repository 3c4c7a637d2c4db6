"""URL filter: allow / block rules, then empirical-Bayes host reputation.

Labelled page outcomes are summed per host, registered domain and suffix.
Each level's good rate is shrunk towards its parent's by a beta-binomial
prior whose strength is fitted by moments over all siblings' counts.  A host
without labelled pages has its domain's rate as prior and no pages of its
own; without labels in its domain it takes its suffix's rate, else the rate
of all labelled pages.  A page whose posterior upper bound for its host stays under ``min_good`` is
blocked.  Everything is DataFrame expressions; the counts per host are written
once, domains, suffixes and priors come from them, and every join is a plain
shuffle join that AQE may split for a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, stage

#: (verdict, host, path): the longest rule that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_GOOD = 0.5
Z = 1.645


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``outcomes`` (host, good 0/1, null where nothing is labelled) -> one
    row per host: posterior ``good`` rate and its upper bound.  Registered
    domain: the last two labels; suffix: the last.

    The rate of all labelled pages counts one good and one bad page more and
    weighs no more than its pages, so a few labels elsewhere do not block."""
    every = outcomes.groupBy("host").agg(F.count("good").cast("double").alias("n"),
                                         F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
    every = (every.withColumn("domain", F.substring_index("host", ".", -2))
             .withColumn("suffix", F.substring_index("host", ".", -1)))
    every = stage(every, "host_counts")
    hosts = every.where(F.col("n") > 0)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def strength(children: DataFrame, name: str) -> DataFrame:
        # one row: the mean rate and, by moments, the prior's weight in pages
        s = children.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"),
                         F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
        mean = F.col("k") / F.col("n")  # null without any outcome
        spread = F.col("kk") - F.col("n") * mean * mean
        within = mean * (1 - mean)
        width = F.col("n") - F.col("nn") / F.col("n")  # 0 with a single sibling: no spread to fit
        between = F.try_divide(spread - (F.col("m") - 1) * within, width)
        weight = F.when((between > 0) & (within > between), F.try_divide(within, between) - 1)
        weight = F.coalesce(weight, F.when(between > 0, F.lit(1.0)).otherwise(F.lit(1000.0)))
        weight = F.least(F.greatest(weight, F.lit(1.0)), F.lit(1000.0))
        return s.select(F.coalesce(mean, F.lit(0.5)).alias(f"{name}_mean"), weight.alias(f"{name}_weight"),
                        F.coalesce("k", F.lit(0.0)).alias(f"{name}_k"), F.coalesce("n", F.lit(0.0)).alias(f"{name}_n"))

    # single-row frames of four numbers
    priors = [F.broadcast(strength(c, n)) for c, n in ((hosts, "host"), (domains, "domain"), (suffixes, "suffix"))]
    rate = lambda n, k, weight, mean: (k + weight * mean) / (n + weight)
    suffixes = suffixes.join(priors[2]).select(
        "suffix", rate(F.col("n"), F.col("k"), F.col("suffix_weight"), F.col("suffix_mean")).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").join(priors[1]).select(
        "domain", rate(F.col("n"), F.col("k"), F.col("domain_weight"), F.col("suffix_rate")).alias("domain_rate"))
    rated = every.join(domains, "domain", "left").join(suffixes, "suffix", "left").join(priors[0])
    near = F.coalesce("domain_rate", "suffix_rate")
    parent = F.coalesce(near, (F.col("host_k") + 1) / (F.col("host_n") + 2))
    weight = F.when(near.isNull(), F.least("host_weight", F.col("host_n") + 2)).otherwise(F.col("host_weight"))
    a = F.col("k") + weight * parent
    b = F.col("n") - F.col("k") + weight * (1 - parent)
    good = a / (a + b)
    upper = good + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return rated.select("host", F.col("n").alias("n_labelled"), good.alias("good"), upper.alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               label_id: str = "doc_id", label_col: str = "quality", rules=RULES, min_good: float = MIN_GOOD,
               z: float = Z) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``.

    A null url or one without ``://`` has empty host and path.  A host
    without labelled pages is judged by its domain, else its suffix, else all
    labelled pages; without labels at all every host is allowed: nothing
    speaks against it.  A page counts as good if any of its labels says so; null
    labels and ids count nothing.  Repeated rows are each returned; of rules
    that fit, the longest wins, so there are no ties; an empty table gives no
    rows.  Urls of any length are split whole; other columns of both tables are
    ignored whatever their names."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = (labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
             .groupBy(F.col(label_id).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("good")))
    reputation = host_reputation(rows.join(known, "id", "left").select("host", "good"), z)
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    found = F.when(F.coalesce(F.col("upper"), F.lit(1.0)) < min_good, "block").otherwise("allow")
    return rows.join(reputation, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, found).alias("verdict"))
