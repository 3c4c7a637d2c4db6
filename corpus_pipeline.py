"""The training-data pipeline: named stages over ``documents``, each calling
one operator of ``inkgauge.llm`` on all that the stage before it kept.

Every stage reads texts whole, whatever their length, returns the columns of
``documents`` alone (others are dropped, whatever their names) and gives no rows
for an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import decontamination, line_dedup, near_dup, packing, toxicity
from inkgauge.llm.common import prepare, stage
from inkgauge.llm.queries import public_tokenizer, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model takes for toxic go.  Null and empty texts
    stay; rows with null or repeated ids are judged by their text alone."""
    prepare(spark)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that other documents repeat; the
    largest id keeps them.  A null text becomes an empty one; rows with a null
    id lose common lines but do not make a line common."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return (out.withColumnRenamed("kept_text", "text")
            .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles, the smallest id stays, with all
    its rows.  Rows with a null id and texts without words stay."""
    prepare(spark)
    groups = near_dup.near_duplicates(docs, shingle=5, similarity=(80, 100))
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Rows with null or repeated ids are
    told apart by their text; null and empty texts stay."""
    prepare(spark)
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, cut and packed into training sequences; each row, repeated
    ones too, is packed once, a null or empty text as its end id."""
    prepare(spark)
    return packing.pack(docs, public_tokenizer())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]
#: Toxicity scores and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline_{name}")
    return docs
