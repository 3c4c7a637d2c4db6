"""Small tables for the operators' tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     # names that operators use inside
                     *[T.StructField(c, T.StringType()) for c in ("id", "key", "pid", "null_key", "n", "pos", "h", "words", "score")]])


def docs(spark, rows):
    """(doc_id, text) pairs, dealt over three tasks."""
    return spark.createDataFrame([(i, t, "en", "s" + str((i or 0) % 3), *["x"] * 9) for i, t in rows], DOCS).repartition(3)


ODD_ROWS = [(None, None), (None, "a b c"), (None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (3, " \n\t "),
            (4, "Ünï çødé wörds ß 漢字 🙂\u00a0x"), (5, "x"), (6, "w " * 3000), (6, "w " * 3000), (7, "\n".join(["same"] * 50))]
