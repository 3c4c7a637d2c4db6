"""Elements of a large JSON array, found in parallel.

An array file may be one line, so it is cut at every closing brace instead: the
splittable text reader takes ``}`` as its line end, and one file gives as many
tasks as it has blocks.  Where an element ends depends on all that comes before
(is a string open, how deep are the brackets); as with quoted records this is
counted per block and put together:

1. In a block every piece is described for both states it may begin in (outside
   or inside a string): the state it leaves and the change of depth.  Running
   over the block, that gives the state and depth after each piece, relative to
   the block's beginning, for either beginning.
2. A block's two outcomes are one row; running over the blocks of a file gives
   each block's true state and depth.
3. An object of the array ends with a piece that returns to depth 1 outside
   strings.  Pieces are numbered by the ends before them, again per block with
   the blocks' sums added, and gathered by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

END = "}"


def _count(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def _marks(value: Column) -> Column:
    """A piece without escaped characters, and of those nothing but quotes and brackets."""
    return F.regexp_replace(F.regexp_replace(value, r"(?s)\\.", ""), r"[^\"{}\[\]]+", "")


def _outside(marks: Column, inside: int) -> Column:
    """The brackets outside strings, if the piece begins outside / inside one."""
    begun = F.regexp_replace(marks, r'^[^"]*+"?', "") if inside else marks
    return F.regexp_replace(begun, r'"[^"]*+(?:"|$)', "")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with, for a block that begins outside (0) or inside (1) a string:
    ``in_s`` whether a string is open after the piece and ``deep_s`` the depth
    gained since the block began."""
    rows = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.concat("value", F.lit(END)).alias("value"))
    rows = rows.withColumn("marks", _marks(F.col("value")))
    rows = rows.withColumn("odd", _count(F.col("marks"), '"') % 2)
    before = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = [_count(_outside(F.col("marks"), s), "{[") - _count(_outside(F.col("marks"), s), "}]") for s in (0, 1)]
    rows = rows.withColumns({"gain_0": gain[0], "gain_1": gain[1], "begun": (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)})
    for s in (0, 1):
        # a piece begins inside a string if the block did and the quotes before it are even, or the other way round
        mine = F.when(F.col("begun") == s, F.col("gain_0")).otherwise(F.col("gain_1"))
        rows = rows.withColumn(f"deep_{s}", F.sum(mine).over(upto)).withColumn(f"in_{s}", (F.col("begun") + F.col("odd") + s) % 2)
    return rows.drop("marks", "gain_0", "gain_1")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, element``: the text of each object in the JSON array of each
    file.  Elements that are no objects are skipped; what follows the last
    object (the closing bracket) is no element; a file cut short loses its last."""
    pieces = written(_pieces(spark, path), "json_pieces")
    last = F.max_by(F.struct(F.col("deep_0"), F.col("deep_1")), F.col("pos")).alias("d")
    blocks = pieces.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), F.max("pos").alias("last"), last)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("state", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2))
    gained = F.when(F.col("state") == 0, F.col("d.deep_0")).otherwise(F.col("d.deep_1"))
    blocks = blocks.withColumn("depth", F.coalesce(F.sum(gained).over(earlier), F.lit(0)))
    # what stands after a file's last brace was given a brace that is not there
    blocks = blocks.withColumn("rest", F.when(F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(), F.col("last")))
    blocks = blocks.select(F.col("file").alias("b_file"), F.col("block").alias("b_block"), "state", "depth", "rest")
    met = pieces.join(blocks, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    pick = lambda name: F.when(F.col("state") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))
    ends = (pick("in") == 0) & (F.col("depth") + pick("deep") == 1) & ~F.col("pos").eqNullSafe(F.col("rest"))
    own = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select("file", "block", "pos", "value", ends.cast("long").alias("ends"))
    met = written(met.withColumn("nth", F.coalesce(F.sum("ends").over(own), F.lit(0))), "json_placed")
    sums = met.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        F.col("file").alias("s_file"), F.col("block").alias("s_block"), "before")
    placed = met.join(sums, (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block")))
    whole = placed.groupBy("file", (F.col("before") + F.col("nth")).alias("nth")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"), F.max("ends").alias("ends"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), "")
    # between two objects stand the comma, before the first the bracket
    return whole.where(F.col("ends") == 1).select("file", F.regexp_replace(text, r"^[^{]*+", "").alias("element"))
