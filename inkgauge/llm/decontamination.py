"""Benchmark decontamination by size-partitioned MinHash containment.

Items are partitioned by the power of two of their shingle count.  Each
item keeps its smallest shingle hashes (a bottom-k MinHash sample); k
follows from its partition's largest size, so that a document holding the
asked share of the item must hold a fixed number of the sample: at most
(1 - t) n shingles can be missing, and no partner is lost.  Documents of any
length are probed shingle by shingle through an equi-join, candidates are
verified by exact containment of the shingles' words.  The keys of the
documents to verify are folded into a bitmap of fixed size, so texts that are
not to be verified are never shuffled.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, let, stage, word_array

SHINGLE = 5
CONTAINMENT = (80, 100)     # 100 * shared >= 80 * item size
BROADCAST_ROWS = 200_000    # item rows up to which they are broadcast
BROADCAST_BYTES = 32 << 20  # and bytes of their shingles
KEY_BITS = 1 << 24          # bits of a key filter: 2 MB, whatever the corpus


def shingles(words: Column, n: int, make) -> Column:
    """``make(words, i)`` for every run of ``n`` words; a shorter non-empty
    sequence is one shingle of all its words."""
    return let(words, lambda w: F.when(
        F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: make(w, i)))))


def hashed(n: int):
    return lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])


def spelled(n: int):
    return lambda w, i: F.array_join(F.slice(w, i + 1, n), " ")


def _bounded(df: DataFrame, text: Column) -> DataFrame:
    """Broadcast ``df`` if its rows and the bytes of ``text`` were measured to
    be few, else leave the join to Spark."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _same_key() -> Column:
    """Condition that a row (``id``, ``th``) is the document of ``c_id``, ``c_th``."""
    return F.col("id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))


def _split(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``id``, ``th``, ...) that may be among ``keys`` (``c_id``,
    ``c_th``), and those that certainly are not.

    Each key sets one bit of a bitmap of ``KEY_BITS`` bits, broadcast in
    pieces of 4 KB: many keys let more rows pass, but the bitmap never grows."""
    def slot(key, th):
        return F.pmod(F.xxhash64(key, th), F.lit(KEY_BITS)) + 1
    # dealt by piece before the bits meet: a key travels as a number, not as a piece
    bits = (keys.select(slot("c_id", "c_th").alias("slot"))
            .select(F.bitmap_bucket_number("slot").alias("c_piece"), F.bitmap_bit_position("slot").alias("bit"))
            .repartition("c_piece").groupBy("c_piece").agg(F.bitmap_construct_agg("bit").alias("c_bits")))
    own = slot("id", "th")
    at = F.bitmap_bit_position(own).cast("int")
    byte = F.conv(F.hex(F.substring("c_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    tested = rows.join(F.broadcast(bits), F.bitmap_bucket_number(own) == F.col("c_piece"), "left").withColumn("c_met", met)
    return tuple(tested.where(c).select(*rows.columns) for c in (F.col("c_met"), ~F.col("c_met")))


def contaminated_texts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", n: int = SHINGLE,
                 containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """Pairs (``id``, ``th``, ``item``, ``item_key``, ``n_item``,
    ``n_shared``): ``th`` is ``xxhash64`` of the document's text, which tells
    rows with equal or null ids apart.  See :func:`contaminated`."""
    share, whole = containment
    def words(c):
        return word_array(F.translate(F.col(c).cast("string"), ASCII_UPPER, ASCII_LOWER))
    # an item row is known by its words, so repeated ids cannot mix
    own = items.select(F.col(item_col).alias("item"), words(item_text).alias("w")).where(F.size("w") > 0).distinct()
    own = own.withColumn("item_key", F.xxhash64("w")).withColumn("hashes", shingles(F.col("w"), n, hashed(n)))
    own = own.withColumn("n_item", F.size("hashes"))
    least = lambda size: F.floor(size * (whole - share) / whole)  # noqa: E731  that many may be missing
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item"))) + 1) - 1  # the partition's largest size
    sample = own.withColumn("k", least(top) + 1)
    sample = sample.withColumn("sample", F.slice(F.sort_array("hashes"), F.lit(1), F.col("k").cast("int")))
    sample = sample.withColumn("need", F.size("sample") - least(F.col("n_item")))
    probe = sample.select("item", "item_key", "need", F.explode("sample").alias("h"))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    grams = base.select("id", "th", words("text").alias("w")).select("id", "th", F.explode(shingles(F.col("w"), n, hashed(n))).alias("h"))
    hits = (grams.join(_bounded(probe, F.lit("")), "h").groupBy("id", "th", "item", "item_key", "need")
            .agg(F.countDistinct("h").alias("hits")).where(F.col("hits") >= F.col("need")))
    flagged = stage(hits.select(F.col("id").alias("c_id"), F.col("th").alias("c_th")).distinct(), "decontamination_keys")
    texts = _split(base, flagged)[0].join(flagged, _same_key(), "left_semi")
    held = texts.select("id", "th", words("text").alias("w")).select("id", "th", F.explode(shingles(F.col("w"), n, spelled(n))).alias("s"))
    parts = own.select("item", "item_key", "n_item", F.explode(shingles(F.col("w"), n, spelled(n))).alias("s"))
    return (held.join(_bounded(parts, F.col("s")), "s").groupBy("id", "th", "item", "item_key", "n_item")
              .agg(F.countDistinct("s").alias("n_shared"))
              .where(whole * F.col("n_shared") >= share * F.col("n_item")))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", n: int = SHINGLE,
                 containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """Pairs (id, item, ``n_item``, ``n_shared``, ``containment``) where the
    document holds the asked share of the item's distinct shingles.

    Null or empty texts hold nothing and are found nowhere; an item shorter
    than a shingle is found in documents that consist of the same words.
    Rows that repeat an id, null ids too, count once a pair; an empty table
    on either side gives no pairs.  Items with the same words are each found.
    Texts of any length are searched whole; other columns of both tables are
    ignored whatever their names."""
    shared = contaminated_texts(docs, items, id_col, text_col, item_col, item_text, n, containment)
    best = shared.groupBy("id", "item").agg(F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.n_item").cast("long").alias("n_item"),
                       F.col("b.n_shared").cast("long").alias("n_shared"), (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, whatever
    their names; rows with null or repeated ids are told apart by their text.
    Null and empty texts stay, an empty table on either side drops nothing.
    Only rows that share a bit with a found document are shuffled."""
    found = stage(contaminated_texts(docs, items, id_col, text_col, **options)
                  .select(F.col("id").alias("c_id"), F.col("th").alias("c_th")).distinct(), "decontamination_found")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    near, clean = _split(rows, found)
    return near.join(found, _same_key(), "left_anti").unionByName(clean).select("row.*")
