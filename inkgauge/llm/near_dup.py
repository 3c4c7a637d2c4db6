"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

1. One scan per text: shingle hashes, a MinHash sample, the band hashes of
   the sample and its odd sketch (every sample toggles one bit of a parity
   bitmap).  Texts with equal shingle sets form a class; only one member of
   each class goes on.
2. Members of a band bucket are candidates.  The population count of the
   XOR of two odd sketches estimates how many samples differ, which is
   precise for high similarity and prunes candidates before their sets move.
3. All members of a bucket meet its hub, the member that shares most buckets
   with most others, on their full shingle sets.
4. The rest is exact by differences from the hub b.  If x is not linked to
   b, then |x & y| = |b| - missing(x) - missing(y) + shared differences, so a
   y linked to x must share at least s of its differences with x, where
   (1 + t) s = t added + missing of both - (1 - t) |b|.  In one order, rarest
   first, the first shared difference has s of either's from there on: an
   equi-join with that condition finds all pairs that can be linked.
5. Members far from the hub can only be linked to members that are rather
   far from it too (triangle inequality); those few are compared directly.

Components come from :mod:`.components`; nothing is collected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, signed, slices, split_words, stage, window_hashes, word_hashes
from .components import connected_components

BANDS, ROWS = 25, 4
SKETCH_BITS = 256
#: XOR bits up to which a pair is confirmed: similarity about 0.55, five
#: standard deviations and more below the thresholds in use.
MAX_XOR = 64
#: Differences are kept down to this similarity to the hub; whatever is linked
#: to a member below it lies below FAR (0.5 + 0.2 or more, in percent).
NEAR, FAR = 50, 70
_RANDOM = np.random.default_rng(20_240_229)
FACTORS = _RANDOM.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingle_set(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingle hashes; fewer than ``n`` words are one shingle."""
    if not len(word_hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes, min(n, len(word_hashes))) + np.uint64(min(n, len(word_hashes))))


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    words, first = split_words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    every = word_hashes(words)
    return [shingle_set(every[a:b], n) for a, b in zip(first[:-1], first[1:])]


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of samples per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * a + b, starts) for a, b in zip(FACTORS, TERMS)], 1)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = mix(h + samples[:, r::ROWS])
    return h


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as words of 64 bits."""
    bit = mix(samples + np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    odd = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(odd, (np.arange(len(samples))[:, None], bit.astype(np.int64)), 1)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in slices(batches):
        sets = _sets(batch, n)
        full = [i for i, x in enumerate(sets) if len(x)]
        bands, sketch = [None] * len(sets), [None] * len(sets)
        sums = np.zeros((len(sets), 2), np.uint64)
        if full:
            samples = min_hashes([sets[i] for i in full])
            for i, b, s in zip(full, signed(band_hashes(samples)), odd_sketches(samples)):
                bands[i], sketch[i] = b, s
                sums[i] = sets[i].sum(), mix(sets[i] ^ np.uint64(0xA0761D6478BD642F)).sum()
        yield pa.record_batch([batch["id"], pa.array([len(x) for x in sets], pa.int64()), pa.array(signed(sums[:, 0].copy())),
                               pa.array(signed(sums[:, 1].copy())), pa.array(bands, longs), pa.array(sketch, longs)],
                              names=["id", "n", "c1", "c2", "bands", "sketch"])


def _shingles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [signed(x) for x in _sets(batch, n)]
        yield pa.record_batch([batch["id"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])


def _xor_bits(x: str, y: str) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their full sets and ``i``, the shared shingles."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) whose full sets are similar enough."""
    share, whole = similarity
    return _with_sets(pairs, sets).where(whole * F.col("i") >= share * F.col("u")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    similarity: tuple[int, int] = (85, 100)) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * shared >= 85 * union of their distinct
    word shingles (or as ``similarity`` says); ``component_id`` is the
    smallest id reachable.  Null or empty texts have no shingles and no
    links; rows that repeat an id are one document, linked through any of
    its texts; a null id is linked with nothing, has a null component and is
    kept.  An empty table gives no rows.  Equal texts are one class, kept by the
    smallest id; sets are those of whole texts, whatever their length; other
    columns are ignored whatever their names."""
    share, whole = similarity
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed_rows = stage(rows.mapInArrow(functools.partial(_sign, n=shingle), "id bigint, n bigint, c1 bigint, c2 bigint, "
                                        "bands array<bigint>, sketch array<bigint>"), "near_dup_signatures")
    linked = signed_rows.where("id is not null and n > 0")
    # equal sets: one class, represented by its smallest document
    # (written, so that the exchange of a class with many members may be split)
    classes = stage(linked.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep")), "near_dup_classes")
    members = stage(linked.join(classes, ["c1", "c2", "n"]).select("id", "rep", "n", F.when(F.col("id") == F.col("rep"), F.col("bands"))
                                                                   .alias("bands"), "sketch"), "near_dup_members")
    own = members.where("bands is not null").select(F.col("rep").alias("node"), "n", "sketch", F.posexplode("bands").alias("band", "h"))
    own = own.select("node", "n", "sketch", F.xxhash64("band", "h").alias("bucket"))
    full = own.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    crowd = stage(own.join(stage(full.select("bucket", "size"), "near_dup_buckets"), "bucket").distinct(), "near_dup_buckets")
    # the hub: the member that shares most buckets with most others
    reach = crowd.groupBy("node").agg(F.sum("size").alias("reach"))
    hubs = crowd.select("bucket", "node").join(reach, "node").groupBy("bucket").agg(F.max_by("node", "reach").alias("hub"))
    hubs = stage(hubs, "near_dup_hubs")

    # full sets of the bucketed representatives only
    wanted = crowd.select(F.col("node").alias("id")).distinct()
    sets = stage(rows.join(wanted, "id", "left_semi").mapInArrow(functools.partial(_shingles, n=shingle), "id bigint, s array<bigint>")
                 .where(F.size("s") > 0).distinct(), "near_dup_sets")

    beside = stage(crowd.select("bucket", "node", "n", "sketch").join(hubs, "bucket").where("node <> hub"), "near_dup_beside")
    star = beside.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = 100 * F.col("i") >= NEAR * F.col("u")
    tag = lambda kind, e: F.xxhash64(F.lit(kind), e)
    missing, added = F.array_except("sb", "sa"), F.array_except("sa", "sb")
    star = stage(_with_sets(star, sets).select(
        "a", "b", F.xxhash64("sa").alias("text_a"), F.xxhash64("sb").alias("text_b"),
        (whole * F.col("i") >= share * F.col("u")).alias("linked"), (100 * F.col("i") >= FAR * F.col("u")).alias("close"),
        # what a member's differences cost: t added + missing, and what the threshold grants
        (share * F.size(added) + whole * F.size(missing)).alias("cost"), ((whole - share) * F.size("sb")).alias("grant"),
        F.when(near, F.concat(F.transform(missing, lambda e: tag(0, e)), F.transform(added, lambda e: tag(1, e)))).alias("differs")), "near_dup_star")
    direct = star.where("linked").select("a", "b").distinct()
    known = connected_components(direct).select(F.col("node"), F.col("component").alias("c"))

    def placed(df: DataFrame, node: str, c: str) -> DataFrame:
        """``df`` with the component so far of its column ``node``."""
        of = known.select(F.col("node").alias(node), F.col("c").alias(c))
        return df.join(of, node, "left").withColumn(c, F.coalesce(c, node))

    # differences from the hub, where the hub has members outside its component;
    # all members rank theirs in one order, the rarest first
    apart = stage(placed(placed(star.where("differs is not null"), "a", "c"), "b", "c_hub"), "near_dup_apart")
    open_hubs = apart.where("c <> c_hub").select("b").distinct()
    each = apart.join(open_hubs, "b", "left_semi").select(
        "b", "text_b", "a", "text_a", "c", (F.col("c") != F.col("c_hub")).alias("open"), "cost", "grant",
        F.size("differs").alias("size"), F.explode("differs").alias("e"))
    each = stage(each, "near_dup_differences")
    holders = each.groupBy("b", "text_b", "e").agg(F.count(F.lit(1)).alias("holders"), F.count_if("open").alias("open_holders"))
    rarest = Window.partitionBy("b", "text_b", "a", "text_a").orderBy("holders", "e")
    ranked = each.join(stage(holders, "near_dup_holders"), ["b", "text_b", "e"]).withColumn("after", F.col("size") - F.row_number().over(rarest) + 1)
    # ``after``: differences from this one on, so many at most can be shared
    ranked = stage(ranked.where((F.col("open_holders") > 0) & (F.col("holders") > 1) & (
        (share + whole) * F.col("after") >= F.col("cost") - F.when(F.col("open"), F.col("grant")).otherwise(0))), "near_dup_ranked")
    one, two = ([F.col(c).alias(f"{c}_{k}") for c in ("a", "c", "cost", "after", "open")] for k in ("x", "y"))
    # x is open; an open pair is met once
    meet = ((F.col("c_x") != F.col("c_y")) & (~F.col("open_y") | (F.col("a_x") < F.col("a_y"))) & (
        (share + whole) * F.least("after_x", "after_y") >= F.col("cost_x") + F.col("cost_y") - F.col("grant")))
    shared = (ranked.where("open").select("b", "text_b", "e", "grant", *one)
              .join(ranked.select("b", "text_b", "e", *two), ["b", "text_b", "e"]).where(meet)
              .select(F.greatest("a_x", "a_y").alias("a"), F.least("a_x", "a_y").alias("b")).distinct())

    # members far from the hub, one of them at least without differences
    measured = star.select(F.col("a").alias("node"), F.col("b").alias("hub"), "close", F.col("differs").isNotNull().alias("measured")).distinct()
    far = beside.join(measured, ["node", "hub"], "left").where("not coalesce(close, false)")
    far = stage(placed(far, "node", "c").select("bucket", "node", "n", "sketch", "c", F.coalesce("measured", F.lit(False)).alias("measured")), "near_dup_far")
    other = far.select("bucket", *[F.col(x).alias(f"{x}_b") for x in ("node", "n", "sketch", "c", "measured")])
    alike = (F.col("c") < F.col("c_b")) & ~(F.col("measured") & F.col("measured_b")) & (_xor_bits("sketch", "sketch_b") <= MAX_XOR) & (
        whole * F.least("n", "n_b") >= share * F.greatest("n", "n_b"))
    rest = far.join(other, "bucket").where(alike).select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()
    links = direct.union(_confirm(shared.union(rest).distinct(), sets, similarity))
    # several texts under one id are one document
    several = members.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    tied = several.select(F.col("id").alias("a"), F.col("lo").alias("b")).union(several.select(F.col("id").alias("a"), F.col("hi").alias("b")))
    known = connected_components(links.union(tied))

    reached = members.groupBy("id").agg(F.min("rep").alias("rep"))
    reached = (reached.join(known, F.col("rep") == F.col("node"), "left")
               .select(F.col("id").alias("of"), F.coalesce("component", "rep").alias("component")))
    component = F.coalesce("component", "id")
    return signed_rows.select("id", "n").join(reached, F.col("id") == F.col("of"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
