"""Hard negatives by exact window search in a multiway hyperplane tree.

1. Vectors become integers; one more coordinate, the root of the longest
   squared length less the own, gives all rows the same length.  A query with 0
   there has ``distance ** 2 = |query| ** 2 + longest - 2 * score``: a window of
   scores is an annulus around the query.
2. The tree is fitted on a bounded sample: each node takes well spread sample
   points as split points, its rows go to the nearest one (the hyperplanes
   between them), and so on.  All rows are routed to their leaf, and each split
   point stores the range of its distances to the rows of every sibling subtree.
3. A query goes down all branches but those that a split point rules out: rows
   in the annulus have distances to it within (query distance +- radius); a
   sibling whose stored range misses that is eliminated.  Leaves lie in blocks
   of bounded size, however many rows a leaf has, and are searched exactly.
4. Each search probes the query's own leaf first; what it finds narrows the
   windows for the rest.  Positives are the first rows of the whole axis with
   the same label; each positive then opens a window for negatives.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage

#: Rows that the split points are chosen from, drawn by hash.
SAMPLE_ROWS = 4096
#: Split points per node, and sample rows below which a node stays a leaf.
ARITY, LEAF_SAMPLE = 8, 128
#: Rows of a block and queries of a parcel: what a task multiplies at a time.
BLOCK_ROWS, PARCEL_QUERIES, STRIP = 32_768, 512, 2_048
SCALE, N_POSITIVES, N_NEGATIVES = 256, 5, 5
ANCHOR_EVERY, SHIFT_EVERY, N_LABELS = 100, 7, 10
#: Integers below this are exact as doubles.
EXACT = 2 ** 53


@dataclass
class Node:
    """Split points (one per child) with their squared lengths; ``lo``/``hi``
    [i, j]: distances of split point i to the rows under child j."""
    number: int
    points: np.ndarray
    lift: np.ndarray
    children: list = field(default_factory=list)  # Node or leaf number
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


def _distances(rows: np.ndarray, lift: np.ndarray, node: Node) -> np.ndarray:
    """Distances of lifted rows to a node's split points, as doubles."""
    square = ((rows ** 2).sum(1) + lift ** 2)[:, None] + ((node.points ** 2).sum(1) + node.lift ** 2)[None, :]
    square -= 2 * (rows @ node.points.T + lift[:, None] * node.lift[None, :])
    return np.sqrt(np.maximum(square, 0))


def spread(rows: np.ndarray, lift: np.ndarray, k: int) -> list[int]:
    """``k`` distinct points far from each other, greedily from the first."""
    chosen, nearest = [0], np.full(len(rows), np.inf)
    while len(chosen) < k:
        at = chosen[-1]
        node = Node(0, rows[at:at + 1], lift[at:at + 1])
        nearest = np.minimum(nearest, _distances(rows, lift, node)[:, 0])
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break
        chosen.append(far)
    return chosen


def fit(rows: np.ndarray, lift: np.ndarray, arity: int = ARITY, leaf: int = LEAF_SAMPLE) -> tuple[list[Node], int]:
    """Nodes (the root first; none if the sample stays one leaf) and the number of leaves."""
    nodes: list[Node] = []
    leaves = 0

    def grow(at: np.ndarray):
        nonlocal leaves
        chosen = spread(rows[at], lift[at], arity) if len(at) > leaf else [0]
        if len(chosen) < 2:
            leaves += 1
            return leaves - 1
        node = Node(len(nodes), rows[at[chosen]], lift[at[chosen]])
        nodes.append(node)
        side = _distances(rows[at], lift[at], node).argmin(1)
        node.children = [grow(at[side == j]) for j in range(len(chosen))]
        return node

    grow(np.arange(len(rows)))
    return nodes, leaves


def route(nodes: list[Node], rows: np.ndarray, lift: np.ndarray, seen=None) -> np.ndarray:
    """The leaf of every row; ``seen(node, child, distances)`` for the rows under each child."""
    leaf = np.zeros(len(rows), np.int32)
    todo = [(nodes[0], np.arange(len(rows)))] if nodes else []
    while todo:
        node, at = todo.pop()
        d = _distances(rows[at], lift[at], node)
        side = d.argmin(1)
        for j, child in enumerate(node.children):
            mine = np.flatnonzero(side == j)
            if not len(mine):
                continue
            if seen:
                seen(node, j, d[mine])
            if isinstance(child, Node):
                todo.append((child, at[mine]))
            else:
                leaf[at[mine]] = child
    return leaf


def reached(nodes: list[Node], leaves: int, queries: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """[query, leaf]: may the leaf hold a row whose distance to the query lies
    in one of its annuli ``near``..``far`` ([query, window]; an empty window has
    ``near > far``)?"""
    out = np.zeros((len(queries), max(leaves, 1)), bool)
    slack = 1e-6 * (1 + np.sqrt((queries ** 2).sum(1)))
    if not nodes:
        out[:, 0] = (near <= far).any(1)
        return out
    todo = [(nodes[0], np.flatnonzero((near <= far).any(1)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        d = _distances(queries[at], np.zeros(len(at)), node)  # [q, i]
        s = slack[at][:, None]
        keep = np.zeros((len(at), len(node.children)), bool)
        for w in range(near.shape[1]):
            a, b = near[at, w][:, None], far[at, w][:, None]
            low = np.maximum(np.maximum(a - d, d - b), 0) - s - 1e-9 * d
            high = d + b + s + 1e-9 * d
            meets = (node.lo[None] <= high[:, :, None]) & (node.hi[None] >= low[:, :, None])  # [q, i, j]
            keep |= meets.all(1) & (a <= b)
        for j, child in enumerate(node.children):
            mine = at[keep[:, j]]
            if isinstance(child, Node):
                todo.append((child, mine))
            else:
                out[mine, child] = True
    return out


# ------------------------------------------------------------------ rows as arrays

VECTORS = "uid bigint, id bigint, label int, v binary, square double, wide double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """[row, component] as doubles; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    at = np.arange(dim)[None, :] < sizes[:, None]
    out[at] = flat
    return out


def narrowest(wide: float) -> str:
    """The smallest kind of number that holds all components."""
    return "<i2" if wide < 2 ** 15 else "<i4" if wide < 2 ** 31 else "<f8"


def _unpack(column: pa.Array, dim: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _binary(rows: np.ndarray, kind: str = "<f8") -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows, kind)], pa.binary())


def _integers(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = np.floor(scale * _matrix(batch.column("v"), dim))
            yield pa.record_batch([batch.column("uid"), batch.column("id"), batch.column("label"), _binary(rows),
                                   pa.array((rows ** 2).sum(1)), pa.array(np.abs(rows).max(1, initial=0.0))],
                                  names=["uid", "id", "label", "v", "square", "wide"])


def vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """The rows that take part, as integers, and the longest vector's length."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad))
    dim = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    numbered = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "label", "v")
    return stage(numbered.mapInArrow(functools.partial(_integers, dim=dim, scale=scale), VECTORS), "vectors"), dim


@dataclass
class Index:
    """The tree with its ranges, and all rows in blocks (``leaf, block, ids, labels, uids, m``)."""
    nodes: list[Node]
    leaves: int
    blocks: DataFrame
    n_blocks: list[int]
    rows: DataFrame
    dim: int
    longest: float
    kind: str


def _lift(square: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest - square, 0))


def _routed(batches: Iterator[pa.RecordBatch], nodes: list[Node], dim: int, longest: float, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = _unpack(batch.column("v"), dim)
            leaf = route(nodes, rows, _lift(batch.column("square").to_numpy(), longest))
            yield pa.record_batch([*[batch.column(c) for c in ("uid", "id", "label")], _binary(rows, kind), pa.array(leaf)],
                                  names=["uid", "id", "label", "v", "leaf"])


def _ranges(batches: Iterator[pa.RecordBatch], nodes: list[Node], dim: int, longest: float) -> Iterator[pa.RecordBatch]:
    """Distance ranges of this task's rows: a number of rows bounded by the tree."""
    lo = [np.full((len(n.points),) * 2, np.inf) for n in nodes]
    hi = [np.full((len(n.points),) * 2, -np.inf) for n in nodes]

    def seen(node, child, d):
        lo[node.number][:, child] = np.minimum(lo[node.number][:, child], d.min(0))
        hi[node.number][:, child] = np.maximum(hi[node.number][:, child], d.max(0))

    for batch in batches:
        if batch.num_rows:
            route(nodes, _unpack(batch.column("v"), dim), _lift(batch.column("square").to_numpy(), longest), seen)
    found = [(n, i, j, lo[n][i, j], hi[n][i, j]) for n in range(len(nodes)) for i, j in np.argwhere(lo[n] <= hi[n])]
    if found:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["node", "i", "j", "lo", "hi"])


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task to one row per (leaf, block)."""
    held: list[pa.RecordBatch] = []
    key = None

    def flush():
        t = pa.Table.from_batches(held)
        col = lambda c, kind: t.column(c).to_numpy().astype(kind).tobytes()
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                                *[pa.array([x], pa.binary()) for x in (col("uid", "<i8"), col("id", "<i8"), col("label", "<i4"),
                                                                     b"".join(t.column("v").to_pylist()))]],
                               names=["leaf", "block", "uids", "ids", "labels", "m"])

    for batch in batches:
        keys = np.stack([batch.column("leaf").to_numpy(), batch.column("block").to_numpy()], 1)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            now = tuple(int(x) for x in keys[a])
            if key is not None and now != key:
                yield flush()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def build_index(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                scale: int = SCALE, sample_rows: int = SAMPLE_ROWS, arity: int = ARITY, leaf_sample: int = LEAF_SAMPLE,
                block_rows: int = BLOCK_ROWS) -> Index:
    """Fit the tree on ``sample_rows`` rows at most, then index every row."""
    rows, dim = vectors(embeddings, id_col, vector_col, label_col, scale)
    n, longest, wide = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("square"), F.lit(0.0)), F.coalesce(F.max("wide"), F.lit(0.0))).first()
    if dim * wide * wide >= EXACT:
        raise ValueError("components are too large for exact inner products")
    # thinned before it is ordered, so that a task sends its share of the sample and no more
    drawn = F.xxhash64("uid").alias("h")
    some = rows.select(drawn, "uid", "v", "square").where(F.pmod("h", F.lit(max(n, 1))) < sample_rows + sample_rows // 4)
    sample = some.orderBy("h", "uid").limit(sample_rows).select("v", "square").collect()
    points = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), "<f8").reshape(-1, dim)
    nodes, leaves = fit(points, _lift(np.array([r["square"] for r in sample], np.float64), longest), arity, leaf_sample)
    tree, kind = dict(nodes=nodes, dim=dim, longest=longest), narrowest(wide)
    for node in nodes:
        node.lo, node.hi = (np.full((len(node.points),) * 2, x) for x in (np.inf, -np.inf))
    # at most arity ** 2 numbers a node, whatever the number of rows
    for r in (rows.mapInArrow(functools.partial(_ranges, **tree), "node int, i int, j int, lo double, hi double")
              .groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()):
        nodes[r["node"]].lo[r["i"], r["j"]], nodes[r["node"]].hi[r["i"], r["j"]] = r["lo"], r["hi"]
    routed = stage(rows.mapInArrow(functools.partial(_routed, **tree, kind=kind), "uid bigint, id bigint, label int, v binary, leaf int"), "routed")
    n_blocks = [1] * max(leaves, 1)
    for r in routed.groupBy("leaf").count().collect():
        n_blocks[r["leaf"]] = -(-r["count"] // block_rows)
    per_leaf = F.element_at(F.array(*[F.lit(n) for n in n_blocks]), F.col("leaf") + 1)
    blocked = (routed.withColumn("block", F.pmod(F.xxhash64("uid"), per_leaf).cast("int"))
               .repartition("leaf", "block").sortWithinPartitions("leaf", "block"))
    blocks = stage(blocked.mapInArrow(functools.partial(_packed, dim=dim),
                                      "leaf int, block int, uids binary, ids binary, labels binary, m binary"), "blocks")
    return Index(nodes, max(leaves, 1), blocks, n_blocks, routed, dim, longest, kind)


# ------------------------------------------------------------------ search

#: A query row: its own uid, vector and label, the leaf it lies in, and per
#: window a number, the scores from ``lo`` to ``hi`` and whether labels must
#: agree or differ.
WINDOWS = "array<struct<w: int, lo: bigint, hi: bigint, same: boolean>>"
FOUND = "uid bigint, w int, score bigint, found bigint, found_uid bigint"
NO_SCORE = 2 ** 62


def _annuli(batch: pa.RecordBatch, dim: int, longest: float, kind: str):
    q = _unpack(batch.column("v"), dim, kind)
    windows = batch.column("windows").to_pylist()
    width = max(map(len, windows), default=0) or 1
    near, far = np.full((len(q), width), 1.0), np.full((len(q), width), -1.0)
    base = (q ** 2).sum(1) + longest
    for i, ws in enumerate(windows):
        for k, w in enumerate(ws):
            if w["lo"] <= w["hi"]:
                far[i, k], near[i, k] = (np.sqrt(max(base[i] - 2.0 * w[c], 0)) for c in ("lo", "hi"))
    return q, near, far


def _parcels(batches: Iterator[pa.RecordBatch], nodes: list[Node], leaves: int, dim: int, longest: float, kind: str,
             probe: bool, n_blocks: list[int], size: int) -> Iterator[pa.RecordBatch]:
    """Per leaf that may hold results, the queries that go there: the own leaf
    (``probe``) or all others."""
    names = ["uid", "label", "v", "windows"]
    for whole in batches:
        for a in range(0, whole.num_rows, size):
            batch = whole.slice(a, size)
            q, near, far = _annuli(batch, dim, longest, kind)
            goes = reached(nodes, leaves, q, near, far)
            own = batch.column("leaf").to_numpy()
            at_home = np.zeros_like(goes)
            at_home[np.arange(len(own)), own] = True
            goes &= at_home if probe else ~at_home
            for leaf in np.flatnonzero(goes.any(0)):
                mine = batch.take(pa.array(np.flatnonzero(goes[:, leaf]))).select(names)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, mine.schema) as w:
                    w.write_batch(mine)
                blocks = n_blocks[leaf]
                yield pa.record_batch([pa.array([leaf] * blocks, pa.int32()), pa.array(range(blocks), pa.int32()),
                                       pa.array([sink.getvalue().to_pybytes()] * blocks, pa.binary())],
                                      names=["q_leaf", "q_block", "queries"])


def _first(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` by score, then id, then uid."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((uids[at], ids[at], -scores[at]))][:k]


def _searched(batches: Iterator[pa.RecordBatch], dim: int, kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """Exact scores of a parcel's queries against a block; the first ``k`` rows of each window."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_buffer()
            m, labels = np.frombuffer(get("m"), kind).reshape(-1, dim).astype(np.float64), np.frombuffer(get("labels"), "<i4")
            ids, uids = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("uids"), "<i8")
            queries = pa.ipc.open_stream(get("queries")).read_all().combine_chunks().to_batches()[0]
            q = _unpack(queries.column("v"), dim, kind)
            of, label = queries.column("uid").to_pylist(), queries.column("label").to_pylist()
            out = []
            windows = queries.column("windows").to_pylist()
            strip = max(1, STRIP * 1024 // max(len(m), 1))
            for a in range(0, len(q), strip):
                scores = np.rint(q[a:a + strip] @ m.T).astype(np.int64)
                for i, s in enumerate(scores, a):
                    asked = [w for w in windows[i] if w["lo"] <= w["hi"]]
                    if not asked:
                        continue
                    some = np.flatnonzero((s >= min(w["lo"] for w in asked)) & (s <= max(w["hi"] for w in asked)) & (uids != of[i]))
                    if not len(some):
                        continue
                    s, same = s[some], labels[some] == label[i]
                    for w in asked:
                        hit = np.flatnonzero((s >= w["lo"]) & (s <= w["hi"]) & (same == w["same"]))
                        if len(hit):
                            hit = hit[_first(s[hit], ids[some[hit]], uids[some[hit]], k)]
                            at = some[hit]
                            out += zip([of[i]] * len(hit), [w["w"]] * len(hit), s[hit].tolist(), ids[at].tolist(), uids[at].tolist())
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                      names=["uid", "w", "score", "found", "found_uid"])


def _visit(index: Index, queries: DataFrame, probe: bool, k: int) -> DataFrame:
    cut = functools.partial(_parcels, nodes=index.nodes, leaves=index.leaves, dim=index.dim, longest=index.longest, kind=index.kind,
                            probe=probe, n_blocks=index.n_blocks, size=PARCEL_QUERIES)
    parcels = queries.select("uid", "label", "v", "leaf", "windows").mapInArrow(cut, "q_leaf int, q_block int, queries binary")
    b = index.blocks
    # parcels repeat a query for each leaf that it visits, which Spark's estimate of their size can't know: no broadcast
    met = parcels.hint("merge").join(b, (F.col("q_leaf") == b["leaf"]) & (F.col("q_block") == b["block"]))
    return met.select("queries", "uids", "ids", "labels", "m").mapInArrow(functools.partial(_searched, dim=index.dim, kind=index.kind, k=k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "w").orderBy(F.col("score").desc(), "found", "found_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every window of every query (``uid, label, v,
    leaf, windows``): ``uid, w, rank, score, found, found_uid``.  The query's
    own row is never found.  Exact: nothing is cut but by ranges that rule a
    subtree out."""
    probed = stage(_ranked(_visit(index, queries, True, k), k), "probed")
    # k rows found: only as good ones can still come before them
    floors = (probed.where(F.col("rank") == k).groupBy("uid")
              .agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("floor")).withColumnRenamed("uid", "f_uid"))
    narrowed = queries.join(floors, F.col("uid") == F.col("f_uid"), "left").withColumn("windows", F.transform(
        "windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], F.try_element_at(F.col("floor"), w["w"])).alias("lo"),
                                      w["hi"].alias("hi"), w["same"].alias("same"))).cast(WINDOWS))
    rest = _visit(index, narrowed, False, k)
    return stage(_ranked(probed.drop("rank").select(*rest.columns).unionByName(rest), k), "found")


def mine(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, anchor_every: int = ANCHOR_EVERY,
         margin: tuple[int, int] = (80, 100), **fitting) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor (id divisible by ``anchor_every``) and
    each of its first positives, the first rows of another label whose score
    lies between the two percentages ``margin`` of the positive's.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part; a shorter vector ends in zeros, an empty one
    scores 0.  Ties go to the smaller id.  Every row stands for itself: a
    repeated row is another row, and an anchor that is there twice is mined
    twice.  Extra columns are ignored whatever their names; an empty table
    gives no rows.  Components so large that an inner product may not be exact
    as a double (2 ** 53) end the job with an error."""
    prepare(embeddings.sparkSession)
    index = build_index(embeddings, id_col, vector_col, label_col, **fitting)
    one = lambda lo, hi, same: F.array(F.struct(F.lit(0).alias("w"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                                                F.lit(same).alias("same"))).cast(WINDOWS)
    anchors = stage(index.rows.where(F.col("id") % anchor_every == 0).withColumn("windows", one(-NO_SCORE, NO_SCORE, True)), "anchors")
    positives = search(index, anchors, n_positives).select("uid", "rank", F.col("score").alias("positive_score"),
                                                           F.col("found").alias("positive_id"))
    low, high = margin
    # low * p <= 100 * s <= high * p in integers
    below = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")
    window = F.struct(F.col("rank").alias("w"), (-below(f"(-{low}L * positive_score)")).alias("lo"),
                      below(f"({high}L * positive_score)").alias("hi"), F.lit(False).alias("same"))
    windows = positives.groupBy("uid").agg(F.sort_array(F.collect_list(window)).cast(WINDOWS).alias("windows")).withColumnRenamed("uid", "w_uid")
    asked = stage(anchors.drop("windows").join(windows, F.col("uid") == F.col("w_uid")).drop("w_uid"), "asked")
    negatives = search(index, asked, n_negatives).select(F.col("uid").alias("n_uid"), "w", F.col("rank").alias("n_rank"),
                                                         F.col("score").alias("negative_score"), F.col("found").alias("negative_id"))
    named = anchors.select("uid", F.col("id").alias("anchor_id")).join(positives, "uid")
    return (named.join(negatives, (F.col("uid") == F.col("n_uid")) & (F.col("rank") == F.col("w")))
            .select("anchor_id", "positive_id", F.col("n_rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
