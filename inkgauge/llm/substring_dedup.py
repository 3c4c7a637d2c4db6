"""Substring deduplication on a compacted De Bruijn graph.

Edges are runs of ``WINDOW`` words.  An edge's minimizer (the smallest hash
of its runs of ``CORE`` words) is the same wherever the edge stands, and
neighbouring edges that share one minimizer form a path of up to ten edges:

1. Every text is cut into such paths.  Brought together by minimizer, a path
   with the same words as in its source (the smallest document that has the
   minimizer) does not branch and is compacted: one row with the source
   coordinates speaks for all its edges.
2. Only where a document's path differs from its source's - at the ends of
   copied passages and around edits - do single edges meet, by 128-bit keys.
3. An edge whose source is a smaller document than its own is removed with
   its words; edges whose source coordinates advance together are one
   repeated span.

Each document counts a path or an edge once.  Before anything is shuffled, a
task tells the documents it has seen itself: a path that a smaller document of
the task holds too goes straight to its document, and only the smallest one
stands for it; a minimizer under which many documents of the task have paths of
their own (where a common passage begins or ends) is declared branching, which
one row tells the others (:class:`Seen`).  A passage that a third of all
documents hold is therefore a few rows a task where it meets the others, and
its many documents are dealt by their own ids.  Texts are dealt by id once and
that exchange is reused.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, signed, slices, split_words, stage, window_hashes, word_hashes

WINDOW, CORE = 13, 4
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Cut:
    """The paths of a slice of documents, as flat arrays over its words."""

    def __init__(self, words: pa.Array, first: np.ndarray, window: int = WINDOW, core: int = CORE):
        sizes = np.diff(first)
        self.first, hashes = first, word_hashes(words)
        self.edge, self.core, span = window_hashes(hashes, window), window_hashes(hashes, core), window - core + 1
        n = len(self.edge)
        self.other = window_hashes(mix(hashes ^ OTHER), window)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inside = doc[:n] == doc[window - 1:] if n else np.empty(0, bool)
        # the leftmost smallest core of each edge
        best, at = self.core[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, span):
            rival = self.core[i:n + i]
            smaller = rival < best
            best[smaller], at[smaller] = rival[smaller], i
        core_at = np.arange(n) + at
        # paths: consecutive edges of one document with the same minimizer place
        starts = np.flatnonzero(inside & np.concatenate([[True], (core_at[1:] != core_at[:-1]) | ~inside[:-1] | (doc[1:n] != doc[:n - 1])]))\
            if n else np.empty(0, np.int64)
        ends = np.empty_like(starts)
        if len(starts):
            # a path ends before the next one starts, or at its document's last edge
            last = self.first[doc[starts] + 1] - window + 1
            ends = np.minimum(np.concatenate([starts[1:], [n]]), last)
        self.start, self.end, self.doc = starts, ends, doc[starts]
        self.minimizer = best[starts]
        # a path is shorter than two edges' words: its ends spell all of it
        self.content = mix(self.edge[starts] * np.uint64(3) + mix(self.edge[ends - 1] ^ OTHER)
                           + (ends - starts).astype(np.uint64) * OTHER + at[starts].astype(np.uint64)) if len(starts) else self.edge[:0]

    def place(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return at - self.first[doc]


#: Repeats in one slice that make a key worth remembering, and keys remembered.
HOT, REMEMBERED = 4, 100_000


class Seen:
    """Which keys a task has seen: the smallest document of each, exactly
    within a slice and for hot keys from slice to slice."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, int]] = {}
        self.open = np.empty(0, np.uint64)

    def branching(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the rows to send have a key ``a`` with many contents, and
        the keys for which that is news to the others."""
        keys, group, size = np.unique(a, return_inverse=True, return_counts=True)
        old = np.isin(keys, self.open)
        new = (size >= HOT) & ~old
        if len(self.open) < REMEMBERED:
            self.open = np.concatenate([self.open, keys[new]])
        return (old | new)[group], keys[new]

    def told(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the smaller document that holds its key (a, b) too and the
        place there; -1 where the row must be sent."""
        order = np.lexsort((ids, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        head = order[new]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        src, at = ids[head], pos[head]
        size = np.bincount(group, minlength=len(head))
        if self.known:
            for g in np.flatnonzero(np.isin(a[head], np.fromiter((k[0] for k in self.known), np.uint64, len(self.known)))):
                best = self.known.get((int(a[head[g]]), int(b[head[g]])))
                if best and best[0] < src[g]:
                    src[g], at[g] = best
        for g in np.flatnonzero(size >= HOT):
            key = int(a[head[g]]), int(b[head[g]])
            if key in self.known or len(self.known) < REMEMBERED:
                self.known[key] = int(src[g]), int(at[g])
        here = src[group] < ids
        return np.where(here, src[group], -1), np.where(here, at[group], -1), here


#: What a row is: to be met by its key; told by its own task where the key
#: stands before, or that its path branches; word to the others of a key that it branches.
SENT, TOLD, OPEN, WORD = range(4)


def _rows(names: list[str], keys: list[np.ndarray], ids: pa.Array, pos: np.ndarray, seen: Seen, branch: bool) -> pa.RecordBatch:
    src, at, here = seen.told(*keys, ids.to_numpy(), pos)
    kind = np.where(here, TOLD, SENT)
    columns = [*[pa.array(signed(k)) for k in keys], ids, pa.array(np.where(here, at, pos)), pa.array(src, mask=~here)]
    if branch:
        sent = np.flatnonzero(~here)
        many, news = seen.branching(keys[0][sent])
        kind[sent[many]] = OPEN
        word = [pa.array(signed(news)), *[pa.array(np.zeros(len(news), np.int64))] * 3, pa.nulls(len(news), pa.int64())]
        columns = [pa.concat_arrays([c, w]) for c, w in zip(columns, word)]
        kind = np.concatenate([kind, np.full(len(news), WORD)])
    return pa.record_batch([*columns, pa.array(kind, pa.int32())], names=[*names, "id", "pos", "src", "kind"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct (minimizer, content) with its first place, or
    with what this task has told it (:data:`SENT`)."""
    seen = Seen()
    for batch in slices(batches):
        cut = Cut(*split_words(batch.column("text")))
        order = np.lexsort((cut.start, cut.content, cut.minimizer, cut.doc))
        d, m, c = cut.doc[order], cut.minimizer[order], cut.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (c[1:] != c[:-1])
        order = order[new]
        yield _rows(["m", "c"], [cut.minimizer[order], cut.content[order]], batch["id"].take(pa.array(cut.doc[order])),
                    cut.place(cut.start[order], cut.doc[order]), seen, True)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column in a row, and each one's row."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _open_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct edges of each document's branching paths, as in :func:`_paths`."""
    seen = Seen()
    for batch in slices(batches):
        cut = Cut(*split_words(batch.column("text")))
        values, row = _lists(batch["branching"])
        hit, _ = _located([cut.doc, signed(cut.minimizer)], [row, values.to_numpy(zero_copy_only=False)])
        count = (cut.end - cut.start)[hit]
        at = np.repeat(cut.start[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        doc = np.repeat(cut.doc[hit], count)
        order = np.lexsort((at, cut.other[at], cut.edge[at], doc))
        d, h, v = doc[order], cut.edge[at[order]], cut.other[at[order]]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (v[1:] != v[:-1])
        order = order[new]
        at, doc = at[order], doc[order]
        yield _rows(["h", "v"], [cut.edge[at], cut.other[at]], batch["id"].take(pa.array(doc)), cut.place(at, doc), seen, False)


def _meet(batches: Iterator[pa.RecordBatch], keys: list[str], content: str | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, word first, then id: every document after a key's
    first is told the source coordinates.  Where its content differs from the
    source's, or word came, both are told that the path branches.

    Only the source's own rows of the last key, and its word, are kept between
    batches."""
    named = [*keys, content] if content else keys
    out_names = [*named, "id", "src", "pos", "branching"]
    held: pa.RecordBatch | None = None
    for batch in batches:
        kind = batch["kind"].to_numpy()
        done = (kind == TOLD) | (kind == OPEN)
        if done.any():  # told where they were read
            local = batch.filter(pa.array(done))
            yield pa.record_batch([*[local[k] for k in named], local["id"], pc.fill_null(local["src"], 0), local["pos"],
                                   pa.array(kind[done] == OPEN)], names=out_names)
            batch = batch.filter(pa.array(~done))
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = [batch[k].to_numpy() for k in keys]
        ids, pos = batch["id"].to_numpy(), batch["pos"].to_numpy()
        same = batch[content].to_numpy() if content else np.zeros(len(ids), np.int64)
        word = batch["kind"].to_numpy() == WORD
        first = np.ones(len(ids), bool)
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        group = np.cumsum(first) - 1
        # the source: the first row of the key that is no word
        least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group[~word], ids[~word])
        source = least[group]
        own = (ids == source) & ~word
        # a source may hold several contents: look each row's up among them
        hit, at = _located([group, same], [group[own], same[own]])
        hit, place = hit & ~own & ~word, pos[own][at] if own.any() else pos
        branches = ~own & ~hit & ~word
        open_group = np.zeros(group[-1] + 1, bool)
        open_group[group[branches | word]] = True
        told = hit | branches | (own & open_group[group])
        yield pa.record_batch([*[batch[k].filter(pa.array(told)) for k in named], pa.array(ids[told]), pa.array(source[told]), pa.array(place[told]),
                               pa.array(~hit[told])], names=out_names)
        last = group == group[-1]
        keep = last & own
        if (last & word).any():
            keep[np.flatnonzero(last & word)[0]] = True
        held = batch.filter(pa.array(keep))


def _find(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``values`` are in ``known`` and where."""
    order = np.argsort(known)
    at = np.searchsorted(known, values, sorter=order)
    at = order[np.minimum(at, len(known) - 1)] if len(known) else np.zeros(len(values), np.int64)
    return (known[at] == values if len(known) else np.zeros(len(values), bool)), at


def _located(values: list[np.ndarray], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which tuples (by columns) are among the known ones and where: found by
    one mixed number, then compared column by column."""
    def mixed(columns):
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = mix(out ^ c.astype(np.int64).view(np.uint64)) * OTHER
        return signed(out)
    hit, at = _find(mixed(values), mixed(known))
    for v, k in zip(values, known):
        if len(k):
            hit &= v == k[at]
    return hit, at


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())]))


def _fields(column: pa.Array, *names: str) -> list[np.ndarray]:
    """Row number and fields of all structs of a list column."""
    values, row = _lists(column)
    return [row, *[values.field(n).to_numpy(zero_copy_only=False) if len(row) else np.empty(0, np.int64) for n in names]]


def _removed_edges(batch: pa.RecordBatch, words: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the slice: does an edge with a smaller source begin here, and
    its source and place there."""
    gone, source, place = np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    d, m, c, src, pos = _fields(batch["paths"], "m", "c", "src", "pos")
    e, h, v, e_src, e_pos = _fields(batch["edges"], "h", "v", "src", "pos")
    if not len(d) and not len(e):
        return gone, source, place
    # only documents with a repeat are cut into paths again
    some = np.zeros(batch.num_rows, bool)
    some[d], some[e] = True, True
    sizes = np.diff(first)
    inside = np.repeat(some, sizes)
    cut = Cut(words.filter(pa.array(inside)), np.concatenate([[0], np.cumsum(sizes[some])]))
    back = np.flatnonzero(inside)  # word of the slice
    of_doc = np.flatnonzero(some)
    hit, at = _located([of_doc[cut.doc], signed(cut.minimizer), signed(cut.content)], [d, m, c])
    count = (cut.end - cut.start)[hit]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    where = back[np.repeat(cut.start[hit], count) + step]
    gone[where], source[where], place[where] = True, np.repeat(src[at[hit]], count), np.repeat(pos[at[hit]], count) + step
    if len(e):
        # edges lie inside a document: the last window - 1 words begin none
        doc = np.repeat(of_doc, sizes[some])[:len(cut.edge)]
        whole = np.arange(len(cut.edge)) + WINDOW <= cut.first[1:][np.repeat(np.arange(len(of_doc)), sizes[some])[:len(cut.edge)]]
        begins = np.flatnonzero(whole)
        hit, at = _located([doc[begins], signed(cut.edge[begins]), signed(cut.other[begins])], [e, h, v])
        where = back[begins[hit]]
        gone[where], source[where], place[where] = True, e_src[at[hit]], e_pos[at[hit]]
    return gone, source, place


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words of edges that have a smaller source; runs of removed
    edges whose source coordinates advance together are spans."""
    for batch in slices(batches):
        words, first = split_words(batch.column("text"))
        gone, source, place = _removed_edges(batch, words, first)
        begun = np.concatenate([np.zeros(WINDOW, np.int64), np.cumsum(gone)])
        keep = begun[WINDOW:] == begun[:-WINDOW]  # no removed edge among the last 13 begun
        kept_first = np.concatenate([[0], np.cumsum(keep)])[first]
        left = pa.ListArray.from_arrays(pa.array(kept_first, pa.int32()), words.filter(pa.array(keep)))
        kept = pc.binary_join(left, " ")
        shas = [hashlib.sha256(x).hexdigest() for x in kept.cast(pa.binary()).to_pylist()]
        at = np.flatnonzero(gone)
        doc = np.searchsorted(first, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(place[at]) != 1) | (np.diff(source[at]) != 0) | (np.diff(doc) != 0)
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(at)]])[:len(a)] - 1
        start = at[a] - first[doc[a]]
        spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, at[b] - first[doc[a]] + WINDOW, source[at[a]], place[at[a]])],
                                           names=[f.name for f in SPAN.value_type])
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc[a], minlength=batch.num_rows))])
        yield pa.record_batch([batch["id"], pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(kept_first)), kept, pa.array(shas, pa.string()),
                               pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), spans)],
                              names=["id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space), ``kept_sha256`` and ``spans`` (start,
    end, source_id, source_start; words).

    A word goes if a run of 13 words over it also starts in a document with
    a smaller id.  Null or empty text has no words; rows that repeat an id
    are one document and are each returned; a null id is smaller than none,
    so its row keeps all its words and is no source.  An empty table gives
    no rows.  Of several places in a source the first is named; texts are read
    whole, whatever their length; other columns are ignored whatever their
    names."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("id is not null")
    paths = known.mapInArrow(_paths, "m bigint, c bigint, id bigint, pos bigint, src bigint, kind int")
    # rows that are told already are dealt by their own document
    def dealt(rows, *keys):
        by = F.when(F.col("kind").isin(TOLD, OPEN), F.xxhash64("id")).otherwise(F.xxhash64(*keys))
        return rows.repartition(by).sortWithinPartitions(*keys, F.desc("kind"), "id")
    told = dealt(paths, "m").mapInArrow(
        functools.partial(_meet, keys=["m"], content="c"), "m bigint, c bigint, id bigint, src bigint, pos bigint, branching boolean")
    told = stage(told.groupBy("id").agg(
        F.collect_set(F.when(F.col("branching"), F.col("m"))).alias("branching"),
        F.collect_set(F.when(~F.col("branching"), F.struct("m", "c", "src", "pos"))).alias("paths")), "repeated_paths")

    # the texts are dealt by id once; every join below reuses that exchange
    edges = (known.join(told.where(F.size("branching") > 0).select("id", "branching"), "id")
             .mapInArrow(_open_edges, "h bigint, v bigint, id bigint, pos bigint, src bigint, kind int"))
    found = dealt(edges, "h", "v").mapInArrow(
        functools.partial(_meet, keys=["h", "v"], content=None), "h bigint, v bigint, id bigint, src bigint, pos bigint, branching boolean")
    found = found.groupBy("id").agg(F.collect_set(F.struct("h", "v", "src", "pos")).alias("edges"))
    whole = known.join(told.select("id", "paths"), "id", "left").join(found, "id", "left")
    lone = rows.where("id is null").select("id", "text", *[F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in ("paths", "edges")])
    kinds = ("id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string, "
             "spans array<struct<start:bigint,end:bigint,source_id:bigint,source_start:bigint>>")
    out = whole.mapInArrow(_remove, kinds).union(lone.mapInArrow(_remove, kinds))
    return out.withColumnRenamed("id", id_col)
