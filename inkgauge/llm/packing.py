"""Packing by minimum bin slack over the multiset of remaining lengths.

1. Documents are tokenised where they lie.  Each is cut into full windows
   and one remainder; every piece is written once with its checksum, its
   length and its number among the equal lengths of its task.
2. The counts per length (at most ``window`` numbers, whatever the corpus
   size) are all that the plan needs.  The largest remaining length opens a
   sequence; a bitset subset-sum over the remaining multiset finds the
   filling closest to capacity, backtracking gives the counts, and the
   pattern is used as often as the multiset allows.
3. A piece's rank among the equal lengths (prefix sums of the per-task
   counts) looks up its sequence and offset in the plan.

No text, token or piece is ever gathered in one place.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage

WINDOW = 2048
END_ID = 1
#: Bytes of text whose chunks are looked up together.
SLICE = 8 << 20
#: Letters whose lower case is one letter of the same kind, then plain ASCII
#: punctuation: the tokenizer's own pre-tokens, normalised alone as in place.
SIMPLE = r"([A-Za-zÀ-ÖØ-öø-ÿ]++)([.,%$&*#;:!?]*+)"
CHUNK = re.compile(f"^(?:{SIMPLE}|(.*))$", re.M)
#: The normalisation and splitting of the file that this rule is for.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PIECES = "pid int, {key} bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, nth bigint"


def by_words(tokenizer) -> bool:
    """Does the tokenizer split and normalise as :class:`WordTokens` takes for granted?"""
    made = json.loads(tokenizer.to_str())
    return made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER and not made["model"].get("dropout")


class Segments(dict):
    """pre-token (or odd chunk) -> number; the ids of all segments lie in a row."""

    def __init__(self):
        super().__init__({"": 0})
        self.fresh: list[str] = []
        self.flat, self.offsets = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def learn(self, ids_of) -> None:
        if self.fresh:
            new = [ids_of(x) for x in self.fresh]
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(new), np.uint32)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])
            self.fresh = []


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``flat[first:first + count]`` in a row."""
    at = np.repeat(first - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return flat[at]


class WordTokens(dict):
    """white-space free chunk -> number of its two segments (word, punctuation).

    The tokenizer drops white space and never merges across it, so a text's
    ids are its chunks' ids in a row.  Fresh chunks are taken apart in one
    pass over all of them.  At ``limit`` chunks or segments the half that was
    used most stays: memory is bounded, and hot words are tokenised once."""

    def __init__(self, tokenizer, limit: int = 400_000):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.tokenizer, self.limit = tokenizer, limit
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256)}
        self.simple = re.compile(SIMPLE + r"|[.,%$&*#;:!?]+")
        self.segments, self.fresh = Segments(), []
        self.parts, self.used = np.empty((0, 2), np.int64), np.empty(0, np.int64)

    def __missing__(self, chunk):
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n

    def ids(self, segment: str) -> list[int]:
        if self.simple.fullmatch(segment):
            return [t.id for t in self.tokenizer.model.tokenize(segment.translate(self.letters))]
        return self.tokenizer.encode(segment, add_special_tokens=False).ids

    def _learn(self) -> None:
        found = CHUNK.findall(b"\n".join(self.fresh).decode("utf-8", "replace"))
        words, marks, odd = zip(*found)
        # one letter stays one letter in lower case, so all words at once
        words = "\n".join(words).lower().split("\n")
        number = self.segments.__getitem__
        first = np.fromiter(map(number, [w or o for w, o in zip(words, odd)]), np.int64, len(words))
        second = np.fromiter(map(number, marks), np.int64, len(words))
        self.segments.learn(self.ids)
        self.parts = np.concatenate([self.parts, np.stack([first, second], 1)])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.fresh = []

    def _thin(self) -> None:
        """Keep the most used half of the chunks, and their segments."""
        names, keep = list(self), np.sort(np.argsort(-self.used, kind="stable")[:self.limit // 2])
        parts, old = self.parts[keep], self.segments
        needed, renumbered = np.unique(np.concatenate([[0], parts.ravel()]), return_inverse=True)
        count = (old.offsets[1:] - old.offsets[:-1])[needed]
        self.segments = Segments()
        of = list(old)
        self.segments.update({of[n]: k for k, n in enumerate(needed.tolist())})
        self.segments.flat = gather(old.flat, old.offsets[needed], count)
        self.segments.offsets = np.concatenate([[0], np.cumsum(count)])
        self.parts, self.used = renumbered[1:].reshape(-1, 2), self.used[keep] // 2
        self.clear()
        self.update({names[n]: k for k, n in enumerate(keep.tolist())})

    def look_up(self, chunks: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct ``chunks`` as they stand at ``at`` in a row,
        and the number of ids of each."""
        if max(len(self), len(self.segments)) > self.limit:
            self._thin()
        number = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.fresh:
            self._learn()
        index = number[at]
        self.used += np.bincount(index, minlength=len(self.used))
        of = self.parts[index].ravel()
        first, count = self.segments.offsets[of], np.diff(self.segments.offsets)[of]
        return gather(self.segments.flat, first, count), count.reshape(-1, 2).sum(1)


def _slice_ids(tokenizer):
    """texts -> all ids in a row, and where each text's ids end."""
    if not by_words(tokenizer):
        def whole(column: pa.Array):
            ids = [e.ids for e in tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.cumsum([0, *map(len, ids)])
        return whole
    table = WordTokens(tokenizer)

    def words(column: pa.Array):
        # ASCII white space alone, as in the chunks' definition; empty chunks have no ids
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.binary()).to_pylist()
        ids, counts = table.look_up(chunks, coded.indices.to_numpy())
        of_doc = split.offsets.to_numpy()
        return ids, np.concatenate([[0], np.cumsum(counts)])[of_doc - of_doc[0]]
    return words


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    ids_of, pid, nth = _slice_ids(Tokenizer.from_file(path)), TaskContext.get().partitionId(), {}
    end = np.array([end_id], "<u4")
    for batch in slices(batches, limit=SLICE):
        ids, until = ids_of(pc.fill_null(batch.column("text"), ""))
        rows = []
        for doc, a, b in zip(batch.column("key").to_pylist(), until[:-1], until[1:]):
            doc_ids = np.concatenate([ids[a:b].astype("<u4"), end])
            for start in range(0, len(doc_ids), window):
                piece = doc_ids[start:start + window]
                n = len(piece)
                nth[n] = nth.get(n, -1) + 1
                rows.append((pid, doc, start, n, zlib.crc32(piece.tobytes()), len(doc_ids), nth[n]))
        cols = list(zip(*rows))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["pid", "key", "start", "length", "ids_crc32", "doc_tokens", "nth"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` whose sum is largest within ``room``:
    bitset subset-sum (bit s: sum s can be reached) over bundles of 1, 2, 4,
    ... equal lengths, then backtracked."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, bundle = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(bundle, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, bundle = left - take, bundle * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, slots per sequence, offset)],
    by rising rank: the sequences of the whole corpus in a table whose size
    depends on ``window`` alone."""
    left, used = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0)
    out: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
    sequence = 0
    while left:
        head = max(left)
        rest = left | {head: left[head] - 1}
        pattern = fill({k: v for k, v in rest.items() if v}, window - head)
        pattern[head] = pattern.get(head, 0) + 1
        times, offset = min(left[k] // c for k, c in pattern.items()), 0
        for length in sorted(pattern, reverse=True):
            slots = pattern[length]
            out[length].append((used[length], sequence, slots, offset))
            used[length] += times * slots
            left[length] -= times * slots
            offset += length * slots
            if not left[length]:
                del left[length]
        sequence += times
    return out


def _place(batches: Iterator[pa.RecordBatch], table: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            at, rows = np.flatnonzero(lengths == length), table[int(length)]
            row = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
            nth = ranks[at] - row[:, 0]
            sequence[at], offset[at] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * length
        columns = {n: batch.column(n) for n in ("key", "start", "length", "ids_crc32", "doc_tokens")}
        columns["length"] = columns["length"].cast(pa.int64())
        yield pa.record_batch([*columns.values(), pa.array(sequence), pa.array(offset)],
                              names=[*columns, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place in sequences of ``window`` tokens.

    Columns: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.  A null or empty text is the end id alone; a
    null id is kept as null; each repeated row is a document of its own;
    extra columns are ignored; an empty table gives no rows.  Ties between
    equal lengths go by task and order of reading.  A file whose normaliser or
    pre-tokenizer is not the one that :class:`WordTokens` knows is used on
    whole texts."""
    cut = functools.partial(_cut, path=tokenizer_path, window=window, end_id=end_id)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(rows.mapInArrow(cut, PIECES.format(key="key")), "pieces")
    per_task = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``window`` rows reach the driver, whatever the corpus size
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = {k: np.array(v, np.int64) for k, v in plan(counts, window).items()}
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["pid", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    out = ranked.mapInArrow(functools.partial(_place, table=table),
                            "key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                            "sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", id_col)
