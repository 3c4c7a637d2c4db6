"""Word edit distance, sentence BLEU and word-set sizes over Arrow batches.

Spark partitions the (document, method) pairs and ships them to Python in
Arrow batches.  One pandas UDF returns a struct with every requested field, so
each pair crosses the JVM/Python boundary once however many of these metrics
are active.  The pairs of one document arrive together: its reference and all
its hypotheses are coded as numbers in one go, and n-grams are counted by
sorted arrays instead of one Python dictionary per pair.
"""

from __future__ import annotations

import math
import re
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode_tables import FOLDS_TO_ASCII, latin1_fold_table

# --- fixed values that must equal the evaluated system's behaviour ---------
# BLEU: up to 4-grams, uniform weights, smoothing "method 4" with k = 5.
BLEU_MAX_N = 4
BLEU_SMOOTH_K = 5
# ---------------------------------------------------------------------------

_WORD_RE = re.compile(r"\w+")


def _tokens(text: str) -> list[str]:
    return _WORD_RE.findall(text.lower())


def clipped_counts(ref: np.ndarray, hyps: list[np.ndarray]) -> np.ndarray:
    """[hypothesis, n - 1]: n-grams of each coded hypothesis that the reference
    holds too, each at most as often as there."""
    out = np.zeros((len(hyps), BLEU_MAX_N), np.int64)
    r, sizes = len(ref), [*map(len, hyps)]
    of = np.repeat(np.arange(len(hyps)), sizes)
    left = np.cumsum(sizes)[of] - np.arange(len(of))  # words from here to the end of its text
    codes = np.concatenate([ref, *hyps])
    grams, width = codes, int(codes.max()) + 1
    room = width  # the grams' numbers are below it
    for n in range(1, min(BLEU_MAX_N, r) + 1):
        if n > 1:
            if room * width >= 1 << 62:
                held, grams = np.unique(grams, return_inverse=True)
                room = len(held)
            # the (n - 1)-gram's number and the next word name the n-gram
            grams = grams[:-1] * width + codes[n - 1:]
            room *= width
        held, times = np.unique(grams[:r - n + 1], return_counts=True)
        own = np.flatnonzero(left[:len(grams) - r] >= n)
        mine = grams[r:][own]
        at = np.minimum(np.searchsorted(held, mine), len(held) - 1)
        hit = held[at] == mine
        if not hit.any():
            break  # no longer ones either
        met = np.bincount(of[own[hit]] * len(held) + at[hit], minlength=len(hyps) * len(held))
        out[:, n - 1] = np.minimum(met.reshape(len(hyps), len(held)), times).sum(axis=1)
    return out


def bleu_scores(ref_text: str, hyp_texts: list[str]) -> list[float]:
    """MET10: sentence BLEU (4-gram, uniform weights, smoothing method 4) of
    each text on ``\\w+`` tokens of the lower-cased texts; an empty side scores 0."""
    return bleu_of_tokens(_tokens(ref_text), [_tokens(t) for t in hyp_texts])


def bleu_of_tokens(ref: list, hyps: list[list]) -> list[float]:
    """:func:`bleu_scores` of texts that are tokens already."""
    if not ref or not any(hyps):
        return [0.0] * len(hyps)
    first, *coded = _numbered([ref, *hyps])
    return [_score(len(first), len(h), m) for h, m in zip(coded, clipped_counts(first, coded).tolist())]


def _numbered(texts: list[list]) -> list[np.ndarray]:
    """The texts' words as numbers, equal where the words are."""
    number = {w: i for i, w in enumerate(set().union(*texts))}
    return [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]


def _score(r: int, c: int, matches: list[int]) -> float:
    """BLEU of a hypothesis of ``c`` words from its clipped matches."""
    if not c or matches[0] == 0:
        return 0.0
    bp = 1.0 if c > r else math.exp(1 - r / c)
    logs = []
    inc = 1
    for n, m in enumerate(matches, 1):
        d = max(1, c - n + 1)
        if m == 0 and c > 1:
            p = (1 / (2 ** inc * BLEU_SMOOTH_K / math.log(c))) / d
            inc += 1
        else:
            p = m / d
        if p > 0:
            logs.append(math.log(p) / BLEU_MAX_N)
    return bp * math.exp(math.fsum(logs))


def bleu(ref_text: str, hyp_text: str) -> float:
    return bleu_scores(ref_text, [hyp_text])[0]


def _pattern_masks(a) -> tuple:
    peq: dict = {}
    bit = 1
    for w in a:
        peq[w] = peq.get(w, 0) | bit
        bit <<= 1
    return peq, len(a)


def word_edit_distance(a: list, b: list, masks: tuple | None = None) -> int:
    """Levenshtein distance between two token sequences, bit-parallel
    (Myers 1999, Hyyrö 2001): each token of ``b`` updates the whole column of
    ``a`` with a few big-integer operations, O(len(b) * len(a) / 64).

    Bits from ``m`` on are not kept clear in between (nothing flows down from
    them); the distance is read off the last column's differences."""
    if not a:
        return len(b)
    if not b:
        return len(a)
    peq, m = masks if masks is not None else _pattern_masks(a)
    find = peq.get
    mask = (1 << m) - 1
    pv, mv = mask, 0
    for w in b:
        eq = find(w)
        if eq is None:  # a token that ``a`` has not: all comparisons fail
            ph = ((mv | (mask ^ pv)) << 1) | 1
            pv = mask ^ (mask & (mv | ph))
            mv &= ph
        else:
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = ((mv | (mask ^ (xh | pv))) << 1) | 1
            pv = (((pv & xh) << 1) | (mask ^ (xv | ph))) & mask
            mv = ph & xv
    return len(b) + pv.bit_count() - mv.bit_count()


def _ends(a: list, b: list) -> tuple[int, int]:
    """Lengths of the beginning and of the rest's end that are equal."""
    most = min(len(a), len(b))
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), most)
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), most)
    return start, min(end, most - start)


def _distance_by_bounds(a: np.ndarray, b: np.ndarray) -> int | None:
    """The edit distance of two coded texts where a bound from below meets one from
    above, else None.

    Below: the words that the longer text has more of than the other.  Above: the
    places that differ, with equal lengths, or the difference in length where the
    shorter text is found in the longer one's order."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    width = int(max(a.max(), b.max())) + 1
    low = len(a) - int(np.minimum(np.bincount(a, minlength=width), np.bincount(b, minlength=width)).sum())
    if len(a) == len(b):
        return low if low == int(np.count_nonzero(a != b)) else None
    if low == len(a) - len(b):
        rest = iter(a.tolist())
        return low if all(w in rest for w in b.tolist()) else None
    return None


def word_error_rates(ref_text: str, hyp_texts: list[str]) -> list:
    """MET11: word edit distance / reference words; empty reference -> None.

    Equal beginnings and ends cost nothing: they are cut off before the rest is
    compared, where they outweigh a new table of the reference's tokens."""
    return rates_of_words(ref_text.split(), [t.split() for t in hyp_texts])


def rates_of_words(ref: list, hyps: list[list]) -> list:
    """:func:`word_error_rates` of texts that are words already."""
    if not ref:
        return [None] * len(hyps)
    masks, rates = None, []
    first, *coded = _numbered([ref, *hyps])
    for hyp, numbers in zip(hyps, coded):
        if (d := _distance_by_bounds(first, numbers)) is not None:
            rates.append(d / len(ref))
            continue
        masks = masks or _pattern_masks(ref)
        start, end = _ends(ref, hyp)
        if 4 * (start + end) >= len(ref):
            d = word_edit_distance(ref[start:len(ref) - end], hyp[start:len(hyp) - end])
        else:
            d = word_edit_distance(ref, hyp, masks)
        rates.append(d / len(ref))
    return rates


# field name -> (Spark type, function of a reference and its hypotheses)
PY_FIELDS = {
    "bleu_score": (T.DoubleType(), bleu_scores),
    "word_error_rate": (T.DoubleType(), word_error_rates),
}

_UDF_CACHE: dict = {}


def python_metrics(ref: Column, hyp: Column, fields: list[str]) -> Column:
    """One Arrow UDF computing every requested Python field as a struct."""
    fields = [f for f in PY_FIELDS if f in set(fields)]
    key = tuple(fields)
    if key not in _UDF_CACHE:
        schema = T.StructType([T.StructField(f, PY_FIELDS[f][0]) for f in fields])
        funcs = [(f, PY_FIELDS[f][1]) for f in fields]

        def run(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
            cols = {f: [] for f, _ in funcs}
            pairs = zip(refs.where(refs.notna(), ""), hyps.where(hyps.notna(), ""))
            for ref, own in groupby(pairs, key=lambda p: p[0]):
                texts = [h for _, h in own]
                for f, fn in funcs:
                    cols[f] += fn(ref, texts)
            return pd.DataFrame(cols)

        _UDF_CACHE[key] = F.pandas_udf(run, schema)
    return _UDF_CACHE[key](ref, hyp)


#: First byte of a text that is folded already (see ``text.fold_escaped``).
FOLDED_MARK = b"\\"


def fold_bytes_table() -> tuple[bytes, bytes]:
    """``latin1_fold_table`` for ``bytes.translate``: what becomes of each byte
    of a UTF-8 text that is re-read as Latin-1, and the bytes deleted."""
    source, target = (t.encode("latin-1") for t in latin1_fold_table())
    return bytes.maketrans(source[:len(target)], target), source[len(target):]


def _as_folded(word: str):
    """A word in Latin-1 bytes, as the folded table gives them; one that has no
    such bytes equals none of those and stays a string."""
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return word


def _phrase_pattern(phrase: str) -> bytes:
    """``(?iu)`` of an ASCII phrase for UTF-8 bytes: Java takes a few characters
    beyond ASCII for ASCII letters."""
    def one(ch):
        forms = {ch.lower(), ch.upper(), *(odd for odd, plain in FOLDS_TO_ASCII.items() if plain == ch.lower())}
        return b"(?:" + b"|".join(re.escape(f.encode()) for f in sorted(forms)) + b")"
    return b"".join(map(one, phrase))


def phrase_deleter(phrases: list[str]):
    """``text.delete_phrases`` of ASCII phrases on UTF-8 bytes: the patterns run
    where a search of bytes says that one may match."""
    patterns = [re.compile(_phrase_pattern(p)) for p in phrases]
    shortest = [p.lower().encode() for p in phrases if not any(q in p for q in phrases if q != p)]
    odd = [ch.encode() for ch in FOLDS_TO_ASCII]

    def delete(text: bytes) -> bytes:
        low = text.lower()
        if any(p in low for p in shortest) or (not text.isascii() and any(ch in text for ch in odd)):
            for p in patterns:
                text = p.sub(b"", text)
        return text
    return delete


def word_set(text: bytes, delete, table: bytes, deleted: bytes) -> set:
    """The distinct words of a text after phrase deletion and the legacy fold."""
    if text.startswith(FOLDED_MARK):
        return {_as_folded(w) for w in text[1:].decode("utf-8").split(" ") if w}
    return set(delete(text).translate(table, deleted).split())


_SET_SIZES: dict = {}


def set_sizes(ref: Column, hyps: list[Column], phrases: list[str]) -> Column:
    """``[|ref|, |hyp 1|, |ref ∩ hyp 1|, |hyp 2|, ...]`` of the word sets of a
    row's texts (see ``text.fold_escaped``): the reference is folded and split
    once a row, and only numbers come back."""
    key = tuple(phrases)
    if key not in _SET_SIZES:
        table, deleted = fold_bytes_table()
        delete = phrase_deleter(list(key))

        def run(*columns: pa.Array) -> pa.Array:
            rows = []
            for texts in zip(*(c.to_pylist() for c in columns)):
                first, *sets = (word_set(t, delete, table, deleted) for t in texts)
                sizes = [len(first)]
                for own in sets:
                    # most words of a good text are the reference's: what is left is small
                    sizes += len(own), len(own) - len(own - first)
                rows.append(sizes)
            return pa.array(rows, pa.list_(pa.int32()))

        _SET_SIZES[key] = F.arrow_udf(run, T.ArrayType(T.IntegerType()))
    return _SET_SIZES[key](*[c.cast("binary") for c in (ref, *hyps)])


def folded_words(text: bytes, delete, table: bytes, deleted: bytes) -> tuple[bytes, list]:
    """A text's words in order after phrase deletion and the legacy fold, and
    bytes that are equal only where the words are."""
    if text.startswith(FOLDED_MARK):
        return text, [_as_folded(w) for w in text[1:].decode("utf-8").split(" ") if w]
    folded = delete(text).translate(table, deleted).strip()
    return folded, folded.split()


def folded_tokens(key: bytes, words: list) -> list:
    """BLEU's tokens of :func:`folded_words`: the words, which hold word
    characters alone, but for texts with escapes."""
    if not key.startswith(FOLDED_MARK):
        return words
    return [_as_folded(t) for t in _tokens(" ".join(w if isinstance(w, str) else w.decode("latin-1") for w in words))]


#: Numbers of a row (the reference) and of each of its methods in ``pair_numbers``.
REF_SIZES, PAIR_SIZES = 2, 3

_PAIR_NUMBERS: dict = {}


def pair_numbers(ref: Column, hyps: list[Column], phrases: list[str], fields: list[str], sets: bool) -> Column:
    """A struct for a row's texts (see ``text.fold_escaped``): ``sizes`` holds
    ``|ref|`` and the reference's characters, then for each method ``|hyp|``,
    ``|ref ∩ hyp|`` (word sets; 0 without ``sets``) and its characters; the
    Python ``fields`` one score for each method.

    Each text is folded and split once however many metrics read it, equal
    texts of a row are scored once, and only numbers come back."""
    fields = [f for f in PY_FIELDS if f in set(fields)]
    key = (tuple(phrases), tuple(fields), sets)
    if key not in _PAIR_NUMBERS:
        table, deleted = fold_bytes_table()
        delete = phrase_deleter(list(phrases))

        def row(texts):
            own = [folded_words(t, delete, table, deleted) for t in texts]
            unlike = {k: i for i, k in enumerate(dict(own))}  # the reference is the first
            words = list(dict(own).values())
            chars = [sum(map(len, w)) + max(len(w) - 1, 0) for w in words]
            n = [(0, 0)] * len(words)
            if sets:
                first, *others = map(set, words)
                n = [(len(first), len(first)), *((len(o), len(o) - len(o - first)) for o in others)]
            nth = [unlike[k] for k, _ in own]
            sizes = [n[0][0], chars[0]]
            for i in nth[1:]:
                sizes += *n[i], chars[i]
            scores = []
            for f in fields:
                if f == "bleu_score":
                    tokens = [folded_tokens(k, w) for k, w in zip(unlike, words)]
                    found = bleu_of_tokens(tokens[0], tokens)
                else:
                    found = rates_of_words(words[0], words)
                scores.append([found[i] for i in nth[1:]])
            return sizes, *scores

        def run(*columns: pa.Array) -> pa.Array:
            rows = [row(texts) for texts in zip(*(c.to_pylist() for c in columns))]
            kinds = [pa.list_(pa.int32()), *[pa.list_(pa.float64())] * len(fields)]
            parts = zip(*rows) if rows else [[]] * len(kinds)
            return pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ["sizes", *fields])

        schema = T.StructType([T.StructField("sizes", T.ArrayType(T.IntegerType())), *[T.StructField(f, T.ArrayType(PY_FIELDS[f][0])) for f in fields]])
        _PAIR_NUMBERS[key] = F.arrow_udf(run, schema)
    return _PAIR_NUMBERS[key](*[c.cast("binary") for c in (ref, *hyps)])
