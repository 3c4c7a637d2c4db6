"""Pairwise text metrics as native Catalyst expressions.

Reference text (human transcription) and hypothesis (a method's output) are
both normalised strings.  Everything here is built from array and string
builtins, so it runs inside whole-stage code generation or the interpreted
higher-order-function evaluator, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_SPACE_CLASS, PY_WORD_CLASS

# --- fixed values that must equal the evaluated system's behaviour ---------
# "equal" threshold of the Jaccard index.
DEFAULT_THRESHOLDS = {"jaccard": 0.93}
# Repetition flag: phrases of 3 words, flagged when one occurs more than 3
# times; low uniqueness when distinct/total characters < 0.4, measured on the
# text padded to the maximum length.
REPETITION_PHRASE_WORDS = 3
REPETITION_THRESHOLD = 3
UNIQUENESS_THRESHOLD = 0.4
# ---------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Python ``str.split()`` on normalised text (single spaces, stripped):
    Spark's ``split('')`` is ``['']`` where Python gives ``[]``."""
    return F.array_remove(F.split(c, " "), "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def _ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def common_size(ref_set: Column, hyp_set: Column) -> Column:
    """|ref ∩ hyp| of two distinct word sets: what their union lacks of both
    sizes.  The metrics below take it ready made, so that a pair's sets meet
    once however many of them are active."""
    return F.size(ref_set) + F.size(hyp_set) - F.size(F.array_distinct(F.concat(ref_set, hyp_set)))


def _common(ref_set: Column, hyp_set: Column, common: Column | None) -> Column:
    return F.size(F.array_intersect(ref_set, hyp_set)) if common is None else common


def precision(ref_set: Column, hyp_set: Column, common: Column | None = None) -> Column:
    """MET12: |ref ∩ hyp| / |hyp| over word sets; empty hyp -> 0."""
    return _ratio_or_zero(_common(ref_set, hyp_set, common), F.size(hyp_set))


def recall(ref_set: Column, hyp_set: Column, common: Column | None = None) -> Column:
    """MET13: |ref ∩ hyp| / |ref| over word sets; empty ref -> 0."""
    return _ratio_or_zero(_common(ref_set, hyp_set, common), F.size(ref_set))


def jaccard(ref_set: Column, hyp_set: Column, common: Column | None = None) -> Column:
    """MET8: |ref ∩ hyp| / |ref ∪ hyp|; both empty -> 0."""
    union = F.size(F.array_union(ref_set, hyp_set)) if common is None else F.size(ref_set) + F.size(hyp_set) - common
    return _ratio_or_zero(_common(ref_set, hyp_set, common), union)


def ratios_of_sizes(n_ref: Column, n_hyp: Column, common: Column) -> dict[str, Column]:
    """MET8, MET12, MET13 of two word sets whose sizes are known."""
    return {"precision": _ratio_or_zero(common, n_hyp), "recall": _ratio_or_zero(common, n_ref),
            "jaccard_similarity": _ratio_or_zero(common, n_ref + n_hyp - common)}


def at_least(score: Column, threshold: float) -> Column:
    """MET2 / MET7 / MET9: the ``equal_*`` flags."""
    return score >= F.lit(threshold)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(bound)``: higher-order
    function lambdas re-evaluate captured expressions per element, so an
    expression used inside a lambda is bound through a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Code points that a word's number may take: from U+0100, the surrogates left out.
FIRST_CODE, SURROGATES, LAST_CODE = 0x100, (0xD800, 0x800), 0x10FFFF


def _code_point_string(tokens: Column, vocab: Column) -> Column:
    """Map every token to one private character (its vocabulary position) so
    a character edit distance is a token edit distance.  A vocabulary beyond
    the code points fails the job instead of decoding to something else."""
    def codes(v):
        def cp(w):
            pos = F.array_position(v, w) + F.lit(FIRST_CODE - 1)
            pos = F.when(pos >= SURROGATES[0], pos + SURROGATES[1]).otherwise(pos)
            return F.decode(F.unhex(F.lpad(F.hex(pos), 8, "0")), "UTF-32")
        room = LAST_CODE - FIRST_CODE - SURROGATES[1]
        return F.when(F.size(v) > room, F.raise_error(F.lit("word edit distance: more distinct words than code points"))
                      ).otherwise(F.array_join(F.transform(tokens, cp), ""))
    return let(vocab, codes)


#: Bands of the edit distance that are tried before the whole table.
EDIT_BANDS = (32, 512)


def word_edit_distance(ref_words: Column, hyp_words: Column) -> Column:
    """Levenshtein distance over words (insert / delete / substitute = 1).

    Spark's banded form costs the band times the length, so narrow bands go
    first; -1 says that the distance is larger."""
    vocab = F.array_distinct(F.concat(ref_words, hyp_words))
    pair = F.struct(_code_point_string(ref_words, vocab).alias("a"), _code_point_string(hyp_words, vocab).alias("b"))
    whole = lambda p: F.levenshtein(p["a"], p["b"])
    def banded(p):
        tries = [F.nullif(F.levenshtein(p["a"], p["b"], k), F.lit(-1)) for k in EDIT_BANDS]
        return F.coalesce(*tries, whole(p))
    return let(pair, banded)


def word_error_rate(ref_words: Column, hyp_words: Column) -> Column:
    """MET11: word edit distance / number of reference words.

    An empty reference has no defined rate: NULL instead of a job failure.
    """
    n = F.size(ref_words)
    return F.when(n > 0, word_edit_distance(ref_words, hyp_words).cast("double") / n)


def regex_tokens(c: Column) -> Column:
    """``re.findall(r'\\w+', text.lower())`` (BLEU tokenisation)."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{PY_WORD_CLASS}]+"), 0)


def has_repetition(c: Column, phrase_words: int = REPETITION_PHRASE_WORDS,
                   threshold: int = REPETITION_THRESHOLD) -> Column:
    """SCL16: non-overlapping ``phrase_words``-word phrases, scanned left to
    right; true when any phrase occurs more than ``threshold`` times.

    After sorting the phrases, "some phrase occurs > t times" is "some
    element equals the one t positions further on".
    """
    w = f"[{PY_WORD_CLASS}]"
    sp = f"[{PY_SPACE_CLASS}]"
    pattern = f"(?<!{w})(?:{w}+{sp}+){{{phrase_words - 1}}}{w}+(?!{w})"
    phrases = F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(pattern), 0))

    def repeated(p):
        n = F.size(p)
        return F.when(n > threshold, F.exists(F.sequence(F.lit(1), F.greatest(n - threshold, F.lit(1))),
                                              lambda i: F.element_at(p, i) == F.element_at(p, i + threshold))
                      ).otherwise(F.lit(False))
    return let(phrases, repeated)


def low_uniqueness(c: Column, max_chars: int | None = None, threshold: float = UNIQUENESS_THRESHOLD,
                   padded: bool = True) -> Column:
    """SCL17: distinct characters / length below ``threshold``.

    The text itself is measured (empty -> false).  With ``max_chars`` it is
    measured as if right-padded with spaces to that length (padding adds the
    space character and stretches the denominator).
    """
    chars = F.regexp_extract_all(c, F.lit("(?s)."), 0)
    distinct = F.size(F.array_distinct(chars))
    n = F.length(c)
    if not padded or max_chars is None:
        return F.when(n > 0, distinct / n < threshold).otherwise(F.lit(False))
    has_space = F.array_contains(chars, " ")
    distinct_padded = distinct + F.when((n < max_chars) & ~has_space, 1).otherwise(0)
    return distinct_padded / F.greatest(n, F.lit(max_chars)) < threshold


def repeated_text_flag(c: Column, max_chars: int | None = None) -> Column:
    """SCL18: 1 when the text both repeats a phrase and has low uniqueness."""
    return (has_repetition(c) & low_uniqueness(c, max_chars)).cast("int")
