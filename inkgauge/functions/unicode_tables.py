"""Character tables derived by rule from Python's ``unicodedata``.

Accent stripping is "decompose (NFD), drop non-spacing marks (Mn)".  Spark has
no Unicode normaliser, so we precompute, once on the driver, what that rule
does to every single character and express it with ``translate`` (one hash
lookup per character, JVM side).  A few characters strip to several: Hangul
syllables, whose parts follow from arithmetic, and the 43 of
:func:`long_forms`; only rows that hold one pay for them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache


#: Characters beyond ASCII that Java's case-insensitive match takes for an ASCII letter.
FOLDS_TO_ASCII = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def py_strip_char(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")


def _ranges_to_class(codes: list[int]) -> str:
    """Compress sorted code points into a Java/RE2 compatible class body."""
    out = []
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        lo, hi = codes[i], codes[j]
        out.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str, str]:
    """Return ``(from_chars, to_chars, multi_class)``.

    ``translate(c, from_chars, to_chars)`` maps each character to its
    mark-stripped base; characters in ``from_chars`` beyond ``len(to_chars)``
    are deleted (they strip to nothing).  ``multi_class`` is a regex class
    body of characters that strip to several characters.
    """
    single_from, single_to, delete, multi = [], [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            continue  # removed by the \p{Mn} pass
        stripped = py_strip_char(ch)
        if stripped == ch:
            continue
        if len(stripped) == 1:
            single_from.append(ch)
            single_to.append(stripped)
        elif not stripped:
            delete.append(ch)
        else:
            multi.append(cp)
    from_chars = "".join(single_from) + "".join(delete)
    to_chars = "".join(single_to)
    return from_chars, to_chars, _ranges_to_class(multi)


@lru_cache(maxsize=1)
def latin1_fold_table() -> tuple[str, str]:
    """``(from_chars, to_chars)`` folding one Latin-1 character the way the
    Python normaliser treats it after its escape codec: lower-case, strip
    marks, whitespace -> space, non-word characters deleted.  Every step is
    per character on Latin-1 text (NFC composes nothing there), so one
    ``translate`` replaces four passes.  Derived from ``str`` rules."""
    import re
    word, space = re.compile(r"\w"), re.compile(r"\s")
    mapped, deleted = [], []
    for code in range(256):
        ch = chr(code)
        folded = py_strip_char(ch.lower())
        if space.fullmatch(folded):
            out = " "
        elif len(folded) == 1 and word.fullmatch(folded):
            out = folded
        else:
            out = ""
        if out == ch:
            continue
        (mapped if out else deleted).append((ch, out))
    return "".join(c for c, _ in mapped) + "".join(c for c, _ in deleted), "".join(o for _, o in mapped)


HANGUL = (0xAC00, 0xD7A3)


@lru_cache(maxsize=1)
def long_forms() -> dict[str, str]:
    """The characters beside Hangul syllables that strip to several."""
    out = {}
    for cp in range(sys.maxunicode + 1):
        if not 0xD800 <= cp <= 0xDFFF and not HANGUL[0] <= cp <= HANGUL[1]:
            stripped = py_strip_char(chr(cp))
            if len(stripped) > 1:
                out[chr(cp)] = stripped
    return out
