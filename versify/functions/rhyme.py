"""Rhyme scalars as Column -> Column functions (all native expressions).

C9 normalize_word, C10 rhyme_suffix, C11 last_word, plus the letter rules of
the rhyme tagger (W1) and the pattern signature (W5) in array form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: vowels of the rhyme rule ('á' is deliberately absent).
RHYME_ACCENTED_VOWELS = "àèéìíòóùú"
PLAIN_VOWELS = "aeiou"

# Unicode blocks whose precomposed letters are folded to their base letter.
_FOLD_RANGES = ((0x00C0, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF))


def _accent_fold_table() -> tuple[str, str]:
    """Built by rule: every code point whose canonical decomposition is a base
    character followed only by combining marks maps to that base."""
    src, dst = [], []
    for lo, hi in _FOLD_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            d = unicodedata.normalize("NFD", ch)
            if len(d) > 1 and d[0] != ch and all(unicodedata.combining(c) for c in d[1:]):
                src.append(ch)
                dst.append(d[0])
    return "".join(src), "".join(dst)


ACCENT_SRC, ACCENT_DST = _accent_fold_table()

WORD_CHARS = r"\p{L}\p{N}_"


def strip_accents(col: Column) -> Column:
    """NFD + drop combining marks, for Latin, Greek and Cyrillic letters."""
    return F.regexp_replace(F.translate(col, ACCENT_SRC, ACCENT_DST), r"\p{Mn}", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_word(col: Column) -> Column:
    """Accents off, non-word characters off, lower case.  Plain ASCII words need the last only."""
    full = F.lower(F.regexp_replace(strip_accents(col), rf"[^{WORD_CHARS}\s]", ""))
    return F.when(col.rlike(r"[^A-Za-z0-9_\s]"), full).otherwise(F.lower(col))


def rhyme_suffix(word: Column) -> Column:
    """Rhyme suffix of a word.

    Last chunk after an apostrophe or hyphen; from its last accented vowel if
    any, else from the second-last plain vowel (or the only one), else the
    last three characters.
    """
    return F.get(rhyme_suffixes(F.array(word)), F.lit(0))


def rhyme_key(word: Column) -> Column:
    """Tagging key: the suffix with accents removed (accents do not matter)."""
    return normalize_word(rhyme_suffix(word))


def last_word_for_tagging(line: Column) -> Column:
    """C11: strip trailing non-word characters except straight apostrophes,
    then take the last whitespace token ('' when there is none)."""
    cleaned = F.when(F.right(line, F.lit(1)).rlike(rf"[^{WORD_CHARS}']"), F.regexp_replace(line, rf"[^{WORD_CHARS}']+$", "")).otherwise(line)
    # it ends with a word, so what follows its last blank is the last token
    return F.coalesce(F.substring_index(F.translate(cleaned, "\t\n\x0b\f\r", " " * 5), " ", -1), F.lit(""))


def last_word(line: Column) -> Column:
    """Last whitespace token of a line, unmodified ('' when there is none)."""
    tokens = F.regexp_extract_all(line, F.lit(r"\S+"), 0)
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))


def letter_from_a(n: Column) -> Column:
    """n-th new rhyme (0-based) of a section that starts at A: A..G, then C..G again."""
    return F.when(n < 7, F.char(65 + n)).otherwise(F.char(67 + (n - 7) % 5))


def letter_from_c(n: Column) -> Column:
    """n-th new rhyme (0-based) of a section that starts at C: C..G cycling."""
    return F.char(67 + n % 5)


def pattern_signature(symbols: Column) -> Column:
    """Relabel an array of symbols by first occurrence (A, B, C, ...; code points from 65 on, without an end)."""
    firsts = F.array_distinct(symbols)

    def label(symbol: Column) -> Column:
        point = F.lit(64) + F.array_position(firsts, symbol)
        wide = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")  # ``char`` wraps at 256
        return F.when(point < 256, F.char(point)).otherwise(wide)

    return F.array_join(F.transform(symbols, label), "")


def rhyme_suffixes(words: Column) -> Column:
    """C10 over an array of words, staged so that every step runs once per
    element (lambda bodies are interpreted and get no common-subexpression
    elimination).  Later rules are only tried where earlier ones found nothing."""
    acc = RHYME_ACCENTED_VOWELS
    apart = lambda w: F.replace(F.replace(F.lower(w), F.lit("’"), F.lit("'")), F.lit("-"), F.lit("'"))
    chunks = F.transform(words, lambda w: F.substring_index(apart(w), "'", -1))

    def from_accent(c: Column) -> Column:
        return F.regexp_extract(F.regexp_replace(c, rf"[^{WORD_CHARS}\s{acc}]", ""), f"[{acc}][^{acc}]*$", 0)

    def from_vowels(norm: Column) -> Column:
        # from the second-last vowel, or the only one
        found = F.regexp_extract(norm, "[aeiou][^aeiou]*(?:[aeiou][^aeiou]*)?$", 0)
        return F.when(norm.rlike("[aeiou]"), found).otherwise(F.regexp_extract(norm, ".{0,3}$", 0))

    def suffix(c: Column) -> Column:
        accented = lambda norm: F.when(norm == "", F.lit("")).when(c.rlike(f"[{acc}]"), from_accent(c)).otherwise(from_vowels(norm))
        return F.when(c == "", F.lit("")).otherwise(bound(normalize_word(c), accented))

    return F.transform(chunks, suffix)
