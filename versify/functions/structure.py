"""Stanza structure and per-document evaluation.

Every function here works on one document's text in array form, so a whole
evaluation is a single projection (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versify.functions.rhyme import last_word, pattern_signature, rhyme_suffixes
from versify.functions.syllable import is_valid_hendecasyllable

# FIXED VALUES: allowed rhyme patterns (signatures by first occurrence).
ALLOWED_OCTAVE_PATTERNS = ("ABBAABBA", "ABABABAB", "ABBABAAB", "ABABBABA")
ALLOWED_SESTET_PATTERNS = ("ABABAB", "ABAABA", "ABCABC", "ABCBAC", "ABCACB")
ALLOWED_QUATRAIN_PATTERNS = ("ABBA", "ABAB", "BAAB", "BABA")
ALLOWED_TERCET_PATTERNS = ("ABA", "BAB", "ABC", "BAC", "ACB")
# FIXED VALUES: stanza line counts accepted by the closed-list check.
CLOSED_STRUCTURES = ("4-4-3-3", "4-4-3-3-3", "4-4-3-3-3-3")


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` only removes blanks)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def _is_marker_or_blank(line: Column) -> Column:
    """blank line or a line that starts with '<'."""
    return ~line.rlike(r"\S") | line.startswith("<")


def block_counts(text: Column) -> Column:
    """Line counts of the stanzas split on blank lines (F4/F5 flavour)."""
    stanzas = F.split(strip_ws(text), r"\n\s*\n", -1)
    return F.transform(
        F.filter(stanzas, lambda s: strip_ws(s) != ""), lambda s: F.size(F.split(s, "\n", -1))
    )


def check_structure(text: Column) -> Column:
    """first two stanzas of 4 lines, every later one of 3, at least four."""
    c = block_counts(text)
    return (
        (F.size(c) >= 4)
        & (F.try_element_at(c, F.lit(1)) == 4)
        & (F.try_element_at(c, F.lit(2)) == 4)
        & F.forall(F.slice(c, 3, 1 << 30), lambda x: x == 3)
    )


def validate_structure(text: Column) -> Column:
    """closed list 4-4-3-3, 4-4-3-3-3, 4-4-3-3-3-3."""
    return F.array_join(block_counts(text), "-").isin(*CLOSED_STRUCTURES)


def eval_text(text: Column) -> Column:
    """Envelope off, trimmed, then the newline placeholder expanded."""
    t = F.replace(F.replace(text, F.lit("<SONNET>"), F.lit("")), F.lit("<END>"), F.lit(""))
    return F.replace(strip_ws(t), F.lit("<NEWLINE>"), F.lit("\n"))


def eval_lines(t: Column) -> Column:
    """Verse lines: non-blank, not starting with '<' (tested before trimming), trimmed."""
    return F.transform(F.filter(F.split(t, "\n", -1), lambda l: ~_is_marker_or_blank(l)), strip_ws)


def stanza_lengths(t: Column) -> Column:
    """Verse lines per stanza (split on exact blank lines), empty stanzas dropped."""
    stanzas = F.filter(F.transform(F.split(t, "\n\n", -1), strip_ws), lambda s: s != "")
    lengths = F.transform(stanzas, lambda s: F.size(F.filter(F.split(s, "\n", -1), lambda l: ~_is_marker_or_blank(l))))
    return F.filter(lengths, lambda n: n > 0)


def line_suffixes(lines: Column) -> Column:
    """Evaluation rhyme key per line: raw suffix of the last word (accents matter)."""
    return rhyme_suffixes(F.transform(lines, last_word))


def rhyme_scheme(suffixes: Column) -> Column:
    """Letters by first occurrence of the suffix, no wrap."""
    return pattern_signature(suffixes)


def rhymed_line_count(suffixes: Column) -> Column:
    """A10: lines whose suffix occurs more than once in the document."""
    return F.size(F.filter(suffixes, lambda s: F.size(F.filter(suffixes, lambda t: t == s)) > 1))


def valid_stanza_count(suffixes: Column, lengths: Column) -> Column:
    """W6 + J5: walk the stanzas with a running offset into the scheme."""

    def stanza_ok(n: Column, i: Column) -> Column:
        offset = F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x)
        sig = pattern_signature(F.slice(suffixes, offset + 1, n))
        quatrain = (i < 2) & (n == 4) & sig.isin(*ALLOWED_QUATRAIN_PATTERNS)
        tercet = (i >= 2) & (n == 3) & sig.isin(*ALLOWED_TERCET_PATTERNS)
        return F.when(quatrain | tercet, 1).otherwise(0)

    return F.aggregate(F.transform(lengths, stanza_ok), F.lit(0), lambda a, x: a + x)


def evaluate_structure(text: Column, strict: bool = False) -> Column:
    """The nine evaluation metrics of one text, as a struct."""
    t = eval_text(text)
    lines = eval_lines(t)
    lengths = stanza_lengths(t)
    suffixes = line_suffixes(lines)
    line_count = F.size(lines)
    is_14 = line_count == 14
    valid_stanzas = valid_stanza_count(suffixes, lengths)
    total_stanzas = F.size(lengths)
    valid_hendeca = F.size(F.filter(lines, lambda l: is_valid_hendecasyllable(l, strict)))
    octave = pattern_signature(F.slice(suffixes, 1, 8))
    sestet = pattern_signature(F.slice(suffixes, 9, 1 << 30))
    is_valid_sonnet = (
        is_14
        & (F.size(suffixes) == 14)
        & (valid_hendeca == 14)
        & octave.isin(*ALLOWED_OCTAVE_PATTERNS)
        & sestet.isin(*ALLOWED_SESTET_PATTERNS)
    )
    return F.struct(
        is_14.alias("is_14_lines"),
        (F.array_join(lengths, "-") == "4-4-3-3").alias("is_correct_structure"),
        (is_14 & (total_stanzas == 4) & (valid_stanzas == 4)).alias("is_valid_stanzas"),
        valid_stanzas.cast("long").alias("valid_stanzas"),
        total_stanzas.cast("long").alias("total_stanzas"),
        is_valid_sonnet.alias("is_valid_sonnet"),
        rhymed_line_count(suffixes).cast("long").alias("rhyme_lines"),
        line_count.cast("long").alias("line_count"),
        valid_hendeca.cast("long").alias("valid_hendecasyllables"),
    )
