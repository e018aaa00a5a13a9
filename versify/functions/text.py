"""Text cleaning and layout scalars (C1-C8, C12-C19) as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from versify.functions.rhyme import bound
from versify.functions.structure import strip_ws

# FIXED VALUES: character replacement table of the verse cleaner, in its order.
REPLACE_TABLE = {
    "ä": "a", "ā": "a", "â": "a", "ō": "o", "ö": "o", "ū": "u", "ī": "ì", "î": "i", "Ô": "O",
    "ë": "e", "ê": "e", "ě": "e", "ü": "u", "[": "", "]": "", "…": "...", "‘": "’", "\xa0": " ",
    "“": "«", "”": "»", "%": "", "&": "e", "*": "", "=": "", "_": "", "|": "", "~": "", "©": "",
    "\xad": "", "¯": "", "°": "'", "³": "", "·": "", "€": "", "„": "", "ར": "", "о": "o",
    "п": "n", "ə": "e", "ɔ": "o", "ı": "i", "―": "—", "ą": "o", "ˇ": "", "ç": "c", "å": "a",
    "E`": "È",
}

# FIXED VALUES: special token -> single character map of the char tokenizer, in order.
SPECIAL_TOKEN_MAP = {
    "<SONNET>": "¶", "\n\n<STANZA>\n\n": "\n\n", "<END>": "§",
    "<RHYME_A>": "Ⓐ", "<RHYME_B>": "Ⓑ", "<RHYME_C>": "Ⓒ", "<RHYME_D>": "Ⓓ", "<RHYME_E>": "Ⓔ",
    "<RHYME_F>": "Ⓕ", "<RHYME_G>": "Ⓖ", "<RHYME_H>": "Ⓗ", "<RHYME_I>": "Ⓘ", "<RHYME_J>": "Ⓙ",
    "<RHYME_K>": "Ⓚ", "<RHYME_L>": "Ⓛ", "<RHYME_M>": "Ⓜ", "<RHYME_N>": "Ⓝ", "<RHYME_O>": "Ⓞ",
    "<RHYME_P>": "Ⓟ", "<RHYME_Q>": "Ⓠ", "<RHYME_R>": "Ⓡ", "<RHYME_S>": "Ⓢ",
}

# FIXED VALUES: text patterns of the cleaning and marking rules (the pipe is literal in
# the two rhyme-prefix patterns; the syllable one spells out word characters).
FOOTNOTE_RE = r"\(\d+\)"
VERSE_FOOTNOTE_RE = r"\(\d{1,2}\)"
CONTINUATION_RE = r"\n\s{4}"
MERGED_LINE_LIMIT = 65
MERGED_SPLIT_RE = r"^(.*?[:;,.?!])\s+[A-Za-z]"  # first [:;,.?!] followed by blanks and a letter
FINETUNE_TITLE_RE = r"\d{1,}\.\s(.*)\."
FINETUNE_TITLE_TRIM_RE = r"^[\]\[»]+|[\]\[»]+$"
RHYME_MARKING_CHAR = r"(?m)^[Ⓐ-Ⓩ][ \t]+[^|\n]*\|[ \t]*"
RHYME_MARKING_SYLLABLE = r"(?m)^<RHYME_[A-Z]>[\p{L}\p{N}_]+\|\s*"


def _translate_args() -> tuple[str, str, list[tuple[str, str]]]:
    """Split the table by rule: one-to-one chars first, deletions after (translate
    deletes source chars without a partner), multi-char entries as replaces."""
    one, dele, multi = [], [], []
    for k, v in REPLACE_TABLE.items():
        if len(k) == 1 and len(v) == 1:
            one.append((k, v))
        elif len(k) == 1 and v == "":
            dele.append(k)
        else:
            multi.append((k, v))
    src = "".join(k for k, _ in one) + "".join(dele)
    dst = "".join(v for _, v in one)
    return src, dst, multi


TRANSLATE_SRC, TRANSLATE_DST, MULTI_REPLACE = _translate_args()


def clean_text(text: Column) -> Column:
    """C1 + C2: replacement table, then footnote marks ``(digits)`` removed.
    No replacement output is a later key, so one translate is equivalent."""
    out = F.translate(text, TRANSLATE_SRC, TRANSLATE_DST)
    for k, v in MULTI_REPLACE:
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, FOOTNOTE_RE, "")


def per_line(text: Column, fn) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), fn), "\n")


def clean_verse(text: Column) -> Column:
    """CRLF/LFCR to blanks, newline+4 blanks to one blank, (n)/(nn) off, lines stripped."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit(" ")), F.lit("\n\r"), F.lit(" "))
    t = F.regexp_replace(t, CONTINUATION_RE, " ")
    t = F.regexp_replace(t, VERSE_FOOTNOTE_RE, "")
    return per_line(t, strip_ws)


def format_structure(lines: Column) -> Column:
    """C4: 14 lines -> 4-4-3-3, 17 lines -> 4-4-3-3-3, otherwise one block."""

    def block(a: int, n: int) -> Column:
        return F.array_join(F.slice(lines, a, n), "\n")

    sonnet = F.concat_ws("\n\n", block(1, 4), block(5, 4), block(9, 3), block(12, 3))
    n = F.size(lines)
    return (
        F.when(n == 14, sonnet)
        .when(n == 17, F.concat_ws("\n\n", sonnet, block(15, 3)))
        .otherwise(F.array_join(lines, "\n"))
    )


def fix_merged_lines(text: Column) -> Column:
    """Non-blank stripped lines; a line over 65 chars is split once after the
    first ``[:;,.?!]`` followed by blanks and an ASCII letter; then C4."""
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda l: strip_ws(l) != ""), strip_ws)
    head_re = MERGED_SPLIT_RE

    def fix(line: Column) -> Column:
        head = F.regexp_extract(line, head_re, 1)
        tail = strip_ws(F.substring(line, F.length(head) + 1, 1 << 30))
        split = (F.length(line) > MERGED_LINE_LIMIT) & line.rlike(head_re)
        return F.when(split, F.array(strip_ws(head), tail)).otherwise(F.array(line))

    return format_structure(F.flatten(F.transform(lines, fix)))


def mark_stanzas(text: Column) -> Column:
    """Blank line -> blank line + <STANZA> + blank line."""
    return F.replace(text, F.lit("\n\n"), F.lit("\n\n<STANZA>\n\n"))


def add_title(text: Column, stem: Column) -> Column:
    """``<TITLE>stem</TITLE>`` and a blank line before the text."""
    return F.concat(F.lit("<TITLE>"), stem, F.lit("</TITLE>\n\n"), text)


def envelope(text: Column) -> Column:
    """``<SONNET>`` line before, ``<END>`` line after."""
    return F.concat(F.lit("<SONNET>\n"), text, F.lit("\n<END>"))


def markup(text: Column, stem: Column | None = None) -> Column:
    """Clean, mark stanzas, optional title, envelope (the post-processing chain)."""
    t = mark_stanzas(clean_text(strip_ws(text)))
    if stem is not None:
        t = add_title(t, stem)
    return envelope(t)


def to_special_chars(text: Column) -> Column:
    """Special tokens to single characters, in map order.  Each is searched only in texts that may hold it."""

    def replaced(t: Column, tokens: dict[str, str]) -> Column:
        for k, v in tokens.items():
            t = F.replace(t, F.lit(k), F.lit(v))
        return t

    rare = {k: v for k, v in SPECIAL_TOKEN_MAP.items() if re.fullmatch("<RHYME_[H-S]>", k)}
    often = {k: v for k, v in SPECIAL_TOKEN_MAP.items() if k not in rare}
    every = lambda t: F.when(t.rlike("<RHYME_[H-S]>"), replaced(t, rare)).otherwise(t)
    some = lambda t: F.when(t.contains("<"), bound(replaced(t, often), every)).otherwise(t)
    return bound(text, some)


def strip_char_rhyme_prefix(text: Column) -> Column:
    """Per line, drop ``Ⓧ suffix |`` prefixes of the char stream."""
    return F.regexp_replace(text, RHYME_MARKING_CHAR, "")


def strip_syllable_rhyme_prefix(text: Column) -> Column:
    """C14: per line, drop ``<RHYME_X>suffix|`` prefixes of the syllable stream."""
    return F.regexp_replace(text, RHYME_MARKING_SYLLABLE, "")


def remove_specials(text: Column, specials: list[str]) -> Column:
    """Delete every given special token string."""
    for s in specials:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def encode_newlines(text: Column) -> Column:
    """C17: CRLF -> LF, LF -> <NEWLINE>, plus a trailing <NEWLINE>."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("<NEWLINE>"))
    return F.concat(t, F.lit("<NEWLINE>"))


def decode_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("<NEWLINE>"), F.lit("\n"))


def finetune_title(filename: Column) -> Column:
    """Title from ``N. title.ext`` (greedy), brackets and » trimmed; null when no match."""
    pat = FINETUNE_TITLE_RE
    raw = F.regexp_extract(filename, pat, 1)
    trimmed = F.regexp_replace(raw, FINETUNE_TITLE_TRIM_RE, "")
    return F.when(filename.rlike(pat), trimmed)


def finetune_record(title: Column, text: Column) -> Column:
    """``<TITLE>`` + title + blank line + text (no closing tag)."""
    return F.concat(F.lit("<TITLE>"), title, F.lit("\n\n"), strip_ws(text))
