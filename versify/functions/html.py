"""HTML extraction scalars over the ``pages`` table (H1-H9), regex based.

Scripts, styles and comments are dropped first.  Paragraph rule: a paragraph is the
content between an opening ``<p ...>`` and the next ``</p>`` (dot matches newlines); its
style is read from its own tag alone.  Leaf list items are ``<li>`` contents up to the
next ``<li``, ``</li>`` or ``<ul``, of which the innermost counts.  Character references
are all decoded, named, decimal and hexadecimal.
"""

from __future__ import annotations

import re

from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from versify.functions.structure import strip_ws

HREF_RE = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""
HIDDEN_RE = r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script>|<style(?:\s[^>]*)?>.*?</style>"
PARA_RE = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
LI_RE = r"(?is)<li(?:\s[^>]*)?>((?:(?!<li|<ul|</ul).)*?)</li>"
STYLED_RE = r"""(?is)<p\s(?:[^>]*?\s)?style\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?</p>"""
STYLE_RE = r"""(?is)^<p\s(?:[^>]*?\s)?style\s*=\s*("[^"]*"|'[^']*')"""
BR_RE = r"(?i)<br\s*/?>"
TITLE_NUMBER_RE = r"^\d+\.\s"
# FIXED VALUE: style of verse paragraphs on the original site.
VERSE_STYLE_RE = r"margin-left:\d+\.\d+\w{1,}.+text-indent\:\d{1,}\.\d{1,}\w{1,}"

WS = r"[\s\x{a0}]"


def links(html: Column) -> Column:
    """H1: every anchor href, quoted either way or not at all, in page order."""
    return F.regexp_extract_all(html, F.lit(HREF_RE), 1)


def paragraphs(html: Column, style_re: str | None = None) -> Column:
    """H6: paragraph bodies; with ``style_re`` only those whose own style matches it
    (the synthetic pages have plain ``<p>``, so it is optional)."""
    shown = F.regexp_replace(html, HIDDEN_RE, "")
    if style_re is None:
        return F.regexp_extract_all(shown, F.lit(PARA_RE), 1)
    styled = F.regexp_extract_all(shown, F.lit(STYLED_RE), 0)
    fitting = F.filter(styled, lambda p: F.regexp_extract(p, STYLE_RE, 1).rlike(style_re))
    return F.transform(fitting, lambda p: F.regexp_extract(p, PARA_RE, 1))


# The named references of HTML, from the standard library; one literal map once the plan is folded.
_NAMES = "\x02".join(f"{name[:-1]}\x01{char}" for name, char in html5.items() if name.endswith(";"))
_REFERENCE = r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def unescape(text: Column) -> Column:
    """Every character reference decoded: named, decimal and hexadecimal."""

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        point = F.when(name.startswith("#"), digits.cast("int"))
        wrong = (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
        char = F.when(wrong, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        names = F.str_to_map(F.lit(_NAMES), F.lit("\x02"), F.lit("\x01"))
        shown = F.when(name.startswith("#"), char).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(shown, F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

    pieces = F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
    return F.when(F.instr(text, "&") > 0, F.array_join(pieces, "")).otherwise(text)


def lift_breaks_out_of_sup(p: Column) -> Column:
    """H7 first step: each ``<sup>`` is replaced by the ``<br>``s it held
    (footnotes are dropped, their line breaks kept)."""
    pieces = F.split(p, "(?i)</sup>", -1)
    n = F.size(pieces)

    def fix(piece: Column, i: Column) -> Column:
        head = F.regexp_replace(piece, r"(?is)<sup(?:\s[^>]*)?>.*$", "")
        inner = F.regexp_extract(piece, r"(?is)<sup(?:\s[^>]*)?>(.*)$", 1)
        brs = F.repeat(F.lit("<br>"), F.size(F.regexp_extract_all(inner, F.lit(BR_RE), 0)))
        return F.when(i < n - 1, F.concat(head, brs)).otherwise(piece)

    return F.array_join(F.transform(pieces, fix), "")


def paragraph_texts(ps: Column) -> Column:
    """H7: breaks become newlines, tags go, references decode, blanks collapse; per paragraph."""

    def marked(p: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(lift_breaks_out_of_sup(p), BR_RE, " ||BR|| "), r"<[^>]*>", "")

    def laid_out(t: Column) -> Column:
        t = strip_ws(F.regexp_replace(t, rf"{WS}+", " "))
        return F.replace(F.replace(t, F.lit(" ||BR|| "), F.lit("\n")), F.lit("||BR||"), F.lit(""))

    return F.transform(ps, lambda p: laid_out(unescape(marked(p))))


def title_from_paragraphs(html: Column) -> Column:
    """H4: first paragraph whose text, without its footnotes, starts with ``N. ``."""
    bare = F.transform(paragraphs(html), lambda p: F.regexp_replace(F.regexp_replace(p, r"(?is)<sup(?:\s[^>]*)?>.*?</sup>", ""), r"<[^>]*>", " "))
    texts = F.transform(bare, lambda t: strip_ws(F.regexp_replace(unescape(t), rf"{WS}+", " ")))
    return F.try_element_at(F.filter(texts, lambda t: t.rlike(TITLE_NUMBER_RE)), F.lit(1))


def title_from_list(html: Column) -> Column:
    """H5: first leaf list item whose text has `` . ``; rebuilt as ``head. rest``.  Every piece of text
    between tags is stripped before the pieces are joined, footnotes included."""
    items = F.regexp_extract_all(F.regexp_replace(html, HIDDEN_RE, ""), F.lit(LI_RE), 1)
    joined = F.transform(items, lambda x: F.array_join(F.transform(F.split(x, r"<[^>]*>", -1), strip_ws), ""))
    texts = F.transform(joined, lambda t: strip_ws(F.regexp_replace(unescape(t), rf"{WS}+", " ")))
    hit = F.try_element_at(F.filter(texts, lambda t: F.instr(t, " . ") > 0), F.lit(1))
    pos = F.instr(hit, " . ")
    return F.when(hit.isNotNull(), F.concat(F.substring(hit, 1, pos - 1), F.lit(". "), F.substring(hit, pos + 3, 1 << 30)))


def page_title(html: Column, url: Column) -> Column:
    return F.coalesce(title_from_paragraphs(html), title_from_list(html), F.concat(F.lit("Unknown_Title_"), url))


def normalize_url(url: Column) -> Column:
    """H3: https scheme (also where there was none), no query or fragment, ``/_X.HTM`` -> ``/__X.HTM`` for letters of any script."""
    base = F.regexp_replace(url, r"(?s)[?#].*$", "")
    rest = F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    https = F.concat(F.when(rest.startswith("//"), "https:").when((rest == "") | rest.startswith("/"), "https://").otherwise("https:"), rest)
    return F.regexp_replace(https, r"(?iu)/_([\p{L}\p{N}_]+).HTM$", "/__$1.HTM")


def container(html: Column, element_id: str, tag: str = "div") -> Column:
    """H1: the first ``tag`` element with this id, from its own start tag up to its own end tag, however deep elements of the
    same kind nest inside; open to the end if it isn't closed; null if there is none."""
    quoted = re.escape(element_id)
    wanted = rf"""(?is)^<{tag}\s(?:[^>]*?\s)?id\s*=\s*(?:"{quoted}"|'{quoted}'|{quoted}(?=[\s>]))"""
    # every part but the first begins with a start or end tag of that kind
    parts = F.split(F.regexp_replace(html, HIDDEN_RE, ""), rf"(?i)(?=<{tag}[\s>])|(?=</{tag}[\s>])", -1)
    start = F.struct(*[F.lit(v).alias(n) for n, v in (("at", 0), ("first", -1), ("depth", 0), ("end", -1))])

    def step(a: Column, part: Column) -> Column:
        begins, ends = part.rlike(rf"(?i)^<{tag}[\s>]"), part.rlike(rf"(?i)^</{tag}")
        inside = (a["first"] >= 0) & (a["end"] < 0)
        opens = (a["first"] < 0) & part.rlike(wanted)
        depth = F.when(opens, 1).when(inside & begins, a["depth"] + 1).when(inside & ends, a["depth"] - 1).otherwise(a["depth"])
        end = F.when(inside & ends & (a["depth"] == 1), a["at"]).otherwise(a["end"])
        return F.struct((a["at"] + 1).alias("at"), F.when(opens, a["at"]).otherwise(a["first"]).alias("first"), depth.alias("depth"), end.alias("end"))

    def cut(both: Column) -> Column:
        found, own = both["found"], both["parts"]
        size = F.when(found["end"] < 0, F.size(own)).otherwise(found["end"]) - found["first"]
        return F.when(found["first"] >= 0, F.array_join(F.slice(own, F.greatest(found["first"], F.lit(0)) + 1, F.greatest(size, F.lit(0))), ""))

    bound = F.transform(F.array(parts), lambda own: F.struct(F.aggregate(own, start, step).alias("found"), own.alias("parts")))
    return F.get(F.transform(bound, cut), F.lit(0))


def _nfc_series(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


_NFC = None


def nfc(col: Column) -> Column:
    """NFC normalisation (no native Spark function); an Arrow-batched pandas UDF,
    created on first use so importing the package needs no session."""
    global _NFC
    if _NFC is None:
        _NFC = F.pandas_udf(_nfc_series, "string")
    return _NFC(col)


def safe_filename(title: Column, is_valid: Column) -> Column:
    """H9: NFC, path separators and colons rewritten, reserved and control chars dropped."""
    name = nfc(strip_ws(title))
    name = F.replace(F.replace(F.replace(name, F.lit("/"), F.lit("-")), F.lit("\\"), F.lit("-")), F.lit(":"), F.lit(" - "))
    name = F.regexp_replace(name, r'[<>:"|?*\x00-\x1F]', "")
    fname = F.concat(F.when(name == "", F.lit("untitled")).otherwise(name), F.lit(".txt"))
    return F.when(is_valid, fname).otherwise(F.concat(F.lit("[CHECK] "), fname))
