"""Main text of pages by site style trees.

The pages of one host are merged into a tree of style nodes: a node is the path of elements (with their
classes and ids, digits made equal) from the body down.  Its importance has two parts.
Presentation: the entropy, over the pages that have the node, of the sequences of children it was
seen with.  Content: one minus the mean entropy of the text blocks in it, where a block on one
page only has entropy 0 and one that stands on all m pages has entropy 1 (the logarithm to
base m of the number of its pages).  What a node repeats from page to page is
therefore unimportant; a text of its own on every page is important.

A page loses the branches whose importance is below the threshold, and those whose names and place
promise no article text: menus, footers, adverts, forms, comments and the like anywhere, and
what stands outside the article of a page that marks one.  Names are overruled where a branch so named holds the
page itself: most of the text that the tree calls important, with the article or heading in it.  An element that is
boilerplate by its own names (a comment, a teaser) or place marks no article.  On a host of less than MIN_PAGES
pages entropies say little, so names decide alone there; an article itself and plain text
elements inside it (paragraphs, headings, lists, tables, quotes) are never unimportant.

Page text: blocks in page order joined by one newline; character references decoded; white space in a
block, line breaks included, is one blank.  Edge cases: null or empty html has no text; null URLs
form one host of their own; broken or cut markup is read as far as it goes, and an end tag that is missing (of
a head, a select, a drawing) costs no text after it, but for script, style, textarea and title; copies of a page on a
host (equal html) count as one page in the tree and in MIN_PAGES, and each has its own row of the result; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import keep, lower_ascii, table

THRESHOLD = 0.5
#: Share of presentation in an importance.
PRESENTATION = 0.1
MIN_PAGES = 5
#: What lies outside the article of a page that marks one.
OUTSIDE = 0.4

NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
MARKS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
#: HTML's own lists.
RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
#: What runs to the end of the source if it isn't closed, as in browsers; what ends at an element of the page's text.
TEXT_ONLY = frozenset("script style textarea title".split())
ENDED = frozenset("svg math select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr article main section div center body html details summary address".split())
FLOW = re.compile(r"<(?:foreignobject|annotation-xml|desc|" + "|".join(sorted(PLAIN | {"nav", "aside", "header", "footer", "form"})) + r")(?![A-Za-z0-9:-])", re.I)
ENDS_P = PLAIN - {"body", "html"} | {"nav", "aside", "header", "footer", "form", "fieldset"}
BOILER_TAGS = frozenset("nav footer aside form header menu dialog button fieldset".split())
#: Words of a class, id or role that promise no article text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments reply replies respond disqus discussion"
    " related recommended share sharing social widget toolbar pagination pager search copyright legal disclaimer skip tags complementary contentinfo".split()
)
ARTICLE_WORDS = frozenset("articlebody".split())
#: What comes before a word that names a part or topic of the page and not the element itself; tags that are
#: boilerplate even if large; tags that a page as a whole holds.
MODIFIERS = frozenset("has have with without no not show hide enable disable category tag topic".split())
SURE_TAGS = BOILER_TAGS - {"form", "fieldset", "dialog"}
FRAMED = frozenset("h1 nav header footer main".split())


class Page:
    """Style nodes and text blocks of one page."""

    def __init__(self, source: str):
        #: (path, children's labels) of each node; (path, text) of each block.
        self.nodes: list[tuple[str, list[str]]] = []
        self.blocks: list[tuple[str, str]] = []
        #: Paths of the elements in page order, one for each element.
        self.opened: list[str] = []
        #: Raw elements that have no end tag from here on.
        self.unended: set[str] = set()
        self.path, self.open = "", [("", "", [])]  # tag, path, children of the open elements
        #: How often each tag is open.
        self.depth: dict[str, int] = {}
        #: Where a tag ends that goes on outside quotes at a mark (see ``_tag_end``); whether there is no > or flow element from here on.
        self.ends: dict[int, int] = {}
        self.no_end = self.no_flow = False
        text: list[str] = []
        at = 0
        while (start := source.find("<", at)) >= 0:
            text.append(source[at:start])
            at = start + 1
            if source.startswith("!--", at):
                at = source.find("-->", at + 3) + 3
                if at < 3:
                    at = len(source)
                continue
            m = NAME.match(source, at)
            if not m and not source.startswith(("!", "?"), at):
                if at == len(source):  # a lone < at the end
                    continue
                text.append("<")
                continue
            end = self._tag_end(source, m.end()) if m else self._find_end(source, at)
            if end < 0:
                if not m and source[at] == "?" or source.find("<", at) >= 0 or source.find(">", at) >= 0:
                    text.append("<")  # not a tag, as it has no end
                    continue
                at = len(source)  # cut off inside a tag
                continue
            at = end + 1
            if not m:
                continue
            tag, attributes = m[2].lower(), source[m.end() : end]
            if not m[1] and tag in RAW and not attributes.endswith("/"):
                at = self._raw_end(source, tag, at)
            elif tag in ("br", "hr", "wbr"):
                text.append(" " if tag == "br" else "")
            elif tag not in INLINE and tag not in VOID:
                self._end_block(text)
                self._close(tag) if m[1] else self._start(tag, attributes)
        text.append(source[at:])
        self._end_block(text)
        while len(self.open) > 1:
            self._pop()

    def _find_end(self, source: str, at: int) -> int:
        """The next >, or -1."""
        end = -1 if self.no_end else source.find(">", at)
        self.no_end = end < 0
        return end

    def _tag_end(self, source: str, at: int) -> int:
        """The > that ends a tag, outside quotes, or -1.  What was found from a mark on outside quotes is kept, so that tags
        without an end are read once and not once for each."""
        seen: list[int] = []
        end = -1
        while not self.no_end and (m := MARKS.search(source, at)):
            mark = m.start()
            if mark in self.ends:
                end = self.ends[mark]
                break
            seen.append(mark)
            if m[0] == ">":
                end = mark
                break
            close = source.find(m[0], mark + 1)
            if close < 0:
                break
            at = close + 1
        else:
            self.no_end = self.no_end or not seen
        for mark in seen:
            self.ends[mark] = end
        return end

    def _raw_end(self, source: str, tag: str, at: int) -> int:
        """Where the page goes on after a raw element's start tag; without an end tag only TEXT_ONLY takes all the rest."""
        begin = None if tag in self.unended else re.compile(f"</{tag}(?![A-Za-z0-9:-])", re.I).search(source, at)
        end = self._find_end(source, begin.end()) if begin else -1
        if end < 0:
            self.unended.add(tag)
        if tag in ENDED and not (self.no_flow and end < 0):
            flow = FLOW.search(source, at, begin.start() if end >= 0 else len(source))
            self.no_flow = not flow and end < 0
            if flow and (end < 0 or flow[0][1:].lower() not in ("foreignobject", "annotation-xml", "desc")):
                return flow.start()
        return end + 1 if end >= 0 else len(source) if tag in TEXT_ONLY else at

    def _end_block(self, text: list[str]) -> None:
        joined = " ".join(html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if joined:
            self.blocks.append((self.open[-1][1], joined))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in ENDS_P and self.open[-1][0] == "p":
            self._pop()
        for group in ("li",), ("dt", "dd"), ("td", "th"), ("tr",):
            if tag in group and self.open[-1][0] in group:
                self._pop()
        label = tag
        for name, *value in ATTRIBUTE.findall(attributes):
            if words := "".join(value).split():
                label += {"class": ".", "id": "#", "role": "@"}[name.lower()] + ".".join(re.sub(r"\d+", "0", w) for w in sorted(words)).replace(">", "")
        self.open[-1][2].append(label)
        path = f"{self.open[-1][1]}>{label}" if self.open[-1][1] else label
        self.opened.append(path)
        self.open.append((tag, path, []))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if self.depth.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        tag, path, children = self.open.pop()
        self.depth[tag] -= 1
        self.nodes.append((path, children))


#: Words of labels seen before, emptied at 16,384: a plain dictionary, which travels to the workers with the functions.
_WORDS: dict[str, frozenset[str]] = {}


def words_of(label: str) -> frozenset[str]:
    """Words of a label's names; what a modifier introduces (has-sidebar, no-comments, category-legal) says nothing of the element."""
    if label in _WORDS:
        return _WORDS[label]
    out: set[str] = set()
    for name in re.split(r"[.#@]", label.lower())[1:]:
        words = SPLIT.split(name)
        out.update(words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))])
    if len(_WORDS) >= 1 << 14:
        _WORDS.clear()
    return _WORDS.setdefault(label, frozenset(out))


def tag_of(label: str) -> str:
    return re.split(r"[.#@]", label, maxsplit=1)[0].lower()


def is_marked(label: str) -> bool:
    """Whether an element is marked as an article and its own names don't say otherwise."""
    words = words_of(label)
    return (tag_of(label) in ("article", "main") or bool(words & ARTICLE_WORDS)) and not words & BOILER_WORDS


def is_boiler(label: str, inside: bool) -> bool:
    """Whether tag or names promise no article text; ``inside`` an article a plain header belongs to it."""
    words = words_of(label)
    return bool(words & BOILER_WORDS) or tag_of(label) in BOILER_TAGS and not (tag_of(label) == "header" and inside and not words)


def branches(path: str) -> list[str]:
    labels = path.split(">") if path else []
    return [">".join(labels[: k + 1]) for k in range(len(labels))]


def outermost(paths: list[str]) -> list[str]:
    """The paths that lie in no other of them."""
    known = frozenset(paths)
    return [x for x in paths if not any(b in known for b in branches(x)[:-1])]


def frames(page: Page, low: frozenset[str]) -> frozenset[str]:
    """Branches that are the page itself whatever their names say, as a form around all of it: they hold over half of the
    text the tree calls important, and in it the heading, the navigation or the one article of the page."""
    held: dict[str, int] = {}
    total = 0
    for path, text in page.blocks:
        own = branches(path)
        if not any(b in low for b in own) and not any(tag_of(x) in SURE_TAGS for x in path.split(">")):
            total += len(text)
            for b in own:
                held[b] = held.get(b, 0) + len(text)
    large = {b for b, n in held.items() if 2 * n > total and is_boiler(b.rsplit(">", 1)[-1], False)}
    out = set()
    for frame in large:
        below = [x for x in page.opened if x.startswith(frame + ">")]
        if len(outermost([x for x in below if is_marked(x.rsplit(">", 1)[-1])])) == 1 or any(tag_of(x.rsplit(">", 1)[-1]) in FRAMED for x in below):
            out.add(frame)
    return frozenset(out)


def promise(path: str, has_article: bool, framed: frozenset[str] = frozenset()) -> float:
    """What the names on the path say: 0 for a branch that never is article text, 2 for plain text of an article, 1 for
    nothing, less outside an article.  The names of ``framed`` branches say nothing."""
    inside, at = False, ""
    for label in path.split(">"):
        at = f"{at}>{label}" if at else label
        if at in framed:
            continue
        if is_boiler(label, inside):
            return 0.0
        inside = inside or is_marked(label)
    if not inside:
        return OUTSIDE if has_article else 1.0
    last = path.rsplit(">", 1)[-1]
    return 2.0 if is_marked(last) or tag_of(last) in PLAIN and not re.search("[.#@]", last) else 1.0


def marks_article(page: Page, low: frozenset[str], framed: frozenset[str]) -> bool:
    """Whether the page marks its article: by one element, or by several that hold at least half of its important text
    (teasers of other pages hold less)."""
    marked = [b for b in page.opened if is_marked(b.rsplit(">", 1)[-1]) and promise(b, False, framed) > 0]
    outer = outermost(marked)
    if len(outer) < 2:
        return bool(outer)
    total, held, within = 0, 0, frozenset(outer)
    for path, text in page.blocks:
        if promise(path, False, framed) > 0 and not any(b in low and promise(b, False, framed) < 2 for b in branches(path)):
            total += len(text)
            held += len(text) * any(b in within for b in branches(path))
    return 2 * held >= total


def main_text(source: str, low: frozenset[str]) -> str:
    """Text of a page without the branches that ``low`` names."""
    page = Page(source)
    framed = frames(page, low)
    article = marks_article(page, low, framed)
    verdicts: dict[str, bool] = {}
    out = []
    for path, text in page.blocks:
        if path not in verdicts:
            verdicts[path] = promise(path, article, framed) >= THRESHOLD and not any(b in low and promise(b, article, framed) < 2 for b in branches(path))
        if verdicts[path]:
            out.append(text)
    return "\n".join(out)


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, path, kind, key): one row for every node (n), its sequence of children (s), and block of text (t) of every
    different page of a host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[dict]] = []
            for source in batch.column(1):
                page = Page(source.as_py() or "")
                seen = set()
                for path, children in page.nodes:
                    key = "s", hashlib.blake2b(">".join(dict.fromkeys(children)).encode(), digest_size=7).digest()
                    seen |= {(path, "n", 0), (path, key[0], int.from_bytes(key[1]))}
                seen |= {(path, "t", int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest())) for path, t in page.blocks if path}
                parts.append([dict(zip(("path", "kind", "key"), x, strict=True)) for x in sorted(seen)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(parts, part)], ["host", "page", "parts"])

    part = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("key", pa.int64())]))
    read_pages = pages.select("host", "html", F.md5("html").alias("page")).mapInArrow(read, "host string, page string, parts array<struct<path string, kind string, key long>>")
    # what was read of a page moves to its copies, not the page
    return read_pages.groupBy("host", "page").agg(F.first("parts").alias("parts")).select("host", F.inline("parts"))


def node_importance(rows: DataFrame) -> DataFrame:
    """(host, path, m, importance) from ``style_rows``: sums of c and c * ln c, so every step adds up in parts."""
    counts = rows.groupBy("host", "path", "kind", "key").agg(F.count("*").cast("double").alias("c"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.max("c").alias("most"))
    stat = sums.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "n", F.col("most"))).alias("m"),
        F.sum(F.when(F.col("kind") == "s", F.col("c"))).alias("sc"),
        F.sum(F.when(F.col("kind") == "s", F.col("cl"))).alias("scl"),
        F.sum(F.when(F.col("kind") == "t", F.col("c"))).alias("tc"),
        F.sum(F.when(F.col("kind") == "t", F.col("cl"))).alias("tcl"),
    )
    base = F.log(F.col("m"))
    shape = F.when(F.col("m") <= 1, 1.0).otherwise(F.least(F.lit(1.0), (F.log("sc") - F.col("scl") / F.col("sc")) / base))
    repeated = F.when(F.col("m") <= 1, 0.0).otherwise(F.col("tcl") / base)
    own = stat.select("host", "path", "m", shape.alias("shape"), F.coalesce("tc", F.lit(0.0)).alias("tc"), F.coalesce(repeated, F.lit(0.0)).alias("repeated"))
    labels = F.split("path", ">")
    branch = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), ">"))
    below = own.select("host", F.explode(branch).alias("path"), "tc", "repeated").groupBy("host", "path").agg(F.sum("tc").alias("tc"), F.sum("repeated").alias("repeated"))
    content = F.when(F.col("tc") > 0, 1 - F.col("repeated") / F.col("tc")).otherwise(1.0)
    return own.select("host", "path", "m", "shape").join(below, ["host", "path"]).select("host", "path", "m", (PRESENTATION * F.col("shape") + (1 - PRESENTATION) * content).alias("importance"))


def extract_text(pages: DataFrame, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    host = lower_ascii(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    weak = node_importance(style_rows(source)).where((F.col("importance") < threshold) & (F.col("m") >= MIN_PAGES))
    # kept as files, so that the planner knows their size: a short list travels to the pages, a long one makes both move
    low = keep(weak.groupBy(F.col("host").alias("site")).agg(F.collect_set("path").alias("low")), "low")
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType())]).add("text", T.StringType()).add("n_chars", T.LongType())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", frozenset(low.as_py() or ())) for x, low in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    joined = source.join(low, F.col("host") == F.col("site"), "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(extracted, schema)


def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_style_tree": op8_style_tree}
