"""Secret scan that knows assignments.

Three plain patterns give the base spans (kinds assign, access, hex).  On top of them a small
lexer reads source and configuration syntax into pairs of a name and a value, follows
constants (``KEY = "..."``, then ``password = KEY``; also joined by + or .), and scores every
literal by the most sensitive name it reaches and by its own look.  A literal that scores
enough and is not wholly in one base span becomes a span of the kind ``literal``; where a base span
ends inside a literal, both are reported, and redaction replaces them as one.

Offsets count code points, ends are exclusive.  Edge cases: null text is empty; empty texts have no
spans; equal rows give equal rows; texts of any length are read whole; an empty table gives no
rows; columns other than id and text are not read by ``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a whole run, as no shorter one can begin before
KINDS = ("assign", "access", "hex", "literal")

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`\n]*`'
#: A name is the whole run of its characters, less what can't begin one, so that no long word is tried again from each letter.
PAIR = re.compile(rf"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>{NAME}+)["'`]?\]?[ \t]*+(?:=>|:=|=(?![=~])|:(?![/:]))[ \t]*(?={QUOTED}|[A-Za-z0-9_$+/-])""")
TERM = re.compile(rf"(?P<quoted>{QUOTED})|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]+)")
JOIN = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'`A-Za-z_])")
ELEMENT = re.compile(rf"<(?P<name>{NAME})>(?P<value>[^<>\n]+)</(?P=name)>")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: What makes a name sensitive, alone or as two words in a row, and what makes it harmless.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8}
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("account", "key"): 0.9}
HARMLESS = {"count", "length", "len", "type", "name", "field", "label", "url", "uri", "path", "file", "prompt", "min", "max", "limit", "expiry", "expires", "policy", "hint", "title", "size"}
#: Whole forms that stand for a secret; variables and templates of one name.
STANDS_FOR = r"(?:(?:api|access|private|secret|db|user|auth|super|new|own)[_\- ]?)*(?:password|passwd|passphrase|pwd|pass|secret|key|token|credentials?|value)"
PLACEHOLDER = re.compile(
    r"(?i)(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|example|test|dummy|placeholder|redacted|example\.(?:com|org|net)"
    rf"|(?:my|your|example|(?:enter|insert|put|use|type)[_\- ](?:your|the|a))[_\- ]?{STANDS_FOR}(?:[_\- ]?(?:here|goes[_\- ]here))?"
    r"|<[^<>]*>|\$\{[^{}]*\}|\$\([^()]*\)|(?-i:\$[A-Z_][A-Z0-9_]*)|\{\{[^{}]*\}\}|%[A-Za-z_][A-Za-z0-9_]*%|%\([A-Za-z_]\w*\)s)"
)
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}(?:PRIVATE KEY|SECRET|CREDENTIAL)[A-Z ]{0,40}-----")
#: A key over several lines, which names itself; to its end line, or without one as far as its code goes.
PEM_BLOCK = re.compile(PEM.pattern + r"(?:[^-]*(?:-(?!----)[^-]*)*-----END [A-Z0-9 ]*-----|(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})+)")
#: The least weight of a name whose value can be of several words.
STRONG = 0.9
THRESHOLD = 0.5
#: Rows whose new texts are held at once.
ROWS = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three plain patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    alone = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([alone, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False))])


def literal_score(value: str, weight: float = 0.0) -> float:
    """0 for short values, placeholders, and several words unless the name's weight is STRONG; rises to 1 with length, kinds of
    characters and entropy; 1 for the head of a private key."""
    if PEM.search(value):
        return 1.0
    if len(value) < 6 or PLACEHOLDER.fullmatch(value.strip()) or weight < STRONG and re.search(r"\s", value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    return min(1.0, 0.25 * min(len(value), 16) / 16 + 0.25 * min(kinds, 3) / 3 + 0.5 * min(entropy, 3.5) / 3.5)


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]], list[str]]]:
    """(name, literals, names of constants) of every assignment; a literal is (value, start, end).  A literal without quotes
    goes on to the end of its run, other assignments included (``a=b=c``); once a sensitive name has such a literal, those
    of the names inside it end where the next name begins, so that a run is read twice, not once for each name."""
    weights: dict[str, float] = {}
    first = whole = -1  # ends of the runs that a name, and a sensitive name, hold to the end
    found = PAIR.finditer(text)
    m = next(found, None)
    while m:
        at, literals, names = m.end(), [], []
        following = next(found, None)
        if m["name"] not in weights:
            weights[m["name"]] = name_score(m["name"])
        if at < whole or at < first and not weights[m["name"]]:
            cut = following.start() if following and following.start() < max(whole, first) else max(whole, first)
            t = TERM.match(text, at, max(at, cut))
            value = t["bare"] if t else ""
            yield m["name"], [(value, t.start(), t.end())] if value else [], [value] if re.fullmatch(NAME, value) else []
            m = following
            continue
        while t := TERM.match(text, at):
            if t["bare"]:
                first = max(first, t.end())
                if weights[m["name"]]:
                    whole = max(whole, t.end())
            if t["quoted"] is not None:
                literals.append((t["quoted"][1:-1], t.start() + 1, t.end() - 1))
            elif not literals and not names and not re.fullmatch(NAME, t["bare"]):
                literals.append((t["bare"], t.start(), t.end()))
                break
            elif re.fullmatch(NAME, t["bare"]):
                names.append(t["bare"])
                literals.append((t["bare"], t.start(), t.end())) if not re.fullmatch(r"[A-Za-z_]+", t["bare"]) else None
            j = JOIN.match(text, t.end())
            if not j:
                break
            at = j.end()
        yield m["name"], literals, names
        m = following
    if "</" in text:
        for m in ELEMENT.finditer(text):
            yield m["name"], [(m["value"], m.start("value"), m.end("value"))], []


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name, at once or through constants."""
    if not ("=" in text or ":" in text or "</" in text or "-----BEGIN" in text):
        return []
    own: dict[str, list[tuple[str, int, int]]] = {}
    uses: dict[str, set[str]] = {}
    for name, literals, names in pairs(text):
        own.setdefault(name, []).extend(literals)
        uses.setdefault(name, set()).update(names)
    best: dict[tuple[int, int], float] = {}
    # each name once, with the weight of the most sensitive target that it reaches: the heaviest first
    seen: set[str] = set()
    for weight, target in sorted(((w, x) for x in own if (w := name_score(x))), reverse=True):
        todo = [target] if target not in seen else []
        seen.add(target)
        while todo:
            name = todo.pop()
            for value, start, end in own[name]:
                if value in own and value != name:  # a constant's name, not a literal
                    continue
                score = weight * literal_score(value, weight)
                if score >= threshold:
                    best[start, end] = max(score, best.get((start, end), 0.0))
            for other in uses[name]:
                if other in own and other not in seen:
                    seen.add(other)
                    todo.append(other)
    if "-----BEGIN" in text:
        known = list(best)
        for m in PEM_BLOCK.finditer(text):
            if not any(s <= m.start() and m.end() <= e for s, e in known):
                best[m.span()] = 1.0
    return [(s, e, x) for (s, e), x in sorted(best.items())]


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; both (start, kind, end) in order."""
    base = base_spans(text)
    more = [(s, 3, e) for s, e, _ in literal_spans(text) if not any(b[0] <= s and e <= b[2] for b in base)]
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in all_spans(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans for every row."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)])
    for name in ("n_assign", "n_access", "n_hex", "n_literal"):
        schema.add(name, T.LongType())
    schema.add("base_sha256", T.StringType()).add("spans", T.StringType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                base, spans = all_spans(value.as_py() or "")
                counts = Counter(k for _, k, _ in spans)
                row = [*(counts[k] for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)]
                for held, x in zip(out, row, strict=True):
                    held.append(x)
            numbers, texts = [pa.array(x, pa.int64()) for x in out[:4]], [pa.array(x, pa.string()) for x in out[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *texts], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The same rows with every span replaced by ``mark`` and the length counted again."""

    at = docs.columns.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                texts = (t.as_py() for t in rows.column(at))
                yield rows.set_column(at, rows.schema.field(at), pa.array([None if t is None else redacted(t, mark) for t in texts], rows.schema.field(at).type))

    out = docs.mapInArrow(cleaned, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
