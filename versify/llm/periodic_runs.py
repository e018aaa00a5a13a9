"""Runs of repeated words by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring
word extends and that is at least 2 * q and ``least`` words long.  For every power of two L each
position gets the name of the L words that begin there; equal stretches have equal names, and
the names for 2 * L come from pairs of names for L.  A run whose period is from L up to 2 * L has
equal names at its start and one period later.  Those successor occurrences, within twice L,
form arithmetic progressions: occurrences at most L / 2 apart belong to one stretch with that
shorter period, so a run can begin only at the head of a progression or have the head of one a
period later.  Each such pair whose words before it differ proposes a period; its common extension
is read off the names from the longest down, and of proposals for one stretch the shortest period
stays.  Only names that occur again in their text go on to 2 * L, so plain text costs two or three levels.

Words are runs of anything but blank, tab, newline, vertical tab, form feed and return, compared
exactly.  Edge cases: null text is empty; texts without runs have an empty list and keep all
words; equal rows and null ids give rows like any other; texts of any length are read whole, each in one task;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import WORD, doc_bytes, spread, table, word_spans

LEAST = 12
SLICE = 1 << 20


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return words.dictionary_encode().indices.to_numpy()[0::2].astype(np.int64)


def renamed(key: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names by position (-1 where the key occurs once), and the positions that have one, ordered by name and position."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    twice = np.bincount(group)[group] > 1 if len(own) else new
    names = np.full(size, -1, np.int64)
    by = at[order][twice]
    names[by] = group[twice]
    return names, by, group[twice]


def proposals(by: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with one name, from ``length`` to twice that apart, of which one is the head of a progression."""
    line = name * (4 * (int(by.max()) + length + 1)) + by  # names in rows that no window leaves
    head = np.r_[True, (name[1:] != name[:-1]) | (2 * (by[1:] - by[:-1]) > length)]
    first, second = [], []
    at = np.flatnonzero(head)
    lo, hi = np.searchsorted(line, line[at] + length), np.searchsorted(line, line[at] + 2 * length)
    first.append(np.repeat(at, hi - lo))
    second.append(spread(lo, hi - lo))
    lo, hi = np.searchsorted(line, line[at] - 2 * length, "right"), np.searchsorted(line, line[at] - length, "right")
    i, j = spread(lo, hi - lo), np.repeat(at, hi - lo)
    inner = ~head[i]  # the others are there already
    first.append(i[inner])
    second.append(j[inner])
    return by[np.concatenate(first)], by[np.concatenate(second)]


def find_runs(word: np.ndarray, edges: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts laid end to end, by start and period.  ``edges``: first word of each text
    and the number of all words."""
    n = len(word)
    nothing = np.zeros(0, np.int64)
    if not n:
        return nothing, nothing, nothing
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    limit = edges[1:][doc]
    letter = doc * (int(word.max()) + 1) + word  # words of different texts differ
    names, by, name = renamed(letter, np.arange(n), n)
    levels, found, length = [], [], 1
    while len(by):
        levels.append(names)
        i, j = proposals(by, name, length)
        open_ = (i == edges[doc[i]]) | (letter[i - 1] != letter[j - 1])
        found.append((i[open_], j[open_]))
        at = np.sort(by)
        at = at[at + 2 * length <= limit[at]]
        at = at[names[at + length] >= 0]
        names, by, name = renamed(names[at] * n + names[at + length], at, n)
        length *= 2
    if not found:
        return nothing, nothing, nothing
    start, again = (np.concatenate(x) for x in zip(*found, strict=True))
    period, common = again - start, np.zeros(len(start), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            a, b = start + common, again + common
            inside = np.flatnonzero(b < limit[start])
            x = levels[k][a[inside]]
            same = inside[(x >= 0) & (x == levels[k][b[inside]])]
            common[same] += 1 << k
    long = (common >= period) & (common + period >= least)
    start, period, end = start[long], period[long], (again + common)[long]
    order = np.lexsort((period, end, start))
    start, period, end = start[order], period[order], end[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, period, end = start[new], period[new], end[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def kept_words(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word stays when every run is cut to its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period of each, by start and period; words count from 0) and collapsed (the text
    with every run cut to its first period, words joined by one blank) for every row."""
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("runs", T.ArrayType(run)).add("collapsed", T.StringType())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in doc_bytes(batch.column(1), SLICE):
                begin, stop, edges = word_spans(data, offsets)
                start, end, period = find_runs(word_names(data, begin, stop), edges, least)
                kept = kept_words(len(begin), start, end, period)
                # the words that stay, each with a blank before it but for the first of a text
                size = np.where(kept, stop - begin, 0)
                words = np.r_[0, np.cumsum(kept)][edges]
                sizes = (size + 1)[kept]
                text = np.full(int(sizes.sum()), 32, np.uint8)
                into = np.cumsum(sizes) - sizes + 1
                text[spread(into, sizes - 1)] = data[spread(begin[kept], sizes - 1)]
                bounds = np.r_[0, np.cumsum(sizes)][words]
                joined = [text[s + 1 : e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                owner = np.searchsorted(edges, start, "right") - 1
                lists = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(start - edges[owner]), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(lists), parts), pa.array(joined, pa.binary()).cast(pa.string())], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(found, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(key)


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, where texts of a hash class get words that repeat: with h = crc32 of the id and
    g = h div 10, if h mod 10 is 0 each word i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8)."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"]])

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = zlib.crc32(str("" if own is None else own).encode())
                words = re.findall(WORD, text.as_py() or "") if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts.append(" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)))
                else:
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(planted, schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = longest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
