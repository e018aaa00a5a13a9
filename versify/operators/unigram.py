"""Unigram language-model tokenizer on Spark.

Words are whitespace pieces of the newline-encoded text with a ``▁`` word
mark (user symbols such as ``<NEWLINE>`` and the specials stay atomic).  All
work is on the table of *distinct* words, in Column expressions:

* a word's lattice is one array of edges in order of their ends; the piece table,
  bounded by ``SEEDS`` and the characters, goes with the tasks that make it;
* the E-step sums over the positions forwards and backwards (sums of logarithms), many
  words at a time in ``lattice``, of which the folds here are the reference form; a task
  sums its expected counts per piece, the M-step is one aggregate of these;
* between the rounds the table shrinks by ``SHRINK``: pieces go whose loss of
  likelihood is least when their best other segmentation takes their counts;
* encoding is the same fold with the best instead of the sum, and back-pointers;
* n-best lists are merged position by position, and a draw takes one of a
  word's ``N_BEST`` with weight ``p ** alpha`` by a hash-seeded number;
* tasks encode and draw whole documents, the distinct words of many at a time.

Pieces have at most ``MAX_LEN`` characters, a parameter of the model; words of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.operators import lattice as L
from versify.operators.bpe import ROWS, SUBWORD_SPECIALS

WORD_MARK = "▁"
USER_SYMBOLS = [*SUBWORD_SPECIALS[1:], "<NEWLINE>"]
UNK = "<unk>"
# FIXED VALUES: the surveyed trainer's parameters (longest piece, seeds, share kept by a round, rounds of EM between two prunings, n-best).
MAX_LEN = 16
SEEDS = 1_000_000
SHRINK = 0.75
SUB_ITERATIONS = 2
N_BEST = 64
# An unknown character scores so much below the least piece.
UNKNOWN_PENALTY = 10.0
# Words of documents that are encoded at once, and draws of words.
WORDS, DRAWS = 1 << 20, 1 << 24
# Words or pieces of which a task of the training makes the lattices.
ROWS_OF_TASK = 20_000


def unigram_words(text: Column) -> Column:
    """Newline-encoded text cut into atomic user symbols and ``▁``-marked words."""
    safe = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(" <NEWLINE> "))
    alt = "|".join(s.replace("[", r"\[").replace("]", r"\]") for s in USER_SYMBOLS)
    toks = F.regexp_extract_all(safe, F.lit(rf"{alt}|\S+"), 0)
    return F.transform(toks, lambda t: F.when(t.isin(*USER_SYMBOLS), t).otherwise(F.concat(F.lit(WORD_MARK), t)))


def word_freqs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    w = docs.select(F.explode(unigram_words(F.col(text_col))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("freq"))


def substrings(words: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(word, freq, n, s, e, piece): every substring of up to ``max_len`` characters, from position s to e."""
    n = F.length("word")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda s: F.transform(F.sequence(s + 1, F.least(s + F.lit(max_len), n)), lambda e: F.struct(s.alias("s"), e.alias("e"))),
        )
    )
    cut = words.where(n > 0).select("word", "freq", n.alias("n"), F.inline(spans))
    return cut.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")))


def seed_pieces(words: DataFrame, size: int = SEEDS, max_len: int = MAX_LEN) -> DataFrame:
    """(piece, count): all single characters and the substrings that occur twice or more; beyond ``size`` those with the largest
    product of count and length."""
    plain = words.where(~F.col("word").isin(*USER_SYMBOLS))
    summed = lambda cut: cut.groupBy("piece").agg(F.sum("freq").cast("double").alias("count"))
    counts, chars = summed(substrings(plain, max_len)), summed(substrings(plain, 1))  # so that no other substrings are made again for the characters
    several = counts.where((F.length("piece") > 1) & (F.col("count") >= 2))
    multi = several.orderBy(F.desc(F.col("count") * F.length("piece")), "piece").limit(size)
    return chars.unionByName(multi)


class Pieces:
    """The pieces of a model as tasks hold them: at most the seeds, a parameter, and the characters, whatever the corpus."""

    def __init__(self, pieces: DataFrame):
        held = pieces.where(F.col("lp").isNotNull()).select("piece", "lp", F.coalesce("id", F.lit(0)).cast("int").alias("id")).toArrow()
        self.columns = [c.combine_chunks() for c in held.columns]  # one buffer a column on its way to the tasks
        self.unknown = (pc.min(held.column("lp")).as_py() or 0.0) - UNKNOWN_PENALTY

    def table(self) -> dict[str, tuple[float, int]]:
        piece, lp, id_ = (c.to_pylist() for c in self.columns)
        return dict(zip(piece, zip(lp, id_, strict=True), strict=True))


    def lattices(self) -> L.Lattices:
        return L.Lattices(self.columns[0].to_pylist(), self.columns[1].to_numpy(zero_copy_only=False), self.unknown, MAX_LEN)


def word_slices(batch: pa.RecordBatch, column: int, most: int = WORDS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about so many of their words at a time."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def distinct_words(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, place, edges): the distinct words of the lists, the place of each word among them, and where each list begins."""
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def word_edges(word: str, table: dict, unknown: float, max_len: int) -> list[tuple[int, int, float, str, int]]:
    """Edges (e, s, lp, piece, id) of a word in order of e and s."""
    out = []
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - max_len), e):
            piece = word[s:e]
            found = table.get(piece)
            if found is not None:
                out.append((e, s, found[0], piece, found[1]))
            elif s + 1 == e:
                out.append((e, s, unknown, UNK, 0))
    return out


EDGES = "array<struct<e:int,s:int,lp:double,piece:string,id:int>>"


def lattices(words: DataFrame, pieces: DataFrame, max_len: int = MAX_LEN, but_whole: bool = False) -> DataFrame:
    """(word, freq, n, edges) of distinct words with the pieces (piece, lp, id): edges (e, s, lp, piece, id) from position s to e, in
    order of e.  A character without a piece gets an edge with id 0.  ``but_whole``: without the edge that is the word itself.
    The pieces go with the tasks, so that no substring of a word is ever shuffled."""
    known = Pieces(pieces)
    fields = [("e", pa.int32()), ("s", pa.int32()), ("lp", pa.float64()), ("piece", pa.string()), ("id", pa.int32())]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.table()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                edges = [word_edges(w, table, known.unknown, max_len) for w in rows.column(0).to_pylist()]
                if but_whole:
                    edges = [[x for x in es if x[0] - x[1] < n] for es, n in zip(edges, rows.column(2).to_pylist(), strict=True)]
                flat = list(zip(*(x for es in edges for x in es), strict=True)) or [[]] * len(fields)
                struct = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(flat, fields, strict=True)], [name for name, _ in fields])
                offsets = pa.array(np.cumsum([0, *map(len, edges)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(offsets, struct)], ["word", "freq", "n", "edges"])

    plain = words.select("word", "freq", F.length("word").alias("n")).where(F.col("n") > 0)
    return plain.mapInArrow(linked, f"word string, freq {plain.schema['freq'].dataType.simpleString()}, n int, edges {EDGES}").where(F.size("edges") > 0)


def forward(edges: Column) -> Column:
    """Logarithm of the sum over all segmentations up to each position, from 0.  ``edges`` in order of e; one pass: the sum
    for the position at hand is kept as its largest term and the rest in proportion."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0).alias("at"), F.lit(0.0).alias("top"), F.lit(1.0).alias("rest"))
    closed = lambda a: F.array_append(a["done"], a["top"] + F.log(a["rest"]))

    def step(a: Column, x: Column) -> Column:
        done = closed(a)
        new = F.struct(done.alias("done"), x["e"].alias("at"), (F.get(done, x["s"]) + x["lp"]).alias("top"), F.lit(1.0).alias("rest"))
        v = F.get(a["done"], x["s"]) + x["lp"]
        top = F.greatest(a["top"], v)
        same = F.struct(a["done"].alias("done"), a["at"].alias("at"), top.alias("top"), (a["rest"] * F.exp(a["top"] - top) + F.exp(v - top)).alias("rest"))
        return F.when(x["e"] == a["at"], same).otherwise(new)

    return F.aggregate(edges, start, step, closed)


def expected_counts(lattice: DataFrame) -> DataFrame:
    """(piece, count): expected number of each piece, summed over all words by their frequency."""
    n = F.col("n")
    turned = F.sort_array(F.transform("edges", lambda x: F.struct((n - x["s"]).alias("e"), (n - x["e"]).alias("s"), x["lp"].alias("lp"))))
    both = lattice.withColumn("turned", turned).withColumn("alpha", forward(F.col("edges"))).withColumn("beta", forward(F.col("turned")))
    share = lambda x: F.col("freq") * F.exp(F.get("alpha", x["s"]) + x["lp"] + F.get("beta", n - x["e"]) - F.get("alpha", n))
    shares = both.select(F.inline(F.transform("edges", lambda x: F.struct(x["piece"].alias("piece"), share(x).alias("share")))))
    return shares.where(F.col("piece") != UNK).groupBy("piece").agg(F.sum("share").alias("count"))


def all_pieces(pieces: DataFrame, max_len: int) -> tuple[L.Lattices, pa.Array, np.ndarray]:
    """The lattices of (piece, lp, count) as tasks hold them, the pieces and their counts by number."""
    held = pieces.where(F.col("lp").isNotNull()).select("piece", "lp", "count").toArrow().combine_chunks()
    piece, lp, count = (held.column(i).combine_chunks() for i in range(3))
    lp = lp.to_numpy(zero_copy_only=False)
    return L.Lattices(piece.to_pylist(), lp, lp.min(initial=np.inf if len(lp) else 0.0) - UNKNOWN_PENALTY, max_len), piece, count.to_numpy(zero_copy_only=False)


def piece_counts(words: DataFrame, pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``expected_counts`` of the words' lattices with the pieces (piece, lp, count): a task sums its own, so one row for each of its
    pieces is shuffled."""
    known, names, _ = all_pieces(pieces, max_len)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(known.size), np.zeros(known.size, bool)
        for batch in batches:
            freq = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, codes in L.by_length(batch.column(0).to_pylist(), max_len):
                edges = known.edges(codes)
                share, piece = L.shares(known.lp[edges], freq[rows]), (edges >= 0) & (edges < known.size)
                np.add.at(total, edges[piece], share[piece])
                met[edges[piece]] = True
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "count"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([names.take(batch.column(0)), batch.column(1)], ["piece", "count"])

    summed = words.select("word", F.col("freq").cast("double")).mapInArrow(counted, "at int, count double").groupBy("at").agg(F.sum("count").alias("count"))
    return summed.mapInArrow(named, "piece string, count double")


def _scored(counts: DataFrame) -> DataFrame:
    """(piece, count, lp, id): logarithms of the shares; ids are not given yet."""
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).select("piece", "count", F.log(F.col("count") / F.col("total")).alias("lp"), F.lit(1).alias("id"))  # one row of one number


def best_path(edges: Column) -> Column:
    """Per position from 0: (score, back, piece, id) of the best segmentation up to it; ties go to the longer last piece."""
    first = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit("").alias("piece"), F.lit(0).alias("id"))
    start = F.struct(F.array().cast("array<struct<score:double,back:int,piece:string,id:int>>").alias("done"), F.lit(0).alias("at"), first.alias("best"))
    closed = lambda a: F.array_append(a["done"], a["best"])
    reached = lambda done, x: F.struct((F.get(done, x["s"])["score"] + x["lp"]).alias("score"), (-x["s"]).alias("back"), x["piece"].alias("piece"), x["id"].alias("id"))

    def step(a: Column, x: Column) -> Column:
        done = closed(a)
        new = F.struct(done.alias("done"), x["e"].alias("at"), reached(done, x).alias("best"))
        same = F.struct(a["done"].alias("done"), a["at"].alias("at"), F.greatest(a["best"], reached(a["done"], x)).alias("best"))
        return F.when(x["e"] == a["at"], same).otherwise(new)

    return F.aggregate(edges, start, step, closed)


def segmentation(path: Column, n: Column) -> Column:
    """The (piece, id) of a best path in order."""
    start = F.struct(n.alias("at"), F.array().cast("array<struct<piece:string,id:int>>").alias("parts"))

    def step(acc: Column, _: Column) -> Column:
        here = F.get(path, acc["at"])
        more = F.concat(F.array(F.struct(here["piece"].alias("piece"), here["id"].alias("id"))), acc["parts"])
        return F.when(acc["at"] <= 0, acc).otherwise(F.struct((-here["back"]).alias("at"), more.alias("parts")))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["parts"])


def losses(scored: DataFrame) -> DataFrame:
    """(piece, count, loss) of the pieces of several characters: how much likelihood goes if its best other segmentation
    takes a piece's counts.  Null for a piece that is not its own best segmentation, which is dropped first."""
    known, _, counts = all_pieces(scored, MAX_LEN)
    total = counts.sum()
    part_count = np.array([*counts, np.nan, np.nan])  # the unknown piece, and none

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, lp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            loss = np.full(batch.num_rows, np.nan)
            for rows, codes in L.by_length(batch.column(0).to_pylist(), MAX_LEN):
                edges = known.edges(codes)
                if len(codes) <= MAX_LEN:
                    edges[-1, len(codes) - 1] = L.NONE  # the word itself
                other, parts = L.best_parts(known, edges)
                own, k = count[rows], (parts != L.NONE).sum(1)
                added = np.log(part_count[parts] + own[:, None]) - np.log(total + own * (k - 1))[:, None]
                loss[rows] = np.where(lp[rows] >= other, own * (lp[rows] - np.nansum(added, 1)), np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(loss, from_pandas=True)], ["piece", "count", "loss"])

    return scored.where(F.length("piece") > 1).select("piece", "count", "lp").mapInArrow(lost, "piece string, count double, loss double")


def dealt(table: DataFrame) -> DataFrame:
    """A table of short rows, written and dealt out by their number: the work on a row is long, so the size of the table says
    little about the tasks that it takes."""
    held = table.checkpoint()
    return held.repartition(held.count() // ROWS_OF_TASK + 1).checkpoint()


def train_unigram(docs: DataFrame, vocab_size: int, text_col: str = "text", seeds: int = SEEDS, shrink: float = SHRINK, sub_iterations: int = SUB_ITERATIONS) -> DataFrame:
    """(id, piece, score): the unknown piece and the user symbols first, then pieces by score.  Single characters are never
    dropped, so a vocabulary may be larger than ``vocab_size`` only by them."""
    words = dealt(word_freqs(docs, text_col).where(~F.col("word").isin(*USER_SYMBOLS)))
    scored = dealt(_scored(seed_pieces(words, seeds).checkpoint()))  # written once before their sum
    chars, several = scored.agg(F.count(F.when(F.length("piece") == 1, 1)), F.count(F.when(F.length("piece") > 1, 1))).first()
    target = max(vocab_size - 1 - len(USER_SYMBOLS) - chars, 0)
    while True:
        for _ in range(sub_iterations):
            counts = piece_counts(words, scored).checkpoint()
            # a piece that no segmentation needs has gone; characters stay with a small count
            scored = dealt(_scored(counts.withColumn("count", F.greatest("count", F.lit(1e-6)))))
        several = scored.where(F.length("piece") > 1).count()
        if several <= target:
            break
        room = max(target, int(several * shrink))
        kept = losses(scored).orderBy(F.desc_nulls_last("loss"), "piece").limit(room).select("piece", "count")
        scored = _scored(kept.unionByName(scored.where(F.length("piece") == 1).select("piece", "count")).checkpoint()).checkpoint()
    ordered = scored.select("piece", F.col("lp").alias("score")).orderBy(F.desc("score"), "piece")
    # the vocabulary, of the size asked for, gets its ids in one pass
    rows = [(UNK, 0.0), *((s, 0.0) for s in USER_SYMBOLS), *((r["piece"], r["score"]) for r in ordered.collect())]
    return docs.sparkSession.createDataFrame([(i, p, x) for i, (p, x) in enumerate(rows)], "id int, piece string, score double")


def plain_pieces(model: DataFrame) -> DataFrame:
    """(piece, lp, id) of a model's pieces without the unknown one and the user symbols."""
    return model.where(~F.col("piece").isin(UNK, *USER_SYMBOLS)).select("piece", F.col("score").alias("lp"), "id")


def _word_ids(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word, ids, pieces) of distinct words: best segmentation, user symbols whole."""
    lattice = lattices(words.where(~F.col("word").isin(*USER_SYMBOLS)).withColumn("freq", F.lit(1)), plain_pieces(model))
    best = lattice.withColumn("path", best_path(F.col("edges"))).select("word", segmentation(F.col("path"), F.col("n")).alias("parts"))
    users = model.where(F.col("piece").isin(*USER_SYMBOLS)).select(F.col("piece").alias("word"), F.array("id").alias("ids"), F.array("piece").alias("pieces"))
    return best.select("word", F.col("parts")["id"].alias("ids"), F.col("parts")["piece"].alias("pieces")).unionByName(users)


def _occurrences(docs: DataFrame, *key: str) -> DataFrame:
    """(key, word, at): the places of each word of a document, so that a frequent word is one row per document."""
    return docs.select(*key, F.posexplode(unigram_words(F.col("text"))).alias("at", "word")).groupBy(*key, "word").agg(F.collect_list("at").alias("at"))


def _once(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the rest (None: there is none), whose words are taken together."""
    twice = docs.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key")).checkpoint()
    if twice.isEmpty():
        return docs, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return docs.join(twice, same, "left_anti"), docs.join(twice, same, "left_semi")


def encode_ids(docs: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of every document in order; a text without words, or a null key, has no ids.  Unknown characters have id 0.
    The model goes with the tasks, which cut each word that they meet once; only documents that share a key are shuffled."""
    known = Pieces(plain_pieces(model))
    users = {r["piece"]: [r["id"]] for r in model.where(F.col("piece").isin(*USER_SYMBOLS)).collect()}
    alone, together = _once(docs, key)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, own = known.lattices(), np.array([*known.columns[2].to_pylist(), 0])
        for batch in batches:
            for rows in word_slices(batch, 1):
                words, place, edges = distinct_words(rows.column(1))
                sizes, pieces = L.best_of(lattices, ["" if w in users else w for w in words])
                ids, at = own[pieces], np.cumsum(sizes) - sizes
                marks = [i for i, w in enumerate(words) if w in users]
                sizes[marks], at[marks] = 1, len(ids) + np.arange(len(marks))
                ids = np.concatenate([ids, [users[words[i]][0] for i in marks]]).astype(np.int32)
                many = sizes[place]
                offsets = np.concatenate([[0], np.cumsum(many)])[edges].astype(np.int32)
                flat = ids[np.repeat(at[place], many) + L.ramp(many)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    words = F.when(F.col(key).isNotNull(), unigram_words(F.col("text")))
    out = alone.select(key, words.alias("words")).mapInArrow(encoded, T.StructType([docs.schema[key]]).add("ids", T.ArrayType(T.IntegerType())))
    return out if together is None else out.unionByName(_encode_together(together, model, key))


def _encode_together(docs: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """``encode_ids`` of documents that share a key: all their words by place."""
    held = _occurrences(docs, key).checkpoint()
    found = held.join(_word_ids(held.select("word").distinct(), model), "word")
    placed = found.select(key, F.explode("at").alias("at"), "ids").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    ids = F.coalesce(F.flatten(F.col("parts")["ids"]), F.array().cast("array<int>"))
    return docs.select(key).join(placed, key, "left").select(key, ids.alias("ids"))


def n_best(words: DataFrame, model: DataFrame, n: int = N_BEST) -> DataFrame:
    """(word, paths): up to ``n`` best segmentations (score, ids) of distinct words, best first, merged position by position."""
    lattice = lattices(words.withColumn("freq", F.lit(1)), plain_pieces(model))
    kind = "array<struct<score:double,ids:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(0).alias("at"), first.alias("held"))
    closed = lambda a: F.array_append(a["done"], F.slice(F.sort_array(a["held"], asc=False), 1, n))
    longer = lambda done, x: F.transform(F.get(done, x["s"]), lambda y: F.struct((y["score"] + x["lp"]).alias("score"), F.array_append(y["ids"], x["id"]).alias("ids")))

    def step(a: Column, x: Column) -> Column:
        done = closed(a)
        new = F.struct(done.alias("done"), x["e"].alias("at"), longer(done, x).alias("held"))
        same = F.struct(a["done"].alias("done"), a["at"].alias("at"), F.concat(a["held"], longer(a["done"], x)).alias("held"))
        return F.when(x["e"] == a["at"], same).otherwise(new)

    return lattice.select("word", F.aggregate("edges", start, step, lambda a: F.element_at(closed(a), -1)).alias("paths"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(2**32)


def best_choices(edges: list[tuple[int, int, float, str, int]], top: int) -> list[tuple[float, tuple[int, ...]]]:
    """Up to ``top`` best segmentations (score, ids), best first, by the rule of ``n_best``."""
    done = [[(0.0, ())]]
    for e, group in groupby(edges, key=itemgetter(0)):
        held = [(score + lp, (*ids, id_)) for _, s, lp, _, id_ in group for score, ids in done[s]]
        held.sort(reverse=True)
        done.append(held[:top])
    return done[-1]


def numbers(starts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of each start followed by 0, 1, ... up to its size."""
    short = np.array([len(s) + len(str(n)) <= L.BLOCK for s, n in zip(starts, sizes.tolist(), strict=True)], bool)
    out, own = np.empty(int(sizes.sum()), np.uint32), np.repeat(short, sizes)
    out[own] = L.numbered_starts([s for s, x in zip(starts, short, strict=True) if x], sizes[short])
    rest = (s + b"%d" % i for s, n, x in zip(starts, sizes.tolist(), short, strict=True) if not x for i in range(n))
    out[~own] = np.fromiter((int.from_bytes(md5(s).digest()[:4], "big") for s in rest), np.uint32)
    return out


def chosen(score: np.ndarray, alpha: float, u: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of the path that each number u in [0, 1) draws from a word's, best first, with weight p ** alpha."""
    there = np.isfinite(score)
    weight = np.where(there, np.exp(alpha * np.where(there, score - score[:, :1], 0.0)), 0.0)
    below = np.full((len(score), 1 << (score.shape[1] - 1).bit_length()), np.inf)
    below[:, : score.shape[1]] = np.cumsum(weight, axis=1)
    mark, held, base = u * below[:, score.shape[1] - 1][word], below.reshape(-1), word * below.shape[1]
    out, step = np.zeros(u.shape, np.int64), below.shape[1] // 2
    while step:
        out += step * (held[base + (out + (step - 1))] <= mark)
        step //= 2
    return out


class Drawn:
    """The paths that the words of some documents draw: of a word only those that are drawn, one after the other."""

    def __init__(self, draws: np.ndarray, place: np.ndarray, n_words: int):
        self.draws, self.order, self.many = draws, np.argsort(place, kind="stable"), np.bincount(place, minlength=n_words)
        self.begin, self.path, self.held, self.paths = np.cumsum(self.many) - self.many, np.empty(draws.shape, np.int32), [], 0

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the words, and of which of them each is."""
        many = self.many[words]
        return self.order[np.repeat(self.begin[words], many) + L.ramp(many)], np.repeat(np.arange(len(words)), many)

    def add(self, at: np.ndarray, path: np.ndarray, paths: tuple[np.ndarray, np.ndarray]) -> None:
        """``paths``: (sizes, ids) of the paths that the draws at the places number."""
        self.path[:, at] = path + self.paths
        self.held.append(paths)
        self.paths += len(paths[0])

    def ids(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ends, ids) of all words for each repetition."""
        size, flat = (np.concatenate(x) for x in zip(*self.held, strict=True))
        start = np.cumsum(size) - size
        for path in self.path:
            many = size[path]
            yield np.concatenate([[0], np.cumsum(many)]).astype(np.int32), flat[np.repeat(start[path], many) + L.ramp(many)]


def sample_ids(docs: DataFrame, model: DataFrame, n_times: int, alpha: float, key: str = "doc_id", n: int = N_BEST, seed: str = "sample") -> DataFrame:
    """T9 + J6: (key, rep, ids): every document ``n_times``, each word drawn from its ``n`` best segmentations with weight p ** alpha.
    The model goes with the tasks, which draw a whole document; only documents that share a key are shuffled."""
    known = Pieces(plain_pieces(model))
    users = {r["piece"]: r["id"] for r in model.where(F.col("piece").isin(*USER_SYMBOLS)).collect()}
    alone, together = _once(docs, key)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, table, own = known.lattices(), known.table(), np.array([*known.columns[2].to_pylist(), 0, 0], np.int32)

        def draw(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, place, edges = distinct_words(rows.column(2))
            sizes = np.diff(edges)
            full = np.flatnonzero(sizes)  # a document without words is not drawn
            if not len(full):
                return
            starts = [f"{seed}:" if x is None else f"{seed}:{x}:" for x in rows.column(1).take(pa.array(full)).to_pylist()]
            out = Drawn(np.stack([numbers([f"{s}{rep}:".encode() for s in starts], sizes[full]) for rep in range(n_times)]), place, len(words))
            marks = [i for i, w in enumerate(words) if w in users]
            at, word = out.occurrences(np.array(marks, np.int64))
            out.add(at, word, (np.ones(len(marks), np.int64), np.array([users[words[i]] for i in marks], np.int32)))
            for group, codes in L.by_length(["" if w in users else w for w in words], MAX_LEN):
                several = L.Several(lattices, lattices.edges(codes), own, n)
                at, word = out.occurrences(group)
                pick = word * n + chosen(several.last, float(alpha), out.draws[:, at] / float(2**32), word)
                used = np.zeros(len(group) * n, bool)
                used[pick] = True
                path = np.flatnonzero(used)
                parts = several.paths(path % n, path // n)
                ids, there = own[parts], parts != L.NONE
                for i in np.flatnonzero(several.odd[path // n]):
                    ways = best_choices(word_edges(words[group[path[i] // n]], table, known.unknown, MAX_LEN), n)[path[i] % n][1]
                    ids[i, : len(ways)], there[i] = ways, np.arange(ids.shape[1]) < len(ways)
                out.add(at, (np.cumsum(used) - 1)[pick], (there.sum(1), ids[there]))
            keys, ends = rows.column(0).take(pa.array(full)), np.append(edges[full], edges[-1])
            for rep, (end, ids) in enumerate(out.ids()):
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(full), rep, np.int32)), pa.ListArray.from_arrays(pa.array(end[ends]), pa.array(ids))], [key, "rep", "ids"])

        for batch in batches:
            for rows in word_slices(batch, 2, max(1, DRAWS // n_times)):
                yield from draw(rows)

    asked = alone.select(key, F.col(key).cast("string").alias("name"), unigram_words(F.col("text")).alias("words"))
    out = asked.mapInArrow(drawn, T.StructType([docs.schema[key]]).add("rep", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType())))
    return out if together is None else out.unionByName(_sample_together(together, model, n_times, alpha, key, n, seed))


def _sample_together(docs: DataFrame, model: DataFrame, n_times: int, alpha: float, key: str, n: int, seed: str) -> DataFrame:
    """``sample_ids`` of documents that share a key: all their words by place."""
    held = _occurrences(docs, key).checkpoint()
    plain = n_best(held.select("word").distinct().where(~F.col("word").isin(*USER_SYMBOLS)), model, n)
    top = F.get("paths", 0)["score"]
    weight = F.transform("paths", lambda p: F.exp(F.lit(float(alpha)) * (p["score"] - top)))
    below = F.aggregate("weight", F.array(F.lit(0.0)), lambda a, w: F.array_append(a, F.element_at(a, -1) + w))
    plain = plain.withColumn("weight", weight).select("word", F.col("paths")["ids"].alias("choices"), below.alias("below"))
    users = model.where(F.col("piece").isin(*USER_SYMBOLS)).select(F.col("piece").alias("word"), F.array(F.array("id")).alias("choices"), F.array(F.lit(0.0), F.lit(1.0)).alias("below"))
    reps = held.join(plain.unionByName(users), "word").select(key, "choices", "below", F.explode("at").alias("at")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_times - 1))))
    mark = uniform(F.lit(seed), F.col(key), F.col("rep"), F.col("at")) * F.element_at("below", -1)
    drawn = reps.withColumn("mark", mark).select(key, "rep", "at", F.get("choices", F.size(F.filter("below", lambda b: b <= F.col("mark"))) - 1).alias("ids"))
    return drawn.groupBy(key, "rep").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "ids")))["ids"]).alias("ids"))
