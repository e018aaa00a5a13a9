"""Byte-level BPE on Spark.

Words come from the byte-level pre-tokenizer (GPT-2 split pattern on the text
with a leading blank).  Texts are cut into words by the classes of their characters, many texts at a time.
Training works on the table of *distinct* words with
their frequencies: pairs are counted once, and each batch of merges that don't
affect each other recounts only the words that hold one of them.  The words, as arrays of
symbols, are checkpointed every few merges into the shared checkpoint folder to cut lineage.
Encoding looks up the rank of every pair of a word and merges the lowest
until none is left, for all distinct words of a batch of texts at once.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUE: the GPT-2 pre-tokenizer split pattern (byte-level BPE).
GPT2_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# FIXED VALUES: special tokens of the subword tokenizers, ids 0..13 in this order.
SUBWORD_SPECIALS = [
    "[UNK]", "<SONNET>", "<STANZA>", "<END>", "<RHYME_A>", "<RHYME_B>", "<RHYME_C>", "<RHYME_D>",
    "<RHYME_E>", "<RHYME_F>", "<RHYME_G>", "<RHYME_H>", "<RHYME_I>", "<RHYME_J>",
]
SYMBOL_RE = r"<[0-9a-f]+>"
# Merges after which the word table is written anew.
MERGES_AT_ONCE = 50
# The pairs among which a batch of merges is chosen.
TOP_PAIRS = 1000
# Rank of a pair without a merge.
NEVER = np.iinfo(np.int64).max
# Texts whose words are merged at once.
ROWS = 256
# Characters of texts whose words are cut and merged at once.
CHARS = 1 << 21
# Classes of characters in the split pattern.
SPACE, LETTER, NUMBER, OTHER = range(4)


SPLIT_MARK = "\u0002"


def pretokenize(text: Column) -> Column:
    """T1 + T2: the text is cut at the specials first (kept whole); every other
    piece gets a leading blank when it has none (add_prefix_space) and is split
    by the GPT-2 pattern."""
    marked = text
    for s_ in SUBWORD_SPECIALS:
        marked = F.replace(marked, F.lit(s_), F.lit(SPLIT_MARK + s_ + SPLIT_MARK))
    pieces = F.filter(F.split(marked, SPLIT_MARK, -1), lambda p: p != "")

    def split_piece(p: Column) -> Column:
        prefixed = F.when(p.startswith(" "), p).otherwise(F.concat(F.lit(" "), p))
        return F.when(p.isin(*SUBWORD_SPECIALS), F.array(p)).otherwise(
            F.regexp_extract_all(prefixed, F.lit(GPT2_SPLIT), 0)
        )

    return F.flatten(F.transform(pieces, split_piece))


def to_symbols(word: Column) -> Column:
    """Byte symbols of a word: ``<hh>`` per UTF-8 byte (lower-case hex)."""
    return F.regexp_replace(F.lower(F.hex(F.encode(word, "UTF-8"))), "([0-9a-f]{2})", "<$1>")


def from_symbols(symbols: Column) -> Column:
    """T6 inverse: concatenated hex back to text."""
    return F.decode(F.unhex(F.regexp_replace(symbols, "[<>]", "")), "UTF-8")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@functools.lru_cache(maxsize=1)
def char_classes(spark: SparkSession) -> np.ndarray:
    """The class of every code point, told by the regular expressions of Spark itself."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    row = spark.range(1).select(*(F.regexp_replace(F.lit(every), rf"\P{{{x}}}+", F.lit("")) for x in "LN")).collect()[0]
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[code_points(row[0])] = LETTER
    kinds[code_points(row[1])] = NUMBER
    kinds[code_points(" \t\n\x0b\f\r")] = SPACE
    return kinds


def pieces_of(text: str) -> list[str]:
    """The pieces of a text between its specials, with leading blanks, and the specials."""
    if SPLIT_MARK not in text and not any(s in text for s in SUBWORD_SPECIALS):
        return [text if text.startswith(" ") else " " + text] if text else []
    for s in SUBWORD_SPECIALS:
        text = text.replace(s, SPLIT_MARK + s + SPLIT_MARK)
    return [p if p in SUBWORD_SPECIALS or p.startswith(" ") else " " + p for p in text.split(SPLIT_MARK) if p]


def word_starts(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether each character begins a word of ``GPT2_SPLIT``, in pieces laid end to end whose first characters are ``first``."""
    kind = kinds[points]
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    alone = starts & np.r_[starts[1:], True]
    inner = np.r_[~first[1:], False]  # another character of its piece follows
    last_space = (kind == SPACE) & np.r_[starts[1:], True] & inner
    quote = alone & inner & (points == ord("'"))
    starts |= last_space
    joins = last_space & (points == ord(" "))  # the next word begins with this blank
    starts[1:][joins[:-1]] = False
    at = np.flatnonzero(quote & starts)  # not after such a blank: may begin one of 's 't 'm 'd 're 've 'll
    after = np.r_[points, 0, 0, 0]
    second, third = after[at + 1], np.where(np.r_[first, True, True, True][at + 2], 0, after[at + 2])
    one = np.isin(second, [ord(c) for c in "stmd"])
    two = ((second == ord("r")) | (second == ord("v"))) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))
    starts[at[one | two] + 1] = False
    for ends in (at[one] + 2, at[two] + 3):
        starts[ends[ends < len(starts)]] = True
    return starts


def cut_words(texts: list[str | None], kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """T1 + T2 of many texts at once: the words of ``pretokenize`` in a row, and their number for each text."""
    pieces = [[] if t is None else pieces_of(t) for t in texts]
    flat = [p for own in pieces for p in own]
    whole = "".join(flat)
    points = code_points(whole)
    edge = np.cumsum([0, *map(len, flat)])
    first = np.zeros(len(points), bool)
    first[edge[:-1]] = True
    starts = word_starts(points, first, kinds)
    for i in (i for i, p in enumerate(flat) if p in SUBWORD_SPECIALS):
        starts[edge[i] + 1 : edge[i + 1]] = False
    begin = np.flatnonzero(starts)
    width = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    offsets = np.r_[0, width][np.r_[begin, len(points)]].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
    return words, np.diff(np.searchsorted(begin, edge[np.cumsum([0, *map(len, pieces)])]))


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``CHARS`` bytes of their texts at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CHARS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def word_table(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct pre-tokenized words with frequencies and their byte symbols;
    specials are excluded (they are atomic ids, never merged).  Words are counted in each slice of texts first."""
    kinds = char_classes(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 0):
                found = pc.value_counts(cut_words(rows.column(0).to_pylist(), kinds)[0])
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    words = texts.select(text_col).mapInArrow(counted, "word string, n long")
    words = words.where(~F.col("word").isin(*SUBWORD_SPECIALS))
    return words.groupBy("word").agg(F.sum("n").alias("freq")).withColumn("sym", to_symbols(F.col("word")))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency."""
    syms = F.regexp_extract_all(F.col("sym"), F.lit(SYMBOL_RE), 0)
    pairs = words.select(
        "freq", F.explode(F.arrays_zip(syms.alias("l"), F.slice(syms, 2, 1 << 30).alias("r"))).alias("p")
    ).where(F.col("p.r").isNotNull())
    return pairs.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(
        F.sum("freq").cast("long").alias("count")
    )


def merged_symbol(left: str, right: str) -> str:
    return "<" + left[1:-1] + right[1:-1] + ">"


def batch_of_merges(top: list[tuple[str, str, int]], known: set[str], complete: bool) -> list[tuple[str, str, int]]:
    """The first pairs of ``top`` (in order of choice) that one-by-one training would choose in the same order.
    A merge of (a, b) changes only pairs that end in a or begin with b, and a pair it makes counts no more than
    such a pair did; so choice goes on while no such pair of an accepted merge counts as much as the next one.  A
    merge of equal symbols, or one that makes a symbol already ``known``, is the last.  Unless ``top`` is
    ``complete``, pairs that count as little as its last one are left for later, as others may tie with them."""
    out: list[tuple[str, str, int]] = []
    lefts: set[str] = set()
    rights: set[str] = set()
    made: set[str] = set()
    at = 0
    while at < len(top):
        tied = [p for p in top[at:] if p[2] == top[at][2]] if at == 0 or top[at][2] != top[at - 1][2] else tied
        if out and not complete and top[at][2] == top[-1][2]:
            break
        if out and any(r in lefts or l in rights for l, r, _ in tied if (l, r) not in {x[:2] for x in out}):
            break
        left, right, count = top[at]
        symbol = merged_symbol(left, right)
        out.append((left, right, count))
        if left == right or symbol in known or symbol in made:
            break
        lefts.add(left)
        rights.add(right)
        made.add(symbol)
        at += 1
    return out


#: A merge in numbers of symbols: left, right and made one.
Step = tuple[int, int, int]


def packed_words(words: DataFrame, gap: int) -> DataFrame:
    """(freq, sym): the words of a batch as one array of symbols, bytes at first, with ``gap`` after each word."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sym, _ = laid_out(batch.column(0), gap)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (batch.column(1).to_numpy().tobytes(), sym.tobytes())], ["freq", "sym"])

    return words.select("word", "freq").mapInArrow(packed, "freq binary, sym binary")


def symbol_type(gap: int) -> type:
    return np.uint16 if gap < 1 << 16 else np.uint32


def laid_out(words: pa.Array, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words with ``gap`` after each, and the length of each word."""
    raw = words.cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy()
    sym = np.full(int(sizes.sum()) + len(raw), gap, symbol_type(gap))
    sym[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(raw)), sizes)] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    return sym, sizes


def pairs_found(sym: np.ndarray, batch: list[Step], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a batch of merges that don't affect each other merges, and the symbols made there."""
    left, right = ({x: i + 1 for i, x in enumerate(dict.fromkeys(step[side] for step in batch))} for side in (0, 1))
    made = np.full((len(left) + 1, len(right) + 1), -1, np.int64)
    for l, r, m in batch:
        made[left[l], right[r]] = m
    slots = np.zeros((2, gap + 1), np.int16)
    for side, known in enumerate((left, right)):
        slots[side, list(known)] = list(known.values())
    ahead = slots[0][sym[:-1]]
    at = np.flatnonzero(ahead)
    new = made[ahead[at], slots[1][sym[at + 1]]]
    at, new = at[new >= 0], new[new >= 0]
    begin = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)  # of a symbol with itself: every other one
    every_other = (np.arange(len(at)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]) % 2 == 0
    return at[every_other], new[every_other]


def merge_batches(sym: np.ndarray, batches: list[list[Step]], gap: int) -> np.ndarray:
    for batch in batches:
        at, new = pairs_found(sym, batch, gap)
        sym = sym.copy()
        sym[at] = new
        sym = np.delete(sym, at + 1)
    return sym


def merged_words(words: DataFrame, batches: list[list[Step]], gap: int) -> DataFrame:
    def merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                sym = np.frombuffer(batch.column(1)[i].as_buffer(), symbol_type(gap))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([merge_batches(sym, batches, gap).tobytes()], pa.binary())], ["freq", "sym"])

    return words.mapInArrow(merged, "freq binary, sym binary")


def weighed_pairs(sym: np.ndarray, freq: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The adjacent symbols of words as numbers ``left * (gap + 1) + right``, and their counts weighted by frequency."""
    at = np.flatnonzero((sym[:-1] != gap) & (sym[1:] != gap))
    pair, which = np.unique(sym[at].astype(np.int64) * (gap + 1) + sym[at + 1], return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, which, freq[(np.cumsum(sym == gap) - (sym == gap))[at]])
    return pair, total


def count_changes(words: DataFrame, done: list[list[Step]], step: list[Step], gap: int) -> DataFrame:
    """(pair, change) of the pair counts by the batch ``step``, from the words that hold one of its pairs once the batches
    ``done`` are made; other words are only searched.  Without steps: all counts."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for f, s in zip(batch.column(0), batch.column(1), strict=True):
                freq, sym = np.frombuffer(f.as_buffer(), np.int64), np.frombuffer(s.as_buffer(), symbol_type(gap))
                sym = merge_batches(sym, done, gap)
                if step:
                    ends = np.flatnonzero(sym == gap)
                    held = np.unique(np.searchsorted(ends, pairs_found(sym, step, gap)[0]))
                    begin, size = np.r_[0, ends + 1][held], np.diff(np.r_[-1, ends])[held]
                    sym = sym[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    freq = freq[held]
                    pair, total = weighed_pairs(sym, freq, gap)
                    found.append((pair, -total))
                    sym = merge_batches(sym, [step], gap)
                found.append(weighed_pairs(sym, freq, gap))
        if found:
            pair, which = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, which, np.concatenate([t for _, t in found]))
            yield pa.RecordBatch.from_arrays([pa.array(pair[total != 0]), pa.array(total[total != 0])], ["pair", "change"])

    found = words.mapInArrow(changes, "pair long, change long")
    return found.groupBy("pair").agg(F.sum("change").alias("change")).where(F.col("change") != 0)


def spelled_words(words: DataFrame, batches: list[list[Step]], names: list[str], gap: int) -> DataFrame:
    """(word, freq, sym): the symbols ``<hh..>`` of words after all merges."""

    def spelled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sym = merge_batches(laid_out(batch.column(0), gap)[0], batches, gap)
            ends = np.flatnonzero(sym == gap)
            text = ["".join(names[i] for i in sym[a:b].tolist()) for a, b in zip([0, *(ends + 1).tolist()], ends.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["word", "freq", "sym"])

    return words.select("word", "freq").mapInArrow(spelled, "word string, freq long, sym string")


def train_bpe(texts: DataFrame, n_merges: int, min_frequency: int = 2) -> tuple[DataFrame, list[tuple[int, str, str, int]]]:
    """T4: returns the final word table (word, freq, sym: symbols ``<hh..>``) and the merges (rank, left, right, count).
    Best pair = highest count, ties by (left, right) ascending; stops early when no pair reaches ``min_frequency``.

    The counts of all pairs are held on the driver: at most the square of the vocabulary, whatever the corpus.  They
    are counted once; then each job counts, for a batch of merges that don't affect each other, the pairs that go
    and come in the words that hold one of them.  Words are arrays of symbols laid end to end, in which a batch
    merges at once; they are written anew every ``MERGES_AT_ONCE`` merges."""
    gap = 256 + n_merges
    table = word_table(texts).select("word", "freq")
    words = packed_words(table, gap).checkpoint()
    names = [f"<{b:02x}>" for b in range(256)]
    number = {name: b for b, name in enumerate(names)}
    counts: dict[tuple[str, str], int] = {}
    merges: list[tuple[int, str, str, int]] = []
    step: list[Step] = []
    every: list[list[Step]] = []
    written = 0  # batches that ``words`` holds
    while True:
        for r in count_changes(words, every[written:], step, gap).collect():
            pair = (names[r["pair"] // (gap + 1)], names[r["pair"] % (gap + 1)])
            counts[pair] = counts.get(pair, 0) + r["change"]
            if not counts[pair]:
                del counts[pair]
        every += [step] if step else []
        if sum(map(len, every[written:])) >= MERGES_AT_ONCE:
            words, written = merged_words(words, every[written:], gap).checkpoint(), len(every)
        if len(merges) >= n_merges:
            break
        top = heapq.nsmallest(TOP_PAIRS, ((-n, l, r) for (l, r), n in counts.items() if n >= min_frequency))
        if not top:
            break
        batch = batch_of_merges([(l, r, -n) for n, l, r in top], set(number), len(top) < TOP_PAIRS)
        step = []
        for left, right, count in batch[: n_merges - len(merges)]:
            merges.append((len(merges), left, right, count))
            made = merged_symbol(left, right)
            if made not in number:
                number[made] = len(names)
                names.append(made)
            step.append((number[left], number[right], number[made]))
        if len(merges) >= n_merges:
            every.append(step)
            break
    return spelled_words(table, every, names, gap), merges


def bpe_tokens(merges) -> list[str]:
    """The tokens in order of their ids: specials (0..13), the 256 byte symbols, merges in rank order."""
    return [*SUBWORD_SPECIALS, *(f"<{b:02x}>" for b in range(256)), *(merged_symbol(l, r) for _, l, r, _ in merges)]


class Ranks:
    """Merges as arrays: sorted pair keys, their rank, and the id that they make; ids are places in ``bpe_tokens``."""

    def __init__(self, merges):
        tokens = bpe_tokens(merges)
        ids = {t: i for i, t in reversed(list(enumerate(tokens)))}
        self.size = len(tokens)
        known: dict[int, tuple[int, int]] = {}
        for rank, left, right, _ in merges:
            known.setdefault(ids[left] * self.size + ids[right], (rank, ids[merged_symbol(left, right)]))
        self.key = np.array(sorted(known), np.int64)
        self.rank = np.array([known[k][0] for k in self.key.tolist()], np.int64)
        self.made = np.array([known[k][1] for k in self.key.tolist()], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NEVER`` without a merge) and its place."""
        if not len(self.key):
            return np.full(len(left), NEVER), np.zeros(len(left), np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER), at


def merge_words(ranks: Ranks, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words laid end to end after all merges, and their number for each word.  In each round every word merges
    all its pairs of its own lowest rank, from the left; words without a pair are done."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    out_ids, out_word, out_at = [], [], []
    at = np.arange(len(ids))
    while len(ids):
        same = np.r_[word[1:] == word[:-1], False]
        rank = np.full(len(ids), NEVER)
        rank[same] = ranks.of(ids[same], ids[1:][same[:-1]])[0]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        length = np.diff(np.r_[first, len(ids)])
        least = np.repeat(np.minimum.reduceat(rank, first), length)
        done = least == NEVER
        for held, x in ((out_ids, ids), (out_word, word), (out_at, at)):
            held.append(x[done])
        pair = np.flatnonzero((rank == least) & ~done)
        begin = np.r_[True, np.diff(pair) != 1] if len(pair) else np.zeros(0, bool)  # overlapping pairs: every other one
        pair = pair[(np.arange(len(pair)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]) % 2 == 0]
        ids = ids.copy()
        ids[pair] = ranks.made[ranks.of(ids[pair], ids[pair + 1])[1]]
        stay = ~done
        stay[pair + 1] = False
        ids, word, at = ids[stay], word[stay], at[stay]
    if not out_ids:
        return ids, np.zeros(len(sizes), np.int64)
    ids, word, at = (np.concatenate(x) for x in (out_ids, out_word, out_at))
    return ids[np.argsort(at)], np.bincount(word, minlength=len(sizes))


def ids_of_words(ranks: Ranks, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and their number for each; equal words are merged once."""
    held = words.cast(pa.large_string()).dictionary_encode()
    special = {s: i for i, s in enumerate(SUBWORD_SPECIALS)}
    distinct = held.dictionary.to_pylist()
    raw = [w.encode() if w not in special else b"" for w in distinct]
    sizes = np.array([len(w) for w in raw], np.int64)
    ids, counts = merge_words(ranks, np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + len(SUBWORD_SPECIALS), sizes)
    atomic = np.array([special.get(w, -1) for w in distinct], np.int64)
    if (atomic >= 0).any():
        into = np.flatnonzero(atomic >= 0)
        ids = np.insert(ids, (np.cumsum(counts) - counts)[into], atomic[into])
        counts[into] = 1
    which = held.indices.to_numpy().astype(np.int64)
    begin, own = (np.cumsum(counts) - counts)[which], counts[which]
    before = np.cumsum(own) - own
    return ids[np.repeat(begin - before, own) + np.arange(int(own.sum()))] if len(which) else ids[:0], own


def encode_ids(docs: DataFrame, merges, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T5: (key, ids): the ids of every text in order, specials atomic; no shuffle.  A null text has no ids."""
    ranks, kinds = Ranks(merges), char_classes(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)]).add("ids", T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 1):
                words, many = cut_words(rows.column(1).to_pylist(), kinds)
                ids, counts = ids_of_words(ranks, words)
                offsets = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(many)]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], schema.names)

    return docs.select(key, text_col).mapInArrow(encoded, schema)


def joined_words(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, joined): the words of every text joined again; null for a null text."""
    kinds = char_classes(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)]).add("joined", T.StringType())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, 1):
                texts = rows.column(1).to_pylist()
                words, many = cut_words(texts, kinds)
                own = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int64()), words)
                text = pc.if_else(rows.column(1).is_valid(), pc.binary_join(own, pa.scalar("", pa.large_string())), pa.scalar(None, pa.large_string()))
                yield pa.RecordBatch.from_arrays([rows.column(0), text.cast(pa.string())], schema.names)

    return docs.select(key, text_col).mapInArrow(joined, schema)


def decode_ids(ids: Column, merges, skip_special: bool = False) -> Column:
    """The text of an id array, with or without its specials.  Bytes are joined before they are
    read as UTF-8, as a character may be spread over tokens."""
    special = len(SUBWORD_SPECIALS)
    chosen = F.filter(ids, lambda i: i >= special) if skip_special else ids
    hexes = [t.encode().hex() if i < special else t[1:-1] for i, t in enumerate(bpe_tokens(merges))]
    table = F.split(F.lit(",".join(hexes)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(chosen, lambda i: F.get(table, i)), "")), "UTF-8")


def doc_token_counts(docs: DataFrame, key: str, merges) -> DataFrame:
    """A3 input: tokens per document."""
    return encode_ids(docs, merges, key).select(key, F.size("ids").cast("long").alias("n_tokens"))
