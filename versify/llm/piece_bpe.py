"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A model (path is a parameter) becomes a table of symbol pairs on the driver: for each pair that makes a
piece its rank, the place of the piece's score, and the piece; also the pairs that make no piece but
lie inside one.  Any other two neighbours never end up in one piece, so texts are cut there,
which parts words at their blanks and most else besides.  Equal stretches of a slice of texts are
encoded once: their characters lie in one flat array, and in each round every stretch
looks up its least pair rank, merges all pairs of that rank from the left, at once, and
is cut and compacted again, until no pair is left.  One at a time, best pair first and leftmost among equals,
is what the library does; a merge is therefore put off to a later round where one to its left makes a
pair that ranks no worse.  Blanks in a row, whose pieces all rank equal, are cut by the longest
piece of blanks, as merging from the left fills those one after the other.

Characters without a piece become byte pieces.  Decoding joins the pieces' bytes by table.  Models
of another type than BPE, without byte fallback, with normalisation rules, user-defined or unused pieces
are refused.  The tables (some MB, fixed by the model) travel with the tasks, which need no model file.

Edge cases: null text is empty; empty texts have no ids, no ids (or null) decode to the empty text; equal rows give
equal rows; texts of any length are read whole; bytes that make no character decode to U+FFFD each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import doc_bytes, spread, table

BLANK = "▁"
SLICE = 1 << 20
#: Ranks of pairs that make no piece themselves but are part of one, and of pairs that never meet in a piece.
NONE, APART = (1 << 30), (1 << 30) + 1
#: Code points below this have a table of their own pairs.
NEAR = 512


@dataclass
class Pieces:
    """A model as arrays.  Symbols are piece ids; other characters are ``size`` plus their code point."""

    size: int
    #: Symbol of each code point.
    symbol: np.ndarray
    #: Pairs (left * span + right) in a hash table with open places (-1), their rank, and the symbol they make.
    pair: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    #: Rank of each piece, and whether it can be part of a pair of no worse rank.
    own: np.ndarray
    hasty: np.ndarray
    #: Whether two near code points can be in one piece.
    near: np.ndarray
    #: Id of each byte's piece; bytes of each piece and where they begin.
    byte_id: np.ndarray
    data: np.ndarray
    at: np.ndarray
    #: Pieces that are single bytes, and those without text of their own.
    is_byte: np.ndarray
    silent: np.ndarray
    #: Length of the longest piece of blanks, if runs of blanks can be cut by it, else 0.
    blanks: int
    prefix: bool

    @property
    def span(self) -> int:
        return self.size + 0x110000

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and its place in the table."""
        key = left.astype(np.int64) * self.span + right
        place = hashed(key, len(self.pair))
        held = self.pair[place]
        other = np.flatnonzero((held != key) & (held >= 0))
        while len(other):  # taken by another pair: one place on
            place[other] = (place[other] + 1) & (len(self.pair) - 1)
            held = self.pair[place[other]]
            other = other[(held != key[other]) & (held >= 0)]
        return np.where(self.pair[place] == key, self.rank[place], APART), place


def hashed(key: np.ndarray, size: int) -> np.ndarray:
    """First place of each key in a table of ``size`` (a power of two)."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hash_table(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The keys in a table at most half full, and the values in the same places."""
    size = 1 << (2 * len(key)).bit_length()
    table, row = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    left, place = np.arange(len(key)), hashed(key, size)
    while len(left):
        free = table[place] < 0
        table[place[free]] = key[left[free]]  # of several for one place the last is there
        row[place[free]] = left[free]
        there = table[place] == key[left]
        left, place = left[~there], (place[~there] + 1) & (size - 1)
    return table, *(v[row] for v in values)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a serialised message (as far as a model's file needs them)."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def load_pieces(path: str) -> Pieces:
    """Tables of a model file."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    held = dict(_fields(raw))  # 2: training, 3: normalisation
    trained, normal = dict(_fields(held[2])), dict(_fields(held[3]))
    kinds = [dict(_fields(value)).get(3, 1) for number, value in _fields(raw) if number == 1]
    if trained.get(3, 1) != 2 or not trained.get(35, 0) or normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1) or set(kinds) - {1, 2, 3, 6} or trained.get(24, 0):
        raise ValueError("only BPE models with byte fallback and without normalisation are encoded")
    size = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(size)]
    piece = {text[i]: i for i in range(size) if kinds[i] == 1}
    levels = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in piece.values()}, reverse=True))}
    own = np.full(size, NONE, np.int32)
    for i in piece.values():
        own[i] = levels[model.get_score(i)]
    chars = set("".join(piece))

    def symbol_of(x: str) -> int | None:
        return piece[x] if x in piece else size + ord(x) if x in chars else None

    inside = {x[i:j] for x in piece for i in range(len(x)) for j in range(i + 2, len(x) + 1)}
    span = size + 0x110000
    rows = []
    for x in inside:
        for cut in range(1, len(x)):
            a, b = symbol_of(x[:cut]), symbol_of(x[cut:])
            if a is not None and b is not None:
                rows.append((a * span + b, own[piece[x]] if x in piece else NONE, piece.get(x, -1), a, b))
    pair, rank, made, left, right = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    hasty = np.zeros(size, bool)
    for part in (left, right):
        known = part < size
        early = rank[known] <= own[part[known]]
        hasty[part[known][early]] = True
    pair, rank, made = hash_table(pair, rank.astype(np.int32), made.astype(np.int32))
    symbol = np.arange(0x110000, dtype=np.int32) + size
    for c in chars & set(piece):
        symbol[ord(c)] = piece[c]
    near = np.zeros((NEAR, NEAR), bool)
    for x in inside:
        if len(x) == 2 and max(map(ord, x)) < NEAR:
            near[ord(x[0]), ord(x[1])] = True
    byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    is_byte = np.array([k == 6 for k in kinds])
    data = [b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else bytes([int(t[3:5], 16)]) if k == 6 else t.replace(BLANK, " ").encode() for t, k in zip(text, kinds, strict=True)]
    runs = [x for x in piece if set(x) == {BLANK}]
    longest = max(map(len, runs), default=0)
    # blanks begin pieces only, and those of several blanks rank equal and last
    plain = all(BLANK not in x[1:] for x in piece if set(x) != {BLANK}) and len({own[piece[x]] for x in runs if len(x) > 1}) == 1
    last = plain and all(own[piece[x]] >= own[i] for x in runs if len(x) > 1 for i in piece.values())
    filled = BLANK * longest in piece and _from_left([BLANK] * longest, piece) == [BLANK * longest]
    return Pieces(
        size, symbol, pair, rank, made, own, hasty, near, byte_id, np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])],
        is_byte, np.array([k == 3 for k in kinds]), longest if last and filled and longest > 1 else 0, bool(normal.get(3, 1)),
    )


def _from_left(parts: list[str], piece: dict[str, int]) -> list[str]:
    """Equal symbols merged pair by pair, leftmost first."""
    while at := next((i + 1 for i, (a, b) in enumerate(pairwise(parts)) if a + b in piece), 0):
        parts = [*parts[: at - 1], parts[at - 1] + parts[at], *parts[at + 1 :]]
    return parts


def merge_rounds(model: Pieces, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that stay, and where they stood, of stretches laid end to end.  ``code``: code points; ``first``: where a
    stretch begins."""
    out = np.full(len(code), -1, np.int32)
    symbol, place = model.symbol[code], np.arange(len(code))
    rank = np.full(len(code), APART, np.int32)  # of each symbol with the next
    rank[:-1] = model.find(symbol[:-1], symbol[1:])[0]
    rank[first[1:] - 1] = APART
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, rank[:-1] == APART])
        sizes = np.diff(np.r_[starts, len(symbol)])
        least = np.minimum.reduceat(rank, starts)
        if (least >= NONE).any():
            done = np.repeat(least >= NONE, sizes)
            out[place[done]] = symbol[done]
            symbol, place, rank = symbol[~done], place[~done], rank[~done]
            sizes, least = sizes[least < NONE], least[least < NONE]
            if not len(symbol):
                break
        stretch = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(rank == least[stretch])
        # every other one of pairs that overlap, from the left
        row = np.r_[True, np.diff(at) != 1]
        at = at[(np.arange(len(at)) - np.flatnonzero(row)[np.cumsum(row) - 1]) % 2 == 0]
        made = model.made[model.find(symbol[at], symbol[at + 1])[1]]
        owner = stretch[at]
        if (several := np.r_[False, owner[1:] == owner[:-1]]).any() and model.hasty[made].any():
            # merges to the right of one that makes a pair of no worse rank wait
            after = at + 2
            inner = rank[at + 1] != APART
            right = np.full(len(at), APART, np.int32)
            right[inner] = model.find(made[inner], symbol[np.minimum(after, len(symbol) - 1)][inner])[0]
            left = np.full(len(at), APART, np.int32)
            inner = (at > 0) & (rank[at - 1] != APART)
            touching = several & np.r_[False, at[1:] - at[:-1] == 2]
            before = np.where(touching, np.r_[0, made[:-1]], symbol[at - 1])
            left[inner] = model.find(before[inner], made[inner])[0]
            now = rank[at]
            stop = np.cumsum(np.minimum(left, right) <= now) - (np.minimum(left, right) <= now)
            heads = np.flatnonzero(~several)
            go = stop == stop[heads][np.cumsum(~several) - 1]
            at, made = at[go], made[go]
        symbol[at] = made
        rank[at] = rank[at + 1]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, place, rank = symbol[stay], place[stay], rank[stay]
        at = at - np.arange(len(at))
        renew = np.zeros(len(symbol) + 1, bool)
        renew[at] = True
        renew[at - 1] = True  # of the first symbol: the place beyond the end
        changed = np.flatnonzero(renew[:-1] & (rank != APART))
        rank[changed] = model.find(symbol[changed], symbol[changed + 1])[0]
    stood = np.flatnonzero(out >= 0)
    return out[stood], stood


def stretches(model: Pieces, code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where stretches begin that share no piece with the one before: at texts, at neighbours that no piece holds, and
    in long runs of blanks."""
    new = np.ones(len(code), bool)
    a, b = code[:-1], code[1:]
    near = (a < NEAR) & (b < NEAR)
    far = np.flatnonzero(~near)
    joint = near.copy()
    joint[near] = model.near[a[near], b[near]]
    joint[far] = model.find(model.symbol[a[far]], model.symbol[b[far]])[0] != APART
    new[1:] = ~joint
    if model.blanks:
        blank = code == ord(BLANK)
        head = blank & np.r_[True, ~blank[:-1]]
        head[edges[:-1][edges[:-1] < len(code)]] = True
        since = np.arange(len(code)) - np.maximum.accumulate(np.where(head, np.arange(len(code)), 0))
        new |= blank & (since % model.blanks == 0)
    new[edges[:-1][edges[:-1] < len(code)]] = True
    return np.flatnonzero(new)


def encode_slice(model: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice in a row, and the edges of the texts in them."""
    n = len(offsets) - 1
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
    edges = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    filled = np.diff(edges) > 0
    if not filled.any():
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    raw[raw == 32] = ord(BLANK)
    if model.prefix:
        shift = np.r_[0, np.cumsum(filled)]
        code = np.full(len(raw) + int(shift[-1]), ord(BLANK), np.int32)
        code[np.arange(len(raw)) + np.repeat(shift[1:], np.diff(edges))] = raw
        edges = edges + shift
    else:
        code = raw
    begin = stretches(model, code, edges)
    bounds = np.r_[begin, len(code)].astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(4 * bounds), pa.py_buffer(code)]).dictionary_encode()
    which = held.indices.to_numpy().astype(np.int64)
    sample = np.empty(len(held.dictionary), np.int64)
    sample[which[::-1]] = np.arange(len(which))[::-1]
    sizes = np.diff(bounds)[sample]
    own = code[spread(begin[sample], sizes)]
    first = np.cumsum(sizes) - sizes
    symbol, stood = merge_rounds(model, own, first)
    # characters without a piece become their bytes
    owner = np.searchsorted(first, stood, "right") - 1
    lone = symbol >= model.size
    if lone.any():
        point = symbol[lone] - model.size
        many = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        spelled = np.frombuffer(point.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        width = np.ones(len(symbol), np.int64)
        width[lone] = many
        ids = np.empty(int(width.sum()), np.int32)
        into = np.cumsum(width) - width
        ids[into[~lone]] = symbol[~lone]
        ids[spread(into[lone], many)] = model.byte_id[spelled]
        symbol, owner = ids, np.repeat(owner, width)
    counts = np.bincount(owner, minlength=len(sample))
    at = np.cumsum(counts) - counts
    ids = symbol[spread(at[which], counts[which])]
    total = np.r_[0, np.cumsum(counts[which])]
    return ids, total[np.searchsorted(begin, edges)]


def encode_pieces(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("ids", T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in doc_bytes(batch.column(1), SLICE):
                ids, edges = encode_slice(model, data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, schema)


def _one_mark(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def decode_slice(model: Pieces, ids: np.ndarray, edges: np.ndarray) -> list[str]:
    """Texts of rows of ids laid end to end."""
    start, size = model.at[ids], np.diff(model.at)[ids]
    if model.prefix:  # the blank that encoding put before the text
        spoken = np.flatnonzero(~model.silent[ids])
        place = np.searchsorted(spoken, edges[:-1])
        has = place < len(spoken)
        head = spoken[place[has]][spoken[place[has]] < edges[1:][has]]
        head = head[(model.data[np.minimum(start[head], len(model.data) - 1)] == 32) & (size[head] > 0) & ~model.is_byte[ids[head]] & (model.own[ids[head]] < NONE)]
        start[head] += 1
        size[head] -= 1
    whole = model.data[spread(start, size)].tobytes()
    codecs.register_error("versify-one-mark", _one_mark)
    silent = np.flatnonzero(model.silent[ids])
    parts = np.sort(np.r_[edges, silent])  # no character goes across a piece without text
    cut = np.r_[0, np.cumsum(size)][parts]
    texts = [whole[a:b].decode("utf-8", "versify-one-mark") for a, b in pairwise(cut.tolist())]
    if len(silent):
        at = np.searchsorted(parts, edges)
        texts = ["".join(texts[a:b]) for a, b in pairwise(at.tolist())]
    return texts


def decode_pieces(rows: DataFrame, model: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text of every row; ids outside the model's are an error."""
    schema = T.StructType([T.StructField("doc_id", rows.schema[id_col].dataType), T.StructField("ids", rows.schema[ids_col].dataType)]).add("text", T.StringType())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            lists = batch.column(1)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            edges = np.r_[0, np.cumsum(sizes)]
            values = lists.flatten().to_numpy(zero_copy_only=False)
            while first < batch.num_rows:  # some rows at a time: as many ids as a slice has bytes, or one longer row
                last = max(first + 1, int(np.searchsorted(edges, edges[first] + SLICE // 4, "right")) - 1)
                own = edges[first : last + 1]
                texts = decode_slice(model, values[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists.slice(first, last - first), pa.array(texts, pa.string())], schema.names)
                first = last

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decoded, schema)


def op13_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op13_piece_rounds": op13_piece_rounds}
