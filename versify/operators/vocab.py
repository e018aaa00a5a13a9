"""Vocabularies, encoding, decoding and splits.

A vocabulary is a table ``vocab(token string, id int)``.  Ids are dense ranks
in binary (code-point) order.  Lookups are joins; the vocabulary side is
left to the planner, which broadcasts it only where its size allows.

A character vocabulary has at most one token for each Unicode code point, so it may
go to the driver whatever the corpus; it becomes two literal strings for ``translate``,
which looks every character up in a hash table inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.functions.text import to_special_chars
from versify.operators.bpe import code_points, text_slices

SEED = 42


def dense_ids(tokens: DataFrame, col: str = "token", first_id: int = 0, kind: str = "int") -> DataFrame:
    """id = rank in binary order.

    The set is never put in one partition: it is range-partitioned, each partition
    counts its rows (one row per partition), the exclusive prefix of those
    counts is joined back and added to a row number inside each partition."""
    ranged = tokens.select(col).repartitionByRange(col).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.checkpoint()  # pin the partition ids; cuts lineage in the shared checkpoint folder
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_off"
        ),
    )
    inside = Window.partitionBy("_pid").orderBy(col)
    return (
        ranged.join(offsets, "_pid")
        .select(col, (F.col("_off") + F.row_number().over(inside) - 1 + first_id).cast(kind).alias("id"))
    )


def char_set(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A7 + U2: distinct characters; a newline is added because the texts are
    joined with newlines before the set is taken.  Each task marks the characters of
    its texts, many at a time, so the shuffle carries at most one row per (task, character)."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            for rows in text_slices(batch, 0):
                seen[code_points("".join(t or "" for t in rows.column(0).to_pylist()))] = True
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in np.flatnonzero(seen)], pa.string())], ["token"])

    chars = texts.select(text_col).mapInArrow(marked, "token string")
    nl = texts.sparkSession.createDataFrame([("\n",)], "token string")
    return chars.unionByName(nl).distinct()


def char_vocab(texts: DataFrame, text_col: str = "text", special_chars: bool = True) -> DataFrame:
    """A7 + W4 + K7: sorted character vocabulary (specials mapped to chars first).
    One pass over the texts; the set, at most one row for each Unicode code point whatever the corpus, is ranked on
    the driver, which holds it for the codec anyway, so consumers don't read the texts again."""
    src = texts.select(to_special_chars(F.col(text_col)).alias("text")) if special_chars else texts.select(
        F.col(text_col).alias("text")
    )
    tokens = sorted(r["token"] for r in char_set(src).collect())  # code points sort as their UTF-8 bytes do
    return texts.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def syllable_vocab(tokens: DataFrame) -> DataFrame:
    """A8 + U4: distinct syllable tokens in binary order, ``<UNK>`` at id 0 when absent."""
    distinct = tokens.select("token").distinct().checkpoint()  # the vocabulary set, computed once
    unk = tokens.sparkSession.createDataFrame([("<UNK>",)], "token string")
    missing = unk.join(distinct, "token", "left_anti")  # insert-if-missing
    has_unk = distinct.where(F.col("token") == "<UNK>").limit(1).count() > 0
    if has_unk:
        return dense_ids(distinct)
    ranked = dense_ids(distinct).withColumn("id", F.col("id") + 1)
    return ranked.unionByName(missing.select("token", F.lit(0).alias("id")))


_SURROGATES, _SURROGATE_COUNT = 0xD800, 0x800


class CharCodec:
    """A character vocabulary on the driver: the tokens in order of their ids, and for each
    the character whose code point stands for the id (id + 1, past the surrogates)."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        points = ((i + 1) + (_SURROGATE_COUNT if i + 1 >= _SURROGATES else 0) for i in range(len(tokens)))
        self.plain, self.coded = "".join(tokens), "".join(map(chr, points))
        self.ids = {t: i for i, t in enumerate(tokens)}

    def __len__(self) -> int:
        return len(self.tokens)

    def unknown(self, text: Column) -> Column:
        """The characters that the vocabulary lacks."""
        return F.translate(text, self.plain, "")

    def known(self, text: Column) -> Column:
        """The text without its unknown characters."""
        rest = self.unknown(text)
        return F.when(rest == "", text).otherwise(F.call_function("translate", text, rest, F.lit("")))

    def encode(self, text: Column) -> Column:
        """Ids of the characters of a text that holds known ones only."""
        point = lambda c: F.ascii(c) - 1 - F.when(F.ascii(c) > _SURROGATES, _SURROGATE_COUNT).otherwise(0)
        return F.transform(F.filter(F.split(F.translate(text, self.plain, self.coded), ""), lambda c: c != ""), point)

    def encode_strict(self, text: Column) -> Column:
        """J1 strict: ``encode``; a text with a character that the vocabulary lacks fails the job and names it."""
        rest = self.unknown(text)
        return F.when(rest == "", self.encode(text)).when(rest.isNotNull(), F.raise_error(F.concat(F.lit("not in the vocabulary: "), rest)).cast("array<int>"))

    def decode(self, ids: Column) -> Column:
        """The text of an id array."""
        tokens = F.filter(F.split(F.lit(self.plain), ""), lambda c: c != "")  # folded to one literal array
        return F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), "")


    def encoder(self, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """J1 for the batches of a task: a column ids as of ``encode``, looked up for many texts at a time."""
        plain = self.plain

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.arange(0x110000, dtype=np.int32) - 1
            table[_SURROGATES + 1 :] -= _SURROGATE_COUNT
            table[code_points(plain)] = np.arange(len(plain))
            for batch in batches:
                for rows in text_slices(batch, place_of(batch, text_col)):
                    texts = rows.column(place_of(rows, text_col)).to_pylist()
                    edges = np.cumsum([0, *(len(t or "") for t in texts)])
                    offsets = pa.array(edges, pa.int32(), mask=np.array([*(t is None for t in texts), False]))
                    ids = pa.ListArray.from_arrays(offsets, pa.array(table[code_points("".join(t or "" for t in texts))]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*rows.schema.names, "ids"])

        return encoded

    def encode_rows(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with a column ids as of ``encode``."""
        schema = T.StructType([*docs.schema.fields]).add("ids", T.ArrayType(T.IntegerType()))
        return docs.mapInArrow(self.encoder(text_col), schema)

    def decode_rows(self, docs: DataFrame, ids_col: str = "ids", out_col: str = "dec") -> DataFrame:
        """``docs`` with the texts of their id arrays in place of these, as of ``decode``."""
        plain = self.plain
        kept = [c for c in docs.columns if c != ids_col]

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chars = code_points(plain)
            for batch in batches:
                at = place_of(batch, ids_col)
                texts = []
                for ids in batch.column(at):
                    own = None if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False)
                    texts.append(None if own is None else chars[own[(own >= 0) & (own < len(chars))].astype(np.int64)].tobytes().decode("utf-32-le"))
                yield pa.RecordBatch.from_arrays([*(batch.column(place_of(batch, c)) for c in kept), pa.array(texts, pa.string())], [*kept, out_col])

        return docs.mapInArrow(decoded, T.StructType([docs.schema[c] for c in kept]).add(out_col, T.StringType()))


def place_of(batch: pa.RecordBatch, column: str) -> int:
    return batch.schema.get_field_index(column)


def char_codec(vocab: DataFrame) -> CharCodec:
    """The codec of a character vocabulary (at most one row for each code point)."""
    return CharCodec([r["token"] for r in vocab.orderBy("id").select("token").collect()])


def explode_chars(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(F.split(F.col(text_col), "")).alias("pos", "token")).where(
        F.col("token") != ""
    )


def encode_join(tokens: DataFrame, vocab: DataFrame, strict: bool = True) -> DataFrame:
    """J1 (strict: LEFT join, unknown -> null id to be counted) or J2 (INNER: drop unknowns)."""
    return tokens.join(vocab, "token", "left" if strict else "inner")


def token_id(tokens: DataFrame, vocab: DataFrame, unk_token: str = "<UNK>") -> DataFrame:
    """Id of each token, else the UNK id, else -1."""
    unk_rows = vocab.where(F.col("token") == unk_token).select("id").limit(1).collect()
    unk_id = unk_rows[0][0] if unk_rows else None
    looked = tokens.join(vocab, "token", "left")
    return looked.select(*tokens.columns, F.coalesce(F.col("id"), F.lit(unk_id).cast("int"), F.lit(-1)).alias("id"))


def shuffle_key(key: Column, seed: int = SEED) -> Column:
    """K5: deterministic shuffle order md5(seed:key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffle_ranks(keys: DataFrame, ratio: float = 0.9) -> DataFrame:
    """K6 exact: (_shuf, rank, split) of the shuffle keys (_shuf): the first floor(ratio * n) in their order are train."""
    ranks = dense_ids(keys.select(F.col("_shuf").alias("token")), "token", first_id=1, kind="long")
    ranks = ranks.withColumnRenamed("token", "_shuf").withColumnRenamed("id", "rank").checkpoint()  # reused by every consumer
    n_train = int(ranks.count() * ratio)
    return ranks.withColumn("split", F.when(F.col("rank") <= n_train, F.lit("train")).otherwise(F.lit("val")))


def train_val_split(docs: DataFrame, key: str, ratio: float = 0.9, seed: int = SEED) -> DataFrame:
    """K6 exact: rank in md5 order; the first floor(ratio * n) are train."""
    ordered = docs.withColumn("_shuf", shuffle_key(F.col(key), seed))
    return ordered.join(shuffle_ranks(ordered.select("_shuf"), ratio), "_shuf").drop("_shuf")


def hash_split(docs: DataFrame, key: str, ratio: float = 0.9, seed: int = SEED) -> DataFrame:
    """K6 by buckets: train where the first 32 bits of md5(seed:key) are below ``ratio`` of their range.  A projection, without
    rank, count or shuffle, and the same for a document whatever others there are; the share is only about ``ratio``."""
    bits = F.conv(F.substring(shuffle_key(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return docs.withColumn("split", F.when(bits < int(ratio * (1 << 32)), F.lit("train")).otherwise(F.lit("val")))
