"""Token streams and training blocks.

A split's token stream is the concatenation of its encoded documents in
shuffle order, with one separator token before every document but the first.
Global positions come from a two-phase prefix sum over per-document token
counts (see ``corpus.running_total``), never from a one-partition window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.operators.corpus import running_total
from versify.operators.vocab import CharCodec, train_val_split

# Cells cut at once.
CELLS = 1 << 14
# Numbers below this are looked up by themselves when they are written out.
KINDS = 1 << 17


def stream_offsets(docs: DataFrame, rank_col: str = "rank", ids_col: str = "ids") -> DataFrame:
    """Adds ``start``: global position of each document's first token."""
    counted = docs.withColumn("_len", F.size(ids_col).cast("long"))
    return running_total(counted, rank_col, "_len", "start").drop("_len")


def stream_tokens(docs: DataFrame, rank_col: str = "rank", ids_col: str = "ids") -> DataFrame:
    """(pos long, id int): the flat token stream (S9 layout)."""
    placed = stream_offsets(docs, rank_col, ids_col)
    return placed.select(
        "start", F.posexplode(ids_col).alias("i", "id")
    ).select((F.col("start") + F.col("i")).alias("pos"), F.col("id"))


def stream_order(keys: DataFrame, key: str, ratio: float = 0.9) -> DataFrame:
    """(key, rank, split, first) of (key): the shuffle order, and whether a row begins its split.  Only keys move."""
    ranked = train_val_split(keys.select(key), key, ratio).checkpoint()
    firsts = [r["first"] for r in ranked.groupBy("split").agg(F.min("rank").alias("first")).collect()]  # a row for each split
    return ranked.select(key, "rank", "split", F.col("rank").isin(firsts).alias("first"))


def stream_starts(sized: DataFrame) -> DataFrame:
    """Adds ``start`` to (rank, split, n): the tokens before a row in the stream of its split.  The rows, without their
    texts, are written once, as their sum and the two passes of the prefix sums each read them."""
    sized = sized.checkpoint()
    train = sized.agg(F.sum(F.when(F.col("split") == "train", F.col("n")))).first()[0] or 0  # one scalar
    start = F.col("at") - F.when(F.col("split") == "val", F.lit(train)).otherwise(F.lit(0))
    return running_total(sized, "rank", "n", "at").withColumn("start", start.cast("long")).drop("at")


def stream_places(lengths: DataFrame, key: str, ratio: float = 0.9) -> DataFrame:
    """(key, split, first, start) of (key, ln): where each document begins in the stream of its split, in
    shuffle order, with one separator before every document but the first of a split.  Only keys and lengths move."""
    ordered = stream_order(lengths, key, ratio).join(lengths.select(key, "ln"), key)
    sized = ordered.withColumn("n", F.col("ln") + F.when(F.col("first"), 0).otherwise(1))
    return stream_starts(sized.select(key, "rank", "split", "first", "n")).select(key, "split", "first", "start")


def encoded_streams(docs: DataFrame, places: DataFrame, key: str, codec: CharCodec, text_col: str = "text") -> DataFrame:
    """(split, start, key, ids) of (key, text): the texts join their places once and are encoded there, separators in
    front; a character that the vocabulary lacks fails the job."""
    text = F.when(F.col("first"), F.col("_t")).otherwise(F.concat(F.lit("\n"), F.col("_t")))
    joined = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(places, key)
    return joined.select("split", "start", key, codec.encode_strict(text).alias("ids"))


def pack_blocks(tokens: DataFrame, n_tokens: int, batch: int, block: int) -> DataFrame:
    """Batches of ``batch x block`` inputs and their next-token targets.

    Batch k covers positions [k*B*T, (k+1)*B*T] (one extra for the target);
    only full batches exist, so there are (N - 1) div (B*T) of them; a token
    contributes to x of its own cell and to y of the cell of position - 1."""
    bt = batch * block
    n_batches = (n_tokens - 1) // bt if n_tokens >= bt + 1 else 0
    limit = n_batches * bt
    x = tokens.where(F.col("pos") < limit).select(
        (F.col("pos") / bt).cast("long").alias("batch_no"),
        ((F.col("pos") % bt) / block).cast("long").alias("row_no"),
        (F.col("pos") % block).alias("col"),
        F.col("id"),
        F.lit("x").alias("role"),
    )
    yp = F.col("pos") - 1
    y = tokens.where((yp >= 0) & (yp < limit)).select(
        (yp / bt).cast("long").alias("batch_no"),
        ((yp % bt) / block).cast("long").alias("row_no"),
        (yp % block).alias("col"),
        F.col("id"),
        F.lit("y").alias("role"),
    )
    cells = x.unionByName(y)
    isx = F.col("role") == "x"
    return cells.groupBy("batch_no", "row_no").agg(
        F.sum(F.when(isx, F.col("id"))).cast("long").alias("x_sum"),
        F.sum(F.when(~isx, F.col("id"))).cast("long").alias("y_sum"),
        F.max(F.when(isx & (F.col("col") == 0), F.col("id"))).cast("long").alias("x_first"),
        F.max(F.when(~isx & (F.col("col") == block - 1), F.col("id"))).cast("long").alias("y_last"),
        F.count(F.lit(1)).cast("long").alias("cells"),
    )


def char_pairs(docs: DataFrame, keys: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """(keys, a, b, n): adjacent characters of each text, counted before anything is looked up."""
    chars = docs.select(*keys, F.filter(F.split(F.col(text_col), ""), lambda c: c != "").alias("_c"))
    zipped = F.arrays_zip(F.col("_c").alias("a"), F.slice("_c", 2, 1 << 30).alias("b"))
    pairs = chars.select(*keys, F.explode(zipped).alias("p")).where(F.col("p.b").isNotNull())
    return pairs.groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def next_token_pairs(pairs: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """W8 / L1 counts: (keys, id, next_id, n) from counted character pairs."""
    first = vocab.select(F.col("token").alias("a"), "id")
    second = vocab.select(F.col("token").alias("b"), F.col("id").alias("next_id"))
    return pairs.join(first, "a").join(second, "b").select(*keys, "id", "next_id", "n")


def interior_cells(docs: DataFrame, limit: int, block: int, codec: CharCodec | None = None, digest: bool = False) -> DataFrame:
    """(c, x, y) of (start, ids): the cells before ``limit`` whose x and y lie in one document, cut many at a time.  With
    a ``codec``, of (start, text): texts are encoded where they are cut, with ``digest`` cells leave it as of ``block_digest``: no array leaves the task, and
    no task chains two Python workers."""
    ids = T.ArrayType(T.IntegerType()) if codec else docs.schema.fields[1].dataType
    encoder = codec.encoder(docs.columns[1]) if codec else iter

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encoder(batches):
            start, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(batch.num_columns - 1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ln = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            low = -(-start // block)
            high = np.minimum((start + ln - 1 - block) // block, limit // block - 1)  # y ends one after x
            many = np.maximum(high - low + 1, 0)
            before = np.cumsum(many) - many
            for at in range(0, int(many.sum()), CELLS):
                cell = np.arange(at, min(at + CELLS, int(many.sum())))
                row = np.searchsorted(before + many, cell, "right")
                c = low[row] + cell - before[row]
                x = ((offsets[row] + c * block - start[row])[:, None] + np.arange(block)).ravel()
                edges = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * block)
                parts = [pa.ListArray.from_arrays(edges, lists.values.take(pa.array(i))) for i in (x, x + 1)]
                if digest:
                    ends = [lists.values.take(pa.array(i)).cast(pa.int64()) for i in (x[::block], x[block - 1 :: block] + 1)]
                    parts = [*map(joined_md5, parts), *ends, pa.array(np.full(len(cell), block))]
                yield pa.RecordBatch.from_arrays([pa.array(c), *parts], names)

    schema = "c long, x_md5 string, y_md5 string, x_first long, y_last long, block_len long"
    schema = schema if digest else T.StructType().add("c", T.LongType()).add("x", ids).add("y", ids)
    names = ["c", "x_md5", "y_md5", "x_first", "y_last", "block_len"] if digest else ["c", "x", "y"]
    return docs.mapInArrow(cut, schema)


def pack_from_docs(docs: DataFrame, n_tokens: int, batch: int, block: int, ids_col: str = "ids",
                   edges: DataFrame | None = None, codec: CharCodec | None = None,
                   digest: bool = False) -> DataFrame:
    """W9 without exploding tokens: (batch_no, row_no, x array<int>, y array<int>).

    Interior cells (x and y inside one document) are two slices of that
    document's ids, emitted in place with no shuffle.  Cells spanning documents
    are gathered from pieces: a cell holds at most ``block`` ids from its pieces
    (a bounded group), ordered by position.  Every boundary piece lies in the
    first or last ``block + 1`` ids of its document, so ``edges`` may carry only
    (start, ln, head, tail) id arrays; without it they are sliced from ``docs``.
    With ``edges`` and a ``codec``, ``ids_col`` may hold texts, encoded as they are cut.
    With ``digest`` the blocks come as of ``block_digest``, interior ones digested as they are cut.
    Rows shuffled ~ documents, not tokens."""
    bt = batch * block
    n_batches = (n_tokens - 1) // bt if n_tokens >= bt + 1 else 0
    limit = n_batches * bt
    start, ln = F.col("start"), F.size(ids_col).cast("long")

    def inside(c: F.Column, ln: F.Column) -> F.Column:
        # both the x range [cT, cT+T) and the y range [cT+1, cT+T+1) lie in this document
        return (c * block >= start) & ((c + 1) * block + 1 <= start + ln)

    # Interior cells: x and y are two slices of one document's ids, no shuffle.
    interior = interior_cells(docs.select("start", ids_col), limit, block, codec, digest)

    # Boundary cells: pieces from the head or the tail of each document.
    if edges is None:
        edges = docs.select(
            "start",
            ln.alias("ln"),
            F.slice(ids_col, 1, block + 1).alias("head"),
            F.slice(ids_col, F.greatest(F.size(ids_col) - block, F.lit(1)), block + 1).alias("tail"),
        )
    e_ln = F.col("ln").cast("long")
    head, tail = F.col("head"), F.col("tail")
    tail_start = start + e_ln - F.size(tail)

    def pieces(shift: int) -> F.Column:
        c0 = F.floor((start - shift) / block)
        c1 = F.floor((start + e_ln - 1 - shift) / block)
        seq = F.when((e_ln > 0) & (c1 >= F.greatest(c0, F.lit(0))), F.sequence(F.greatest(c0, F.lit(0)), c1)).otherwise(
            F.array().cast("array<bigint>")
        )
        seq = F.filter(seq, lambda c: (c * block < limit) & ~inside(c, e_ln))

        def piece(c: F.Column) -> F.Column:
            lo = F.greatest(start, c * block + shift)
            hi = F.least(start + e_ln, (c + 1) * block + shift)
            from_head = F.slice(head, (lo - start + 1).cast("int"), (hi - lo).cast("int"))
            from_tail = F.slice(tail, (lo - tail_start + 1).cast("int"), (hi - lo).cast("int"))
            return F.struct(
                c.alias("c"),
                F.lit(shift).alias("role"),
                lo.alias("lo"),
                F.when(hi <= start + F.size(head), from_head).otherwise(from_tail).alias("part"),
            )

        return F.transform(seq, piece)

    parts = edges.select(F.explode(F.concat(pieces(0), pieces(1))).alias("p")).select("p.*")
    per_cell = parts.groupBy("c", "role").agg(F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("ps"))
    seqs = per_cell.select("c", "role", F.flatten(F.transform("ps", lambda x: x["part"])).alias("ids"))
    gathered = seqs.groupBy("c").agg(
        F.max(F.when(F.col("role") == 0, F.col("ids"))).alias("x"),
        F.max(F.when(F.col("role") == 1, F.col("ids"))).alias("y"),
    )

    def numbered(cells: DataFrame) -> DataFrame:
        no, row = (F.col("c") / batch).cast("long").alias("batch_no"), (F.col("c") % batch).cast("long").alias("row_no")
        return cells.select(no, row, *(c for c in cells.columns if c != "c"))

    if digest:
        return numbered(interior).unionByName(block_digest(numbered(gathered)))
    return numbered(interior.unionByName(gathered))


def joined_md5(lists: pa.ListArray) -> pa.Array:
    """The md5 of the numbers of each list joined by commas, as of ``md5(array_join(..., ','))``."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    own = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    numbers = pc.fill_null(own, 0).to_numpy()
    if 0 <= numbers.min(initial=0) and numbers.max(initial=0) < KINDS:
        kinds, at = np.arange(numbers.max(initial=0) + 1), numbers
    else:
        kinds, at = np.unique(numbers, return_inverse=True)
    at = np.where(own.is_valid().to_numpy(zero_copy_only=False), at, len(kinds)) if own.null_count else at
    words = np.array([*(f"{k}," for k in kinds.tolist()), ""], "S")
    edges = np.r_[0, np.cumsum(np.char.str_len(words).take(at))][offsets - offsets[0]]
    flat = words.take(at).tobytes().translate(None, b"\0")  # shorter words are filled up with zeros
    ends = np.maximum(edges[:-1], edges[1:] - 1)  # without the last comma
    made = [hashlib.md5(flat[a:b], usedforsecurity=False).hexdigest() for a, b in zip(edges[:-1].tolist(), ends.tolist(), strict=True)]
    return pa.array(made, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))


def block_digest(blocks: DataFrame) -> DataFrame:
    """Blocks as comparable scalars: md5 of the id lists, first x id, last y id, length."""
    return blocks.select(
        "batch_no",
        "row_no",
        F.md5(F.array_join("x", ",")).alias("x_md5"),
        F.md5(F.array_join("y", ",")).alias("y_md5"),
        F.element_at("x", 1).cast("long").alias("x_first"),
        F.element_at("y", -1).cast("long").alias("y_last"),
        F.size("x").cast("long").alias("block_len"),
    )
