"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where enough of its bits are zero: more bits
below the normal size, fewer above it (normalised chunking), never below the least and always
at the largest size.  As a cut depends on the last 32 bytes only, an edit changes the
chunks around it and no others.  A fingerprint is the set of chunk digests with their
lengths; the containment of a document in another is the share of its bytes that lies in
chunks of the other too.

Edge cases: null is empty; an empty text has an empty fingerprint, which is like another empty one
(1) and unlike the rest (0); equal texts have equal fingerprints; rows with one id follow each
other in order of the md5 of their text, null ids come first; the last row is followed by the first, one
single row by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import keep, mix, table

LEAST, NORMAL, LARGEST = 32, 96, 384
#: Bits that must be zero to cut before and after the normal size.
HARD, EASY = 8, 5
#: Characters of the rows that one task takes in order of their id.
RANGE_CHARS = 16_000_000
#: Ranges at most; on larger inputs they hold more characters.
MOST_RANGES = 50_000
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

Fingerprint = dict[int, int]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: of the last 32 bytes, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(h: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, from its rolling hashes."""
    easy = np.flatnonzero(h >> np.uint32(32 - EASY) == 0) + 1
    hard = h[easy - 1] >> np.uint32(32 - HARD) == 0
    ends, easy, hard = [], easy.tolist(), hard.tolist()
    start, size, k = 0, len(h), 0
    while size - start > LEAST:
        end = min(start + LARGEST, size)
        while k < len(easy) and easy[k] < start + LEAST:
            k += 1
        while k < len(easy) and easy[k] < end:
            if hard[k] or easy[k] - start >= NORMAL:
                end = easy[k]
                break
            k += 1
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def chunk_digest(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=6).digest())


def fingerprint(text: bytes) -> Fingerprint:
    """Chunk digests and the bytes that each stands for."""
    out: Fingerprint = {}
    start = 0
    for end in cuts(gear_hashes(np.frombuffer(text, np.uint8))):
        key = chunk_digest(text[start:end])
        out[key] = out.get(key, 0) + end - start
        start = end
    return out


def as_text(f: Fingerprint) -> str:
    """digest:length of all chunks in ascending order."""
    return " ".join(f"{k:012x}:{f[k]}" for k in sorted(f))


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """Share of a's bytes in chunks that b has too, as often at most."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(min(n, b[k]) for k, n in a.items() if k in b) / total


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The smaller of both containments: 1 for equal texts, near 0 for one that is a small part."""
    return min(containment(a, b), containment(b, a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every row, without a shuffle."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(fingerprint((t.as_py() or "").encode())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(made, schema)


def in_ranges(rows: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """Rows of (id, text) with ``part``: ranges of ascending ids; and the number of ranges.  The text moves once,
    later, so the bounds come from the ids alone: quantiles found by Spark, one for each range."""
    if not isinstance(rows.schema["id"].dataType, T.NumericType):
        raise ValueError("the order of the rows needs a numeric id")
    wanted = min(int(chars // RANGE_CHARS) + 1, MOST_RANGES)
    if wanted == 1:
        return rows.withColumn("part", F.lit(0).cast("long")), 1
    bounds = sorted(set(rows.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.1 / wanted)))
    splits = [float("-inf"), *bounds, float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_part", handleInvalid="keep").transform(rows.withColumn("_at", F.col("id").cast("double")))
    part = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("_part")).cast("long")
    return dealt.withColumn("part", part).drop("_at", "_part"), len(splits) - 1


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of every row and its edited text; see op10."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranged, parts = in_ranges(rows, chars)
    # a range's last row needs the first one of the next range that has rows; the last range's that of the first
    head = F.min(F.struct(F.col("id").isNotNull().alias("given"), "id", F.md5("text").alias("body")))
    heads = ranged.groupBy("part").agg(head.alias("h"))  # one short row for each range, at most MOST_RANGES
    in_order = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(in_order), F.max("part").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # as a file, whose size the planner knows before it would move the texts for the join
    closing = keep(heads.select(F.col("h.id").alias("hid"), F.col("h.body").alias("body"), before.alias("to")), "closing")
    id_type = docs.schema[id_col].dataType
    ends = ranged.join(closing, F.col("id").eqNullSafe(F.col("hid"))).where(F.md5("text") == F.col("body")).select("id", "text", F.col("to").alias("part"))
    ends = ends.dropDuplicates(["part"])
    both = ranged.select("part", F.lit(0).alias("late"), "id", "text").unionByName(ends.select("part", F.lit(1).alias("late"), "id", "text"))
    ordered = both.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "late", "id", F.md5("text"))
    schema = T.StructType([T.StructField("doc_id", id_type)])
    schema.add("n_chars", T.LongType()).add("edited_sha256", T.StringType()).add("fingerprint", T.StringType()).add("edited_fingerprint", T.StringType())
    schema.add("near_edited", T.DoubleType()).add("near_next", T.DoubleType())

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, fingerprint of the row before
        for batch in batches:
            out: list[list] = [[] for _ in schema.names]
            for part, late, own, text in zip(*batch.columns, strict=True):
                part, late, own, text = part.as_py(), late.as_py(), own.as_py(), text.as_py()
                print_ = fingerprint(text.encode())
                if held is not None and held[0] == part:
                    before, quarter = held[2], len(held[2]) // 4
                    changed = (before[: len(before) - quarter] + text[:quarter]).encode()
                    new = fingerprint(changed)
                    row = (held[1], len(before), hashlib.sha256(changed).hexdigest(), as_text(held[3]), as_text(new), likeness(held[3], new), likeness(held[3], print_))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                held = None if late else (part, own, text, print_)
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], schema.names)

    return ordered.mapInArrow(edited, schema)


def op10_cdc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op10_cdc_fingerprint": op10_cdc_fingerprint}
