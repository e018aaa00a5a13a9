"""Hard negatives by exact integer products in a residue number system.

Components are whole numbers floor(scale * x).  The score of two rows is their inner product; it is computed modulo
several small primes as float32 matrix products of the residues (so small that no sum leaves the whole numbers
that float32 holds) and put together by Chinese remaindering into the exact signed score.  The
number of primes follows from the largest component of the table.

Anchors are a stated query set against all rows, in blocks: rows and anchors are dealt to blocks of about
``BLOCK`` rows by a hash, and each pair of blocks is one group, worked off in tiles of few anchors.  A
first pass finds the first positives of each anchor, a second one, with the windows that
their scores give, the first negatives in each.  Each group sends at most as many rows for an
anchor (and positive) as are asked for in the end, so nothing depends on how many rows share a label or vector.

Rows take part if id, label and vector are not null and all components are numbers.  Edge cases: of equal
rows each is an anchor, positive or negative of its own; vectors of different lengths have no score, so rows
meet only those of their length; empty vectors have score 0; fewer positives or negatives than asked for
give all; anchors without positives, and an empty table, give no rows; other columns are not
read; products that could leave 62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versify.llm.common import keep, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: Negatives score from so many hundredths of the positive's score up to all of it.
LOWEST = 80
BLOCK = 4_096
TILE = 64
#: Components summed in one float32 product.
WIDTH = 1_024
LEAST = np.iinfo(np.int64).min


def primes_for(bound: int, width: int) -> list[int]:
    """Odd primes, largest first, whose product exceeds twice ``bound``, with residues (from -p / 2 to p / 2) whose
    products sum up over ``width`` components within 2**24."""
    most = 2 * int((2**24 / max(1, width)) ** 0.5) + 1
    most = min(most, 4093)
    out, product = [], 1
    for n in range(most, 2, -1):
        if product > 2 * bound + 1:
            break
        if n % 2 and all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            out.append(n)
            product *= n
    return out


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the values modulo it as float32, from -p / 2 to p / 2."""
    return [((values + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows from the residues of both sides."""
    parts = []
    for a, b, p in zip(left, right, primes, strict=True):
        total = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], WIDTH):
            total += (a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T).astype(np.int64)
        parts.append(total % p)
    # mixed radix digits: score = d0 + p0 * (d1 + p1 * (d2 + ...)), signed by taking the last digit around zero
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        d = parts[k]
        for j in range(k):
            d = (d - digits[j]) * pow(primes[j], -1, p) % p
        digits.append(d if k + 1 < len(primes) else (d + p // 2) % p - p // 2)
    out = digits[-1]
    for d, p in zip(digits[-2::-1], primes[-2::-1], strict=True):
        out = out * p + d
    return out


def first_of(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of each row, ties by smaller id."""
    held = np.where(allowed, score, LEAST)
    if held.shape[1] > k:
        edge = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        allowed = allowed & (held >= edge[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def whole_numbers(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(uid, id, label, size, v) of the rows that take part: v holds 64-bit whole numbers as bytes; top, the largest of them."""
    number = F.col(vector_col).cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, top, size = [], [], []
            for value in batch.column(2):
                v = np.floor(scale * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if len(v) and np.abs(v).max() >= 2.0**53:
                    raise OverflowError("components beyond 53 bits")
                packed.append(v.astype(np.int64).tobytes())
                top.append(int(np.abs(v).max()) if len(v) else 0)
                size.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(packed, pa.binary()), pa.array(top, pa.int64())], ["id", "label", "size", "v", "top"])

    out = source.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), number.alias("v"))
    return out.mapInArrow(made, "id long, label long, size int, v binary, top long").withColumn("uid", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), size)


def blocks_of(rows: DataFrame, asking: DataFrame, n_rows: int, n_asking: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt to all pairs of their blocks."""
    right, left = max(1, -(-n_rows // BLOCK)), max(1, -(-n_asking // BLOCK))
    dealt = rows.withColumn("r", F.pmod(F.xxhash64("uid"), F.lit(right))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(left - 1))))
    fresh = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # columns of their own, as both sides come from one table
    asked = fresh.withColumn("a", F.pmod(F.xxhash64("uid"), F.lit(left)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(right - 1).cast("long"))))
    return asked, dealt, ["size", "a", "r"]


def first_positives(rows: DataFrame, asking: DataFrame, counts: tuple[int, int], primes: dict[int, list[int]], k: int) -> DataFrame:
    """(anchor, pick, positive, score): the k best other rows of each anchor's label; pick from 1."""

    def met(ask: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if ask.num_rows and own.num_rows:
            size = ask.column("size")[0].as_py()
            ids, uid, label = (own.column(c).to_numpy() for c in ("id", "uid", "label"))
            right = residues(_matrix(own.column("v"), size), primes[size])
            who, which, x = ask.column("uid").to_numpy(), ask.column("label").to_numpy(), _matrix(ask.column("v"), size)
            for at in range(0, len(who), TILE):
                score = products(residues(x[at : at + TILE], primes[size]), right, primes[size])
                like = (which[at : at + TILE, None] == label) & (who[at : at + TILE, None] != uid)
                row, column = first_of(score, like, ids, k)
                out.append((who[at + row], uid[column], ids[column], score[row, column]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor", "other", "positive", "score"])

    asked, dealt, keys = blocks_of(rows, asking, *counts)
    columns = [*keys, "uid", "id", "label", "v"]
    found = asked.select(*columns).groupBy(*keys).cogroup(dealt.select(*columns).groupBy(*keys)).applyInArrow(met, "anchor long, other long, positive long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive", "other")
    return found.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k).select("anchor", "pick", "positive", "score")


def first_negatives(rows: DataFrame, asking: DataFrame, counts: tuple[int, int], primes: dict[int, list[int]], k: int, lowest: int) -> DataFrame:
    """(anchor, pick, rank, negative, score): the k best rows of another label in the window of each of an anchor's ``best`` positives."""

    def met(ask: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if ask.num_rows and own.num_rows:
            size = ask.column("size")[0].as_py()
            ids, uid, label = (own.column(c).to_numpy() for c in ("id", "uid", "label"))
            right = residues(_matrix(own.column("v"), size), primes[size])
            who, which, x = ask.column("uid").to_numpy(), ask.column("label").to_numpy(), _matrix(ask.column("v"), size)
            best = ask.column("best").to_pylist()
            for at in range(0, len(who), TILE):
                score = products(residues(x[at : at + TILE], primes[size]), right, primes[size])
                unlike = which[at : at + TILE, None] != label
                tops = best[at : at + TILE]
                for pick in range(max(map(len, tops))):
                    # whole numbers: lowest * positive <= 100 * negative as a bound on the negative
                    high = np.array([t[pick] if pick < len(t) else LEAST for t in tops], np.int64)
                    low = np.array([-(-lowest * t[pick] // 100) if pick < len(t) else 0 for t in tops], np.int64)
                    row, column = first_of(score, unlike & (score >= low[:, None]) & (score <= high[:, None]), ids, k)
                    out.append((who[at + row], np.full(len(row), pick + 1), uid[column], ids[column], score[row, column]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor", "pick", "other", "negative", "score"])

    asked, dealt, keys = blocks_of(rows, asking, *counts)
    columns = [*keys, "uid", "id", "label", "v"]
    found = asked.select(*columns, "best").groupBy(*keys).cogroup(dealt.select(*columns).groupBy(*keys)).applyInArrow(met, "anchor long, pick long, other long, negative long, score long")
    order = Window.partitionBy("anchor", "pick").orderBy(F.desc("score"), "negative", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "pick", "rank", "negative", F.col("score").alias("negative_score"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, scale: int = SCALE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  ``is_anchor``: a column of ``id``."""
    own = keep(whole_numbers(rows, scale, id_col, label_col, vector_col), "whole")
    anchors = own.where(is_anchor)
    sizes = own.groupBy("size").agg(F.count("*").alias("n"), F.max("top").alias("top"), F.count(F.when(is_anchor, 1)).alias("asking")).collect()  # one row for each length of vector
    primes = {}
    for r in sizes:
        bound = max(1, r["size"]) * r["top"] ** 2
        if bound >= 1 << 61:
            raise OverflowError("scores beyond 62 bits")
        primes[r["size"]] = primes_for(bound, min(WIDTH, r["size"]))
    counts = (sum(r["n"] for r in sizes), sum(r["asking"] for r in sizes))
    found = keep(first_positives(own, anchors, counts, primes, positives), "positives")
    best = found.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("pick", "score"))), lambda x: x["score"]).alias("best"))
    asking = anchors.join(best, F.col("uid") == F.col("anchor")).drop("anchor")
    mined = first_negatives(own, asking, counts, primes, negatives, lowest)
    out = mined.join(found, ["anchor", "pick"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")


def op12_rns_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


#: Rows and scores in DuckDB, on doubles that hold the whole numbers exactly.
OP12_SQL = """
WITH own AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label AS own_label, b.id AS other, b.label AS other_label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM own a JOIN own b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, own_label, other AS positive_id, score AS positive_score FROM scored WHERE own_label = other_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.other_label <> p.own_label
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 5
"""

QUERIES = {"op12_rns_negatives": op12_rns_negatives}
ORACLE = {"op12_rns_negatives": OP12_SQL}
