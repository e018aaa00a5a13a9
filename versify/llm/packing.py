"""Packing into length buckets that a dynamic programme over the global histogram chooses.

A document is a sequence of tokens (its words and one end token).  Documents longer than
``max_len`` are cut into sequences of ``max_len`` tokens and a rest, so nothing is dropped
and the histogram has at most ``max_len`` entries whatever the input: that bound is what
may go to the driver.  The programme finds the bucket lengths (at most ``n_buckets``)
for which the padding summed over all sequences is least; of equal solutions the one
with the smallest previous boundary, from the last bucket back.  Inside a bucket the
sequences are put in a seeded order and cut into batches of ``token_budget // length``.

Edge cases: null or empty text is one end token; null ids count as an empty id in the order;
repeated rows are sequences of their own; an empty table gives no rows; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versify.llm.common import WORD, keep, table

MAX_LEN = 4096
N_BUCKETS = 12
TOKEN_BUDGET = 32_768
SEED = "pack"


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): words of the text and one end token."""
    words = F.regexp_count(F.col(text_col), F.lit(WORD))
    return docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(words, F.lit(0)) + 1).cast("long").alias("n"))


def sequences(lengths: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, seq_no, n_tokens): documents over ``max_len`` tokens in several sequences."""
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len)))
    return lengths.select("doc_id", "n", cut.alias("seq_no")).select(
        "doc_id", "seq_no", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("seq_no") * max_len).alias("n_tokens")
    )


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Bucket lengths with the least padding, for a histogram in ascending order of length.

    best[j] over the first j lengths with k buckets is the least best'[i] plus the padding of
    one bucket for i..j; the smallest best i never falls as j rises, so each layer is
    solved by halving."""
    size = len(lengths)
    if not size:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    tall = np.concatenate([[0], lengths])
    best = tall * rows - tokens
    back: list[np.ndarray] = []
    for k in range(2, min(n_buckets, size) + 1):
        layer, prev = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        todo = [(k, size, k - 1, size - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(left, min(right, mid - 1) + 1)
            cost = best[i] + tall[mid] * (rows[mid] - rows[i]) - (tokens[mid] - tokens[i])
            at = int(np.argmin(cost))
            layer[mid], prev[mid] = cost[at], i[at]
            todo += [(low, mid - 1, left, int(i[at])), (mid + 1, high, int(i[at]), right)]
        best = layer
        back.append(prev)
    j, out = size, [int(lengths[-1])]
    for prev in reversed(back):
        j = int(prev[j])
        out.append(int(tall[j]))
    return out[::-1]


def bucket_of(n_tokens: Column, boundaries: list[int]) -> Column:
    """The smallest boundary that holds the sequence."""
    out = F.lit(None).cast("long")
    for b in reversed(boundaries):
        out = F.when(n_tokens <= b, F.lit(b).cast("long")).otherwise(out)
    return out


def pack(lengths: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, seed: str = SEED) -> DataFrame:
    """Batches of sequences: doc_id, seq_no, n_tokens, bucket_len, batch_no, slot.

    ``lengths`` has doc_id and n.  The rank inside a bucket comes from 4,096 ranges of the
    seeded key: counted, summed up, and added to the rank inside the range, so no bucket
    is ever ordered by one task."""
    seqs = sequences(lengths, max_len)
    histogram = seqs.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    boundaries = best_boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), n_buckets)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("seq_no").cast("string")))
    keyed = seqs.select("*", bucket_of(F.col("n_tokens"), boundaries).alias("bucket_len"), key.alias("key")).withColumn("piece", F.substring("key", 1, 3))
    before = Window.partitionBy("bucket_len").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("bucket_len", "piece").agg(F.count("*").alias("c"))
    starts = starts.select("bucket_len", "piece", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket_len", "piece").orderBy("key", "doc_id", "seq_no", "n_tokens")
    ranked = keyed.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["bucket_len", "piece"])
    rank = F.col("start") + F.col("r")
    per_batch = F.floor(F.lit(token_budget) / F.col("bucket_len"))
    return ranked.select(
        "doc_id",
        "seq_no",
        "n_tokens",
        "bucket_len",
        F.floor(rank / per_batch).cast("long").alias("batch_no"),
        (rank % per_batch).cast("long").alias("slot"),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``pack`` over whole texts; the token counts are kept in the shared folder, so that the
    texts are read once."""
    return pack(keep(token_lengths(docs, id_col, text_col), "lengths"), **params)


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle(max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, seed: str = SEED) -> str:
    cost = "h.len * (h.c - {c}) - (h.t - {t})"
    steps = [f"d1 AS MATERIALIZED (SELECT h.j, {cost.format(c=0, t=0)} AS cost, [h.len] AS path FROM h)"]
    for k in range(2, n_buckets + 1):
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT h.j, any_value(h.len) AS len, min({{'c': d.cost + {cost.format(c='g.c', t='g.t')}, 'i': d.j}}) AS m "
            f"FROM d{k - 1} d JOIN h g ON g.j = d.j JOIN h ON h.j > d.j GROUP BY h.j)"
        )
        steps.append(f"d{k} AS MATERIALIZED (SELECT m.j, m.m.c AS cost, list_append(d.path, m.len) AS path FROM m{k} m JOIN d{k - 1} d ON d.j = m.m.i)")
    found = " UNION ALL ".join(f"SELECT {k} AS k, path FROM d{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, n_buckets + 1))
    return f"""
WITH lens AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS n FROM documents),
seqs AS (SELECT doc_id, s AS seq_no, least({max_len}, n - s * {max_len}) AS n_tokens
         FROM lens, unnest(generate_series(0, (n - 1) // {max_len})) AS u(s)),
hist AS (SELECT n_tokens AS len, count(*) AS cnt FROM seqs GROUP BY 1),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY len) AS j, CAST(len AS BIGINT) AS len,
      CAST(sum(cnt) OVER (ORDER BY len) AS BIGINT) AS c, CAST(sum(cnt * len) OVER (ORDER BY len) AS BIGINT) AS t FROM hist),
{", ".join(steps)},
best AS (SELECT path FROM ({found}) ORDER BY k DESC LIMIT 1),
bounds AS (SELECT unnest(path) AS b FROM best),
keyed AS (SELECT s.*, (SELECT min(b) FROM bounds WHERE b >= s.n_tokens) AS bucket_len,
          md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || seq_no) AS key FROM seqs s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY key, doc_id NULLS FIRST, seq_no, n_tokens) - 1 AS r FROM keyed)
SELECT doc_id, CAST(seq_no AS BIGINT) AS seq_no, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket_len AS BIGINT) AS bucket_len,
       CAST(r // ({budget} // bucket_len) AS BIGINT) AS batch_no, CAST(r % ({budget} // bucket_len) AS BIGINT) AS slot
FROM ranked"""


QUERIES = {"op1_length_buckets": op1_length_buckets}
ORACLE = {"op1_length_buckets": _oracle()}
