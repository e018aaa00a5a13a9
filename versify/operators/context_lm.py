"""Variable-order character model with back-off, and generation over a context window (L1, L4).

A context is the string of the last 0 to ``ORDER`` characters.  All orders are counted in one aggregate, each
character once for every suffix of its history.  Probabilities are interpolated by absolute
discounting, lowest order first:

    p(t | c) = (n(c, t) - D) / n(c) + D * kinds(c) / n(c) * p(t | c without its first character)

down to one part in V for each of the V characters of the vocabulary; the second factor of the sum alone is the
weight for characters not seen after c.  They sum to one in every context.  Generation draws from the longest
known context; what lies before that is forgotten, so the next context is again one the corpus holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versify.operators import lm as LM
from versify.operators.bpe import code_points, text_slices

ORDER = 3
DISCOUNT = 0.75


def suffixes(history: Column) -> Column:
    """All suffixes, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.length(history)), lambda k: F.right(history, k))


def counted_grams(texts: list[str], order: int) -> pa.RecordBatch:
    """(history, token, n) of some texts.  A character and those before it become one number, from the numbers of the
    characters in these texts; texts of too many different ones are counted in halves, a single one gram by gram."""
    bits = 64 // (order + 1)
    points = code_points("".join(texts))
    alphabet, code = np.unique(points, return_inverse=True)
    if len(alphabet) + 1 >= 1 << bits and len(texts) > 1:
        half = len(texts) // 2
        return pa.concat_batches([counted_grams(texts[:half], order), counted_grams(texts[half:], order)])
    if len(alphabet) + 1 >= 1 << bits:
        found = Counter((texts[0][max(0, i - order) : i], c) for i, c in enumerate(texts[0]))
        columns = [pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.string()), pa.array(found.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["history", "token", "n"])
    sizes = np.array([len(t) for t in texts], np.int64)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = code.astype(np.uint64) + np.uint64(1)  # 0: before the text
    gram = code.copy()
    for k in range(1, order + 1):
        gram[k:] |= np.where(place[k:] >= k, code[:-k], np.uint64(0)) << np.uint64(k * bits)
    gram, n = np.unique(gram, return_counts=True)
    chars = pa.array(["", *map(chr, alphabet.tolist())], pa.string())
    part = lambda k: chars.take(pa.array((gram >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)))
    history = pc.binary_join_element_wise(*(part(k) for k in range(order, 0, -1)), "") if order else pa.array([""] * len(gram), pa.string())
    return pa.RecordBatch.from_arrays([history, part(0), pa.array(n, pa.int64())], ["history", "token", "n"])


def grams(texts: DataFrame, *key: str, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(key, history, token, n): the characters with up to ``order`` before them in the same text.  Without a key they are
    counted in slices of the texts before they are grouped."""
    if not key and order < 8:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in text_slices(batch, 0):
                    yield counted_grams([t for t in rows.column(0).to_pylist() if t], order)

        found = texts.select(text_col).mapInArrow(counted, "history string, token string, n long")
        return found.groupBy("history", "token").agg(F.sum("n").alias("n"))
    chars = texts.select(*key, F.filter(F.split(text_col, ""), lambda c: c != "").alias("chars"))
    one = F.transform(
        F.sequence(F.lit(1), F.size("chars")),
        lambda i: F.struct(F.array_join(F.slice("chars", F.greatest(F.lit(1), i - order), F.least(F.lit(order), i - 1)), "").alias("history"), F.get("chars", i - 1).alias("token")),
    )
    return chars.where(F.size("chars") > 0).select(*key, F.inline(one)).groupBy(*key, "history", "token").agg(F.count(F.lit(1)).alias("n"))


def context_model(counts: DataFrame, vocab_size: int, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """L1: (ctx, token, n, ctx_n, p, backoff) of all orders; backoff is the same for all rows of a context."""
    every = counts.select(F.explode(suffixes(F.col("history"))).alias("ctx"), "token", "n").groupBy("ctx", "token").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("ctx")
    stat = every.withColumn("ctx_n", F.sum("n").over(own)).withColumn("kinds", F.count("*").over(own))
    stat = stat.withColumn("backoff", discount * F.col("kinds") / F.col("ctx_n")).withColumn("direct", (F.col("n") - discount) / F.col("ctx_n")).checkpoint()
    level = stat.where(F.length("ctx") == 0).withColumn("p", F.col("direct") + F.col("backoff") / vocab_size)
    out = level
    for k in range(1, order + 1):
        lower = level.select(F.col("ctx").alias("shorter"), "token", F.col("p").alias("lower"))
        here = stat.where(F.length("ctx") == k).withColumn("shorter", F.right("ctx", F.lit(k - 1)))
        level = here.join(lower, ["shorter", "token"]).withColumn("p", F.col("direct") + F.col("backoff") * F.col("lower")).select(*out.columns)
        out = out.unionByName(level)
    return out.select("ctx", "token", "n", "ctx_n", "p", "backoff")


def log_probability(pairs: DataFrame, model: DataFrame, vocab_size: int) -> DataFrame:
    """(history, token, logp) of distinct pairs: the longest context in which the token was seen, times the weights of the known
    contexts above it."""
    asked = pairs.select("history", "token").distinct().withColumn("ctx", F.explode(suffixes(F.col("history"))))
    seen = asked.join(model.select("ctx", "token", "p"), ["ctx", "token"], "left")
    known = seen.join(model.groupBy("ctx").agg(F.first("backoff").alias("backoff")), "ctx", "left")
    steps = known.groupBy("history", "token").agg(F.sort_array(F.collect_list(F.struct(F.length("ctx").alias("k"), "p", "backoff")), asc=False).alias("steps"))  # one for each order
    start = F.struct(F.lit(False).alias("found"), F.lit(0.0).alias("logp"))

    def step(a: Column, x: Column) -> Column:
        at = F.struct(F.lit(True).alias("found"), (a["logp"] + F.log(x["p"])).alias("logp"))
        on = F.struct(F.lit(False).alias("found"), (a["logp"] + F.log(F.coalesce(x["backoff"], F.lit(1.0)))).alias("logp"))
        return F.when(a["found"], a).when(x["p"].isNotNull(), at).otherwise(on)

    total = F.aggregate("steps", start, step, lambda a: F.when(a["found"], a["logp"]).otherwise(a["logp"] - F.log(F.lit(float(vocab_size)))))
    return steps.select("history", "token", total.alias("logp"))


def candidates(model: DataFrame, prompts: DataFrame, temperature: float, k: int | None, p: float | None, order: int = ORDER) -> DataFrame:
    """(tail, ctx, cands): for every tail that a generation can come to, its longest known context and that one's truncated
    distribution as [lo, hi) intervals.  ``prompts`` has a column tail."""
    dist = model.select("ctx", "token", F.log("p").alias("logit"))
    cands = LM.intervals(LM.truncated(dist, temperature, k, p)).groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "token"))).alias("cands"))
    tails = model.select(F.right(F.concat("ctx", "token"), F.lit(order)).alias("tail")).union(prompts.select("tail")).distinct()
    shorter = tails.select("tail", F.explode(suffixes(F.col("tail"))).alias("ctx"))
    longest = shorter.join(cands.select("ctx"), "ctx", "left_semi").groupBy("tail").agg(F.max_by("ctx", F.length("ctx")).alias("ctx"))
    return longest.join(cands, "ctx").select("tail", "ctx", "cands")


def generate(prompts: DataFrame, table: DataFrame, eos: str | None, max_new: int, order: int = ORDER, cut_every: int = 6) -> DataFrame:
    """L4: (sample_id, text, n_new, done) from prompts (sample_id, tail): one character a step for all samples that have not
    ended, drawn by a hash-seeded number; EOS ends a sample and is kept.  Ended samples leave the loop, and lineage is
    cut every few steps."""
    state = prompts.select("sample_id", "tail", F.lit("").alias("text"), F.lit(False).alias("done"), F.lit(0).alias("n_new"))
    out = None
    for step in range(max_new):
        u = LM.uniform(F.col("sample_id"), F.lit(step))
        held = state.join(table, "tail", "left")
        hit = F.try_element_at(F.filter("cands", lambda c: (u >= c["lo"]) & (u < c["hi"])), F.lit(1))["token"]
        tok = F.when(~F.col("done"), F.coalesce(hit, F.try_element_at("cands", F.lit(-1))["token"])).alias("_tok")
        ended = F.col("done") | F.col("_tok").isNull() | (F.col("_tok") == F.lit(eos) if eos is not None else F.lit(False))
        state = held.select("sample_id", "tail", "ctx", "text", "done", "n_new", tok).select(
            "sample_id",
            F.when(F.col("_tok").isNull(), F.col("tail")).otherwise(F.right(F.concat("ctx", "_tok"), F.lit(order))).alias("tail"),
            F.concat("text", F.coalesce("_tok", F.lit(""))).alias("text"),
            ended.alias("done"),
            (F.col("n_new") + F.col("_tok").isNotNull().cast("int")).alias("n_new"),
        )
        if (step + 1) % cut_every == 0 or step + 1 == max_new:
            state = state.checkpoint()
            gone = state.where("done")
            out = gone if out is None else out.unionByName(gone)
            state = state.where("not done")
            if state.isEmpty():
                break
    return (out.unionByName(state) if out is not None else state).select("sample_id", "text", "n_new", "done")
