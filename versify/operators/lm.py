"""Next-token statistics and truncated sampling.

The transformer of the original project is re-aimed to a character bigram
model: counts per (context, token) are a ``groupBy``; probabilities,
temperature, top-k and top-p are windows partitioned by context (a context's
distribution is bounded by the vocabulary); draws are inverse-CDF lookups
with hash-seeded uniforms, so every result is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def bigram_model(pairs: DataFrame, vocab_size: int, k: float = 1.0) -> DataFrame:
    """L1: (ctx, token, n, p) with add-k smoothing over the vocabulary."""
    ctx = Window.partitionBy("ctx")
    return pairs.select(F.col("id").alias("ctx"), F.col("next_id").alias("token"), "n").withColumn(
        "ctx_n", F.sum("n").over(ctx)
    ).withColumn("p", (F.col("n") + k) / (F.col("ctx_n") + k * vocab_size))


def pair_nll(pairs: DataFrame, model: DataFrame, vocab_size: int, k: float = 1.0) -> DataFrame:
    """L2: negative log-likelihood of each observed (ctx, token) pair; unseen
    pairs get the smoothed floor of their context, unseen contexts 1/V."""
    ctx_tot = model.select("ctx", "ctx_n").distinct()
    joined = pairs.join(model.select("ctx", "token", "n"), ["ctx", "token"], "left").join(ctx_tot, "ctx", "left")
    p = (F.coalesce(F.col("n"), F.lit(0)) + k) / (F.coalesce(F.col("ctx_n"), F.lit(0)) + k * vocab_size)
    return joined.withColumn("nll", -F.log(p))


def softmax_t(dist: DataFrame, temperature: float) -> DataFrame:
    """K3: temperature softmax of ``logit`` per ``ctx`` (max-subtracted)."""
    ctx = Window.partitionBy("ctx")
    z = F.col("logit") / temperature
    e = dist.withColumn("_e", F.exp(z - F.max(z).over(ctx)))
    return e.withColumn("prob", F.col("_e") / F.sum("_e").over(ctx)).drop("_e")


def top_k(dist: DataFrame, k: int | None) -> DataFrame:
    """K1: keep logits >= the k-th largest (ties kept); k clipped; None or 0 disables."""
    if not k:
        return dist
    return dist.withColumn("_r", F.rank().over(Window.partitionBy("ctx").orderBy(F.desc("logit")))).where(
        F.col("_r") <= k
    ).drop("_r")


def top_p(dist: DataFrame, p: float | None) -> DataFrame:
    """K2: on re-normalised probabilities, keep a token iff the mass strictly
    before it (logit desc, token asc) is <= p; the first token is always kept."""
    if not p:
        return dist
    ctx = Window.partitionBy("ctx")
    order = ctx.orderBy(F.desc("logit"), F.asc("token")).rowsBetween(Window.unboundedPreceding, -1)
    renorm = dist.withColumn("_q", F.col("prob") / F.sum("prob").over(ctx))
    before = F.round(F.coalesce(F.sum("_q").over(order), F.lit(0.0)), 9)
    return renorm.withColumn("_before", before).where(F.col("_before") <= p).drop("_q", "_before")


def truncated(
    dist: DataFrame,
    temperature: float,
    k: int | None,
    p: float | None,
    dist_transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """K3 -> V1 hook -> K1 -> K2 -> final softmax over the survivors."""
    d = dist.withColumn("logit", F.col("logit") / temperature)
    if dist_transform is not None:
        d = dist_transform(d)
    d = top_p(softmax_t(top_k(d, k), 1.0), p)
    return softmax_t(d.drop("prob"), 1.0)


def intervals(dist: DataFrame) -> DataFrame:
    """K4 support: cumulative [lo, hi) per ctx in (logit desc, token asc) order."""
    order = Window.partitionBy("ctx").orderBy(F.desc("logit"), F.asc("token"))
    hi = F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return dist.withColumn("hi", F.round(hi, 9)).withColumn("lo", F.round(hi - F.col("prob"), 9))


def uniform(*parts: Column) -> Column:
    """Hash-seeded uniform in [0, 1): first 8 hex digits of md5(seed:parts...) / 2^32."""
    key = F.concat_ws(":", F.lit(str(SEED)), *[x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def draw(samples: DataFrame, iv: DataFrame) -> DataFrame:
    """K4: samples(sample_id, ctx, u) -> the token whose [lo, hi) holds u;
    u above the last hi (rounding) falls to the last token of the context."""
    last = iv.groupBy("ctx").agg(F.max_by("token", "hi").alias("_last"))
    hit = samples.join(iv.select("ctx", "token", "lo", "hi"), "ctx", "left").where(
        (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
    )
    picked = hit.groupBy("sample_id").agg(F.min("token").alias("token"))
    return (
        samples.join(picked, "sample_id", "left")
        .join(last, "ctx", "left")
        .select("sample_id", "ctx", "u", F.coalesce("token", "_last").alias("token"))
    )


def generate(
    prompts: DataFrame,
    iv: DataFrame,
    eos_id: int | None,
    max_new_tokens: int,
    checkpoint_every: int = 8,
) -> DataFrame:
    """L4: batch generation for every prompt row (sample_id, ids array<int>).

    Context = the last token (the bigram order bounds the context window).
    The truncated distribution is folded to one row per context holding its
    sorted [lo, hi) intervals (bounded by top-k).  Each step is then a single
    join of the state on its context and one projection that picks the token whose interval holds a
    hash-seeded uniform, so the state is referenced once per step; a sample
    stops right after emitting ``eos_id`` (EOS kept); lineage is cut every few
    steps."""
    cands = iv.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "token"))).alias("cands"))
    cands = cands.checkpoint()
    state = prompts.select(
        "sample_id", F.col("ids").cast("array<int>").alias("ids"), F.lit(False).alias("done"), F.lit(0).alias("n_new")
    )
    for step in range(max_new_tokens):
        u = uniform(F.col("sample_id"), F.lit(step))
        joined = state.withColumn("ctx", F.element_at("ids", -1)).join(cands, "ctx", "left")
        hit = F.try_element_at(F.filter("cands", lambda c: (u >= c["lo"]) & (u < c["hi"])), F.lit(1))["token"]
        tok = F.when(~F.col("done"), F.coalesce(hit, F.try_element_at("cands", F.lit(-1))["token"]))
        state = joined.withColumn("_tok", tok).select(
            "sample_id",
            F.when(F.col("_tok").isNotNull(), F.concat("ids", F.array(F.col("_tok").cast("int")))).otherwise(F.col("ids")).alias("ids"),
            (F.col("done") | F.col("_tok").isNull() | ((F.col("_tok") == eos_id) if eos_id is not None else F.lit(False))).alias("done"),
            (F.col("n_new") + F.when(F.col("_tok").isNotNull(), 1).otherwise(0)).alias("n_new"),
        )
        if (step + 1) % checkpoint_every == 0:
            state = state.checkpoint()
            if state.where(~F.col("done")).limit(1).count() == 0:
                break
    return state
