import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from versify.llm import mixing, packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for size, k in itertools.product((1, 2, 5, 9), (1, 2, 3, 4)):
        lengths = np.sort(rng.choice(np.arange(1, 60), size, replace=False)).astype(np.int64)
        counts = rng.integers(1, 9, size)
        got = packing.best_boundaries(lengths, counts, k)
        least = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1].tolist(), m))
        assert padding(lengths, counts, got) == least and len(got) <= k and got[-1] == lengths[-1]
    assert packing.best_boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_batches_keep_every_token(spark, docs):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y z"), (5, "w " * 1000), *((i, "t " * (i % 37)) for i in range(10, 200))]
    df = docs(rows, ("n", "key", "piece", "bucket_len"))
    got = packing.pack_documents(df, max_len=64, n_buckets=4, token_budget=256).collect()
    want = sum(len((t or "").replace(" ", "_").split()) + 1 for _, t in rows)
    assert sum(r["n_tokens"] for r in got) == want
    assert len({r["bucket_len"] for r in got}) == 4 and all(r["n_tokens"] <= r["bucket_len"] for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket_len"], r["batch_no"]), []).append(r["slot"])
    for (length, no), slots in batches.items():
        last = no == max(n for b, n in batches if b == length)
        assert sorted(slots) == list(range(len(slots))) and len(slots) * length <= 256 and (last or len(slots) == 256 // length)
    assert {r["seq_no"] for r in got if r["doc_id"] == 5} == set(range(math.ceil(1001 / 64)))
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_poisson_counts(spark, docs):
    assert abs(sum(1 - c for c in mixing.poisson_cdf(7.5)) - 7.5) < 1e-9  # the mean is the sum of the tails
    assert abs(sum(1 - c for c in mixing.poisson_cdf(900.0)) - 900) < 1e-6
    assert mixing.poisson_cdf(0.0) == [1.0]


def test_mix_hits_its_weights(spark, docs):
    rows = [(i, f"text {i}" + " y" * 40, "big" if i % 10 else "small") for i in range(4000)]
    df = docs(rows, ("mix_rate", "_u"))
    got = mixing.poisson_mix(df, {"big": 1.0, "small": 1.0})
    sums = {r["source"]: r["c"] for r in got.groupBy("source").agg(F.sum(F.length("text")).alias("c")).collect()}
    assert 0.85 < sums["big"] / sums["small"] < 1.18
    assert 0.9 < sum(sums.values()) / sum(len(t) for _, t, _ in rows) < 1.1
    keys = [r["mix_key"] for r in got.select("mix_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = mixing.poisson_mix(df.repartition(7), {"big": 1.0, "small": 1.0})
    assert sorted(r["mix_key"] for r in again.select("mix_key").collect()) == keys


def test_mix_edge_cases(spark, docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x", None), (3, "x", None), (None, "y", "b"), (5, "z", "left out")]
    got = mixing.poisson_mix(docs(rows), {"a": 1, None: 1, "b": 1})
    assert all(r["source"] != "left out" for r in got.collect())
    pairs = [r["n"] for r in got.where("doc_id = 3").groupBy("mix_copy").agg(F.count("*").alias("n")).collect()]
    assert all(n == 2 for n in pairs)  # equal rows, equal counts
    assert mixing.poisson_mix(docs(rows).limit(0)).count() == 0
