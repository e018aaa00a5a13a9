"""Whole-table invariants of the corpus and encoding queries (sf0.001)."""

from versify.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_token_count_invariant(spark):
    # characters counted with one newline per document; encoding adds one
    # separator per document except the first of each split -> total - 2
    total = QUERIES["corpus_stats"](spark, SF).first()["total_chars"]
    split = {r["split"]: r["n_tokens"] for r in QUERIES["split_tokens"](spark, SF).collect()}
    assert split["train"] + split["val"] == total - 2


def test_encode_decode_round_trip(spark):
    rows = QUERIES["decode"](spark, SF).collect()
    assert rows and all(r["round_trip"] for r in rows)


def test_bpe_round_trip_and_budget(spark):
    assert all(r["round_trip"] for r in QUERIES["bpe_decode"](spark, SF).collect())
    from versify.plans.catalog import half_of_words

    budget = half_of_words(spark, SF)
    kept = QUERIES["word_budget"](spark, SF).collect()
    assert sum(r["increment"] for r in kept) == budget
    assert all(r["words_before"] < budget for r in kept)
    assert sum(r["word_count"] for r in kept) >= budget  # the crossing row is kept whole


def test_pack_blocks_are_full(spark):
    rows = QUERIES["pack_blocks"](spark, SF).collect()
    assert rows and all(r["block_len"] == 64 for r in rows)


def test_running_total_across_buckets(spark):
    from versify.operators.corpus import running_total

    rows = [(i**3, (i * 7) % 5 + 1) for i in range(3000)]  # sparse keys
    df = spark.createDataFrame(rows, "doc_id long, w long")
    got = {r["doc_id"]: r["before"] for r in running_total(df, "doc_id", "w", "before").collect()}
    acc, want = 0, {}
    for i, w in rows:
        want[i] = acc
        acc += w
    assert got == want
