import datetime as dt
import random

from pyspark.sql import functions as F

from versify.operators import bpe as BPE
from versify.operators import runlog as RL
from versify.session import ensure_checkpoint_dir


def test_pretokenize_keeps_specials_and_prefix(spark):
    df = spark.createDataFrame([("<SONNET>ciao  mondo, sì\\n",)], "t string")
    toks = df.select(BPE.pretokenize(F.col("t"))).first()[0]
    assert toks[0] == "<SONNET>"
    assert "".join(toks[1:]) == " ciao  mondo, sì\\n"
    assert " mondo" in toks and "," in toks


def test_bpe_merges_most_frequent_pair_first(spark):
    ensure_checkpoint_dir(spark)
    texts = spark.createDataFrame([("aa aa aa ab",)], "text string")
    _, merges = BPE.train_bpe(texts, 3)
    # words: " aa" x3, " ab" x1 -> pairs (<20><61>) 4, (<61><61>) 3, (<61><62>) 1
    assert merges[0][1:] == ("<20>", "<61>", 4)
    ids = BPE.encode_ids(spark.createDataFrame([(1, "aa <END>é"), (2, ""), (3, None)], "doc_id long, text string"), merges)
    got = {r.doc_id: (r.ids, r.t, r.p) for r in ids.withColumn("t", BPE.decode_ids(F.col("ids"), merges)).withColumn("p", BPE.decode_ids(F.col("ids"), merges, True)).collect()}
    assert got[2] == ([], "", "") and got[3] == ([], "", "")
    assert got[1][1:] == (" aa <END> é", " aa  é") and 3 in got[1][0]


def test_bpe_ids_equal_merges_in_rank_order(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(300)] + ["a" * 40, "ab" * 30, "é" * 9]
    texts = spark.createDataFrame([(i, " ".join(rng.sample(words, 60))) for i in range(20)], "doc_id long, text string")
    table, merges = BPE.train_bpe(texts, 80)
    tokens = {t: i for i, t in reversed(list(enumerate(BPE.bpe_tokens(merges))))}

    def by_replacing(word):
        text = "".join(f"<{b:02x}>" for b in word.encode())
        for _, l, r, _ in merges:
            text = text.replace(l + r, BPE.merged_symbol(l, r))
        return text

    assert len(merges) == 80 and all(r.sym == by_replacing(r.word) for r in table.collect())
    got = {r.doc_id: r.ids for r in BPE.encode_ids(texts, merges).collect()}
    for r in texts.select("doc_id", BPE.pretokenize(F.col("text")).alias("w")).collect():
        assert got[r.doc_id] == [tokens[t + ">"] for w in r.w for t in by_replacing(w).split(">")[:-1]]


def test_bpe_encodes_with_many_merges(spark):
    """30,000 merges, which no chain of replacements would bear."""
    merges, names = [], [f"<{b:02x}>" for b in range(256)]
    rng = random.Random(1)
    seen = set(names)
    while len(merges) < 30_000:
        l, r = rng.choice(names), rng.choice(names)
        if len(l + r) < 40 and BPE.merged_symbol(l, r) not in seen:
            merges.append((len(merges), l, r, 2))
            names.append(BPE.merged_symbol(l, r))
            seen.add(names[-1])
    docs = spark.createDataFrame([(i, "il mare della sera " * 20) for i in range(50)], "doc_id long, text string")
    ids = BPE.encode_ids(docs, merges)
    back = ids.select(BPE.decode_ids(F.col("ids"), merges).alias("t")).distinct().collect()
    assert [r.t for r in back] == [" " + "il mare della sera " * 20]


def _events(spark, losses):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=10 * i), 7, float(v)) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")


def test_steps_best_and_early_stop(spark):
    ensure_checkpoint_dir(spark)
    # evaluation every step: improves at 0, 1, 3; then 3 evaluations without improvement
    steps = RL.ordered_steps(_events(spark, [5, 4, 4.5, 3, 3.5, 3.2, 3.1, 2.0]))
    got = {r["step"]: r["prev_ts"] for r in steps.collect()}
    assert sorted(got) == list(range(8)) and got[0] is None
    best = RL.best_step(RL.eval_rows(steps, 1)).first()
    assert best["best_step"] == 7 and best["best_loss"] == 2.0
    stop = RL.early_stop(RL.eval_rows(steps, 1), 1, 3).first()
    assert stop["stop_step"] == 6 and stop["best_step"] == 3
    tp = {r["step"]: r["tokens_per_s"] for r in RL.throughput(steps, 2, 256).collect()}
    assert tp[0] is None and abs(tp[2] - 25.6) < 1e-9


def test_stream_budget_matches_batch(spark):
    from versify.operators import corpus as C
    from versify.plans.catalog import corpus
    from versify.streaming import ingest as ST

    sf = "/root/testdata/sf0.001"
    s = {r["doc_id"]: r["increment"] for r in ST.stream_budget(spark, sf, 5000).collect()}
    b = {r["doc_id"]: r["increment"] for r in C.word_budget(corpus(spark, sf), 5000).collect()}
    assert s == b and sum(b.values()) == 5000
