"""Unigram lattices against exhaustive enumeration of segmentations."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from versify.operators import unigram as UG

LOGP = {"▁": -2.0, "a": -2.5, "b": -2.2, "c": -3.0, "▁a": -1.5, "ab": -1.7, "bc": -1.9, "abc": -2.4, "▁ab": -2.6, "ca": -2.1, "abcabcabca": -9.0}
WORDS = ["▁abc", "▁abca", "▁cab", "▁bcab", "▁a", "▁abcabc", "▁abcabcabca"]
IDS = {p: i for i, p in enumerate(LOGP, start=20)}


def segmentations(word, logp=LOGP):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(i for i, c in enumerate(cuts, start=1) if c), len(word)]
        pieces = [word[s:e] for s, e in itertools.pairwise(edges)]
        if all(p in logp for p in pieces):
            yield pieces


def score(pieces, logp=LOGP):
    return sum(logp[p] for p in pieces)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(0, UG.UNK, 0.0), *((i, s, 0.0) for i, s in enumerate(UG.USER_SYMBOLS, start=1)), *((IDS[p], p, x) for p, x in LOGP.items())]
    return spark.createDataFrame(rows, "id int, piece string, score double")


def words_frame(spark, words=WORDS):
    return spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, freq long")


def test_encoding_is_the_best_segmentation(spark, model):
    docs = [(1, "abc abca\ncab"), (2, "bcab abcabc abcabcabca a"), (3, "axb é"), (4, ""), (5, None), (6, "a <STANZA> a a")]
    got = {r.doc_id: r.ids for r in UG.encode_ids(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    names = {**{i: p for p, i in IDS.items()}, 0: UG.UNK, **{i: s for i, s in enumerate(UG.USER_SYMBOLS, start=1)}}
    assert [names[i] for i in got[1]][3:] and got[4] == [] and got[5] == []
    for d, words in ((1, [["▁abc", "▁abca"], ["▁cab"]]), (2, [["▁bcab", "▁abcabc", "▁abcabcabca", "▁a"]])):
        want = []
        for line in words:
            want += [] if not want else ["<NEWLINE>"]
            for w in line:
                want += max(segmentations(w), key=lambda s: (score(s), len(s[-1])))
        assert [names[i] for i in got[d]] == want
    assert [names[i] for i in got[3]] == ["▁a", UG.UNK, "b", "▁", UG.UNK]
    assert [names[i] for i in got[6]] == ["▁a", "<STANZA>", "▁a", "▁a"]


def test_expected_counts_are_posterior_counts(spark, model):
    want = {}
    for freq, w in enumerate(WORDS, start=1):
        segs = list(segmentations(w))
        z = sum(math.exp(score(s)) for s in segs)
        for s in segs:
            for p in s:
                want[p] = want.get(p, 0.0) + freq * math.exp(score(s)) / z
    got = {r.piece: r["count"] for r in UG.expected_counts(UG.lattices(words_frame(spark), UG.plain_pieces(model))).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_n_best_lists_are_complete(spark, model):
    plain = words_frame(spark).select("word")
    for n in (3, 64):
        got = {r.word: [(round(p.score, 9), tuple(p.ids)) for p in r.paths] for r in UG.n_best(plain, model, n).collect()}
        for w in WORDS:
            want = sorted(((round(score(s), 9), tuple(IDS[p] for p in s)) for s in segmentations(w)), reverse=True)
            assert [x for x, _ in got[w]] == [x for x, _ in want[:n]] and set(got[w]) <= set(want) and len(set(got[w])) == len(got[w])


def test_draws_follow_the_weights(spark, model):
    alpha, times = 0.5, 4000
    docs = spark.createDataFrame([(1, "abca <END>")], "doc_id long, text string")
    rows = UG.sample_ids(docs, model, times, alpha).collect()
    assert len(rows) == times and all(r.ids[-1] == 3 for r in rows)
    weights = {tuple(IDS[p] for p in s): math.exp(alpha * score(s)) for s in segmentations("▁abca")}
    total = sum(weights.values())
    seen = {}
    for r in rows:
        seen[tuple(r.ids[:-1])] = seen.get(tuple(r.ids[:-1]), 0) + 1
    assert set(seen) <= set(weights)
    for ids, w in weights.items():
        assert abs(seen.get(ids, 0) / times - w / total) < 0.03


def brute_losses(counts):
    total = sum(counts.values())
    logp = {p: math.log(c / total) for p, c in counts.items()}
    out = {}
    for p, c in counts.items():
        if len(p) > 1:
            others = [s for s in segmentations(p, logp) if len(s) > 1]
            best = max(others, key=lambda s: score(s, logp))
            after = sum(math.log(counts[x] + c) - math.log(total + c * (len(best) - 1)) for x in best)
            out[p] = c * (logp[p] - after) if logp[p] >= score(best, logp) else None
    return out


def test_losses_of_dropped_pieces(spark):
    counts = {"▁": 9.0, "a": 8.0, "b": 7.5, "c": 4.0, "▁a": 6.0, "ab": 5.0, "bc": 0.05, "abc": 2.0, "▁abc": 3.0}
    scored = UG._scored(spark.createDataFrame(list(counts.items()), "piece string, count double"))
    want = brute_losses(counts)
    got = {r.piece: r.loss for r in UG.losses(scored).collect()}
    assert set(got) == set(want) and want["bc"] is None
    assert all((got[p] is None) == (want[p] is None) and abs((got[p] or 0) - (want[p] or 0)) < 1e-9 for p in want)


def test_training_equals_a_plain_one(spark):
    """Seeds, two steps of EM, pruning by loss, until the vocabulary fits: each by enumeration."""
    text = "abab abc abab cab abc bab abcab abcab"
    size = 1 + len(UG.USER_SYMBOLS) + 4 + 5
    docs = spark.createDataFrame([(text,), (None,), ("",), (text + "\nabc",)], "text string")
    model = UG.train_unigram(docs, size, shrink=0.5).collect()
    freqs = {}
    for w in (text + " " + text + " abc").split():
        freqs["▁" + w] = freqs.get("▁" + w, 0) + 1
    counts = {}
    for w, f in freqs.items():
        for s, e in itertools.combinations(range(len(w) + 1), 2):
            counts[w[s:e]] = counts.get(w[s:e], 0.0) + f
    counts = {p: c for p, c in counts.items() if len(p) == 1 or c >= 2}
    target = size - 1 - len(UG.USER_SYMBOLS) - sum(len(p) == 1 for p in counts)
    while True:
        for _ in range(2):
            total = sum(counts.values())
            logp = {p: math.log(c / total) for p, c in counts.items()}
            counts = {}
            for w, f in freqs.items():
                segs = list(segmentations(w, logp))
                z = sum(math.exp(score(s, logp)) for s in segs)
                for s in segs:
                    for p in s:
                        counts[p] = counts.get(p, 0.0) + f * math.exp(score(s, logp)) / z
            counts = {p: max(c, 1e-6) for p, c in counts.items()}
        several = [p for p in counts if len(p) > 1]
        if len(several) <= target:
            break
        loss = brute_losses(counts)
        ranked = sorted(several, key=lambda p: (loss[p] is None, -(loss[p] or 0), p))
        kept = ranked[: max(target, int(len(several) * 0.5))]
        counts = {p: c for p, c in counts.items() if len(p) == 1 or p in kept}
    total = sum(counts.values())
    got = {r.piece: r.score for r in model if r.id > len(UG.USER_SYMBOLS)}
    assert set(got) == set(counts) and len(got) == target + 4
    assert all(abs(got[p] - math.log(c / total)) < 1e-6 for p, c in counts.items())
    assert [r.id for r in model] == list(range(len(model))) and model[0].piece == UG.UNK
