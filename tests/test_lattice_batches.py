"""Lattices of many words at a time against the form of one word, and against the folds."""

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from versify.operators import lattice as L
from versify.operators import unigram as UG


def pieces_of(rnd):
    pieces = list("▁abcdé") + sorted({"".join(rnd.choice("▁abcdé") for _ in range(rnd.randint(2, 5))) for _ in range(80)})
    ids = list(range(10, 10 + len(pieces)))
    rnd.shuffle(ids)
    return pieces, [-4.0 if i % 3 else -1 - 8 * rnd.random() for i in range(len(pieces))], ids


def words_of(rnd):
    return ["▁" + "".join(rnd.choice("abcdéx" if i % 7 == 0 else "abcd") for _ in range(rnd.randint(0, 19))) for i in range(300)] + ["▁abababababab", "▁aaaaaaaaaaaaaaaaaaaa", "▁x"]


def test_paths_are_those_of_each_word(monkeypatch):
    """Ties, which the scores of 1 in 3 pieces make many, go by the ids."""
    rnd = random.Random(5)
    pieces, lp, ids = pieces_of(rnd)
    unknown = min(lp) - UG.UNKNOWN_PENALTY
    held, own, table = L.Lattices(pieces, np.array(lp), unknown, UG.MAX_LEN), np.array([*ids, 0, 0]), dict(zip(pieces, zip(lp, ids)))
    words = words_of(rnd)
    monkeypatch.setattr(L, "ENTRIES", 1 << 9)
    sizes, flat = L.best_of(held, words)
    best = np.split(own[flat], np.cumsum(sizes)[:-1])
    for n in (1, 5, 64):
        met = 0
        for rows, codes in L.by_length(words, UG.MAX_LEN):
            several = L.Several(held, held.edges(codes), own, n)
            for j, r in enumerate(rows):
                edges = UG.word_edges(words[r], table, unknown, UG.MAX_LEN)
                want = UG.best_choices(edges, n)
                assert [x for x in several.last[j] if x > -np.inf] == [x for x, _ in want]
                if not several.odd[j]:
                    got = several.paths(np.arange(len(want)), np.full(len(want), j))
                    assert [tuple(own[p[p != L.NONE]]) for p in got] == [p for _, p in want]
                    met += 1
        assert met > 200
    top = [max(UG.best_choices(UG.word_edges(w, table, unknown, UG.MAX_LEN), 1))[0] for w in words]
    score = dict(zip(ids, lp)) | {0: unknown}
    assert all(abs(sum(score[i] for i in b) - t) < 1e-9 for b, t in zip(best, top))


def test_numbers_are_md5():
    starts, sizes = [b"", b"sample:7:3:", b"x" * 50, b"y" * 70], np.array([1234, 101, 100_001, 12])
    want = [int.from_bytes(md5(s + str(i).encode()).digest()[:4], "big") for s, n in zip(starts, sizes) for i in range(n)]
    assert UG.numbers(starts, sizes).tolist() == want


def test_counts_are_those_of_the_folds(spark):
    """The folds took every edge of every word through a column of structs and a grouping."""
    rnd = random.Random(6)
    pieces, lp, ids = pieces_of(rnd)
    frame = spark.createDataFrame([(p, x, i, 1.0) for p, x, i in zip(pieces, lp, ids)], "piece string, lp double, id int, count double")
    words = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words_of(rnd))], "word string, freq long").repartition(3)
    want = {r.piece: r["count"] for r in UG.expected_counts(UG.lattices(words, frame)).collect()}
    got = {r.piece: r["count"] for r in UG.piece_counts(words, frame).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)
    assert "edges" not in UG.piece_counts(words, frame)._jdf.queryExecution().executedPlan().toString()


def test_long_words_and_keys_are_drawn_as_by_the_folds(spark, monkeypatch):
    rnd = random.Random(7)
    pieces, lp, ids = pieces_of(rnd)
    users = [(i, s, 0.0) for i, s in enumerate([UG.UNK, *UG.USER_SYMBOLS])]
    model = spark.createDataFrame([*users, *zip(ids, pieces, lp)], "id int, piece string, score double")
    words = [w[1:] for w in words_of(rnd)]
    docs = [("k" * (i % 3 * 40) + str(i), " ".join(words[i :: 30]) + "\n<END> " + "ab" * 14) for i in range(30)]
    frame = spark.createDataFrame([*docs, (None, "aab"), ("e", " ")], "doc_id string, text string")
    monkeypatch.setattr(UG, "DRAWS", 200)
    rows = lambda d: sorted((str(r.doc_id), r.rep, r.ids) for r in d.collect())
    assert rows(UG.sample_ids(frame, model, 3, 0.2, n=8)) == rows(UG._sample_together(frame, model, 3, 0.2, "doc_id", 8, "sample"))
    some = [r.ids for r in UG.encode_ids(frame.where(F.col("doc_id").isNotNull()), model).orderBy("doc_id").collect()]
    assert some == [r.ids for r in UG._encode_together(frame.where(F.col("doc_id").isNotNull()), model, "doc_id").orderBy("doc_id").collect()]
