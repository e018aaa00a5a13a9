"""Words cut many texts at a time are those of the split pattern; training holds its words as arrays of symbols."""

import random

import numpy as np
from pyspark.sql import functions as F

from versify.operators import bpe as BPE

ALPHABET = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "r", "e", "v", "l", "s", "d", "a", "É", "ß", "Ж", "中", "𝒜", "́", "7", "٣", "½", "Ⅷ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", ".", "!?", "-", "€", "😀", "\u0002", "[UNK]", "<SONNET>", "<END>", "<RHYME_A>", "<", ">", "\x00", "﻿"]


def test_words_are_those_of_the_pattern(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randint(0, 14)))) for i in range(6000)] + [(6000, None), (6001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.w for r in docs.select("doc_id", BPE.pretokenize(F.col("text")).alias("w")).collect()}
    words, many = BPE.cut_words([t for _, t in rows], BPE.char_classes(spark))
    at = np.r_[0, np.cumsum(many)].tolist()
    words = words.to_pylist()
    for (i, text), a, b in zip(rows, at, at[1:], strict=False):
        assert words[a:b] == (want[i] or []), repr(text)
    joined = {r.doc_id: r.joined for r in BPE.joined_words(docs).collect()}
    assert joined == {i: None if w is None else "".join(w) for i, w in want.items()}
    counted = {r.word: r.freq for r in BPE.word_table(docs).collect()}
    plain = docs.select(F.explode(BPE.pretokenize(F.col("text"))).alias("w")).where(~F.col("w").isin(*BPE.SUBWORD_SPECIALS)).groupBy("w").count()
    assert counted == {r.w: r["count"] for r in plain.collect()}


def test_batches_merge_as_one_by_one():
    rng = random.Random(2)
    gap = 50
    for _ in range(300):
        words = ["".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(8)]
        batch = rng.choice([[("a", "b", "X"), ("c", "d", "Y")], [("a", "a", "X")], [("a", "b", "X"), ("a", "c", "Y"), ("d", "d", "Z")]])
        code = {c: i for i, c in enumerate("abcdXYZ")}
        sym = np.array([x for w in words for x in (*(code[c] for c in w), gap)], np.uint16)
        for l, r, m in batch:
            words = [w.replace(l + r, m) for w in words]
        got = BPE.merge_batches(sym, [[tuple(code[c] for c in step) for step in batch]], gap)
        assert got.tolist() == [x for w in words for x in (*(code[c] for c in w), gap)]


def test_training_holds_words_in_few_rows(spark):
    """Not a row for each word, which every job would search by itself."""
    words = spark.createDataFrame([(f"w{i}", 1) for i in range(3000)], "word string, freq long").coalesce(1)
    assert BPE.packed_words(words, 300).count() <= 2
