"""Operators 11 to 13: runs against all periods, negatives against Python's whole numbers, pieces against the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from versify.llm import hard_negatives as hn
from versify.llm import periodic_runs as pr
from versify.llm import piece_bpe as pb
from versify.llm.common import WORD

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def all_runs(words, least=12):
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            if words[x] != words[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x + q - s >= max(least, 2 * q):
                seen.setdefault((s, x + q), q)
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def random_words(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
    kind = rng.random()
    if kind < 0.3:
        return [rng.randrange(k) for _ in range(n)]
    if kind < 0.6:
        block = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
        out = (block * 50)[:n]
        for _ in range(rng.randint(0, 2) if out else 0):
            out[rng.randrange(len(out))] = rng.randrange(k)
        return out
    out = ([0, 1] * 30)[: n // 2] + ([1, 0, 0] * 30)[: n // 4] + ([0, 1] * 30)[: n // 3]
    return out + out[::-1]


def test_runs_equal_all_periods():
    rng = random.Random(1)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        edges = np.r_[0, np.cumsum([len(t) for t in texts])]
        start, end, period = pr.find_runs(np.array([x for t in texts for x in t], np.int64), edges)
        owner = np.searchsorted(edges, start, "right") - 1
        for i, t in enumerate(texts):
            got = [(int(s - edges[i]), int(e - s), int(q)) for s, e, q, o in zip(start, end, period, owner, strict=True) if o == i]
            assert got == all_runs(t), t


def expected_runs(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_equals_brute_force(spark):
    rows = [tuple(r) for r in pr.op11_periodic_runs(spark, SF).collect()]
    short = spark.read.parquet(f"{SF}/documents.parquet").where("size(split(text, ' ')) < 1200").select("doc_id", "text").collect()
    by_id = {r[0]: r for r in rows}
    assert len(short) > 100 and sum(by_id[d][1] > 0 for d, _ in short) > 5
    for d, t in short:
        assert by_id[d] == expected_runs(d, t)


def test_runs_edge_cases(spark, docs):
    again = "one  two\tthree " * 6
    rows = [(1, None), (2, ""), (3, " \n"), (4, again), (4, again), (None, "a " * 30), (5, "é " * 11), (6, "é  " * 12), (7, "w " * 300_000)]
    out = {(r.doc_id, i): r for i, r in enumerate(pr.periodic_runs(docs(rows, ["runs", "start", "collapsed"]).coalesce(1)).collect())}
    got = [([tuple(x) for x in r.runs], r.collapsed) for r in out.values()]
    assert got == [([], ""), ([], ""), ([], ""), ([(0, 18, 3)], "one two three"), ([(0, 18, 3)], "one two three"), ([(0, 30, 1)], "a"), ([], " ".join("é" * 11)), ([(0, 12, 1)], "é "), ([(0, 300_000, 1)], "w")]
    assert pr.periodic_runs(docs([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize(("width", "top"), [(1, 3), (64, 256), (64, 1 << 20), (3000, 1 << 20), (5, 1 << 28)])
def test_products_are_exact(width, top):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-top, top + 1, (n, width)) for n in (7, 9))
    a[0], b[0], b[1] = top, top, -top  # the bound itself, in both signs
    primes = hn.primes_for(width * top * top, min(hn.WIDTH, width))
    assert all(min(hn.WIDTH, width) * (p // 2) ** 2 <= 1 << 24 for p in primes)
    assert len(primes) > 1 or top == 3
    got = hn.products(hn.residues(a, primes), hn.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert got.tolist() == want


def negatives_by_hand(rows):
    out = []
    kept = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for n, (a, label, v) in enumerate(kept):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for m, (b, other, w) in enumerate(kept) if m != n and len(w) == len(v))
        for s, b, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, b, k + 1, c, -s, -x) for k, (x, c, _) in enumerate(window)]
    return sorted(out)


def test_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 40)
    monkeypatch.setattr(hn, "TILE", 3)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=4).round(1).tolist()) for i in range(600)]
    rows += [(900 + i, i % 2, [0.5, 0.5, 0.25, 0.0]) for i in range(150)]  # equal vectors, many ties
    rows += [(900, 0, [0.5, 0.5, 0.25, 0.0])] * 2 + [(100, 1, [1.0, 2.0])] + [(101 + i, i % 2, [1.0, 2.0]) for i in range(12)]
    rows += [(200, None, [1.0] * 4), (300, 1, None), (400, 1, [1.0, None, 1.0, 1.0]), (500, 1, [1.0, float("nan"), 1.0, 1.0]), (None, 1, [9.0] * 4), (600, 1, []), (601, 0, []), (602, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("uid", F.lit(1)).withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in hn.hard_negatives(df, F.col("id") % 100 == 0).collect())
    assert got == negatives_by_hand(rows) and any(r[0] == 600 for r in got)


def test_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.hard_negatives(df, F.col("id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hn.hard_negatives(lone, F.col("id") % 100 == 0).count() == 0


@pytest.fixture(scope="module")
def model():
    return pb.load_pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hard_texts(library):
    rng = random.Random(3)
    out = ["", " ", "\n", "a" * 5000, " " * 1000 + "x" + " " * 77, "▁" * 40, " " * 16 + "a", " " * 15, " " * 31 + "the", "***" * 500, "-" * 777, "=" * 1000, "<s> </s> <0x0A>", "ab\u0000c", "日本語 🙂 é"]
    kinds = ["ab", "abc ", "aeiou thns ", "  \n\t", "*-=#/ ", "0123 .", "éèçàù ou", "日本語a ", "▁ a", "\r\n*/ )('$", "".join(chr(c) for c in range(32, 127)), "🙂🙃é́ß "]
    out += ["".join(rng.choice(kind) for _ in range(rng.randint(0, 60))) for kind in kinds for _ in range(200)]
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    return out + ["".join(rng.choice(known) for _ in range(rng.randint(1, 12))) for _ in range(2000)]


def test_pieces_equal_the_library(spark, docs, model, library):
    texts = hard_texts(library)
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    out = {r.doc_id: r for r in pb.decode_pieces(pb.encode_pieces(docs(rows, ["ids"]), model), model).collect()}
    assert out[-1].ids == [] and out[-1].text == ""
    want = library.encode(texts)
    assert [out[i].ids for i in range(len(texts))] == want
    assert [out[i].text for i in range(len(texts))] == library.decode(want)


def test_any_ids_decode_like_the_library(model, library):
    rng = random.Random(4)
    rows = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    edges = np.r_[0, np.cumsum([len(r) for r in rows])]
    assert pb.decode_slice(model, np.array([x for r in rows for x in r], np.int32), edges) == library.decode(rows)


def test_pieces_query_equals_the_library(spark, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = {r[0]: tuple(r) for r in pb.op13_piece_rounds(spark, SF).collect()}
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(t or "")
        assert rows[d] == (d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_long_words_end_soon(model, library):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)) + " " * 50_000 + "*" * 50_000
    data = np.frombuffer(text.encode(), np.uint8)
    assert pb.encode_slice(model, data, np.array([0, len(data)]))[0].tolist() == library.encode(text)


def test_pieces_of_no_rows(docs, model):
    assert pb.decode_pieces(pb.encode_pieces(docs([(1, "x")]).limit(0), model), model).count() == 0
