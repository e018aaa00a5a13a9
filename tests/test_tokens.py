import math

import pytest
from pyspark.sql import functions as F

from versify.operators import context_lm as CL
from versify.operators import lm as LM
from versify.operators import pack as P
from versify.operators import vocab as V
from versify.sources import io as IO


def test_char_codec_small_vocab(spark):
    codec = V.CharCodec(["\n", "a", "b"])
    df = spark.createDataFrame([("ab\n",), ("b?aé",), ("",)], "t string")
    rows = df.select(codec.encode(codec.known(F.col("t"))).alias("ids"), F.length(codec.unknown(F.col("t"))).alias("u")).collect()
    assert [(r["ids"], r["u"]) for r in rows] == [([1, 2, 0], 0), ([2, 1], 2), ([], 0)]
    back = spark.createDataFrame([([1, 2, 0, 0],)], "ids array<int>").select(codec.decode(F.col("ids"))).first()[0]
    assert back == "ab\n\n"


def test_char_codec_past_every_limit(spark):
    tokens = [chr(c) for c in range(0x20, 0x12000) if not 0xD800 <= c < 0xE000]
    assert len(tokens) > 70_000
    codec = V.CharCodec(tokens)
    picked = [0, 1, 54_999, 55_295, 55_296, 60_000, 63_455, 63_456, 69_999]
    text = "".join(tokens[i] for i in picked)
    df = spark.createDataFrame([(text,)], "t string").select(codec.encode(F.col("t")).alias("ids"))
    assert df.first()["ids"] == picked
    assert df.select(codec.decode(F.col("ids"))).first()[0] == text


def test_flatten_nested_ids(spark):
    df = spark.createDataFrame([([[1, 2], [3]],)], "ids array<array<int>>")
    assert df.select(F.flatten("ids")).first()[0] == [1, 2, 3]


def test_dense_ids_and_unk(spark):
    toks = spark.createDataFrame([("b",), ("a",), ("c",)], "token string")
    voc = V.syllable_vocab(toks)
    got = {r["token"]: r["id"] for r in voc.collect()}
    assert got == {"<UNK>": 0, "a": 1, "b": 2, "c": 3}
    looked = V.token_id(spark.createDataFrame([("a",), ("zz",)], "token string"), voc)
    assert {r["token"]: r["id"] for r in looked.collect()} == {"a": 1, "zz": 0}


def test_pack_twenty_tokens(spark):
    toks = spark.createDataFrame([(i, i + 1) for i in range(20)], "pos long, id int")
    blocks = P.pack_blocks(toks, 20, 2, 3).orderBy("batch_no", "row_no").collect()
    assert len({r["batch_no"] for r in blocks}) == 3
    for r in blocks:  # y is x shifted by one: every y id is the x id + 1
        assert r["y_sum"] == r["x_sum"] + 3
        assert r["y_last"] == r["x_first"] + 3


def _dist(spark, logits):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(logits)], "ctx int, token int, logit double")


def test_top_k_keeps_two_largest(spark):
    d = LM.top_k(_dist(spark, [1, 2, 3, 4, 5]), 2)
    assert sorted(r["token"] for r in d.collect()) == [3, 4]


def test_top_p_keeps_first(spark):
    d = LM.top_p(LM.softmax_t(_dist(spark, [10, 1, 1, 1]), 1.0), 0.5)
    assert [r["token"] for r in d.collect()] == [0]


def test_generate_stops_after_eos_and_respects_max(spark):
    # deterministic model: after 1 -> 3, after 3 -> 4 (EOS), after 4 -> 4
    rows = [(1, 3, 0.0, 1.0), (3, 4, 0.0, 1.0), (4, 4, 0.0, 1.0), (2, 3, 0.0, 1.0)]
    iv = spark.createDataFrame(rows, "ctx int, token int, lo double, hi double")
    prompts = spark.createDataFrame([(1, [1]), (2, [2])], "sample_id long, ids array<int>")
    out = {r["sample_id"]: r["ids"] for r in LM.generate(prompts, iv, 4, 10).collect()}
    assert out[1] == [1, 3, 4] and out[2] == [2, 3, 4]
    no_eos = {r["sample_id"]: r["ids"] for r in LM.generate(prompts, iv, None, 5).collect()}
    assert len(no_eos[1]) == 1 + 5


def test_pack_from_docs_equals_token_form(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6, 7]), (2, [8, 9]), (3, [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20])],
                                 "rank long, ids array<int>")
    placed = P.stream_offsets(docs)
    blocks = {(r["batch_no"], r["row_no"]): (r["x"], r["y"]) for r in P.pack_from_docs(placed, 20, 2, 3).collect()}
    assert len({b for b, _ in blocks}) == 3  # (20 - 1) div 6 batches
    for (b, r), (x, y) in blocks.items():
        first = b * 6 + r * 3 + 1
        assert x == [first, first + 1, first + 2] and y == [first + 1, first + 2, first + 3]
    toks = spark.createDataFrame([(i, i + 1) for i in range(20)], "pos long, id int")
    sums = {(r["batch_no"], r["row_no"]): (r["x_sum"], r["y_sum"]) for r in P.pack_blocks(toks, 20, 2, 3).collect()}
    assert sums == {k: (sum(x), sum(y)) for k, (x, y) in blocks.items()}


def test_dense_ids_over_many_ranges(spark):
    toks = spark.createDataFrame([(f"{i * 7919 % 5000:05d}",) for i in range(5000)], "token string")
    got = {r["token"]: r["id"] for r in V.dense_ids(toks).collect()}
    assert got == {f"{i:05d}": i for i in range(5000)}


def test_strict_encoding_names_unknown_characters(spark):
    codec = V.CharCodec(["a", "b"])
    rows = spark.createDataFrame([("abba",), (None,)], "t string")
    assert [r[0] for r in rows.select(codec.encode_strict(F.col("t"))).collect()] == [[0, 1, 1, 0], None]
    with pytest.raises(Exception, match="not in the vocabulary: xy"):
        spark.createDataFrame([("axby",)], "t string").select(codec.encode_strict(F.col("t"))).collect()


def test_context_model_sums_to_one_and_scores_by_its_longest_context(spark):
    from versify.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    texts = ["abracadabra", "abra cadabra", "", "b"]
    counts = CL.grams(spark.createDataFrame([(t,) for t in texts], "text string"))
    vocab = sorted(set("".join(texts)))
    model = CL.context_model(counts, len(vocab))
    p = {(r.ctx, r.token): r.p for r in model.collect()}
    backoff = {r.ctx: r.backoff for r in model.collect()}

    def prob(history, token):
        if (history, token) in p:
            return p[history, token]
        return backoff.get(history, 1.0) * (prob(history[1:], token) if history else 1 / len(vocab))

    for ctx in [*backoff, "zzz", "bzr"]:
        assert abs(sum(prob(ctx, t) for t in vocab) - 1) < 1e-12
    asked = [("abr", "a"), ("zab", "c"), ("", "q"), ("rac", " "), ("zzz", "b"), ("ra", "b")]
    got = CL.log_probability(spark.createDataFrame(asked, "history string, token string"), model, len(vocab)).collect()
    assert {(r.history, r.token) for r in got} == set(asked)
    assert all(abs(r.logp - math.log(prob(r.history, r.token))) < 1e-12 for r in got)


def test_generation_over_contexts_ends_and_goes_on(spark):
    from versify.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    text = "abcabcabc\n"
    model = CL.context_model(CL.grams(spark.createDataFrame([(text,)] * 3, "text string")), 4)
    prompts = spark.createDataFrame([(1, "abc"), (2, "zzb"), (3, ""), (4, "c\n")], "sample_id long, tail string")
    out = {r.sample_id: r for r in CL.generate(prompts, CL.candidates(model, prompts, 1.0, None, None), "\n", 40, cut_every=3).collect()}
    assert len(out) == 4
    for r in out.values():
        assert r.n_new == len(r.text) <= 40 and r.done == r.text.endswith("\n") and "\n" not in r.text[:-1]
    assert out[1].text[0] in "a\n" and out[2].text[0] == "c"
    assert {r.n_new for r in CL.generate(prompts, CL.candidates(model, prompts, 1.0, None, None), None, 7).collect()} == {7}


def test_hash_split_is_of_the_document_alone(spark):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    whole = {r.doc_id: r.split for r in V.hash_split(docs, "doc_id").collect()}
    part = {r.doc_id: r.split for r in V.hash_split(docs.where("doc_id % 3 = 0"), "doc_id").collect()}
    assert all(whole[d] == s for d, s in part.items())
    assert abs(sum(s == "train" for s in whole.values()) / 2000 - 0.9) < 0.03


def test_streams_have_no_gaps(spark, tmp_path):
    texts = {i: "ab" * (i % 4) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    codec = V.CharCodec(["\n", "a", "b"])
    places = P.stream_places(docs.select("doc_id", F.length("text").alias("ln")), "doc_id")
    IO.write_streams(P.encoded_streams(docs, places, "doc_id", codec), str(tmp_path / "s"))
    for split, many in (("train", 27), ("val", 3)):
        rows = sorted(IO.read_streams(spark, str(tmp_path / "s"), split).collect(), key=lambda r: (r["start"], len(r["ids"])))
        at = 0
        for n, r in enumerate(rows):
            assert r["start"] == at and r["ids"] == ([0] if n else []) + [1, 2] * (r["doc_id"] % 4)
            at += len(r["ids"])
        assert len(rows) == many
    with pytest.raises(Exception, match="not in the vocabulary"):
        P.encoded_streams(docs, places, "doc_id", V.CharCodec(["\n", "a"])).collect()
    with pytest.raises(Exception, match="16-bit"):
        IO.write_streams(spark.createDataFrame([("train", 0, [70_000])], "split string, start long, ids array<int>"), str(tmp_path / "t"))
