import random

from pyspark.sql import functions as F

from versify.operators import context_lm as CL
from versify.operators import vocab as V


def test_grams_of_slices_are_those_of_each_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab \n\x00é𝒜中", k=rng.randint(0, 30))) for _ in range(400)] + [None, "", "a"]
    docs = spark.createDataFrame([(0, t) for t in texts], "k int, text string")
    for order in (0, 1, 3):
        want = {(r.history, r.token): r.n for r in CL.grams(docs, "k", order=order).collect()}
        assert {(r.history, r.token): r.n for r in CL.grams(docs, order=order).collect()} == want
    wide = ["".join(map(chr, range(0x10000, 0x10000 + 40_000))), "".join(map(chr, range(0x20000, 0x20000 + 70_000)))]
    for some in (wide, wide[1:]):
        assert sum(CL.counted_grams(some, 3).column(2).to_pylist()) == sum(map(len, some))


def test_grams_are_counted_before_they_are_exploded(spark):
    docs = spark.createDataFrame([("abab" * 500,)] * 50, "text string").coalesce(1)
    plan = CL.grams(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_codec_of_rows_is_that_of_columns(spark):
    """Rows are looked up in slices; a lambda for each character is the plain form."""
    rng = random.Random(9)
    codec = V.CharCodec(sorted("ab \n\x00é𝒜中"))
    rows = [(i, "".join(rng.choices("ab \n\x00é𝒜中", k=rng.randint(0, 20)))) for i in range(300)] + [(300, None), (301, ""), (302, "z�😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = codec.encode_rows(docs).withColumn("plain", codec.encode(F.col("text"))).collect()
    assert len(both) == len(rows) and all(r.ids == r.plain for r in both)
    ids = spark.createDataFrame([(r.doc_id, r.ids) for r in both] + [(400, [0, -1, 99, 2])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.dec for r in codec.decode_rows(ids).collect()}
    assert got == {r.doc_id: r.t for r in ids.select("doc_id", codec.decode(F.col("ids")).alias("t")).collect()}
