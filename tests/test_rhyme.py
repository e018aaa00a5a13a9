import poems
from pyspark.sql import functions as F

from versify.functions.rhyme import rhyme_suffix, rhyme_suffixes
from versify.operators.rhyme_tags import tag_rhymes, tag_rhymes_window


def test_rhyme_suffix_goldens(spark):
    df = spark.createDataFrame(poems.SUFFIXES, "word string, suffix string")
    rows = df.select("suffix", rhyme_suffix(F.col("word")).alias("got")).collect()
    assert all(r["suffix"] == r["got"] for r in rows)
    arr = df.agg(F.collect_list("word").alias("w")).select(rhyme_suffixes(F.col("w")).alias("s")).first()["s"]
    assert sorted(arr) == sorted(s for _, s in poems.SUFFIXES)


def _tagged(spark, text, with_suffix=False):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(tag_rhymes(F.col("text"), with_suffix).alias("t")).first()["t"]


def test_tag_short(spark):
    t = _tagged(spark, poems.TAGGED)
    for line in ["<RHYME_A> Apre la riva", "<RHYME_B> passa la nave", "<RHYME_B> grave soave",
                 "<RHYME_A> l'ombra è cattiva", "<SONNET>", "<STANZA>", "<END>"]:
        assert line in t


def test_tag_full_uses_sestet_letters(spark):
    t = _tagged(spark, poems.UNTAGGED)
    for line in ["<RHYME_A> apre la riva", "<RHYME_B> passa la nave", "<RHYME_C> nuota la trota", "<RHYME_D> passa la vela"]:
        assert line in t


def test_tag_suffix_form(spark):
    t = _tagged(spark, "\n".join(["<SONNET>", "apre la riva", "passa la nave", "<END>"]), True)
    assert "<RHYME_A> iva | apre la riva" in t
    assert "<RHYME_B> ave | passa la nave" in t


def test_letters_wrap_after_g(spark):
    words = ["riva", "nave", "trota", "vela", "mano", "fiume", "bosco", "grillo", "pietra"]
    text = "\n".join(f"riga {w}" for w in words)
    t = _tagged(spark, text)
    letters = [line.split(">")[0][len("<RHYME_"):] for line in t.split("\n")]
    assert letters == ["A", "B", "C", "D", "E", "F", "G", "C", "D"]


def test_array_form_equals_window_form(spark):
    rows = list(enumerate(poems.ALL.values()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    arr = df.select("doc_id", F.posexplode(F.split(tag_rhymes(F.col("text"), True), "\n", -1)).alias("pos", "a"))
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), "line"
    )
    win = tag_rhymes_window(lines, ["doc_id"], True).select("doc_id", (F.col("line_no") - 1).alias("pos"), "tagged_line")
    joined = arr.join(win, ["doc_id", "pos"])
    assert joined.count() == arr.count()
    assert joined.where(F.col("a") != F.col("tagged_line")).count() == 0
