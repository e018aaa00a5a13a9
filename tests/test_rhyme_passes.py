"""The staged rhyme rules give what the plain ones give, and each step is written once in a plan."""

import random

from pyspark.sql import functions as F

from versify.functions import rhyme as R
from versify.functions import text as X
from versify.functions.structure import strip_ws
from versify.operators import rhyme_tags as RT
from versify.operators import vocab as V
from versify.streaming.ingest import encoded_poems

PARTS = ["a", "e", "b", "str", "È", "ò", "á", "ù", "'", "’", "-", "ñ", "Ж", "́", "中", "7", "_", "İ", "ẞ", "!", "—", "...", "€", "😀", "\x1c", "\xa0", "\x85"]
BLANKS = [" ", "  ", "\t", "\n", "\r", "\x0b", "\f"]


def plain_normalized(col):
    return F.lower(F.regexp_replace(R.strip_accents(col), rf"[^{R.WORD_CHARS}\s]", ""))


def plain_suffix(word):
    acc = R.RHYME_ACCENTED_VOWELS
    chunk = F.element_at(F.split(F.lower(F.replace(word, F.lit("’"), F.lit("'"))), "['-]", -1), -1)
    original, normalized = F.regexp_replace(chunk, rf"[^{R.WORD_CHARS}\s{acc}]", ""), plain_normalized(chunk)
    rules = [F.regexp_extract(original, f"[{acc}][^{acc}]*$", 0), F.regexp_extract(normalized, "[aeiou][^aeiou]*[aeiou][^aeiou]*$", 0), F.regexp_extract(normalized, "[aeiou][^aeiou]*$", 0)]
    out = F.when((chunk == "") | (normalized == ""), F.lit(""))
    for rule in rules:
        out = out.when(rule != "", rule)
    return out.otherwise(F.regexp_extract(normalized, ".{0,3}$", 0))


def test_staged_rules_are_the_plain_ones(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices(PARTS + rng.choice((BLANKS, [" "], [])), k=rng.randint(0, 9))) for _ in range(6000)] + [None, "", "<a", " <a", " a<"]
    df = spark.createDataFrame([(t,) for t in lines], "t string").repartition(8)
    t, s = F.col("t"), strip_ws(F.col("t"))
    cleaned = F.regexp_replace(t, rf"[^{R.WORD_CHARS}']+$", "")
    old = {
        "word": F.coalesce(F.try_element_at(F.regexp_extract_all(cleaned, F.lit(r"\S+"), 0), F.lit(-1)), F.lit("")),
        "suffix": plain_suffix(t), "norm": plain_normalized(t), "verse": (s != "") & ~s.startswith("<"),
    }
    new = {"word": R.last_word_for_tagging(t), "suffix": R.rhyme_suffix(t), "norm": R.normalize_word(t), "verse": RT.is_verse(t)}
    for k in old:
        assert [r for r in df.select("t", old[k].alias("o"), new[k].alias("n")).collect() if r.o != r.n] == [], k


def test_special_characters_are_replaced_in_map_order(spark):
    rng = random.Random(6)
    parts = [*X.SPECIAL_TOKEN_MAP, "a", "<", ">", "\n\n", "<STANZA>", "<RHYME_", "T>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(3000)] + [None]
    plain = F.col("t")
    for k, v in X.SPECIAL_TOKEN_MAP.items():
        plain = F.replace(plain, F.lit(k), F.lit(v))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plain.alias("o"), X.to_special_chars(F.col("t")).alias("n"))
    assert [r for r in df.collect() if r.o != r.n] == []


def test_each_step_is_written_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    words = spark.createDataFrame([("abc",)], "w string").repartition(1)
    assert plan(words.select(R.rhyme_suffix(F.col("w")).alias("s"))).count("regexp_extract(") <= 3
    docs = spark.createDataFrame([(1, "it", "a b")], "doc_id long, lang string, text string").repartition(1)
    assert plan(encoded_poems(docs, V.CharCodec(["\n", "a"]))).count("[aeiou][^aeiou]*(?:") == 1
