import random

from pyspark.sql import functions as F

from versify.functions import structure as S
from versify.functions import syllable as Y
from versify.operators.verse import verse_view

PIECES = list("aeiouhbcrtsl") + list("àòăÉ×k") + ["'", "’", " ", " ", " ", "\t", "-", ",", "«", "\r", "\u0085", " ", "\x0b", "\x01", "\x02", "😀", "|", "e'", " h"]


def lines():
    rnd = random.Random(3)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]


def test_passes_equal_the_folds(spark):
    df = spark.createDataFrame([(l,) for l in lines()], "line string")
    both = df.select("line", Y.syllabify_line(F.col("line")).alias("a"), Y.syllabify_line_fold(F.col("line")).alias("b"))
    assert not both.where(~F.col("a").eqNullSafe(F.col("b"))).collect()


def test_counts_of_random_lines_equal_the_fold(spark):
    df = spark.createDataFrame([(l,) for l in lines() if not set(l) & set("\x01\x02\x85\u2028")], "line string")
    both = df.select("line", Y.line_syllable_count(F.col("line")).alias("a"), Y.line_syllable_count_fold(F.col("line")).alias("b"))
    assert not both.where("a <> b").collect()


def test_tokens_need_no_fold(spark):
    """Only a line with control characters that the passes use themselves goes through the folds, of which each token once took two."""
    df = spark.createDataFrame([("la riva\n\ne il mare",), (None,), ("",)], "t string").select(Y.syllabify_text(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["la", " ri", "va", "\n", "\n", "e il", " ma", "re"], None, ["\n"][:0]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2 and plan.count("transform(split(") == 1


def test_verse_view_cuts_a_text_into_words_once(spark):
    """Inside the lambda over the poems it was cut again for each of them, so a long text took the square of its length."""
    text = " ".join(f"w{i}" for i in range(500))
    view = verse_view(spark.createDataFrame([(1, "it", text)], "doc_id long, lang string, text string"))
    assert view._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert " ".join(w for r in view.orderBy("poem_no").collect() for w in r["text"].split()) == text


def test_blank_lines_are_told_without_a_trimmed_copy(spark):
    odd = ["", " ", "\t\x0b\f\r", "\u0085", " \u0085", "  ", "<a", " <a", " a ", None]
    df = spark.createDataFrame([(x,) for x in odd], "t string").select("t", S.eval_lines(F.col("t")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r.x for r in df.collect()] == [[], [], [], ["\u0085"], ["\u0085"], [" "], [], ["<a"], ["a"], None]
