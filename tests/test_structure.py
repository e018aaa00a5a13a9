import poems
from pyspark.sql import functions as F

from versify.functions.structure import check_structure, evaluate_structure, validate_structure
from versify.operators.evaluate import evaluate_frame, evaluation_report


def _metrics(spark):
    rows = [(i, n, t) for i, (n, t) in enumerate(poems.ALL.items())]
    df = spark.createDataFrame(rows, "doc_id long, name string, text string")
    return {r["name"]: r for r in evaluate_frame(df, ["name"]).collect()}


def test_regular_sonnets_are_valid(spark):
    m = _metrics(spark)
    for name in ["field", "inn"]:
        r = m[name]
        assert r["is_14_lines"] and r["is_correct_structure"] and r["is_valid_sonnet"]
        assert r["valid_stanzas"] == 4 and r["total_stanzas"] == 4
        assert r["line_count"] == 14 and r["rhyme_lines"] == 14 and r["valid_hendecasyllables"] == 14


def test_scrap_is_invalid(spark):
    r = _metrics(spark)["scrap"]
    assert not r["is_14_lines"] and not r["is_correct_structure"] and not r["is_valid_sonnet"]
    assert r["valid_stanzas"] == 0 and r["total_stanzas"] == 1 and r["line_count"] == 3


def test_valid_octave_invalid_sestet(spark):
    r = _metrics(spark)["one_rhyme"]
    assert r["is_14_lines"] and r["is_correct_structure"]
    assert r["valid_stanzas"] == 2 and r["total_stanzas"] == 4 and not r["is_valid_sonnet"]


def test_scalar_form_equals_staged_form(spark):
    rows = list(enumerate(poems.ALL.values()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r["doc_id"]: tuple(r)[1:] for r in evaluate_frame(df, ["doc_id"]).collect()}
    b = {r["doc_id"]: tuple(r)[1:] for r in df.select("doc_id", evaluate_structure(F.col("text")).alias("m")).select("doc_id", "m.*").collect()}
    assert a == b


def test_check_structure(spark):
    df = spark.createDataFrame([(poems.REGULAR,), (poems.SHORT_FIRST,)], "text string")
    got = [r[0] for r in df.select(check_structure(F.col("text"))).collect()]
    assert got == [True, False]
    got = [r[0] for r in df.select(validate_structure(F.col("text"))).collect()]
    assert got == [True, False]


def test_report_denominators(spark):
    rows = list(enumerate(poems.ALL.values())) + [(99, "<SONNET>\n<END>")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = evaluation_report(evaluate_frame(df, ["doc_id"])).first()
    assert r["samples"] == len(rows)  # a zero-line sample still counts in the denominator
    assert r["valid_sonnets"] == 2
