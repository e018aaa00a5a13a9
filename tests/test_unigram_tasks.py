from pyspark.sql import functions as F

from versify.operators import unigram as UG


def model_of(spark):
    pieces = [(c, -4.0 - i / 10) for i, c in enumerate("▁abcdor")] + [("▁ca", -3.0), ("or", -2.5), ("▁cab", -5.0), ("da", -3.5)]
    rows = [(UG.UNK, 0.0), *((s, 0.0) for s in UG.USER_SYMBOLS), *pieces]
    return spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(rows)], "id int, piece string, score double")


DOCS = [(1, "cabro dor\ncado x"), (2, ""), (3, None), (None, "cado <END> oro"), (5, "cab"), (5, "ro da")]


def test_substrings_are_not_shuffled(spark):
    """The substrings of all distinct words once went through a join and a grouping."""
    words = spark.createDataFrame([("▁cado", 2), ("", 1), ("▁x", 1)], "word string, freq int")
    held = UG.lattices(words, UG.plain_pieces(model_of(spark)))
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    got = {r.word: [(x.e, x.s, x.piece) for x in r.edges] for r in held.collect()}
    assert got == {"▁cado": [(1, 0, "▁"), (2, 1, "c"), (3, 0, "▁ca"), (3, 2, "a"), (4, 3, "d"), (5, 4, "o")], "▁x": [(1, 0, "▁"), (2, 1, UG.UNK)]}


def test_documents_are_encoded_as_by_the_folds(spark):
    """Documents that share a key are taken together, as before; the rest never leave their task."""
    model, docs = model_of(spark), spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = lambda d: sorted((str(r.doc_id), r.ids) for r in d.collect())
    assert rows(UG.encode_ids(docs, model)) == rows(UG._encode_together(docs, model, "doc_id"))


def test_documents_are_drawn_as_by_the_folds(spark):
    model, docs = model_of(spark), spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = lambda d: sorted((str(r.doc_id), r.rep, r.ids) for r in d.collect())
    for n in (1, 4, 64):
        assert rows(UG.sample_ids(docs, model, 3, 0.2, n=n)) == rows(UG._sample_together(docs, model, 3, 0.2, "doc_id", n, "sample"))


def test_training_deals_its_tables_by_rows(spark, monkeypatch):
    monkeypatch.setattr(UG, "ROWS_OF_TASK", 10)
    assert UG.dealt(spark.range(35).coalesce(1)).rdd.getNumPartitions() == 4
    assert UG.dealt(spark.range(0).select(F.col("id"))).count() == 0
