from pyspark.sql import functions as F

from versify.sources import io


def test_text_corpus_recursive_and_sink(spark, tmp_path):
    root = tmp_path / "c"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("uno\n", encoding="utf-8")
    (root / "sub" / "b.txt").write_text("due  ", encoding="utf-8")
    (root / "skip.md").write_text("x", encoding="utf-8")
    df = io.read_text_corpus(spark, str(root))
    got = {r["path"]: r["text"] for r in df.collect()}
    assert got == {"a.txt": "uno\n", "sub/b.txt": "due  "}
    io.write_text_table(df, str(tmp_path / "out"))
    back = {r["path"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {"a.txt": "uno\n", "sub/b.txt": "due\n"}


def test_jsonl_tokens_vocab_round_trip(spark, tmp_path):
    recs = spark.createDataFrame([("<TITLE>è\n\ntesto",)], "text string")
    io.write_jsonl(recs, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j")).first()["text"] == "<TITLE>è\n\ntesto"
    toks = spark.createDataFrame([("train", 0, 5), ("train", 1, 6), ("val", 0, 7)], "split string, pos long, id int")
    io.write_tokens(toks, str(tmp_path / "t"))
    assert [r["id"] for r in io.read_tokens(spark, str(tmp_path / "t"), "val").collect()] == [7]
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    io.write_vocab(vocab, {"BOS": "¶"}, str(tmp_path / "v"))
    v, s = io.read_vocab(spark, str(tmp_path / "v"))
    assert v.count() == 2 and s.first()["token"] == "¶"
    meta = io.dataset_metadata(spark.createDataFrame([("train", 10), ("val", 2)], "split string, n_tokens long"), "x", 2)
    assert meta.select("splits.train_tokens", "splits.val_tokens").first() == (10, 2)


def test_parquet_batches(spark, tmp_path):
    df = spark.range(25).withColumn("text", F.lit("x"))
    io.write_parquet_batches(df.coalesce(1), str(tmp_path / "p"), rows_per_file=10)
    files = [p for p in (tmp_path / "p").iterdir() if p.name.endswith(".parquet")]
    assert len(files) == 3 and spark.read.parquet(str(tmp_path / "p")).count() == 25


def test_read_pretrain_declared_schema(spark, tmp_path):
    from versify.operators import corpus as C

    bad = spark.createDataFrame(
        [("a", "x", "t", "1800", "uno due", "2"), ("b", "y", "u", "17x0", "tre", "1"), ("c", "z", "v", "1850", "", "0")],
        "identifier string, creator string, title string, publication_date string, text string, word_count string",
    )
    bad.write.parquet(str(tmp_path / "pt"))
    df = io.read_pretrain(spark, str(tmp_path / "pt"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string", "string", "int", "string", "int"]
    kept = C.content_filter(C.year_filter(df)).select("identifier").collect()
    assert [r[0] for r in kept] == ["a"]  # bad year -> null -> dropped; empty text dropped


def test_quarantine_parts_rows_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "12"), (2, "x"), (3, None), (4, "7")], "id long, year string")
    good, rejected, counts = io.write_quarantined(rows, F.when(F.col("year").try_cast("int").isNull(), "year"), str(tmp_path / "q"))
    assert sorted(r.id for r in good.collect()) == [1, 4] and good.columns == ["id", "year"]
    assert sorted((r.id, r.reason) for r in rejected.collect()) == [(2, "year"), (3, "year")]
    assert counts == {"good": 2, "rejected": 2}
    none, _, counts = io.write_quarantined(rows.limit(0), F.lit("x"), str(tmp_path / "e"))
    assert none.count() == 0 and counts == {"good": 0, "rejected": 0}
