"""Registered queries that write a sink to the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versify.operators import corpus as C
from versify.operators import vocab as V
from versify.session import ensure_checkpoint_dir
from versify.sources import io as IO
from versify.sources.tables import read_table


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


def pretrain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 -> S3 -> F1 with a further predicate (V2) -> F2: numbers stored as text, every eleventh year unreadable."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    year = F.when(F.col("doc_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("publication_date").cast("string"))
    stored = C.pretrain_view(d).withColumn("publication_date", year).withColumn("word_count", F.col("word_count").cast("string"))
    path = folder(spark, "pretrain")
    IO.write_parquet_batches(stored.drop("doc_id"), path, rows_per_file=100)
    kept = C.content_filter(C.year_filter(IO.read_pretrain(spark, path), F.col("creator") != "src0"))
    return C.project_corpus(kept).select("identifier", "creator", "publication_date", "word_count", F.md5("text").alias("text_md5"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file for each benchmark item in a folder of its own, read back whole."""
    path = folder(spark, "texts")
    read_table(spark, sf_dir, "benchmark", "item_id", "text").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    files = IO.read_text_corpus(spark, path)
    return files.select(F.regexp_extract("path", r"item_id=(-?\d+)/", 1).cast("long").alias("item_id"), F.md5("text").alias("text_md5"))


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document sink by relative path."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    path = folder(spark, "table")
    IO.write_text_table(d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text"), path)
    return spark.read.parquet(path).select("path", F.md5("text").alias("text_md5"))


def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 -> S8: documents as JSON lines and back; equal texts counted."""
    path = folder(spark, "jsonl")
    IO.write_jsonl(read_table(spark, sf_dir, "documents", "text"), path)
    return IO.read_jsonl(spark, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark characters as id streams of two splits (every tenth item is val), vocabulary and
    specials beside them; the val stream read back and its tokens counted."""
    ensure_checkpoint_dir(spark)
    path, vocab_path = folder(spark, "tokens"), folder(spark, "vocab")
    IO.write_vocab(V.char_vocab(read_table(spark, sf_dir, "documents", "text"), special_chars=False), {"EOS": "\n"}, vocab_path)
    vocab, specials = IO.read_vocab(spark, vocab_path)
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    split = F.when(F.col("item_id") % 10 == 0, "val").otherwise("train")
    chars = V.explode_chars(b.select("item_id", split.alias("split"), "text"), ["item_id", "split"])
    ids = V.encode_join(chars, vocab, strict=False)
    IO.write_tokens(ids.select("split", (F.col("item_id") * (1 << 32) + F.col("pos")).alias("pos"), "id"), path)
    named = IO.read_tokens(spark, path, "val").join(vocab, "id").join(specials, "token", "left")
    return named.groupBy("token").agg(F.first("id").cast("int").alias("id"), F.first("name").alias("special"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (pretrain_files, text_files, text_table, jsonl_records, token_streams)}

ORACLE = {
    "pretrain_files": r"""SELECT CAST(doc_id AS VARCHAR) AS identifier, source AS creator, CAST(1780 + doc_id % 60 AS INTEGER) AS publication_date,
       CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count, md5(text) AS text_md5
FROM documents WHERE doc_id % 11 <> 0 AND 1780 + doc_id % 60 >= 1791 AND source <> 'src0' AND len(regexp_extract_all(text, '\S+')) > 0""",
    "text_files": "SELECT CAST(item_id AS BIGINT) AS item_id, md5(text || chr(10)) AS text_md5 FROM benchmark",
    "text_table": r"SELECT source || '/' || doc_id || '.txt' AS path, md5(regexp_replace(text, '\s+$', '') || chr(10)) AS text_md5 FROM documents",
    "jsonl_records": "SELECT md5(text) AS text_md5, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1",
    "token_streams": """WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents UNION SELECT chr(10)),
v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM c WHERE token <> ''),
b AS (SELECT unnest(string_split(text, '')) AS token FROM benchmark WHERE item_id % 10 = 0)
SELECT token, CAST(any_value(id) AS INTEGER) AS id, CASE WHEN token = chr(10) THEN 'EOS' END AS special, CAST(count(*) AS BIGINT) AS n
FROM b JOIN v USING (token) GROUP BY token""",
}
