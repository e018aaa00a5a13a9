"""Sources and sinks (S1-S14) as plain DataFrame readers and writers.

Text corpora are folders of ``*.txt`` files (one document per file, key =
path relative to the root); everything else is parquet or JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.operators.corpus import PRETRAIN_SCHEMA


def read_text_corpus(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """One row per ``*.txt`` file: (path relative to root, stem, text).

    Files are read whole as bytes and decoded as UTF-8, so the text is exactly
    the file content (the line-oriented text reader would drop a final newline)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.load(root).select("path", F.decode("content", "UTF-8").alias("text"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), "^" + _regex_escape(root.rstrip("/")) + "/", "")
    return df.select(
        rel.alias("path"),
        F.regexp_extract(rel, r"([^/]*)\.txt$", 1).alias("stem"),
        "text",
    )


def _regex_escape(s: str) -> str:
    import re

    return re.escape(s)


def read_pretrain(spark: SparkSession, path: str) -> DataFrame:
    """S3: the pretraining corpus in its declared schema.  Every declared column
    is read with ``try_cast``: a value that does not fit becomes null (and the
    F1/F2 filters then drop the row) instead of stopping the job; a missing
    column is all null."""
    raw = spark.read.parquet(path)
    cols = []
    for f in PRETRAIN_SCHEMA.fields:
        col = F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
        cols.append(col.alias(f.name))
    return raw.select(*cols)


def read_texts_only(spark: SparkSession, path: str) -> DataFrame:
    """Column-pruned scan of the ``text`` column."""
    return spark.read.parquet(path).select("text")


def write_parquet_batches(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Parquet sink flushed every ``rows_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_text_table(df: DataFrame, path: str) -> None:
    """Per-document sink keyed by relative path; text right-stripped plus one newline."""
    df.select("path", F.concat(F.regexp_replace("text", r"\s+$", ""), F.lit("\n")).alias("text")).write.mode(
        "overwrite"
    ).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept as is."""
    df.write.mode("overwrite").json(path)


CHAT_SCHEMA = T.StructType(
    [T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))]
)
RECORD_SCHEMA = T.StructType([T.StructField("text", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token streams (split, pos, id) partitioned by split; ids must fit 16 bits."""
    bad = tokens.where((F.col("id") < 0) | (F.col("id") >= 65536)).limit(1).count()
    if bad:
        raise ValueError("token id outside the unsigned 16-bit range")
    tokens.write.mode("overwrite").partitionBy("split").parquet(path)


def read_tokens(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a token stream (partition pruning on ``split``)."""
    return spark.read.parquet(path).where(F.col("split") == split).select("pos", "id")


def write_streams(streams: DataFrame, path: str, bits: int = 16) -> None:
    """S9 by documents: (split, start, ..., ids) rows, a folder for each split; an id outside the unsigned range of so many
    bits fails the job in the same pass."""
    outside = (F.array_max("ids") >= F.lit(1 << bits)) | (F.array_min("ids") < 0)
    checked = F.when(outside, F.raise_error(F.lit(f"token id outside the unsigned {bits}-bit range")).cast("array<int>")).otherwise(F.col("ids"))
    streams.withColumn("ids", checked).write.mode("overwrite").partitionBy("split").parquet(path)


def read_streams(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """S10 by documents: the rows of the splits (partition pruning), of all without any."""
    streams = spark.read.parquet(path)
    return streams.where(F.col("split").isin(*splits)) if splits else streams


def write_vocab(vocab: DataFrame, specials: dict[str, str], path: str) -> None:
    """Vocabulary table; specials as (name, token) rows alongside."""
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spark = vocab.sparkSession
    spark.createDataFrame(sorted(specials.items()), "name string, token string").write.mode("overwrite").parquet(
        f"{path}/specials"
    )


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocab(token, id), specials(name, token)); itos / stoi are the same table."""
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/specials")


def dataset_metadata(tokens_per_split: DataFrame, dataset: str, vocab_size: int) -> DataFrame:
    """Dataset, vocab size and tokens per split as one nested row."""
    piv = tokens_per_split.agg(
        F.sum(F.when(F.col("split") == "train", F.col("n_tokens"))).cast("long").alias("train_tokens"),
        F.sum(F.when(F.col("split") == "val", F.col("n_tokens"))).cast("long").alias("val_tokens"),
    )
    return piv.select(
        F.lit(dataset).alias("dataset"),
        F.lit(vocab_size).alias("vocab_size"),
        F.struct("train_tokens", "val_tokens").alias("splits"),
    )


def run_summary(evals: DataFrame, run: str = "user_id") -> DataFrame:
    """Best loss, best step and evaluations done per run."""
    return evals.groupBy(run).agg(
        F.min("value").alias("best_val_loss"),
        F.min_by("step", F.struct("value", "step")).alias("best_step"),
        F.max("step").alias("steps_done"),
    )


def write_json(df: DataFrame, path: str) -> None:
    """Metadata sinks (S12-S14) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_quarantined(df: DataFrame, reason: Column, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows without a reason and rejected rows with theirs, to two folders in one pass; and how many went where, counted
    by the same pass."""
    spark = df.sparkSession
    counted = Observation()
    marked = df.withColumn("reason", reason).withColumn("sink", F.when(F.col("reason").isNull(), "good").otherwise("rejected"))
    seen = marked.observe(counted, F.count(F.when(F.col("reason").isNull(), 1)).alias("good"), F.count("reason").alias("rejected"))
    seen.write.partitionBy("sink").parquet(path)
    kept = T.StructType([f for f in marked.schema.fields if f.name != "sink"])
    both = spark.read.schema(kept.add("sink", "string")).parquet(path)
    good = both.where(F.col("sink") == "good").drop("sink", "reason")
    return good, both.where(F.col("sink") == "rejected").drop("sink"), dict(counted.get)
