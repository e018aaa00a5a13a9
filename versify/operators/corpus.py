"""Pretraining-corpus operators: declared schema, filters, word budget, stats.

The corpus view derives the declared pretraining schema from ``documents``:
identifier, creator, title, publication_date (int), text, word_count (int).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRETRAIN_SCHEMA = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("publication_date", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

FIRST_YEAR = 1791  # F1 lower bound (no upper bound)
DEFAULT_BUDGET = 200_000_000  # W3 word budget


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0))


def pretrain_view(documents: DataFrame) -> DataFrame:
    """documents -> declared corpus schema (plus doc_id as the stream order)."""
    return documents.select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("identifier"),
        F.col("source").alias("creator"),
        F.concat_ws("-", F.col("lang"), F.col("doc_id").cast("string")).alias("title"),
        (F.lit(1780) + F.col("doc_id") % 60).cast("int").alias("publication_date"),
        F.col("text"),
        word_count(F.col("text")).cast("int").alias("word_count"),
    )


def year_filter(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """F1 (+ V2: an extra row predicate)."""
    out = df.where(F.col("publication_date").isNotNull() & (F.col("publication_date") >= FIRST_YEAR))
    return out.where(predicate) if predicate is not None else out


def content_filter(df: DataFrame) -> DataFrame:
    """drop empty text and zero/null word counts."""
    return df.where(F.col("text").isNotNull() & (F.col("text") != "") & (F.coalesce("word_count", F.lit(0)) != 0))


def project_corpus(df: DataFrame) -> DataFrame:
    """the six declared columns in output order."""
    return df.select("identifier", "creator", "title", "publication_date", "word_count", "text")


def running_total(df: DataFrame, order_col: str, value_col: str, out_col: str) -> DataFrame:
    """Exclusive prefix sum of ``value_col`` in ``order_col`` order, without an
    unpartitioned window over the table.

    Rows are dealt to ranges of ``order_col`` whose bounds Spark samples from the
    data, so sparse or hashed keys make no more ranges than dense ones; the
    ranges' totals (one row each) get their exclusive prefix sum, are joined
    back, and a window inside each range finishes the sum.  The ranges are pinned by
    a checkpoint, as a second sampling need not give the same bounds."""
    b = df.repartitionByRange(order_col).withColumn("_bucket", F.spark_partition_id()).checkpoint()
    totals = b.groupBy("_bucket").agg(F.sum(value_col).alias("_bt"))
    offsets = totals.select(
        "_bucket",
        F.coalesce(
            F.sum("_bt").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    within = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(offsets, "_bucket")
        .withColumn(out_col, F.col("_off") + F.coalesce(F.sum(value_col).over(within), F.lit(0)))
        .drop("_bucket", "_off")
    )


def word_budget(corpus: DataFrame, target_words: int = DEFAULT_BUDGET, *carried: str) -> DataFrame:
    """W3 + A6: keep rows while the words *before* the row are under the
    target (the crossing row is kept whole); ``increment`` clips the last one.
    Only ids, years and word counts are summed up; ``carried`` names further columns."""
    eligible = content_filter(year_filter(corpus)).select("doc_id", "publication_date", "word_count", *carried)
    summed = running_total(eligible, "doc_id", "word_count", "words_before")
    kept = summed.where(F.col("words_before") < target_words)
    return kept.withColumn(
        "increment", F.least(F.col("word_count").cast("long"), F.lit(target_words) - F.col("words_before"))
    )


def year_counts(kept: DataFrame) -> DataFrame:
    """A5: rows per publication year."""
    return kept.groupBy("publication_date").agg(F.count(F.lit(1)).cast("long").alias("n"))


def corpus_metadata(kept: DataFrame, dataset_name: str) -> DataFrame:
    """One row with total words, year -> count map and creation time.
    Per-year partial rows carry their word sums, so one global aggregate
    yields both the total and the map."""
    years = kept.groupBy("publication_date").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("increment").cast("long").alias("w")
    )
    return years.agg(
        F.sum("w").cast("long").alias("total_words"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("publication_date", "n")))).alias("publication_years"),
    ).select(
        F.lit(dataset_name).alias("dataset_name"),
        "total_words",
        "publication_years",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )


def length_stats(df: DataFrame, length: Column, prefix: str) -> DataFrame:
    """A2/A3: mean, exact median, min, max and population std of a length."""
    return df.agg(
        F.round(F.avg(length), 6).alias(f"{prefix}_mean"),
        F.round(F.median(length).cast("double"), 6).alias(f"{prefix}_median"),
        F.min(length).cast("long").alias(f"{prefix}_min"),
        F.max(length).cast("long").alias(f"{prefix}_max"),
        F.round(F.stddev_pop(length), 6).alias(f"{prefix}_std"),
    )
