"""Readers for the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Session setting: deal every scan out to so many partitions.  For small tables of one row group
#: each, as in tests; unset, as it should be on a cluster, no scan is shuffled.
READ_PARTITIONS = "spark.versify.read.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str, widen: bool = True) -> DataFrame:
    """Scan one table; naming ``columns`` prunes the parquet read schema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    dealt = spark.conf.get(READ_PARTITIONS, None) if widen else None
    return df.repartition(int(dealt)) if dealt else df
