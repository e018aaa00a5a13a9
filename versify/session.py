"""Spark session helpers.

The library never creates a session behind the caller's back: every public
function takes the session (or a DataFrame) explicitly.  ``local_session`` is
only a convenience for tests, the bench and ad-hoc runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "versify") -> SparkSession:
    """A local session tuned for the small scale factors used in tests."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.versify.read.partitions", str(4 * (os.cpu_count() or 1) if cpus == "*" else 4 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("VERSIFY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to a shared folder and we
    only read it; unset there, it is an error, as no folder of one machine is seen by
    the others.  Only a local master gets a scratch folder of its own.
    """
    conf_dir = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Connect session: the server owns the checkpoint folder)
        return conf_dir or ""
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="versify-ckpt-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, local_dir)
    sc.setCheckpointDir(local_dir)
    return local_dir
