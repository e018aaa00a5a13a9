"""Run-log analytics over ``events`` (R2-R5): run = user_id, step = order of
(ts, event_id) inside the run, loss = value.

Step numbers and previous timestamps are computed per (run, range
partition): piece row counts and last timestamps form a small table whose
prefix sums are joined back, so a hot run (a third of all rows) is spread
over many tasks instead of one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def micros(col: str) -> F.Column:
    """Microseconds since 1970 for TIMESTAMP or TIMESTAMP_NTZ, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def ordered_steps(events: DataFrame, run: str = "user_id") -> DataFrame:
    """Adds ``step`` (0-based) and ``prev_ts`` per run in (ts, event_id) order.

    Rows are range-partitioned on (run, ts, event_id), so a run is split over
    as many tasks as its size needs.  Each (run, partition) piece reports its
    row count and last row (a table of at most runs x partitions rows); the
    prefix of those counts within the run gives the step offset and the
    previous piece's last row gives ``prev_ts`` at the piece boundary."""
    ranged = events.repartitionByRange(run, "ts", "event_id").withColumn("_pid", F.spark_partition_id()).checkpoint()
    pieces = ranged.groupBy(run, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("ts", "event_id")).alias("_last"))
    per_run = Window.partitionBy(run).orderBy("_pid")
    pieces = pieces.select(
        run,
        "_pid",
        F.coalesce(F.sum("_n").over(per_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lag("_last").over(per_run)["ts"].alias("_prev_piece_ts"),
    )
    inside = Window.partitionBy(run, "_pid").orderBy("ts", "event_id")
    return (
        ranged.join(pieces, [run, "_pid"])
        .withColumn("step", (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
        .withColumn("prev_ts", F.coalesce(F.lag("ts").over(inside), F.col("_prev_piece_ts")))
        .drop("_pid", "_off", "_prev_piece_ts")
    )


def eval_rows(steps: DataFrame, every: int) -> DataFrame:
    """Periodic selection of log rows."""
    return steps.where(F.col("step") % every == 0)


def best_step(evals: DataFrame, run: str = "user_id") -> DataFrame:
    """R2: first step of the strict minimum validation loss per run."""
    return evals.groupBy(run).agg(
        F.min_by("step", F.struct("value", "step")).alias("best_step"),
        F.min("value").alias("best_loss"),
        F.count(F.lit(1)).cast("long").alias("n_evals"),
    )


def _prefix_frame(ranged: DataFrame, key: str, order: list[str], col: str, agg, combine, inclusive: bool, out: str) -> DataFrame:
    pieces = ranged.groupBy(key, "_pid").agg(agg(col).alias("_pa"))
    per_key = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(key, "_pid", agg("_pa").over(per_key).alias("_before"))
    frame = Window.partitionBy(key, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return ranged.join(pieces, [key, "_pid"]).withColumn(out, combine(F.col("_before"), agg(col).over(frame))).drop("_before")


def early_stop(evals: DataFrame, every: int, patience: int, run: str = "user_id") -> DataFrame:
    """+``every`` for each evaluation without strict improvement, reset on
    improvement; the run stops at the first evaluation reaching ``patience``.

    Evaluations are range-partitioned on (run, step); the running minimum
    before each evaluation and the step of the last improvement are prefix
    aggregates over pieces, so no run is ever one window partition."""
    ranged = evals.select(run, "step", "value").repartitionByRange(run, "step").withColumn(
        "_pid", F.spark_partition_id()
    ).checkpoint()
    least = lambda a, b: F.least(a, b)  # noqa: E731  (least skips nulls)
    greatest = lambda a, b: F.greatest(a, b)
    m = _prefix_frame(ranged, run, ["step"], "value", F.min, least, False, "before")
    m = m.withColumn("improved", F.col("before").isNull() | (F.col("value") < F.col("before")))
    m = m.withColumn("_imp_step", F.when(F.col("improved"), F.col("step")))
    m = _prefix_frame(m, run, ["step"], "_imp_step", F.max, greatest, True, "last_improvement").cache()
    stops = m.where(F.col("step") - F.col("last_improvement") >= patience).groupBy(run).agg(F.min("step").alias("stop_step"))
    runs = m.select(run).distinct()
    with_stop = runs.join(stops, run, "left")
    best = (
        m.where("improved")
        .join(with_stop, run)
        .where(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))
        .groupBy(run)
        .agg(F.max("step").alias("best_step"))
    )
    return with_stop.join(best, run, "left")


def throughput(steps: DataFrame, every: int, tokens_per_step: int) -> DataFrame:
    """Step time from the previous log row and tokens per second, logged every ``every`` steps."""
    dt_ms = (micros("ts") - micros("prev_ts")) / 1000.0
    return eval_rows(steps, every).select(
        "user_id",
        "step",
        F.round(dt_ms, 3).alias("dt_ms"),
        F.round(F.try_divide(F.lit(float(tokens_per_step)) * 1000.0, dt_ms), 6).alias("tokens_per_s"),
    )
