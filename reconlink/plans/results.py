"""Reading side: progress, queue, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from reconlink.functions.dates import elapsed_text
from reconlink import scale


def progress(batches: DataFrame, now=None) -> DataFrame:
    """Adds percent (0 to 100), elapsed_seconds (open end = now) and elapsed.

    ``batches``: status, progress_done, progress_total, started_at, finished_at.
    """
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    total = F.coalesce("progress_total", F.lit(0))
    done = F.when((F.col("status") == "done") & F.col("progress_total").isNotNull(), total).otherwise(F.coalesce("progress_done", F.lit(0)))
    safe = F.greatest(F.least(done, total), F.lit(0))
    percent = F.when(total <= 0, 0).otherwise(F.bround(100 * safe / total, 0).cast("int"))
    seconds = F.unix_seconds(F.coalesce(F.col("finished_at").cast("timestamp"), moment)) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return batches.withColumns({"percent": percent, "elapsed_seconds": F.greatest(seconds, F.lit(0).cast("long"))}).withColumn(
        "elapsed", elapsed_text("elapsed_seconds"))


def queue_position(batches: DataFrame) -> DataFrame:
    """Adds position: 0 while running, else older unfinished + 1, NULL when finished.

    ``batches``: batch_id, status, queued_at (no NULLs among unfinished).
    """
    open_ = batches.filter("status IN ('running', 'queued')").groupBy("queued_at").agg(F.count(F.lit(1)).alias("_n"))
    older = scale.segmented_scan(open_, [], ["queued_at"], {"_older": ("sum", F.col("_n"))}, exclusive=("_older",))
    joined = batches.join(older.select("queued_at", "_older"), "queued_at", "left")
    return joined.withColumn("position", F.when(F.col("status") == "running", F.lit(0).cast("long")).when(
        F.col("status") == "queued", F.coalesce("_older", F.lit(0)) + 1)).drop("_older")


def owned_queue(batches: DataFrame, owner: str, statuses: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    return batches.filter(F.col("status").isin(*statuses) & (F.col("owner") == owner))


def stale_packages(batches: DataFrame, keep: int = 10) -> DataFrame:
    """Finished batches whose stored package is beyond the newest ``keep`` of their owner."""
    kept = batches.filter(F.col("status").isin("done", "failed") & F.col("package").isNotNull() & (F.col("package") != ""))
    newest = W.partitionBy("owner").orderBy(F.desc_nulls_last("finished_at"), F.desc("created_at"), F.desc("batch_id"))
    top = kept.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).select("batch_id")
    return kept.join(top, "batch_id", "left_anti")
