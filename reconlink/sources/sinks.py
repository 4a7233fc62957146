"""Where results go: partitioned tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from reconlink.functions.text import truncate_tail


def write_results(mentions: DataFrame, results: DataFrame, path: str, mode: str = "append") -> None:
    """Mentions and their results, partitioned by batch so that a batch is read alone."""
    mentions.write.mode(mode).partitionBy("batch_id").parquet(f"{path}/mentions")
    results.write.mode(mode).partitionBy("batch_id").parquet(f"{path}/results")


def read_results(spark, path: str, batch_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    pair = tuple(spark.read.parquet(f"{path}/{part}") for part in ("mentions", "results"))
    return pair if batch_id is None else tuple(df.filter(F.col("batch_id") == batch_id) for df in pair)


def event_documents(results: DataFrame, key: list[str], text_limit: int | None = None) -> DataFrame:
    """One JSON document per row with its key; with a limit the text is cut with a note."""
    shown = results.withColumn("text", truncate_tail("text", text_limit)) if text_limit and "text" in results.columns else results
    return shown.select(*key, F.to_json(F.struct(*[c for c in shown.columns]), {"ignoreNullFields": "false"}).alias("document"))


def batch_payload(batch: DataFrame, items: DataFrame) -> DataFrame:
    """Per batch the first non-empty template note and the number of items."""
    w = W.partitionBy("batch_id").orderBy("idx")
    noted = items.filter("template_info IS NOT NULL AND template_info <> ''").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    counts = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("items"))
    return batch.join(noted.select("batch_id", "template_info"), "batch_id", "left").join(counts, "batch_id", "left").na.fill(0, ["items"])
