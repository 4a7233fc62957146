"""The list of queries that run on the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
# What one task gets of a text table that comes in few files, in bytes of its texts.
PART_BYTES = 32 * 1024 * 1024


class Tables:
    """Lazy readers of the given parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._sizes: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in TEXT_KEYS and len(df.inputFiles()) < cores:
            # a handful of files gives as few tasks; text work is worth one shuffle, into tasks that do not grow with the table
            return df.repartition(max(cores, -(-self._text_bytes(name, df) // PART_BYTES)), TEXT_KEYS[name])
        return df

    def _text_bytes(self, name: str, df: DataFrame) -> int:
        """Measured, because files of repeated texts are far smaller than what they hold; once per query."""
        if name not in self._sizes:
            texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind == "string"]
            self._sizes[name] = df.agg(F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()[0]
        return self._sizes[name]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its oracle SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
