"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; everything else is a scan of that
histogram from its long end. Only the histogram is shuffled: one row per task and
length. The scan runs in two steps, over blocks of neighbouring lengths and over the
few block totals, so no task holds the whole histogram.

Cases: a null text has length 0; an empty table gives an empty histogram; repeated rows
count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .bpe import count_tokens

#: lengths per block of the scan
BLOCK = 1024


def histogram(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per length: n_tokens, docs."""
    return df.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length as a context limit L: documents and tokens over it, and what truncation at L leaves.

    ``docs_over``/``tokens_over`` are of documents longer than L, ``truncated_total`` is the
    sum of min(length, L), ``share`` the share of documents of at most L tokens: the
    q-quantile is the smallest L with share >= q.
    """
    blocks = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = blocks.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(every).alias("docs_all"), F.sum("t").over(every).alias("tokens_all"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = blocks.join(totals, "block").select(
        "n_tokens", "docs", "docs_all", "tokens_all",
        (F.col("d_later") + F.coalesce(F.sum("docs").over(within), F.lit(0))).alias("docs_over"),
        (F.col("t_later") + F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(within), F.lit(0))).alias("tokens_over"),
    )
    return over.select(
        "n_tokens", "docs", "docs_over", "tokens_over", "docs_all", "tokens_all",
        (F.col("tokens_all") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        (1 - F.col("docs_over") / F.col("docs_all")).alias("share"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits, also between lengths: one row (context_limit, docs_over, truncated_total), in one pass."""
    asked = sorted({int(x) for x in limits})
    docs, length = F.col("docs"), F.col("n_tokens")
    sums = hist.agg(*[
        F.struct(
            F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(length > x, docs)), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(docs * F.least(length, F.lit(x))), F.lit(0)).alias("truncated_total"),
        ).alias(f"at{x}") for x in asked
    ])
    return sums.select(F.explode(F.array(*[f"at{x}" for x in asked])).alias("a")).select("a.*")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """One row with the smallest length that each share of the documents does not exceed."""
    return sums.agg(*[F.min(F.when(F.col("share") >= q, F.col("n_tokens"))).alias(f"q{round(q * 1000):03d}") for q in shares])


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return suffix_sums(histogram(count_tokens(df.select(text), text)))
