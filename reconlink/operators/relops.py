"""Small relational helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reconlink import scale


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key; ``n`` may be a column."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def newest(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(ts), F.asc(tie)).limit(n)


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range with either bound optional."""
    kept = df if low is None else df.filter(F.col(column) >= F.lit(low))
    return kept if high is None else kept.filter(F.col(column) <= F.lit(high))


def equal_if_given(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def birth_filter(column: str, birth=None, year: int | None = None) -> Column:
    """Exact date if given, else the year if given, else no test."""
    if birth is not None:
        return F.col(column) == F.lit(birth)
    if year is not None:
        return F.year(column) == year
    return F.lit(True)


def search(df: DataFrame, columns: list[str], text: str, key: list[str]) -> DataFrame:
    """Rows where any column holds ``text`` in any case, one per key."""
    plain = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{plain}%"), F.lit(False)) for c in columns])
    return df.filter(hit).dropDuplicates(key)


def not_blank(column: str) -> Column:
    return ~(F.col(column).isNull() | (F.col(column) == ""))


def children_list(parents: DataFrame, children: DataFrame, key: str, item: list[str], name: str) -> DataFrame:
    """Parents with their children as one sorted list each; no child gives an empty list."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias(name))
    kind = lists.schema[name].dataType
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def count_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    return parents.join(children.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").na.fill(0, [name])


def fill_down(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last non-blank value at or above each row."""
    return scale.segmented_scan(df, keys, order, {name: ("last", F.nullif(F.trim(column), F.lit("")))})


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, descending: bool = False) -> DataFrame:
    """Sequential number from 1 per key (or over all rows when there is no key)."""
    return scale.segmented_scan(df, keys, order, {name: ("count", F.lit(1))}, descending=descending)


def latest_per(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    return top_per(df, keys, [F.desc(ts), F.desc(tie)], 1, "_rn").drop("_rn")


def only_latest_active(df: DataFrame, keys: list[str], ts: str, tie: str, flag: str) -> DataFrame:
    """Of the active rows of a key only the newest stays active."""
    w = W.partitionBy(*keys, flag).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).withColumn(flag, F.col(flag) & (F.col("_rn") == 1)).drop("_rn")


def replace_when_found(base: DataFrame, better: DataFrame, keys: list[str]) -> DataFrame:
    """``better`` where it has rows for the key, else ``base``."""
    return better.unionByName(base.join(better.select(*keys).distinct(), keys, "left_anti"))


def missing_both_ways(report: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    a, b = report.select(*keys).distinct(), registry.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing_in_registry")).unionByName(
        b.join(a, keys, "left_anti").withColumn("side", F.lit("missing_in_report")))


def keep_current(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is still in ``current``."""
    return stored.join(current.select(*keys).distinct(), keys, "left_semi")


def page(df: DataFrame, order: str, number: int, size: int | None = None, *, default: int = 50, most: int = 100) -> DataFrame:
    """One page by a unique order column, with total, page number, size and has_next.

    Size and number are clamped to what exists. Rows are numbered by a
    segmented scan, so deep pages need no single sorted task.
    """
    size = max(1, min(most, default if size is None else size))
    total = df.count()
    pages = max(1, -(-total // size))
    number = max(1, min(pages, number))
    rows = numbered(df, [], [order], "row_no")
    return rows.filter(F.col("row_no").between((number - 1) * size + 1, number * size)).withColumns({
        "total": F.lit(total), "page": F.lit(number), "page_size": F.lit(size), "has_next": F.lit(number < pages)})


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and adjacent inclusive ranges joined: keys, start, end, parts."""
    rows = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).groupBy(*keys, "_s").agg(
        F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
    reach = scale.Ordered.of(rows, keys, ["_s"]).scan({"_reach": ("max", F.col("_e"))}, exclusive=("_reach",))
    fresh = reach.map(lambda r: r.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + 1), 1).otherwise(0)))
    island = fresh.scan({"_island": ("sum", F.col("_new"))}).result
    return island.groupBy(*keys, "_island").agg(
        F.min("_s").alias(start), F.max("_e").alias(end), F.sum("_n").alias("parts")).drop("_island")


def best_record(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order, 1, "_rn").drop("_rn")
