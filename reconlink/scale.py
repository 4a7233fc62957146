"""Building blocks that keep plans balanced when the data grows.

* ``measured`` / ``fits`` put a number on a side before anything is replicated;
* ``Ordered`` and ``segmented_scan`` are running windows over ranges of a total order, so that
  hot keys, and tables without a key, are spread over all tasks;
* ``newest_in_window`` is an interval join with a per-row limit that never
  emits more than the limit per row, however dense the time line is;
* ``cut`` ends a lineage on shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What may be replicated to every executor.
REPLICATE_ROWS = 500_000
REPLICATE_BYTES = 64 * 1024 * 1024


def checkpoint_folder(spark) -> str:
    """The session's shared folder ``spark.checkpoint.dir``.

    Only in local mode, where every task sees the driver's disk, is a folder made when none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"/tmp/reconlink-checkpoints-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and drop its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int


def measured(df: DataFrame) -> Size:
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0)).alias("bytes"),
    ).first()
    return Size(int(row["rows"]), int(row["bytes"]))


def fits(df: DataFrame, rows: int = REPLICATE_ROWS, bytes_: int = REPLICATE_BYTES) -> bool:
    size = measured(df)
    return size.rows <= rows and size.bytes <= bytes_


@dataclass(frozen=True)
class Ordered:
    """Rows in the ranges of one total order (keys, then ``order``), ready for running aggregates.

    ``rows`` carry ``_p``, the number of their range. The rows are range-partitioned once and kept in
    that state, because where ranges lie may differ when a part is computed again. A range holds its share of all rows
    whatever the keys are, so a hot key, or no key at all, is cut into as many ranges as its size asks for.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> "Ordered":
        ranged = df.repartitionByRange(*([] if parts is None else [parts]), *keys, *order)
        return Ordered(cut(ranged.withColumn("_p", F.spark_partition_id())), tuple(keys), tuple(order))

    def map(self, change: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> "Ordered":
        """Rows changed, left out or multiplied; ``order`` must refine the order they are in."""
        return Ordered(change(self.rows), self.keys, self.order if order is None else tuple(order))

    def scan(self, outputs: dict[str, tuple[str, Column]], *, exclusive: tuple[str, ...] = (), descending: bool = False) -> "Ordered":
        """Running aggregates per key: op in sum, max, min, count, last (the last non-null value).

        Two passes: a local window per range and key, and what the ranges before give a key. Only the first
        key of a range (the last one when descending) can have begun before it, so there is at most one such carry per range,
        joined by ``_p``; the local windows use the same exchange. Names in ``exclusive`` stop before the current row.
        """
        ops = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
        ranked = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        base = W.partitionBy("_p", *self.keys).orderBy(*ranked)
        local, totals, carries, merged = {}, [], [], {}
        past = W.partitionBy(*self.keys).orderBy(F.desc("_p") if descending else F.asc("_p"))
        before = past.rowsBetween(W.unboundedPreceding, -1)
        for name, (op, value) in outputs.items():
            frame = base.rowsBetween(W.unboundedPreceding, -1 if name in exclusive else 0)
            local[name] = (F.last(value, ignorenulls=True) if op == "last" else ops[op](value)).over(frame)
            if op == "last":
                pick = (F.min if descending else F.max)(F.when(value.isNotNull(), F.struct(*self.order, value.alias("_v"))))
                totals.append(pick.getField("_v").alias(f"_t_{name}"))
            else:
                totals.append(ops[op](value).alias(f"_t_{name}"))
            total, here, carry = F.col(f"_t_{name}"), F.col(name), F.col(f"_c_{name}")
            if op == "last":
                carries.append(F.last(total, ignorenulls=True).over(before).alias(f"_c_{name}"))
                merged[name] = F.coalesce(here, carry)
            else:
                carries.append((F.sum if op == "count" else ops[op])(total).over(before).alias(f"_c_{name}"))
                # sums and counts add up; greatest and least leave nulls out
                merged[name] = {"max": F.greatest, "min": F.least}[op](here, carry) if op in ("max", "min") else (
                    F.when(carry.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + carry))
        sums = self.rows.groupBy("_p", *self.keys).agg(*totals)
        carry = sums.select(
            F.col("_p").alias("_c_p"), *[F.col(k).alias(f"_c_{k}") for k in self.keys], F.row_number().over(past).alias("_c_no"), *carries).filter("_c_no > 1")
        # joined by the range alone, the rows then lie right for the windows; the key is a mere condition
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in self.keys], F.lit(True))
        joined = self.rows.join(carry, (F.col("_p") == F.col("_c_p")) & F.when(same, True), "left").withColumns(local)
        return Ordered(joined.withColumns(merged).select(*[c for c in self.rows.columns if c not in outputs], *outputs), self.keys, self.order)

    @property
    def result(self) -> DataFrame:
        return self.rows.drop("_p")


def segmented_scan(
    df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, tuple[str, Column]], *,
    descending: bool = False, exclusive: tuple[str, ...] = (), parts: int | None = None,
) -> DataFrame:
    """One ``Ordered.scan`` over ``df``; the order columns must make rows unique."""
    return Ordered.of(df, keys, order, parts).scan(outputs, exclusive=exclusive, descending=descending).result


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@dataclass(frozen=True)
class TimeLine:
    """Right rows with their place on the time line, and position ranges for left times and named windows.

    ``rows``: keys, _pos, _row, _b. ``ranges``: keys, _lt, window, newer, to: the
    right rows of that window are those with newer < _pos <= to, newest first.
    """

    keys: tuple[str, ...]
    rows: DataFrame
    ranges: DataFrame

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """``wanted``: keys, any columns, and _r, an array of (newer, to). One row per right row in any of the ranges."""
        blocks = F.array_distinct(F.flatten(F.transform("_r", lambda r: F.sequence(
            F.floor(r["newer"] / BLOCK), F.floor((r["to"] - 1) / BLOCK)))))
        return (
            wanted.withColumn("_b", F.explode(blocks)).join(self.rows, [*self.keys, "_b"])
            .filter(F.exists("_r", lambda r: (F.col("_pos") > r["newer"]) & (F.col("_pos") <= r["to"])))
            .drop("_b", "_r")
        )


BLOCK = 64


def time_line(
    left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, tie: str, windows: dict[str, tuple[int, int, int | None]],
    keys: list[str] | None = None, parts: int | None = None, cut_scan: bool = False,
) -> TimeLine:
    """Place all right rows and all window borders on one line, by one segmented scan.

    ``windows``: name -> (seconds before, seconds after, limit or None). However many
    windows are asked for and however dense the line is, every row and border
    passes once and no pair of rows is made.
    """
    keys = keys or []
    micro = 1_000_000
    payload = [c for c in right.columns if c not in keys]
    ev = right.filter(F.col(right_ts).isNotNull()).withColumn("_rt", _micros(right_ts))
    pts = left.filter(F.col(left_ts).isNotNull()).select(*keys, _micros(left_ts).alias("_lt")).distinct()
    packed = F.struct(*payload, "_rt").alias("_row")
    kind = ev.select(packed).schema[0].dataType
    borders = F.array(*[
        F.struct((F.col("_lt") + F.lit(shift * micro)).alias("_t"), F.lit(side).alias("_kind"), F.lit(name).alias("window"))
        for name, (before, after, _) in windows.items() for side, shift in ((0, -before), (2, after))])
    line = ev.select(
        *keys, F.col("_rt").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("window"), F.col(tie).alias("_tie"), packed,
        F.lit(None).cast("long").alias("_lt"),
    ).unionByName(pts.select(*keys, "_lt", F.explode(borders).alias("_x")).select(
        *keys, "_x.*", F.lit(None).cast(ev.schema[tie].dataType).alias("_tie"), F.lit(None).cast(kind).alias("_row"), "_lt"))
    # scanned from the future to the past: position 1 is the newest row. At one
    # instant a window's late border comes first, then the rows, then early borders.
    spot = segmented_scan(
        line.withColumns({"_d": -F.col("_t"), "_neg": -F.col("_kind")}), keys, ["_d", "_neg", "_tie"],
        {"_pos": ("sum", F.when(F.col("_kind") == 1, 1).otherwise(0))}, parts=parts,
    ).select(*keys, "_kind", "window", "_lt", "_pos", "_row")
    spot = cut(spot) if cut_scan else spot
    limit_of = F.create_map(*[x for name, (_, _, limit) in windows.items() for x in (F.lit(name), F.lit(limit).cast("long"))])
    ranges = (
        spot.filter("_kind <> 1").groupBy(*keys, "_lt", "window")
        .agg(F.max(F.when(F.col("_kind") == 2, F.col("_pos"))).alias("newer"), F.max(F.when(F.col("_kind") == 0, F.col("_pos"))).alias("to"))
        .withColumn("to", F.least(F.col("to"), F.coalesce(F.col("newer") + F.element_at(limit_of, F.col("window")), F.col("to"))))
        .filter("to > newer")
    )
    rows = spot.filter("_kind = 1").select(*keys, "_pos", "_row", F.floor((F.col("_pos") - 1) / BLOCK).alias("_b"))
    return TimeLine(tuple(keys), rows, ranges)


def newest_in_window(
    left: DataFrame,
    right: DataFrame,
    *,
    left_ts: str,
    right_ts: str,
    tie: str,
    before: int,
    after: int,
    limit: int,
    keys: list[str] | None = None,
    parts: int | None = None,
    bucket_limit: int | None = None,
) -> DataFrame:
    """For each left row the newest ``limit`` right rows in [ts-before, ts+after] seconds.

    ``keys`` must be equal on both sides (same names). Newest first, ``tie``
    ascending among equal times. Adds ``rank_in_window``. The right side must
    not carry the left side's column names (keys aside).

    Two exact plans. When no time bucket of the right side holds more than
    ``limit`` rows, a bucket equi join is bounded by itself. Otherwise rows get
    positions on a ``time_line``, a window becomes a position range, and only
    the at most ``limit`` newest positions of it are fetched.
    """
    keys = keys or []
    micro = 1_000_000
    span = (before + after) * micro
    ev = right.filter(F.col(right_ts).isNotNull()).withColumn("_rt", _micros(right_ts))
    pts = left.filter(F.col(left_ts).isNotNull()).select(*keys, _micros(left_ts).alias("_lt")).distinct()
    bucket = F.floor(F.col("_rt") / F.lit(span)).cast("long") if span else F.col("_rt")
    fullest = ev.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if fullest <= (limit if bucket_limit is None else bucket_limit):
        buckets = F.array(F.col("_lt")) if span == 0 else F.sequence(
            F.floor((F.col("_lt") - before * micro) / F.lit(span)).cast("long"),
            F.floor((F.col("_lt") + after * micro) / F.lit(span)).cast("long"),
        )
        found = pts.withColumn("_b", F.explode(buckets)).join(ev.withColumn("_b", bucket), [*keys, "_b"])
        found = found.filter(F.col("_rt").between(F.col("_lt") - before * micro, F.col("_lt") + after * micro)).drop("_b")
        newest = W.partitionBy(*keys, "_lt").orderBy(F.col("_rt").desc(), F.col(tie).asc())
        found = found.withColumn("rank_in_window", F.row_number().over(newest)).filter(F.col("rank_in_window") <= limit)
    else:
        line = time_line(left, right, left_ts=left_ts, right_ts=right_ts, tie=tie, windows={"w": (before, after, limit)}, keys=keys, parts=parts)
        # the left rows meet their range before its rows are fetched: what is fetched, up to ``limit`` a row, is shuffled no more
        own = left.withColumn("_lt", _micros(left_ts)).join(line.ranges.select(*keys, "_lt", "newer", "to"), [*keys, "_lt"])
        found = line.fetch(own.withColumn("_r", F.array(F.struct("newer", "to")))).select(
            *left.columns, F.col("_row").dropFields("_rt").alias("_row"), (F.col("_pos") - F.col("newer")).cast("int").alias("rank_in_window"))
        return found.select(*keys, *[c for c in left.columns if c not in keys], "_row.*", "rank_in_window")
    return left.withColumn("_lt", _micros(left_ts)).join(found.drop("_rt"), [*keys, "_lt"]).drop("_lt")
