"""What the operators of this subpackage share: reading tables, adding Arrow-made columns, cutting lineage, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
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
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def chunks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of ``column`` each; a longer value is a slice by itself."""
    array = batch.column(column)
    if not len(batch):
        return
    sizes = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    ends = np.cumsum(np.asarray(pa.compute.binary_length(sizes), dtype=np.int64))
    start, used = 0, 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, used + size, side="right")))
        yield batch.slice(start, stop - start)
        start, used = stop, int(ends[stop - 1])


def with_arrow_columns(
    df: DataFrame, text: str, made: T.StructType, make: Callable[[], Callable[[list[str]], list]], size: int = 1 << 20
) -> DataFrame:
    """``df`` with the columns ``made``, computed from the texts in slices of about ``size`` bytes.

    ``make`` is called once per task and returns the function from a list of texts
    (null given as empty) to the Arrow arrays of the made columns. A column of ``df``
    with the name of a made one is replaced.
    """
    kept = [c for c in df.columns if c not in made.fieldNames() or c == text]
    plain = df.select(*[F.col(f"`{c}`") for c in kept])
    hidden = text in made.fieldNames()
    names = [c for c in kept if not (hidden and c == text)]
    schema = T.StructType([f for f in plain.schema if f.name in names] + list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in chunks(batch, text, size):
                arrays = work([x or "" for x in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + list(arrays), names=[*names, *made.fieldNames()])

    return plain.mapInArrow(run, schema)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes.split and bytes.lower know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs ``starts[i] .. starts[i] + lengths[i]``, one after another."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def binary_array(data: np.ndarray, lengths: np.ndarray, kind=pa.binary()) -> pa.Array:
    """Arrow values that lie one after another in ``data``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the links ``a - b``: one row (node, root), root the smallest node of its component.

    Large star and small star in turn (Kiveris et al.) until nothing changes: every
    node points at its smallest neighbour, so the number of rounds grows with the logarithm
    of a component's size. Neighbour lists are never gathered, only their minimum,
    which is partly taken before the shuffle; the joins back are equi joins whose hot
    nodes AQE may split.
    """
    links = cut(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    )
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        after = cut(
            small.where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionAll(down.select(F.col("m").alias("lo"), "hi")).distinct()
        )
        same = (
            links.agg(F.count("lo"), F.bit_xor(F.xxhash64("lo", "hi"))).first(),
            after.agg(F.count("lo"), F.bit_xor(F.xxhash64("lo", "hi"))).first(),
        )
        links = after
        if same[0] == same[1]:
            break
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
