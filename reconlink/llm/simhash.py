"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.
Fingerprints link at ``radius`` or fewer differing bits. The tables are structured bit
masks: bit i carries a nonzero vector f(i) of radius + 1 bits, and the mask of v tests the
bits with <f(i), v> = 1. Any radius positions span a space that some v != 0 is
orthogonal to, so every pair within the radius agrees in at least one of the
2^(radius+1) - 1 tables; no pair is left to chance.

Only distinct fingerprints enter the tables. A bucket gives a spanning forest of its links
(at most size - 1 rows), never all pairs: a search takes one fingerprint, links all that
are near and not yet reached, and goes on from those. A bucket of over ``SPLIT`` fingerprints is
first split by the same masks over the bits that its table did not test, unless links beyond the radius are asked for.

Cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle give one shingle of them all; rows without doc_id get a
component like any other row, named by the smallest doc_id in it (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from .common import components, cut, with_arrow_columns, words_of

SHINGLE, SEED, RADIUS = 4, 42, 4
SPLIT = 4096
#: buckets up to this size are compared at once for a whole batch
SMALL = 8


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = words_of(text)
    if not words:
        return []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose hashes lie one after another; no hash gives zero."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
        out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` with the fingerprint as a (signed) long."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            each = [shingle_hashes(t, size, seed) for t in texts]
            counts = np.array([len(x) for x in each], dtype=np.int64)
            flat = np.fromiter((h for x in each for h in x), dtype=np.uint64, count=int(counts.sum()))
            return [pa.array(majority(flat, counts).view(np.int64))]

        return work

    return with_arrow_columns(df, text, T.StructType([T.StructField(out, T.LongType())]), make)


def covering_masks(radius: int = RADIUS, bits: list[int] | None = None) -> list[int]:
    """Masks over the given bit positions, one for each nonzero v."""
    places = list(range(64)) if bits is None else bits
    top = (1 << (radius + 1)) - 1
    return [sum(1 << p for k, p in enumerate(places) if bin((k % top + 1) & v).count("1") % 2) for v in range(1, top + 1)]


def near(a: np.ndarray, b, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within ``prints`` (distinct)."""
    links, left = [], prints
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = near(left, one, radius)
            if hit.any():
                found = left[hit]
                links += [(one, x) for x in found]
                queue += list(found)
                left = left[~hit]
    return links


def bucket_links(prints: np.ndarray, mask: int, radius: int, reach: int | None = None) -> list[tuple[int, int]]:
    """Links of up to ``reach`` bits (by default the radius) within one bucket, whose members agree on ``mask``.

    The masks that split a large bucket are sure of the radius only, so with a reach beyond it the bucket is searched whole.
    """
    reach = radius if reach is None else reach
    if len(prints) <= SPLIT or reach > radius:
        return forest(prints, reach)
    links = []
    for sub in covering_masks(radius, [b for b in range(64) if not mask >> b & 1]):
        keys = prints & np.uint64(sub)
        order = np.argsort(keys, kind="stable")
        for run in np.split(prints[order], np.flatnonzero(np.diff(keys[order])) + 1):
            links += forest(run, reach)
    return links


def links(prints: DataFrame, column: str = "fingerprint", radius: int = RADIUS, reach: int | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius of each other; ``prints`` are distinct.

    With a ``reach`` beyond the radius, what the tables bring together at up to so many bits is linked too.
    """
    reach = radius if reach is None else reach
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(F.col(column).alias("p"), F.posexplode(F.array(*[F.col(column).bitwiseAND(F.lit(m)) for m in signed])).alias("t", "k"))
    dealt = keyed.repartition("t", "k").sortWithinPartitions("t", "k", "p").select("t", "k", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))

        def closed(t: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            """The links of whole buckets."""
            starts = np.concatenate([[0], np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(p)]]))
            size_of = np.repeat(sizes, sizes)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            a, b = [], []
            for apart in range(1, SMALL):
                here = np.flatnonzero((size_of[:-apart] <= SMALL) & (bucket[apart:] == bucket[:-apart])) if len(p) > apart else []
                if len(here):
                    hit = here[near(p[here], p[here + apart], reach)]
                    a.append(p[hit])
                    b.append(p[hit + apart])
            for i in np.flatnonzero(sizes > SMALL):
                found = bucket_links(p[starts[i] : starts[i] + sizes[i]], masks[t[starts[i]]], radius, reach)
                if found:
                    x, y = np.array(found, dtype=np.uint64).T
                    a.append(x)
                    b.append(y)
            a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            t, k, p = (np.concatenate([old, np.asarray(batch.column(i)).astype(kind) if kind is np.int64 else np.asarray(batch.column(i)).view(kind)]) for i, (old, kind) in enumerate(zip(rest, (np.int64, np.int64, np.uint64))))
            if not len(p):
                continue
            # the last bucket may go on in the next batch
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1])).max(initial=-1)) + 1
            rest = (t[last:], k[last:], p[last:])
            if last:
                yield closed(t[:last], k[:last], p[:last])
        if len(rest[2]):
            yield closed(*rest)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (long), component_id."""
    prints = cut(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fingerprint"))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fingerprint"), radius=radius))
    joined = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(names, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row of the smallest doc_id stays.

    Of rows that share this doc_id one stays. Rows without doc_id can't be named and all stay.
    """
    found = simhash_components(df, doc_id, text, radius)
    keepers = found.where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(text), F.xxhash64(*df.columns))
    number = "_row" + "_" * max(map(len, df.columns))
    named = df.join(keepers, doc_id, "left_semi").withColumn(number, F.row_number().over(order)).where(f"{number} = 1").select(*df.columns)
    return named.unionByName(df.where(F.col(doc_id).isNull()))
