"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared in lower case with white space runs as one space. An
item of m characters leaks into a document if some substring of the document is
within e = floor(rate * m) edits of it. By the q-gram lemma such a substring shares at
least m - q + 1 - q * e of the item's q-grams, on diagonals (document position minus
item position) that differ by at most e. Diagonals are cut into bands of width
2e + 1 that overlap by half, so some band holds them all; shared q-grams are counted per band
and bands below the bound are dropped, which can lose nothing. What stays is verified
by alignment within the band.

The benchmark is a query set: it is taken in blocks of bounded size (``BLOCK`` characters of items),
each block is one pass over all documents, and no text is shuffled.

Items so short that the bound falls to zero are counted by shorter q-grams, of which an
item of m characters keeps one unedited as long as q <= m / (e + 1).

Cases: null or empty texts hold no leak; items of which no edit is allowed and that are shorter than
``q`` are searched as exact substrings, at every place; null or blank
items are no items; repeated items and documents are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks

Q, RATE = 8, 0.1
#: longest q-grams of items that are too short for ``Q``
BRIEF = 4
#: characters of items that are searched in one pass
BLOCK = 2_000_000
FOUND = "item_id long, edits int, start int, stop int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def grams(text: str, q: int) -> np.ndarray:
    """A 64-bit number for each q-gram; equal grams give equal numbers. Grams of half the length are put together."""
    base, points = 0x100000001B3, codes(text) + np.uint64(1)
    if len(points) < q:
        return np.zeros(0, dtype=np.uint64)

    def of(length: int) -> np.ndarray:
        if length == 1:
            return points
        half = of(length // 2)
        shift = length // 2
        out = half[:-shift] * np.uint64(pow(base, shift, 1 << 64)) + half[shift:]
        return out[:-1] * np.uint64(base) + points[length - 1 :] if length % 2 else out

    return of(q) * np.uint64(0x9E3779B97F4A7C15)


def aligned(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int]:
    """Fewest edits between the whole item and a substring of ``text`` (start, stop), if within the limit.

    Rows of the edit matrix follow the item; a row keeps the cells of ``text`` that the band
    reaches. Insertions within a row are a running minimum. Starts travel with the costs.
    """
    n, cells = len(text), np.arange(len(text) + 1)
    big = 1 << 20
    # cost * big + (n - start): of equal costs the latest start, the tightest substring
    row = n - cells
    for k, c in enumerate(item, 1):
        step = np.empty(n + 1, dtype=np.int64)
        step[0] = k * big + n
        step[1:] = np.minimum(row[1:] + big, row[:-1] + np.where(text == c, 0, big))
        row = np.minimum.accumulate(step - cells * big) + cells * big
        # the least cost of a row never falls again
        if k % 8 == 0 and row.min() // big > limit:
            return limit + 1, 0, 0
    at = int(np.argmin(row // big))
    return int(row[at] // big), n - int(row[at] % big), at


def places(text: str, item: str) -> Iterator[int]:
    """Where an item begins in the text, one place after the other."""
    at = text.find(item)
    while at >= 0:
        yield at
        at = text.find(item, at + len(item))


class Block:
    """The items of one pass, indexed by their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.items = q, [(i, n) for i, t in items if (n := normal(t))]
        self.codes = [codes(n) for _, n in self.items]
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.floor(rate * sizes).astype(np.int64)
        self.bound = sizes - q + 1 - q * self.edits
        self.counted = self.bound > 0
        each = [grams(n, q) if ok else np.zeros(0, dtype=np.uint64) for (_, n), ok in zip(self.items, self.counted)]
        owner = np.repeat(np.arange(len(each)), [len(g) for g in each])
        place = np.concatenate([np.arange(len(g)) for g in each] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        flat = np.concatenate(each or [np.zeros(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        # a bit map in front of the search: most grams of most texts are in no item
        self.bits = max(12, int(np.ceil(np.log2(16 * max(1, len(self.keys))))))
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[self.keys >> np.uint64(64 - self.bits)] = True
        self.short = [k for k in range(len(self.items)) if not self.counted[k] and not self.edits[k]]
        # what is left has a positive bound with q-grams of its own length
        fits = {k: min(BRIEF, q - 1, len(self.codes[k]) // (int(self.edits[k]) + 1)) for k in range(len(self.items)) if not self.counted[k] and self.edits[k]}
        self.brief = [([k for k in fits if fits[k] == n], n) for n in sorted({n for n in fits.values() if n > 0})]
        self.brief = [(own, Block([self.items[k] for k in own], n, rate)) for own, n in self.brief]
        self.width = 2 * self.edits + 1

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, stop) in the normal form: for each item its best place in each region."""
        found = [(k, 0, at, at + len(self.items[k][1])) for k in self.short for at in places(text, self.items[k][1])]
        for owner, block in self.brief:
            found += [(owner[k], *more) for k, *more in block.search(text)]
        own = grams(text, self.q)
        at = np.flatnonzero(self.map[own >> np.uint64(64 - self.bits)])
        if len(at):
            slot = np.searchsorted(self.keys, own[at])
            slot[slot == len(self.keys)] = 0
            ok = self.keys[slot] == own[at]
            at, slot = at[ok], slot[ok]
        if not len(at):
            return found
        many = self.many[slot]
        hit = np.repeat(self.first[slot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = self.owner[hit]
        diagonal = np.repeat(at, many) - self.place[hit]
        # bands of 2e + 1 diagonals, one beginning every e + 1: any e + 1 neighbours lie in one of them
        step = self.edits[item] + 1
        shift = diagonal + (1 << 31)
        upper = shift // step
        key, place = np.concatenate([item << 40 | upper, item << 40 | (upper - 1)]), np.tile(self.place[hit], 2)
        bands, band, counts = np.unique(key, return_inverse=True, return_counts=True)
        full = counts[band] >= self.bound[item[np.arange(len(key)) % len(item)]]
        # a shared q-gram counts once for its place in the item, however often the band repeats it
        cells = np.unique(band[full] * (int(self.place.max()) + 1) + place[full])
        counts = np.bincount(cells // (int(self.place.max()) + 1), minlength=len(bands))
        good = counts >= self.bound[bands >> 40]
        text_codes = codes(text)
        last: dict[int, tuple[int, int]] = {}
        for band in bands[good]:
            k = int(band >> 40)
            e, m = int(self.edits[k]), len(self.codes[k])
            low = int(band & ((1 << 40) - 1)) * (e + 1) - (1 << 31)
            start, stop = max(0, low - e), min(len(text_codes), low + 2 * e + 2 + m + e)
            if k in last and stop <= last[k][1]:
                continue
            cost, a, b = aligned(self.codes[k], text_codes[start:stop], e)
            if cost <= e:
                found.append((k, cost, start + a, start + b))
                last[k] = (start, stop)
        # overlapping bands find one place twice: keep the best of those that overlap
        found.sort(key=lambda x: (x[0], x[1], x[2]))
        kept: list[tuple[int, int, int, int]] = []
        for f in found:
            if not any(g[0] == f[0] and g[2] < f[3] and f[2] < g[3] for g in kept[-8:]):
                kept.append(f)
        return kept


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``size`` characters; each is fetched when its pass is planned."""
    sizes = benchmark.where(F.length(F.trim(text)) > 0).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    total = sizes.agg(F.sum(F.length("t"))).first()[0] or 0
    count = int(total // size) + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(count))
    return [[(r["i"], r["t"]) for r in sizes.where(part == k).collect()] for k in range(count)] if total else []


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """One row per leaked item and place: doc_id, item_id, edits, start, stop (characters of the normal form)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(plain.dtypes)['doc_id']}, {FOUND}"

    def pass_over(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(items, q, rate)
            for batch in batches:
                rows = []
                ids = batch.column("doc_id").to_pylist()
                for i, t in zip(ids, batch.column("text").to_pylist()):
                    rows += [(i, block.items[k][0], e, a, b) for k, e, a, b in (block.search(normal(t)) if t else [])]
                kinds = (batch.column("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "item_id", "edits", "start", "stop"]
                )

        return plain.mapInArrow(run, schema)

    found = [pass_over(items) for items in blocks(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; one pass per block, nothing is shuffled."""
    out = docs
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            block = Block(items, q, rate)
            for batch in batches:
                for part in chunks(batch, text, 1 << 20):
                    yield part.filter(pa.array([not (t and block.search(normal(t))) for t in part.column(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
