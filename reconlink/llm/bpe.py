"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

The pieces of a batch (matches of the split pattern) are made unique, sorted into
buckets by length and laid out as rows of a padded matrix of byte ids. In each round
every row merges its leftmost pair of minimum rank; ranks of pairs come from an
open-addressing hash table in numpy. Finished rows leave the matrix (compaction) and
the matrix is narrowed when its longest row allows it. Pieces over ``LONG`` bytes
follow the same rule with a heap, so that one huge piece costs n log n and not n * n.

Cases: a null text is encoded as the empty text (no ids); any Unicode text decodes to
its own UTF-8 bytes; repeated rows are encoded each; a column of the input with the
name of a made column is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import binary_array, ragged, with_arrow_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 512
#: distinct pieces that a task remembers; beyond that it starts anew
REMEMBERED = 150_000
NONE = np.int32(2**31 - 1)
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256, LONG)
WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(LONG + 1)]
#: characters whose letter, number and space classes are the same in ``re`` and in Unicode's properties
SIMPLE = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
#: the public pattern for such texts, in the terms of the faster ``re``
FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


class PairTable:
    """Hashed lookup of the merged id of a pair of ids; multiplicative hash, linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slots, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.values[slots[todo]] == NONE]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self.slot(keys)
        out = np.full(len(keys), NONE, dtype=np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            values, same = self.values[at], self.keys[at] == keys[todo]
            out[todo[same]] = values[same]
            todo = todo[~same & (values != NONE)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return out


class Seen(dict):
    """Piece to number; a piece met for the first time gets the next number and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.waiting.append(piece)
        self[piece] = number = len(self)
        return number


class Encoder:
    """The merges of one rank file, with a bounded memory of pieces it has seen."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.exact = regex.compile(pattern).findall
        self.fast = FAST.findall if pattern == public_tokenizers.PATTERN else None
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(self.ranks.values()) + 1
        self.token_length = np.zeros(size, dtype=np.int64)
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
            self.token_length[rank] = len(token)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        pairs = [
            (a, b, rank)
            for token, rank in self.ranks.items() if len(token) > 1
            for at in range(1, len(token))
            if (a := self.ranks.get(token[:at])) is not None and (b := self.ranks.get(token[at:])) is not None
        ]
        self.pairs = PairTable(*(np.array(x, dtype=np.int64) for x in zip(*pairs)))
        self.forget()

    def forget(self) -> None:
        self.seen = Seen()
        self.ids, self.starts, self.lengths = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def split(self, text: str) -> list[str]:
        return self.fast(text) if self.fast and SIMPLE.fullmatch(text) else self.exact(text)

    def matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has; the pieces are of about one length."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        ids = np.zeros((len(pieces), width), dtype=np.int32)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = np.full((len(pieces), width), NONE, dtype=np.int32)
        paired = inside[:, 1:]
        ranks[:, :-1][paired] = self.pairs.find(ids[:, :-1][paired], ids[:, 1:][paired])
        out, counts, own = np.zeros_like(ids), np.zeros(len(pieces), dtype=np.int64), np.arange(len(pieces))
        while len(own):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            done = best == NONE
            if done.any():
                out[own[done], :width], counts[own[done]] = ids[done], sizes[done]
                go = ~done
                width = max(2, int(sizes[go].max(initial=2)))
                own, sizes, at, best, ids, ranks = own[go], sizes[go], at[go], best[go], ids[go, :width], ranks[go, :width]
                if not len(own):
                    break
            rows, after = np.arange(len(own)), np.arange(width - 1) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            # what moved up by one place: the cell right of the merged one
            ids[rows, at] = best
            sizes = sizes - 1
            ranks[rows, sizes - 1] = NONE
            for left in (at - 1, at):
                ok = np.flatnonzero((left >= 0) & (left + 1 < sizes))
                ranks[ok, left[ok]] = self.pairs.find(ids[ok, left[ok]], ids[ok, left[ok] + 1])
        return out[np.arange(out.shape[1]) < counts[:, None]], counts

    def long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks != NONE)]
        heapq.heapify(heap)
        ids, current = ids.tolist(), ranks.tolist() + [int(NONE)]
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)

        def rank(a: int, b: int) -> int:
            return int(self.pairs.find(np.array([ids[a]]), np.array([ids[b]]))[0])

        while heap:
            best, i = heapq.heappop(heap)
            if not alive[i] or current[i] != best:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = best, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left in (before[i], i):
                if left < 0:
                    continue
                right = after[left]
                current[left] = rank(left, right) if right < len(ids) else int(NONE)
                if current[left] != NONE:
                    heapq.heappush(heap, (current[left], left))
        return np.array([x for x, there in zip(ids, alive) if there], dtype=np.int32)

    def learn(self) -> None:
        """Encode the pieces that wait, bucket by bucket."""
        waiting, self.seen.waiting = self.seen.waiting, []
        first, found = len(self.seen) - len(waiting), [self.ids]
        self.starts, self.lengths = (np.concatenate([x, np.zeros(len(waiting), dtype=np.int64)]) for x in (self.starts, self.lengths))
        end = len(self.ids)

        def keep(numbers: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal end
            numbers = np.array(numbers, dtype=np.int64)
            self.starts[numbers], self.lengths[numbers] = end + np.cumsum(counts) - counts, counts
            found.append(ids)
            end += len(ids)

        whole: tuple[list[int], list[int]] = ([], [])
        buckets: dict[int, tuple[list[int], list[bytes]]] = {w: ([], []) for w in WIDTHS}
        for number, piece in enumerate(waiting, first):
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                whole[0].append(number)
                whole[1].append(rank)
            elif len(raw) > LONG:
                ids = self.long(raw)
                keep([number], ids, np.array([len(ids)]))
            else:
                bucket = buckets[WIDTH_OF[len(raw)]]
                bucket[0].append(number)
                bucket[1].append(raw)
        keep(whole[0], np.array(whole[1], dtype=np.int32), np.ones(len(whole[0]), dtype=np.int64))
        for width, (numbers, raws) in buckets.items():
            rows = max(1, (1 << 20) // width)
            for at in range(0, len(raws), rows):
                keep(numbers[at : at + rows], *self.matrix(raws[at : at + rows]))
        self.ids = np.concatenate(found)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        pieces: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = self.split(text)
            counts[i] = len(found)
            pieces += found
        if len(self.seen) > REMEMBERED:
            self.forget()
        index = np.fromiter(map(self.seen.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if self.seen.waiting:
            self.learn()
        lengths = self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(counts)
        return self.ids[ragged(self.starts[index], lengths)], ends[last] - ends[last - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and the number of bytes of each text."""
        lengths = self.token_length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(counts)
        return self.token_bytes[ragged(self.token_start[ids], lengths)], ends[last] - ends[last - counts]


@functools.lru_cache(maxsize=2)
def encoder(path: str | None, pattern: str) -> Encoder:
    """One per Python worker; a missing path is found by the worker, where the library may lie elsewhere."""
    return Encoder(path or public_tokenizers.path(VOCABULARY), pattern)


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, packed: bool = False) -> DataFrame:
    """``df`` with ``n_tokens`` long and ``ids``: array of int, or packed little-endian unsigned 32-bit binary."""
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", kind)])

    def make():
        own = encoder(path, pattern)

        def work(texts: list[str]) -> list[pa.Array]:
            ids, counts = own.encode(texts)
            if packed:
                return [pa.array(counts), binary_array(ids.astype("<u4"), counts * 4)]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return [pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]

        return work

    return with_arrow_columns(df, text, made, make)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``n_tokens`` only."""
    made = T.StructType([T.StructField("n_tokens", T.LongType())])

    def make():
        own = encoder(path, pattern)
        return lambda texts: [pa.array(own.encode(texts)[1])]

    return with_arrow_columns(df, text, made, make)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with ``out`` binary: the bytes of the ids in ``ids`` (packed, or an array of int; null: none)."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.BinaryType())])
    names = [c for c in df.columns if c != out]

    def run(batches):
        own = encoder(path, pattern)
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                values = batch.column(ids)
                if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
                    parts = [np.frombuffer(x or b"", dtype="<u4") for x in values.to_pylist()]
                else:
                    parts = [np.array(x or [], dtype=np.int64) for x in values.to_pylist()]
                counts = np.array([len(x) for x in parts], dtype=np.int64)
                data, sizes = own.decode(np.concatenate(parts).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [binary_array(data, sizes)], names=[*names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """Per document: number of ids, SHA-256 of the packed ids and of the bytes decoded from them."""
    coded = decode(encode(df.select("doc_id", "text"), packed=True).drop("text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
