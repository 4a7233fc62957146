"""Fuzzy passages that repeat across documents, by collinear chaining of shared seeds.

Seeds are word k-mers thinned to window minima (of every ``WINDOW`` neighbouring k-mers the
one of the smallest hash), so two texts that share WINDOW + K - 1 words in a row share
a seed. Each seed links its occurrences to its first one (smallest doc_id), a star and
never all pairs. Stars alone lose a passage whose seeds were first met, in shorter pieces, in
different documents; so each run of ``MIN_WORDS`` words whose seeds all were met in earlier documents, and
that no star passage covers, links to the first document that holds the whole run: no exact run of that
length is lost. Only runs made of such *open* seeds are shuffled. The seeds' links of a document to one other are merged to anchors along
diagonals and chained in order, with a cost for gaps, by a Fenwick tree over the other
document's positions. A chain is aligned word by word, between its anchors and
beyond its ends, and is a passage if it covers ``MIN_WORDS`` words of which
``IDENTITY`` agree. Passages are of the later document; the first occurrence stays.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Cases: null, empty and short texts have no passages; rows without doc_id neither give nor get any;
rows that share a doc_id count as one document, whose chains are held against each
row's own text; a document that repeats a passage only within itself has none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import chunks, words_of

K, WINDOW = 5, 16
MIN_WORDS, IDENTITY = 40, 0.8
#: words between two anchors of a chain at most, before their gap costs more than a seed gives
REACH = 40
#: words beyond a chain's ends that the alignment may take in
BEYOND = 64
#: drop of the running score that ends an extension
DROP = 12
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))


def run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(ids) - k + 1)
    own = np.zeros(n, dtype=np.uint64)
    for i in range(k if n else 0):
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
    own ^= own >> np.uint64(32)
    return own * np.uint64(0x94D049BB133111EB)


def leftmost_least(own: np.ndarray, window: int) -> np.ndarray:
    """For every window of ``own`` the place of its smallest value, the first one of equals; windows grow by doubling."""
    at, value, size = np.arange(len(own)), own, 1
    while size < window:
        step = min(size, window - size)
        left = value[:-step] <= value[step:]
        at, value, size = np.where(left, at[:-step], at[step:]), np.where(left, value[:-step], value[step:]), size + step
    return at


def minima(ids: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's k-mers, and for every window of them the place of its smallest."""
    if len(ids) - k + 1 < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    own = run_hashes(ids, k)
    return own, leftmost_least(own, window)


def seeds_of(ids: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the window minima of a text's k-mers."""
    own, least = minima(ids, k, window)
    places = np.unique(least)
    return own[places].view(np.int64), places.astype(np.int32)


def seeds_of_all(texts: list[np.ndarray], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of several texts at once: hash, number of the text, place in it. Windows over a border don't count."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    own, least = minima(np.concatenate([np.zeros(0, dtype=np.uint64), *texts]), k, window)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    here = np.arange(len(least))
    places = np.unique(least[ends[text[here]] - here >= k + window - 1]) if len(least) else least
    row = text[places]
    return own[places].view(np.int64), row, (places - (ends - sizes)[row]).astype(np.int32)


def run_starts(least: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where runs of ``MIN_WORDS`` words begin in which every window's seed (at ``least``) is among the ``places``.

    The windows within a run depend on its words only, so a run that two documents hold has
    the same seeds in both and none is left out.
    """
    need = MIN_WORDS - K - WINDOW + 2
    ok = np.concatenate([[0], np.cumsum(np.isin(least, places))])
    return np.flatnonzero(ok[need:] - ok[:-need] == need) if len(ok) > need else np.zeros(0, dtype=np.int64)


def runs_of(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of ``MIN_WORDS`` words whose seeds are all among the ``places``."""
    starts = run_starts(minima(ids)[1], places)
    return run_hashes(ids, MIN_WORDS)[starts].view(np.int64), starts.astype(np.int32)


def open_seeds_of(ids: np.ndarray, places: np.ndarray, spans: Callable[[], list[tuple[int, int]]]) -> np.ndarray:
    """Hashes of the seeds, among the ``places``, of the runs that none of the ``spans`` covers; those are asked for only if there is a run."""
    own, least = minima(ids)
    starts = run_starts(least, places)
    if len(starts) and (covered := spans()):
        begins, ends = np.array(covered).T
        at = np.searchsorted(begins, starts, side="right") - 1
        starts = starts[(at < 0) | (starts + MIN_WORDS > ends[at])]
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    steps = np.zeros(len(least) + 1, dtype=np.int64)
    steps[starts] += 1
    steps[starts + MIN_WORDS - K - WINDOW + 2] -= 1
    return np.unique(own[least[np.cumsum(steps[:-1]) > 0]]).view(np.int64)


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per seed of (doc_id, text): h, doc_id, pos."""
    kind = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                h, row, pos = seeds_of_all([word_ids(words_of(t or "")) for t in part.column("text").to_pylist()], k, window)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column("doc_id").take(pa.array(row)), pa.array(pos)], names=["h", "doc_id", "pos"])

    schema = T.StructType([T.StructField("h", T.LongType()), kind, T.StructField("pos", T.IntegerType())])
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def matches(found: DataFrame) -> DataFrame:
    """Each occurrence of a seed (or run) outside its first document next to the first one: doc_id, pos, first_id, first_pos.

    The first occurrence is an aggregate, partly taken before its shuffle; the join back is an
    equi join of which AQE may split a hot seed.
    """
    first = found.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last_id")).where("last_id != first.doc_id")
    narrow = first.select("h", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"))
    return found.join(narrow, "h").where("doc_id != first_id").select("doc_id", "pos", "first_id", "first_pos")


def open_seeds(plain: DataFrame, links: DataFrame, stars: DataFrame) -> DataFrame:
    """The distinct seeds (h) of runs whose seeds all have ``links`` and that no passage of the ``stars`` covers."""
    places = links.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    rows = plain.join(places, "doc_id").join(stars, "doc_id", "left").select("text", "places", "chains")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):
                out = [np.zeros(0, dtype=np.int64)]
                for t, p, c in zip(*(part.column(i) for i in ("text", "places", "chains"))):
                    ids = word_ids(words_of(t.as_py() or ""))
                    out.append(open_seeds_of(ids, p.values.to_numpy(), lambda: joined_spans(passages_of(ids, c.as_py() or []))))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["h"])

    return rows.mapInArrow(run, "h long").distinct()


def runs(plain: DataFrame, found: DataFrame, open_ones: DataFrame) -> DataFrame:
    """One row per run of ``MIN_WORDS`` words whose seeds are all open: h, doc_id, pos."""
    kind = plain.schema["doc_id"]
    places = found.join(open_ones, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):
                each = [runs_of(word_ids(words_of(t.as_py() or "")), p.values.to_numpy()) for t, p in zip(part.column("text"), part.column("places"))]
                rows = np.repeat(np.arange(len(part)), [len(h) for h, _ in each])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h for h, _ in each])), part.column("doc_id").take(pa.array(rows)), pa.array(np.concatenate([p for _, p in each]))],
                    names=["h", "doc_id", "pos"],
                )

    schema = T.StructType([T.StructField("h", T.LongType()), kind, T.StructField("pos", T.IntegerType())])
    return plain.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(run, schema)


def run_chains(found: DataFrame) -> DataFrame:
    """The links of runs put together along diagonals, each a chain of one anchor."""
    line = Window.partitionBy("doc_id", "first_id", "d").orderBy("pos")
    each = found.withColumn("d", F.col("pos") - F.col("first_pos")).withColumn("island", F.col("pos") - F.dense_rank().over(line))
    whole = each.groupBy("doc_id", "first_id", "d", "island").agg(F.min("pos").alias("a"), (F.max("pos") - F.min("pos") + MIN_WORDS).alias("n"))
    return whole.select("doc_id", "first_id", F.array("a").alias("a"), F.array(F.col("a") - F.col("d")).alias("b"), F.array("n").alias("n"), F.lit(True).alias("exact"))


class Fenwick:
    """Largest (value, item) among the ranks up to a given one."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, item)
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        rank += 1
        out = (-np.inf, -1)
        while rank:
            if self.best[rank][0] > out[0]:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(a: np.ndarray, b: np.ndarray, k: int = K, reach: int = REACH) -> list[list[tuple[int, int, int]]]:
    """Chains of anchors (place in a, place in b, words) out of the matches of two documents.

    An anchor's worth is its seeds' words; a gap costs its words in both texts, so that a gap of
    ``reach`` words in each undoes one seed.
    """
    order = np.lexsort((a, a - b))
    a, b = a[order], b[order]
    new = np.flatnonzero((np.diff(a - b) != 0) | (np.diff(a) > reach)) + 1
    starts, stops = np.concatenate([[0], new]), np.concatenate([new, [len(a)]]) - 1
    worth = np.minimum((stops - starts + 1) * k, a[stops] - a[starts] + k).tolist()
    a0, b0, size = a[starts].tolist(), b[starts].tolist(), (a[stops] - a[starts] + k).tolist()
    cost = k / (2 * reach)
    many = len(a0)
    ends = sorted({b0[i] + size[i] for i in range(many)})
    rank = {e: r for r, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    # an anchor can be followed once it has ended in a: ends come before starts at the same place
    events = sorted([(a0[i], 1, i) for i in range(many)] + [(a0[i] + size[i], 0, i) for i in range(many)])
    score, before = [0.0] * many, [-1] * many
    for _, starting, i in events:
        if starting:
            at = int(np.searchsorted(ends, b0[i], side="right")) - 1
            value, j = tree.upto(at) if at >= 0 else (-np.inf, -1)
            gain = value - cost * (a0[i] + b0[i])
            score[i] = worth[i] + max(0.0, gain)
            before[i] = j if gain > 0 else -1
        else:
            e = b0[i] + size[i]
            tree.put(rank[e], score[i] + cost * (a0[i] + size[i] + e), i)
    used, out = [False] * many, []
    for i in sorted(range(many), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append((a0[i], b0[i], size[i]))
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


CHAIN = "doc_id {0}, first_id {0}, a array<int>, b array<int>, n array<int>"


def chained(found: DataFrame) -> DataFrame:
    """The chains of two seeds or more: doc_id, first_id, and the anchors as arrays.

    ``found`` is dealt by document, so a task holds the links of one document at a time, which its
    length bounds.
    """
    kind = dict(found.dtypes)["doc_id"]
    dealt = found.sortWithinPartitions("doc_id", "first_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def closed(rows: pa.Table) -> pa.RecordBatch:
            doc, first = (rows.column(c).to_numpy() for c in ("doc_id", "first_id"))
            a, b = (rows.column(c).to_numpy().astype(np.int64) for c in ("pos", "first_pos"))
            bounds = np.flatnonzero((doc[1:] != doc[:-1]) | (first[1:] != first[:-1])) + 1
            starts, stops = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(a)]])
            out = []
            for s, e in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
                for chain in chains(a[s:e], b[s:e]):
                    if chain[-1][0] + chain[-1][2] - chain[0][0] > K + 1:
                        x, y, n = (list(c) for c in zip(*chain))
                        out.append((s, x, y, n))
            picked = pa.array([int(s) for s, *_ in out], pa.int64())
            lists = [pa.array([row[i] for row in out], pa.list_(pa.int32())) for i in (1, 2, 3)]
            whole = rows.combine_chunks()
            columns = [pa.concat_arrays(whole.column(c).take(picked).chunks) if len(out) else pa.array([], whole.schema.field(c).type) for c in ("doc_id", "first_id")]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=["doc_id", "first_id", "a", "b", "n"])

        for batch in batches:
            here = pa.Table.from_batches([batch])
            rest = here if rest is None else pa.concat_tables([rest, here])
            doc = rest.column("doc_id").to_numpy()
            if not len(doc):
                continue
            last = int(np.flatnonzero(doc != doc[-1]).max(initial=-1)) + 1
            if last:
                yield closed(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and len(rest):
            yield closed(rest)

    return dealt.mapInArrow(run, CHAIN.format(kind))


def fragments(chain: DataFrame, docs: DataFrame) -> DataFrame:
    """The chains with the word numbers of the first document around them (``words`` packed, from word ``at``)."""
    kind = dict(chain.dtypes)["doc_id"]
    names = ["doc_id", "first_id", "a", "b", "n", "exact"]
    # the texts keep their names, so that their shuffle is the one of the other joins
    own = chain.withColumnRenamed("doc_id", "own_id")
    joined = own.join(docs, F.col("first_id") == F.col("doc_id")).select(F.col("own_id").alias("doc_id"), *names[1:], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] = ("", np.zeros(0, dtype=np.uint32))
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                starts, pieces = [], []
                for t, b, n in zip(*(part.column(c).to_pylist() for c in ("text", "b", "n"))):
                    if held[0] != t:
                        held = (t, word_ids(words_of(t or "")).astype("<u4"))
                    start = max(0, b[0] - BEYOND)
                    starts.append(start)
                    pieces.append(held[1][start : b[-1] + n[-1] + BEYOND].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(starts, pa.int32()), pa.array(pieces, pa.binary())],
                    names=[*names, "at", "words"],
                )

    return joined.mapInArrow(run, CHAIN.format(kind) + ", exact boolean, at int, words binary")


def gap_matches(x: np.ndarray, y: np.ndarray) -> int:
    """Most words that agree in order between two gaps; rows of the usual table, in the band that the gaps' lengths allow."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    if len(x) == len(y) and (same := int((x == y).sum())) * 2 >= len(x):
        return same
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for w in x:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (y == w))
        row = np.maximum.accumulate(step)
    return int(row[-1])


def extension(same: np.ndarray) -> tuple[int, int]:
    """How far to go on along a diagonal, and how many words agree on the way: best running score before it drops too low."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -2))
    low = np.flatnonzero(np.maximum.accumulate(score) - score > DROP)
    score = score[: low[0]] if len(low) else score
    if not len(score) or score.max() <= 0:
        return 0, 0
    far = int(score.argmax()) + 1
    return far, int(same[:far].sum())


def aligned(own: np.ndarray, other: np.ndarray, at: int, a: list[int], b: list[int], n: list[int]) -> tuple[int, int, int, int, int] | None:
    """Align a chain: (start, stop, first's start, first's stop, words that agree), or None if the texts don't fit it."""
    if a[-1] + n[-1] > len(own) or b[-1] + n[-1] - at > len(other):
        return None
    total, stop_a, stop_b = 0, a[0], b[0]
    for x, y, size in zip(a, b, n):
        total += gap_matches(own[stop_a:x], other[stop_b - at : y - at]) + int((own[x : x + size] == other[y - at : y - at + size]).sum())
        stop_a, stop_b = x + size, y + size
    right = min(len(own) - stop_a, len(other) + at - stop_b, BEYOND)
    far, more = extension(own[stop_a : stop_a + right] == other[stop_b - at : stop_b - at + right])
    left = min(a[0], b[0] - at, BEYOND)
    back, less = extension((own[a[0] - left : a[0]] == other[b[0] - left - at : b[0] - at])[::-1])
    return a[0] - back, stop_a + far, b[0] - back, stop_b + far, total + more + less


def joined_spans(found: list[tuple[int, int, int, object, int, int]]) -> list[tuple[int, int]]:
    """Word ranges that cover the passages."""
    out: list[tuple[int, int]] = []
    for start, stop, *_ in sorted(found, key=lambda x: x[:2]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def passages_of(own: np.ndarray, chain: list[dict]) -> list[tuple]:
    """The passages of the text of these words: (start word, stop word, agreeing words, first_id, first's start, first's stop).

    Chains of runs add what the others leave over: those within passages found so far are no news.
    """
    out, spans = [], None
    for c in sorted(chain, key=lambda c: (c["exact"], -sum(c["n"]), c["a"], c["first_id"], c["b"])):
        if c["exact"]:
            spans = joined_spans(out) if spans is None else spans
            if any(x <= c["a"][0] and c["a"][0] + c["n"][0] <= y for x, y in spans):
                continue
        got = aligned(own, np.frombuffer(c["words"], dtype="<u4").astype(np.uint64), c["at"], c["a"], c["b"], c["n"])
        if got and got[1] - got[0] >= MIN_WORDS and got[4] >= IDENTITY * max(got[1] - got[0], got[3] - got[2]):
            out.append((got[0], got[1], got[4], c["first_id"], got[2], got[3]))
            spans = None
    return out


def gathered(chain: DataFrame, plain: DataFrame) -> DataFrame:
    """The chains of each document with their fragments, as one array."""
    return fragments(chain, plain).groupBy("doc_id").agg(F.collect_list(F.struct("first_id", "a", "b", "n", "exact", "at", "words")).alias("chains"))


def chains_of(plain: DataFrame) -> DataFrame:
    """All chains of each doc_id of ``plain`` (doc_id not null, text): doc_id, chains."""
    found = seeds(plain)
    links = matches(found).repartition("doc_id")
    stars = gathered(chained(links).withColumn("exact", F.lit(False)), plain)
    # dealt once, so that the texts are not read for the first holders and again for the links
    open_runs = runs(plain, found, open_seeds(plain, links, stars)).repartition("doc_id")
    whole = gathered(run_chains(matches(open_runs)), plain)
    both = stars.join(whole.withColumnRenamed("chains", "more"), "doc_id", "full")
    return both.select("doc_id", F.flatten(F.array_compact(F.array("chains", "more"))).alias("chains"))


def with_chains(docs: DataFrame, how: str = "left") -> DataFrame:
    """``docs`` with ``chains``: for each row the chains of its doc_id (left: null if none)."""
    plain = docs.where("doc_id is not null").select("doc_id", "text")
    return (plain if how == "inner" else docs).join(chains_of(plain), "doc_id", how)


def passages(docs: DataFrame) -> DataFrame:
    """One row per passage: doc_id, start, stop (words), agreeing words, and where it was first: first_id, first_start, first_stop."""
    rows = with_chains(docs.select("doc_id", "text"), "inner").select("doc_id", "text", "chains")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):
                # chains become Python values one row at a time
                rows = enumerate(zip(part.column("text"), part.column("chains")))
                found = [(i, *p) for i, (t, c) in rows for p in passages_of(word_ids(words_of(t.as_py() or "")), c.as_py())]
                ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                kinds = (pa.int32(), pa.int32(), pa.int32(), ids.type, pa.int32(), pa.int32())
                columns = [pa.array([f[j + 1] for f in found], k) for j, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "start", "stop", "same_words", "first_id", "first_start", "first_stop"])

    return rows.mapInArrow(run, f"doc_id {kind}, start int, stop int, same_words int, first_id {kind}, first_start int, first_stop int")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for start, stop in spans:
        out.append(raw[at : places[start][0]])
        at = places[stop][0] if stop < len(places) else len(raw)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass").rstrip() if spans else text


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of the later documents and ``n_chars`` set anew.

    A document of which no word is left is gone: all of it stands in earlier ones. Documents
    without a repeated passage stay as they are.
    """
    names = docs.columns
    # other columns travel under names that none of the operator's own can have
    coded = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_d{i}") for i, c in enumerate(names)])
    rows = with_chains(coded).select(*coded.columns, "chains")
    at, coded_names = names.index("text"), coded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):
                texts, keep = part.column("text").to_pylist(), []
                changed = [False] * len(texts)
                for i, c in enumerate(part.column("chains")):
                    spans = joined_spans(passages_of(word_ids(words_of(texts[i] or "")), c.as_py())) if c.is_valid else []
                    if spans:
                        texts[i], changed[i] = without(texts[i], spans), True
                    keep.append(not spans or bool(texts[i].strip()))
                columns = [part.column(c) for c in coded_names]
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(t) if m else n for t, m, n in zip(texts, changed, columns[k].to_pylist())], columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
