"""Language-model scoring by context-tree weighting over byte contexts.

A text is its token sequence: words after lower-casing A-Z, each spelled by its bytes and a space, and one
end (a line feed). A byte is eight binary decisions, one for each prefix of its bits; every
decision has a tree of byte contexts, up to ``DEPTH`` bytes back and not beyond the space before
the word; there one more byte follows, the state, which tells what kind of common word came last.
Each context has a Krichevsky-Trofimov estimate from its training counts; context-tree
weighting mixes the estimates of all depths, each context weighing its own estimate against what
its longer contexts say. A context that training has not seen says what the longest seen
one does. Code lengths come out as log10 probabilities.

States are groups of the ``COMMON`` most common words that stand next to one another (in effect, the
languages and registers of the corpus), found by k-means over their neighbour counts.

As contexts leave the word only for the state, a word's probability after a state is one number, and the
work runs on the corpus's distinct words after states (a word is keyed by its state's byte and its own):

1. words are counted, partly before the shuffle;
2. words give counts of (context, byte), summed over all words;
3. contexts that share their last three bytes lie together and weigh their subtrees; the
   contexts of up to two bytes above them, of which bytes allow 65,793 at most, are weighed on the driver;
   then the predictions go down the tree;
4. buckets of words fetch the (context, byte) predictions they need and sum them up;
5. documents add up their words: the ``FREQUENT`` most common words (of up to ``SHORT`` bytes) are
   sent to all tasks, every other word is joined.

Cases: null and empty texts are the end alone; a null doc_id is not held out; repeated rows are scored
each; without training text each bit has probability one half.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, words_of

DEPTH, NEAR = 6, 3
FREQUENT, SHORT = 150_000, 64
#: words that make states, and states (0: none of those words yet)
COMMON, STATES = 256, 16
#: a word may be a common one if it is so much of all tokens
SHARE = 1 / 5000
#: distinct words, and bytes of texts, that a task counts before it hands them on
HELD, HELD_BYTES = 200_000, 1 << 25
#: words, their bytes, and (context, byte) pairs that are worked on together; a byte takes about 200 bytes of arrays, a pair 3,500
WORDS, WORD_BYTES, PAIRS = 50_000, 1 << 19, 50_000
END = b"\n"
SPACE = 0x20
SPACED = b" "


def common_words(docs: DataFrame) -> list[bytes]:
    """The most common words of the training texts, of those that are ``SHARE`` of all tokens; by exact counts, so the layout of the table has no part in it.

    A task hands on words that are half of ``SHARE`` of its tokens. The rest of a word of ``SHARE`` is less than half of
    it, so the sum of what is handed on names every such word, and at most 2 / SHARE words in all, which are then counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, used = Counter(), 0, 0

        def out() -> pa.RecordBatch:
            # a space is no word: it carries the number of tokens
            some = [(SPACED, seen), *((w, n) for w, n in counts.items() if 2 * n >= SHARE * seen and len(w) <= SHORT)]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text or "")
                counts.update(words)
                seen += len(words)
                used += len(text or "")
                if len(counts) > HELD or used > HELD_BYTES:
                    yield out()
                    counts, seen, used = Counter(), 0, 0
        yield out()

    texts = docs.where("trains").select("text")
    part = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).cache()
    total = part.where(F.col("word") == F.lit(SPACED)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    likely = {bytes(r["word"]) for r in part.where((F.col("n") >= SHARE / 2 * total) & (F.col("word") != F.lit(SPACED))).select("word").collect()}
    part.unpersist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = Counter(words_of(text or ""))
                for w in own.keys() & likely:
                    counts[w] += own[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    exact = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARE * total)
    return [bytes(r["word"]) for r in exact.orderBy(F.desc("n"), "word").limit(COMMON).collect()]


def word_states(docs: DataFrame) -> dict[bytes, int]:
    """State of each common word. At most COMMON * COMMON neighbour counts come to the driver."""
    words = common_words(docs)
    number = {w: k for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                met = [k for w in words_of(text or "") if (k := number.get(w)) is not None]
                counts.update(zip(met, met[1:]))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["a", "b", "n"])

    if not words:
        return {}
    near = np.zeros((len(words), len(words)))
    for a, b, n in docs.where("trains").select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n")).collect():
        near[a, b] += n
        near[b, a] += n
    return dict(zip(words, (grouped(near, STATES - 1) + 1).tolist()))


def grouped(near: np.ndarray, many: int) -> np.ndarray:
    """k-means over the square roots of neighbour shares; centres begin far apart, so there is no chance in it."""
    mass = near.sum(axis=1)
    points = np.sqrt(near / np.maximum(mass, 1)[:, None])
    centres = points[:1]
    for _ in range(min(many, len(points)) - 1):
        far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.sqrt(mass)
        centres = np.vstack([centres, points[far.argmax()]])
    for _ in range(30):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([np.average(points[own == k], axis=0, weights=mass[own == k] + 1e-9) if (own == k).any() else c for k, c in enumerate(centres)])
    return own


def after_states(words: list[bytes], states: dict[bytes, bytes]) -> list[bytes]:
    """Each token of a text with the byte of the state before it; the end comes last."""
    out, state = [], b"\0"
    get = states.get
    for w in words:
        out.append(state + w)
        state = get(w, state)
    out.append(state + END)
    return out


def word_counts(docs: DataFrame, states: dict[bytes, int]) -> DataFrame:
    """One row per distinct token after a state of (trains, text): word, n in training texts (0 if in others only)."""
    signs = {w: bytes([s]) for w, s in states.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        used = 0

        def out() -> pa.RecordBatch:
            trained, other = counts[1], [w for w in counts[0] if w not in counts[1]]
            columns = [pa.array([*trained, *other], pa.binary()), pa.array([*trained.values(), *[0] * len(other)], pa.int64())]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for trains, text in zip(batch.column("trains").to_pylist(), batch.column("text").to_pylist()):
                counts[bool(trains)].update(after_states(words_of(text or ""), signs))
                used += len(text or "")
                if len(counts[0]) + len(counts[1]) > HELD or used > HELD_BYTES:
                    yield out()
                    used = 0
        yield out()

    return docs.select("trains", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelled(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte that spells a word: context << 8 | byte, and the number of the word."""
    raw = b"".join(b" " + w[1:] + (b"" if w[1:] == END else b" ") for w in words)
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(w) + (0 if w[1:] == END else 1) for w in words], dtype=np.int64)
    states = np.array([w[0] + 1 for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - starts[owner]
    key = np.zeros(len(data), dtype=np.int64)
    for back in range(depth):
        at = np.arange(len(data)) - 1 - back
        key |= np.where(place > back, data[np.maximum(at, 0)] << (8 * back), 0)
    key |= np.where(place <= depth, states[owner] << (8 * np.minimum(place, depth)), 0)
    told = place > 0
    return (key << 8 | data)[told], owner[told]


def pair_counts(words: DataFrame, depth: int) -> DataFrame:
    """One row per (context, byte) that spells some word: pair, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights = [], []

        def out() -> pa.RecordBatch:
            pairs, owner = spelled(held, depth)
            unique, inverse = np.unique(pairs, return_inverse=True)
            n = np.bincount(inverse, weights=np.array(weights, dtype=float)[owner], minlength=len(unique))
            held.clear()
            weights.clear()
            return pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n.astype(np.int64))], names=["pair", "n"])

        size = 0
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                held.append(word)
                weights.append(n)
                size += len(word)
                if size >= 2 * WORD_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    return words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up; x > 0."""
    product = np.ones_like(x)
    for k in range(7):
        product *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def depth_of(context: np.ndarray, depth: int) -> np.ndarray:
    """Bytes of each context: up to the state before the space that begins a word, else the full depth."""
    out = np.full(len(context), depth)
    for back in range(depth - 1, -1, -1):
        out[(context >> (8 * back)) & 0xFF == SPACE] = back + 2
    return out


def decisions(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | prefix of bits) and the bit, for the eight decisions of each pair, row by row."""
    byte, steps = pairs & 0xFF, np.arange(8)
    prefix = (1 << steps) | (byte[:, None] >> (8 - steps))
    return (pairs >> 8 << 8)[:, None] | prefix, (byte[:, None] >> (7 - steps)) & 1


class Level:
    """The nodes of one depth, by code: counts, estimates and weights."""

    def __init__(self, codes: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, leaf: np.ndarray):
        self.codes, self.n0, self.n1 = codes, n0, n1
        own = log_kt(n0, n1)
        self.log_pw = np.where(leaf, own, np.logaddexp(own, below) - np.log(2))
        self.stop = np.where(leaf, 1.0, np.exp(np.minimum(0.0, own - np.log(2) - self.log_pw)))
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    @classmethod
    def of(cls, leaves, children, depth: int) -> Level:
        """From the counts of contexts that end at this depth and the level below."""
        codes, n0, n1 = leaves
        if children is not None:
            up = shortened(children.codes, depth)
            codes, n0, n1 = np.concatenate([codes, up]), np.concatenate([n0, children.n0]), np.concatenate([n1, children.n1])
        unique, inverse = np.unique(codes, return_inverse=True)
        total = lambda w: np.bincount(inverse, weights=w, minlength=len(unique))
        own = len(leaves[0])
        below = np.concatenate([np.zeros(own), children.log_pw]) if children is not None else np.zeros(own)
        inner = np.concatenate([np.zeros(own), np.ones(len(codes) - own)])
        return cls(unique, total(n0), total(n1), total(below), total(inner) == 0)

    def down(self, before: np.ndarray, left: np.ndarray) -> None:
        """What the path above gives (``before``) and the weight it leaves become predictions and what goes on."""
        self.q = before + left * self.one
        self.before, self.left = before + left * self.stop * self.one, left * (1 - self.stop)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes


def shortened(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes with the contexts cut to their last ``depth`` bytes; seven bytes are all that a code holds."""
    return codes if depth >= 7 else codes & ((1 << (8 * depth + 8)) - 1)


def subtree(pairs: np.ndarray, n: np.ndarray, depth: int) -> tuple[dict[int, Level], dict[int, tuple]]:
    """The weighed levels from ``depth`` up to ``NEAR``, and the counts of the contexts shorter than that."""
    seen = n > 0
    codes, bits = decisions(pairs[seen])
    counts = np.repeat(n[seen].astype(float), 8)
    of = np.repeat(depth_of(pairs[seen] >> 8, depth), 8)
    codes, ones = codes.ravel(), counts * bits.ravel()
    zeros = counts - ones
    leaves = {d: (codes[of == d], zeros[of == d], ones[of == d]) for d in range(1, depth + 2)}
    levels: dict[int, Level] = {}
    for d in range(depth + 1, NEAR - 1, -1):
        levels[d] = Level.of(leaves[d], levels.get(d + 1), d)
    return levels, {d: leaves[d] for d in range(1, NEAR)}


def streamed(rows: DataFrame, schema: str, work, by: str = "bucket"):
    """``work(pairs, n)`` for each bucket of (bucket, pair, n), a bucket at a time."""
    dealt = rows.repartition(by).sortWithinPartitions(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, dtype=np.int64),) * 3
        for batch in batches:
            rest = tuple(np.concatenate([old, np.asarray(batch.column(c)).astype(np.int64)]) for old, c in zip(rest, (by, "pair", "n")))
            while len(rest[0]) and rest[0][0] != rest[0][-1]:
                stop = int(np.searchsorted(rest[0], rest[0][0], side="right"))
                yield from work(rest[1][:stop], rest[2][:stop])
                rest = tuple(x[stop:] for x in rest)
        if len(rest[0]):
            yield from work(rest[1], rest[2])

    return dealt.select(by, "pair", "n").mapInArrow(run, schema)


def summits(pairs: DataFrame, depth: int) -> list[tuple[int, int, float, float, float, int]]:
    """Counts and weighed subtrees of the contexts of two bytes, and the counts of shorter words' contexts."""

    def work(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        levels, short = subtree(codes, n, depth)
        rows = [(np.full(len(x[0]), d), x[0], x[1], x[2], np.zeros(len(x[0])), np.zeros(len(x[0]), dtype=np.int64)) for d, x in short.items()]
        top = levels[NEAR]
        rows.append((np.full(len(top.codes), NEAR - 1), shortened(top.codes, NEAR - 1), top.n0, top.n1, top.log_pw, np.ones(len(top.codes), dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["depth", "code", "n0", "n1", "below", "inner"])

    made = streamed(pairs, "depth long, code long, n0 double, n1 double, below double, inner long", work)
    return made.groupBy("depth", "code").agg(F.sum("n0"), F.sum("n1"), F.sum("below"), F.max("inner")).collect()


def top_levels(rows: list) -> dict[int, Level]:
    """The levels of at most two bytes, with their predictions."""
    levels: dict[int, Level] = {}
    for d in range(NEAR - 1, -1, -1):
        own = [r for r in rows if r[0] == d]
        columns = [np.array([r[i] for r in own], dtype=kind) for i, kind in ((1, np.int64), (2, float), (3, float), (4, float), (5, np.int64))]
        if d == NEAR - 1:
            order = np.argsort(columns[0])
            codes, n0, n1, below, inner = (c[order] for c in columns)
            levels[d] = Level(codes, n0, n1, below, inner == 0)
        else:
            levels[d] = Level.of(tuple(columns[:3]), levels[d + 1], d)
    descend(levels, 0, NEAR - 1)
    return levels


def descend(levels: dict[int, Level], start: int, stop: int) -> None:
    for d in range(start, stop + 1):
        level = levels[d]
        if d == 0:
            level.down(np.zeros(len(level.codes)), np.ones(len(level.codes)))
            continue
        at, _ = levels[d - 1].find(shortened(level.codes, d - 1))
        level.down(levels[d - 1].before[at], levels[d - 1].left[at])


def predicted(pairs: np.ndarray, levels: dict[int, Level], depth: int) -> np.ndarray:
    """Log10 probability of the byte of each pair after its context."""
    codes, bits = decisions(pairs)
    of = np.repeat(depth_of(pairs >> 8, depth), 8)
    codes, one = codes.ravel(), np.full(codes.size, 0.5)
    for d, level in sorted(levels.items()):
        at, there = level.find(shortened(codes, d))
        there &= of >= d
        one[there] = level.q[at[there]]
    chance = np.where(bits.ravel() == 1, one, 1 - one)
    return np.log10(chance).reshape(-1, 8).sum(axis=1)


def pair_scores(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Weigh the trees and predict: pair, logp."""
    many = max(1, -(-pairs.count() // PAIRS))
    last = F.shiftright("pair", 8).bitwiseAND(F.lit((1 << (8 * NEAR)) - 1))
    dealt = pairs.select(F.pmod(F.xxhash64(last), F.lit(many)).alias("bucket"), "pair", "n")
    top = top_levels(summits(dealt, depth))

    def work(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        levels = {**top, **subtree(codes, n, depth)[0]}
        descend(levels, NEAR, depth + 1)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(predicted(codes, levels, depth))], names=["pair", "logp"])

    return streamed(dealt, "pair long, logp double", work)


def word_scores(words: DataFrame, pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """word (with its state), n, n_word (of all states), first (one row of each word), logp: buckets of words meet the predictions that spell them."""
    kinds, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    many = max(1, -(-kinds // WORDS), -(-size // WORD_BYTES))
    # words that begin alike share most of their contexts, so they lie in one bucket; long ones by their first half
    bucket = F.pmod(F.xxhash64(F.expr("substring(word, 2, greatest(5, length(word) div 2))")), F.lit(many)).cast("int")
    dealt = words.select("word", "n", bucket.alias("bucket")).repartition("bucket")

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def out() -> pa.RecordBatch:
            keys = np.unique(spelled(held, depth)[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), own, dtype=np.int32)), pa.array(keys)], names=["bucket", "pair"])

        for batch in batches:
            for word, where in zip(batch.column("word").to_pylist(), batch.column("bucket").to_pylist()):
                if where != own and held:
                    yield out()
                    held = []
                own = where
                held.append(word)
        if held:
            yield out()

    wanted = dealt.sortWithinPartitions("bucket").select("word", "bucket").mapInArrow(needs, "bucket int, pair long")
    fetched = wanted.join(pairs, "pair").select("bucket", "pair", "logp")

    def work(own: pa.Table, found: pa.Table) -> pa.Table:
        keyed, n = own.column("word").to_pylist(), own.column("n").to_pylist()
        totals: dict[bytes, int] = {}
        for w, k in zip(keyed, n):
            totals[w[1:]] = totals.get(w[1:], 0) + k
        firsts = {w[1:]: i for i, w in reversed(list(enumerate(keyed)))}
        keys, owner = spelled(keyed, depth)
        pair, logp = (found.column(c).to_numpy() for c in ("pair", "logp"))
        order = np.argsort(pair)
        total = np.bincount(owner, weights=logp[order][np.searchsorted(pair[order], keys)], minlength=len(own))
        return pa.table({
            "word": own.column("word"), "n": own.column("n"), "n_word": pa.array([totals[w[1:]] for w in keyed], pa.int64()),
            "first": pa.array([firsts[w[1:]] == i for i, w in enumerate(keyed)], pa.bool_()), "logp": pa.array(total),
        })

    return dealt.groupBy("bucket").cogroup(fetched.groupBy("bucket")).applyInArrow(work, "word binary, n long, n_word long, first boolean, logp double")


def most_frequent(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words above a count that at most ``most`` words reach; counts are looked at in steps of an eighth of a doubling."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, taken = None, 0
    for r in sorted(sizes, reverse=True):
        taken += r["words"]
        if taken > most:
            break
        least = r["step"]
    return words.where(step >= least) if least is not None else words.limit(0)


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Score (doc_id, text, trains): doc_id, trains, n_tokens, n_known, train_tokens, base_score, score."""
    states = word_states(docs)
    words = cut(word_counts(docs, states))
    pairs = cut(pair_counts(words, depth))
    scored = cut(word_scores(words, pair_scores(pairs, depth), depth))
    total, kinds = scored.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("first") & (F.col("n_word") > 0), 1))).first()
    base = lambda n: np.log10((n + 0.5) / (total + 0.5 * (kinds + 1)))
    top = most_frequent(scored.where((F.length("word") <= SHORT) & (F.col("n") > 0))).collect()
    common = {bytes(r["word"]): (float(base(r["n_word"])), r["logp"]) for r in top}
    signs = {w: bytes([s]) for w, s in states.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, (text, mark) in enumerate(zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist())):
                counts = Counter(after_states(words_of(text or ""), signs))
                n_tokens = known = 0
                fixed = model = 0.0
                for word, n in counts.items():
                    n_tokens += n
                    if word in common:
                        b, p = common[word]
                        known, fixed, model = known + n, fixed + n * b, model + n * p
                    else:
                        rows.append((k, word, n, 0, 0, 0, 0.0, 0.0))
                # a key that is no word and that no other text shares
                rows.append((k, b"\xff%d" % mark, 0, 1, n_tokens, known, fixed, model))
                if len(rows) > 200_000:
                    yield packed(batch, rows)
                    rows = []
            if rows:
                yield packed(batch, rows)

    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        head = [batch.column(c).take(pa.array(at)) for c in ("doc_id", "trains", "mark")]
        return pa.RecordBatch.from_arrays([*head, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=PARTS)

    PARTS = ["doc_id", "trains", "mark", "word", "times", "rows", "n_tokens", "n_known", "base", "model"]
    kind = dict(docs.dtypes)["doc_id"]
    parts = docs.select("doc_id", "trains", F.xxhash64("text").alias("mark"), "text").mapInArrow(
        run, f"doc_id {kind}, trains boolean, mark long, word binary, times long, rows long, n_tokens long, n_known long, base double, model double"
    )
    looked = parts.join(scored, "word", "left")
    times, here = F.col("times"), F.col("n_word").isNotNull()
    floor = F.log10((F.col("n_word") + 0.5) / (total + 0.5 * (kinds + 1)))
    sums = looked.groupBy("doc_id", "trains", "mark").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(here & (F.col("n_word") > 0), times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(here, times * floor).otherwise(0.0)).alias("base"), F.sum(F.col("model") + F.when(here, times * F.col("logp")).otherwise(0.0)).alias("model"),
    )
    # equal rows were added up together
    each = sums.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    share = lambda c: (F.col(c) / F.col("rows"))
    return each.select(
        "doc_id", "trains", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        share("base").alias("base_score"), share("model").alias("score"),
    )


def scores(docs: DataFrame, folds: int = 5, depth: int = DEPTH) -> DataFrame:
    """Learn from the documents whose crc32 of the doc_id as text does not leave 1, and score all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 1, F.lit(False))
    found = score_texts(docs.select("doc_id", "text", (~held).alias("trains")), depth)
    return found.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
