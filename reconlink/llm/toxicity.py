"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon and of lexicons learned from labels (words and
word beginnings), second-person words near lexicon hits, capitals, punctuation
and obfuscation. The learned lexicons are class counts of the words of labelled texts,
summed by Spark; a training row's own count is left out of its own features, so that
the trees do not learn to trust words that only mark their own text. Trees and
calibration are Spark ML's; calibration rows take no part in growing trees.

The classifier is fitted on at most ``sample`` labelled rows, chosen by hash, and keeps
at most ``LEXICON`` words; scores are for every row and from its whole text only.

Cases: null and empty texts get the score of their (zero) features; without labelled
rows of both classes the score is the smoothed share of toxic rows; labels that are
null or have a null doc_id are not used; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, with_arrow_columns

SAMPLE, LEXICON, THRESHOLD = 40_000, 20_000, 0.7
#: distinct words that a task counts before it hands them on
HELD = 150_000
#: words between a lexicon hit and a second-person word that count as near
NEAR = 5

# Common insults in four languages.
INSULTS = frozenset(
    """idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin fool foolish clown clowns loser losers
    pathetic worthless scum scumbag trash garbage filth filthy vermin disgusting disgrace ugly coward pig pigs rat rats creep
    freak jerk bastard damn crap shit bullshit fuck fucking asshole bitch hate kill die shut shutup retard retarded
    débile imbécile crétin connard connasse salaud ordure merde nul minable abruti bouffon dégoûtant
    dumm dummkopf trottel vollidiot arschloch scheiße abschaum versager widerlich ekelhaft wertlos erbärmlich
    estúpido estúpida imbécil tonto tonta basura escoria asqueroso patético inútil mierda cabrón payaso perdedor""".split()
)
# Second-person words in four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
# Digits and signs that stand for letters.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": ""})

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+")
SPACED = re.compile(r"\b(?:[^\W\d_][ .\-*]){3,}[^\W\d_]\b")
LONE = re.compile(r"\b[^\W\d_]\b")
#: what stands beside a letter of ``SPACED`` in its token
APART = frozenset(("", ".", "-", "*"))
DRAWN = re.compile(r"([^\W\d_])\1\1")
OTHER = re.compile(r"[^\w\s]")
#: kinds of terms by their first sign; words begin with neither
KINDS = {"4": 1, "5": 2}
#: different tokens that a task remembers
REMEMBERED = 100_000


class Token:
    """What a white-space-separated token of a text tells by itself."""

    __slots__ = ("words", "hidden", "capitals", "shouted", "marks", "signs", "drawn", "fixed", "person", "single", "inner")

    def __init__(self, raw: str):
        low = raw.lower()
        if low.isalpha():
            self.words, self.hidden, self.signs = [low], (), 0
        else:
            self.words, self.hidden, self.signs = WORD.findall(low), [m.translate(FOLD) for m in MASKED.findall(low) if not SPACED.fullmatch(m)], len(OTHER.findall(raw))
        self.capitals = 0 if raw == low else sum(map(str.isupper, raw))
        self.shouted = int(self.capitals > 1 and raw.isupper())
        self.marks = raw.count("!") + raw.count("?") if self.signs else 0
        self.drawn = int(DRAWN.search(low) is not None)
        self.fixed = sum(w in INSULTS for w in (*self.words, *self.hidden))
        self.person = any(w in SECOND_PERSON for w in self.words)
        # letters that may be part of a word spelled letter by letter, and those that may be within it
        lone = [] if low.isalpha() and len(low) > 1 else [(low[i - 1 : i] in APART, low[i + 1 : i + 2] in APART) for m in LONE.finditer(low) for i in (m.start(),)]
        self.single, self.inner = sum(a or b for a, b in lone), sum(a and b for a, b in lone)

    def special(self) -> bool:
        return bool(self.hidden or self.shouted or self.marks or self.drawn or self.fixed or self.person or self.single)

    def terms(self) -> list[str]:
        return [t for w in (*self.words, *self.hidden) for t in terms_of(w)]


class Remembered(dict):
    """What ``make`` says of a token, remembered up to a bound."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, raw: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = made = self.make(raw)
        return made


def terms_of(word: str) -> list[str]:
    """What the learned lexicons count: the word, and beginnings of longer ones marked by their length."""
    out = [word] if len(word) < 40 else []
    if len(word) > 4:
        out.append(f"4{word[:4]}")
    if len(word) > 5:
        out.append(f"5{word[:5]}")
    return out


def spaced(text: str) -> list[str]:
    """Words that are spelled letter by letter."""
    return [re.sub(r"[ .\-*]", "", m) for m in SPACED.findall(text.lower())]


def may_be_spaced(letters: Iterable[tuple[int, int, int]]) -> bool:
    """Whether tokens (single, inner, how often) hold letters enough for ``SPACED``: four, of which two within."""
    single = inner = 0
    for a, b, k in letters:
        single += a * k
        inner += b * k
    return single > 3 and inner > 1


def counted(raw: str) -> tuple[int, int, list[str]]:
    token = Token(raw)
    return token.single, token.inner, token.terms()


def terms(text: str, tokens: Remembered) -> set[str]:
    """The terms of a text; ``tokens`` remembers what was ``counted``."""
    own = [(tokens[t], k) for t, k in Counter(text.split()).items()]
    out = {x for (*_, found), _ in own for x in found}
    if may_be_spaced((single, inner, k) for (single, inner, _), k in own):
        out.update(x for w in spaced(text) for x in terms_of(w))
    return out


def class_counts(train: DataFrame) -> DataFrame:
    """One row per term: in how many toxic and other texts of ``train`` (text, toxic) it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tokens = (Counter(), Counter()), Remembered(counted)

        def out() -> pa.RecordBatch:
            every = [*counts[1].keys() | counts[0].keys()]
            columns = [pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts[::-1])]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "other"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(terms(text or "", tokens))
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield out()
        yield out()

    made = train.select("text", "toxic").mapInArrow(run, "term string, toxic long, other long")
    return made.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def weight(toxic, other, n_toxic: int, n_other: int):
    """Log ratio of the class rates, less one standard error."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return ratio - np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def learned_lexicon(train: DataFrame, n_toxic: int, n_other: int, size: int = LEXICON) -> dict[str, tuple[int, int]]:
    """The ``size`` terms that speak most for the toxic class, with their counts."""
    up, down = F.col("toxic") + 0.5, F.col("other") + 0.5
    lean = F.log(up / (n_toxic + 1)) - F.log(down / (n_other + 1)) - F.sqrt(1 / up + 1 / down)
    best = class_counts(train).where("toxic >= 2").withColumn("lean", lean).where("lean > 0.5").orderBy(F.desc("lean"), "term").limit(size)
    return {r["term"]: (r["toxic"], r["other"]) for r in best.collect()}


def featurizer(lexicon: dict[str, tuple[int, int]], n_toxic: int, n_other: int) -> Callable[[str, int | None], list[float]]:
    """The dense features of a text; with a label, its own part in the lexicon's counts is left out."""
    table = np.array(list(lexicon.values()), dtype=float).reshape(-1, 2)
    plain = dict(zip(lexicon, weight(table[:, 0], table[:, 1], n_toxic, n_other).tolist()))
    without = {
        label: dict(zip(lexicon, weight(np.maximum(table[:, 0] - label, 0), np.maximum(table[:, 1] - 1 + label, 0), n_toxic - label, n_other - 1 + label).tolist()))
        for label in (0, 1)
    } if lexicon else {0: {}, 1: {}}
    # a term with its weight and the place of its kind: word, four or five first letters
    kept = {x: (x, w, KINDS.get(x[0], 0)) for x, w in plain.items()}

    def seen(raw: str) -> tuple:
        # most tokens are a plain word, perhaps with one mark after it, and need no closer look
        body, signs = (raw, 0) if raw.isalpha() else (raw[:-1], 1)
        low = body.lower()
        if not (body.isalpha() and (not signs or raw[-1] in ".,;:")) or len(low) == 1 or low in INSULTS or low in SECOND_PERSON or DRAWN.search(low):
            token = Token(raw)
            return len(token.words), token.capitals, token.signs, token if token.special() else None, [kept[x] for x in token.terms() if x in kept]
        capitals = 0 if low == body else 1 if body[1:] == low[1:] else sum(map(str.isupper, body))
        if capitals > 1 and body.isupper():
            token = Token(raw)
            return 1, token.capitals, token.signs, token, [kept[x] for x in token.terms() if x in kept]
        known = [kept[low]] if low in kept else []
        if len(low) > 4:
            known += [kept[x] for x in ("4" + low[:4], "5" + low[:5] if len(low) > 5 else "") if x in kept]
        return 1, capitals, signs, None, known

    tokens = Remembered(seen)

    def features(text: str, label: int | None = None) -> list[float]:
        lean = None if label is None else without[label]
        order = text.split()
        counts = Counter(order)
        words = capitals = signs = 0
        special, found, hits = [], ([], [], []), set()
        for raw, k in counts.items():
            size, upper, other, token, known = tokens[raw]
            words += size * k
            capitals += upper * k
            signs += other * k
            if token:
                special.append((token, k))
                if token.fixed:
                    hits.add(raw)
            for x, w, kind in known:
                if lean is not None:
                    w = lean[x]
                found[kind].append((w, k))
                if w > 1:
                    hits.add(raw)
        hidden = [w for t, k in special if t.hidden for w in t.hidden * k]
        if may_be_spaced((t.single, t.inner, k) for t, k in special):
            apart = spaced(text)
            hidden += apart
            for x, w, kind in (kept[x] for word in apart for x in terms_of(word) if x in kept):
                found[kind].append((w if lean is None else lean[x], 1))
        n, chars = max(1, words + len(hidden)), max(1, len(text))
        fixed = sum(t.fixed * k for t, k in special)
        out = [float(np.log1p(words)), fixed / n, min(fixed, 5.0)]
        for scores in found:
            scores.sort(reverse=True)
            top = [x for x, k in scores[:3] for _ in range(min(k, 3))][:3]
            out += [top[0] if top else 0.0, sum(top) / 3, float(min(sum(k for x, k in scores if x > 1), 20)), sum(x * k for x, k in scores if x > 0) / n]
        close = met = 0
        if hits:
            persons = {raw for raw in counts if (t := tokens[raw][3]) and t.person}
            places = [i for i, t in enumerate(order) if t in hits]
            met, close = len(places), sum(any(t in persons for t in order[max(0, i - NEAR) : i + NEAR + 1]) for i in places)
        out += [close / n, close / max(1, met), sum(t.person * k for t, k in special) / n]
        out += [capitals / chars, sum(t.shouted * k for t, k in special) / n, sum(t.marks * k for t, k in special) / chars, signs / chars]
        out += [len(hidden) / n, float(sum(w in INSULTS for w in hidden)), sum(t.drawn * k for t, k in special) / n]
        return out

    return features


VECTOR = T.ArrayType(T.DoubleType(), False)


def with_features(df: DataFrame, lexicon: dict, n_toxic: int, n_other: int, text: str = "text", out: str = "features") -> DataFrame:
    def make():
        features = featurizer(lexicon, n_toxic, n_other)
        return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    return with_arrow_columns(df, text, T.StructType([T.StructField(out, VECTOR)]), make)


class Classifier:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7):
        chosen = (
            labels.where("doc_id is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
        )
        # at most ``sample`` rows of two numbers; the labelled texts are read once
        train = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
        counts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.n_toxic, self.n_other = counts.get(1, 0), counts.get(0, 0)
        self.lexicon: dict[str, tuple[int, int]] = {}
        self.trees = self.steps = None
        if not self.n_toxic or not self.n_other:
            return
        self.lexicon = learned_lexicon(train, self.n_toxic, self.n_other)
        lexicon, n_toxic, n_other = self.lexicon, self.n_toxic, self.n_other

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = featurizer(lexicon, n_toxic, n_other)
            for batch in batches:
                ids, texts, marks = (batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))
                rows = pa.array([features(t or "", m) for t, m in zip(texts, marks)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), rows], names=["doc_id", "toxic", "features"])

        schema = T.StructType([train.schema["doc_id"], train.schema["toxic"], T.StructField("features", VECTOR)])
        rows = cut(train.select("doc_id", "text", "toxic").mapInArrow(run, schema)).select(
            F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("vector"), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0).alias("calibrates"),
        )
        parts = {(r["calibrates"], r["label"]) for r in rows.select("calibrates", "label").distinct().collect()}
        apart = len(parts) == 4 and self.n_toxic >= 100
        grow, fit = (rows.where("not calibrates"), rows.where("calibrates")) if apart else (rows, rows)
        self.trees = GBTClassifier(featuresCol="vector", labelCol="label", predictionCol="side", maxIter=20, maxDepth=3, stepSize=0.2, maxBins=64, seed=seed).fit(grow)
        self.steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(self.raw(fit))

    def raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``score``: the calibrated probability of the toxic class."""
        if self.trees is None:
            return df.withColumn("score", F.lit((self.n_toxic + 0.5) / (self.n_toxic + self.n_other + 1)))
        # the columns travel under names that no made column can have
        kept = [c for c in df.columns if c != "score"]
        coded = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
        made = with_features(coded, self.lexicon, self.n_toxic, self.n_other, f"_c{kept.index(text)}").withColumn("vector", array_to_vector("features"))
        steps = self.steps.transform(self.raw(made))
        return steps.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")).alias("score"))


def held_out(doc_id: str = "doc_id", folds: int = 3) -> F.Column:
    """Whether crc32 of the doc_id as text leaves 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns from the labels that are not held out."""
    return Classifier(docs, labels.where(~held_out()))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"_d{i}") for i, c in enumerate(docs.columns)])
    scored = fit(docs, labels).score(inner).where(F.col("score") < THRESHOLD)
    return scored.select(*[F.col("text" if c == "text" else f"_d{i}").alias(c) for i, c in enumerate(docs.columns)])
