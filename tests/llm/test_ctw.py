"""The distributed model against context-tree weighting by recursion over all contexts."""

import math
import random
import zlib
from collections import Counter, defaultdict

from reconlink.llm import ctw

SCHEMA = "doc_id long, text string, extra string"


def lg(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def symbols(token, depth):
    """(context nearest first, byte) for each byte of a token (state, word)."""
    state, word = token[0], token[1:]
    seq = b" " + word + (b"" if word == ctw.END else b" ")
    for i in range(1, len(seq)):
        context = list(seq[max(0, i - depth) : i][::-1])
        if i <= depth:
            context.append(("state", state))
        yield context, seq[i]


def brute_scores(rows, states, depth):
    trained = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    tokens = lambda t: ctw.after_states((t or "").encode().lower().split(), {w: bytes([s]) for w, s in states.items()})
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for _, text, *_ in trained:
        for token in tokens(text):
            for context, byte in symbols(token, depth):
                for k in range(8):
                    node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
                    for d in range(len(context) + 1):
                        counts[tuple(context[:d]), node][bit] += 1
                        if d:
                            children[tuple(context[: d - 1]), node].add(tuple(context[:d]))
    weights = {}

    def log_pw(context, node):
        if (context, node) not in weights:
            own = lg(*counts[context, node])
            below = [log_pw(c, node) for c in children[context, node]]
            both = own if not below else math.log(0.5) + own + math.log1p(math.exp(min(500, sum(below) - own)))
            weights[context, node] = (both, 1.0 if not below else math.exp(math.log(0.5) + own - both))
        return weights[context, node][0]

    def chance(context, byte):
        total = 0.0
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
            before, left, one = 0.0, 1.0, 0.5
            for d in range(len(context) + 1):
                key = (tuple(context[:d]), node)
                if key not in counts:
                    break
                log_pw(*key)
                n0, n1 = counts[key]
                kt, stop = (n1 + 0.5) / (n0 + n1 + 1), weights[key][1]
                one = before + left * kt
                before, left = before + left * stop * kt, left * (1 - stop)
            total += math.log10(one if bit else 1 - one)
        return total

    return [sum(chance(c, b) for token in tokens(text) for c, b in symbols(token, depth)) for _, text, *_ in rows]


def corpus():
    rnd = random.Random(7)
    words = ["the", "of", "and", "thing", "Tion", "été", "der", "und", "zug", "x" * 70]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "er", "."]) for _ in range(rnd.randint(0, 30))), "e") for i in range(40)]
    return rows + [(100, None, "e"), (101, "", "e"), (3, rows[3][1], "e"), (None, "the  end\x0bof\tit", "e"), (102, "\x00\x00 unheard-of wörds", "e")]


def test_scores_against_recursion(spark, monkeypatch):
    monkeypatch.setattr(ctw, "WORDS", 20)
    monkeypatch.setattr(ctw, "PAIRS", 60)
    monkeypatch.setattr(ctw, "FREQUENT", 7)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    trains = df.selectExpr("coalesce(crc32(cast(doc_id as string)) % 5 <> 1, true) AS trains", "text")
    states = ctw.word_states(trains)
    got = sorted(ctw.scores(df).collect(), key=lambda r: (str(r["doc_id"]), r["score"]))
    model = brute_scores(rows, states, ctw.DEPTH)
    counts, total = Counter(), 0
    for i, text, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            own = (text or "").encode().lower().split() + [ctw.END]
            counts.update(own)
            total += len(own)
    want = []
    for (i, text, _), score in zip(rows, model):
        own = (text or "").encode().lower().split() + [ctw.END]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in own)
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(w in counts for w in own), total, base, score))
    want.sort(key=lambda r: (str(r[0]), r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g["base_score"], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g["score"], w[6], rel_tol=1e-6, abs_tol=1e-6)


def test_without_training_text(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = ctw.scores(spark.createDataFrame([(i, "ab", "e") for i in ids], SCHEMA)).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and math.isclose(r["score"], -4 * 8 * math.log10(2)) for r in rows)
    assert ctw.scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_layout_has_no_part_in_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    one, many = ({r["doc_id"]: r["score"] for r in ctw.scores(df.repartition(k, "doc_id")).collect()} for k in (1, 16))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-9) for i in one)
