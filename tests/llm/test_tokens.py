"""BPE against tiktoken, length histogram against plain sums."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconlink.llm import bpe, lengths


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    with open(P.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(4)
    fixed = ["", " ", "it's  we'll\n\n \t x", "a" * 3000, "ab" * 700 + "é" * 400, "日本語テキスト😀👍🏽   x", "x" * 513, "\x1c ²½_1a", "tab\tand space", "<|endoftext|>"]
    return fixed + ["".join(rnd.choice("ab éçß1 .,'\n_stre²日") for _ in range(rnd.randint(1, 80))) for _ in range(120)]


DOCS = "doc_id long, text string, ids string, n_tokens string"


def test_bpe_equals_tiktoken(spark, reference):
    cases = [*texts(), "", "again", "again", None]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(cases)], DOCS).repartition(3)
    plain = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df)).collect()}
    digests = {r["doc_id"]: r for r in bpe.digests(df).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    for i, t in enumerate(cases):
        want = reference.encode_ordinary(t or "")
        assert list(plain[i]["ids"]) == want and plain[i]["n_tokens"] == len(want) == counts[i], t
        assert bytes(plain[i]["decoded"]) == (t or "").encode() and plain[i]["text"] == t
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_an_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert bpe.digests(df).collect() == [] and lengths.token_counts(df).collect() == []


def test_bounded_memory_changes_nothing(reference, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Encoder(P.path(bpe.VOCABULARY), P.PATTERN)
    for t in texts():
        assert own.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_suffix_sums(spark, monkeypatch):
    monkeypatch.setattr(lengths, "BLOCK", 7)
    rnd = random.Random(5)
    sizes = [rnd.choice([0, 0, rnd.randint(0, 60), 1000]) for _ in range(300)]
    hist = lengths.histogram(spark.createDataFrame([(n,) for n in sizes], "n_tokens long"))
    sums = lengths.suffix_sums(hist)
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(sizes))
    for limit, r in rows.items():
        assert (r["docs"], r["docs_over"], r["tokens_over"]) == (sizes.count(limit), sum(n > limit for n in sizes), sum(n for n in sizes if n > limit))
        assert (r["docs_all"], r["tokens_all"], r["truncated_total"]) == (300, sum(sizes), sum(min(n, limit) for n in sizes))
        assert abs(r["share"] - sum(n <= limit for n in sizes) / 300) < 1e-12
    asked = [0, 13, 59, 5000]
    got = {r["context_limit"]: (r["docs_over"], r["truncated_total"]) for r in lengths.at_limits(hist, asked).collect()}
    assert got == {x: (sum(n > x for n in sizes), sum(min(n, x) for n in sizes)) for x in asked}
    assert lengths.quantiles(sums, [0.5, 1.0]).first().asDict() == {"q500": sorted(sizes)[149], "q1000": max(sizes)}
    none = lengths.at_limits(hist.where(F.lit(False)), [5]).first()
    assert (none["docs_over"], none["truncated_total"]) == (0, 0)
