"""The pipeline against the same stages by loops in one process."""

import numpy as np
import pytest

import corpus_pipeline
from reconlink.llm import bpe, chaining as C, decontam as D, neardup as N, simhash as S, toxicity as T

FOLDER = "/root/testdata/sf0.001"


def brute_passages(docs):
    """Words to cut from each document: its seeds' links to their first occurrence, chained and aligned."""
    first, places = {}, {}
    for i, t in docs:
        ids = C.word_ids(C.words_of(t or ""))
        places[i] = (ids, *C.seeds_of(ids))
    for i, (_, hashes, at) in places.items():
        for h, p in zip(hashes.tolist(), at.tolist()):
            first[h] = min(first.get(h, (i, p)), (i, p))
    out = {}
    for i, (ids, hashes, at) in places.items():
        links = {}
        for h, p in zip(hashes.tolist(), at.tolist()):
            if first[h][0] != i:
                links.setdefault(first[h][0], []).append((p, first[h][1]))
        found = []
        for other, pairs in links.items():
            if len(pairs) > 1:
                a, b = np.array(pairs).T
                for chain in C.chains(a, b):
                    x, y, n = (list(c) for c in zip(*chain))
                    start = max(0, y[0] - C.BEYOND)
                    if x[-1] + n[-1] - x[0] > C.K + 1:
                        got = C.aligned(ids, places[other][0][start : y[-1] + n[-1] + C.BEYOND], start, x, y, n)
                        if got and got[1] - got[0] >= C.MIN_WORDS and got[4] >= C.IDENTITY * max(got[1] - got[0], got[3] - got[2]):
                            found.append((got[0], got[1]))
        out[i] = C.joined_spans(found)
    return out


def test_pipeline_by_loops(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    rejected = {r["doc_id"] for r in T.scores(docs, labels).collect() if r["predicted"]}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected)
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := N.words_of(t or "")) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    spans = brute_passages(rows)
    rows = [(i, C.without(t, spans[i])) for i, t in rows]
    rows = [(i, t) for i, t in rows if not spans[i] or t.strip()]
    block = D.Block([(r["item_id"], r["text"]) for r in read("benchmark").collect()], D.Q, D.RATE)
    rows = [(i, t) for i, t in rows if not block.search(D.normal(t))]
    own = bpe.encoder(None, __import__("public_tokenizers").PATTERN)
    want = {i: own.encode([t])[0].tolist() for i, t in rows}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 50 < len(got) < docs.count()


def test_stages_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, FOLDER)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "some words", "en", "s", 10), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 40_000, "en", "s", 80_000)]
    assert stage(spark, spark.createDataFrame(rows, schema), FOLDER).count() >= 1


def test_columns_that_clash_stay(spark):
    schema = "doc_id long, text string, _row long, _chains string, first_id long, words string, n_chars long"
    text = " ".join(f"word{i}" for i in range(120))
    rows = [(1, text, 7, "a", 5, "w", 9), (1, text, 7, "a", 5, "w", 9), (2, "other " * 60, 8, "b", 6, None, 3)]
    df = spark.createDataFrame(rows, schema)
    for module in (S, N):
        assert sorted(map(tuple, module.keep_one(df).collect())) == [rows[0], rows[2]]
    assert sorted(map(tuple, C.cut_passages(df).select(*df.columns).collect())) == rows
