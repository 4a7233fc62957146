"""Near copies against brute-force Jaccard similarity over all pairs."""

import random
from itertools import combinations

from reconlink.llm import neardup as N

SCHEMA = "doc_id long, text string, node long, group long, _row string"


def brute_set(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def similar(a, b):
    return a == b or len(a & b) / max(1, len(a | b)) >= 0.8


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    rnd = random.Random(12)
    word = lambda: rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.35 else f"w{int(rnd.paretovariate(0.6)) % 4000}"
    texts = []
    for size, changes in ((60, 1), (120, 2), (200, 3), (200, 4), (300, 5), (300, 6)):
        for _ in range(25):
            base = [word() for _ in range(size)]
            copy = list(base)
            for at in rnd.sample(range(size), changes):
                copy[at] = word()
            texts += [" ".join(base), "\n".join(copy)]
    base = [word() for _ in range(150)]
    for _ in range(40):  # a group of copies of one text
        copy = list(base)
        copy[rnd.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(base), " ".join(base).upper(), "one two", "one  two", "one two three", "x " * 3000, "x " * 2000]
    return [(3 * i, t, 1, 2, "r") for i, t in enumerate(texts)]


def test_recall_and_no_false_link(spark):
    rows = corpus()
    got = {r["doc_id"]: r["group"] for r in N.near_copies(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").repartition(3)).collect()}
    sets = {i: brute_set(t) for i, t, *_ in rows}
    true = [(a, b) for a, b in combinations(sets, 2) if similar(sets[a], sets[b])]
    assert sum(got[a] == got[b] for a, b in true) >= 0.9 * len(true)
    # of the pairs outside the large group too
    pairs = [(a, b) for a, b in true if b < 900]
    assert len(pairs) > 100 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    whole = components(sets, true)
    assert all(whole[i] == whole[g] and g <= i for i, g in got.items())


def test_cases(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50 ", "w51 ")
    rows = [(4, text, 1, 2, "r"), (2, near, 5, None, None), (2, near, 5, None, None), (None, text, 1, 1, "n"), (7, None, 1, 1, "e"), (8, "", 1, 1, "e"), (9, "a b", 1, 1, "s")]
    kept = sorted(map(tuple, N.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert kept == sorted([rows[1], rows[3], rows[4], rows[6]], key=str)
    assert N.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_that_surely_stay_are_not_shuffled(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(80)) for _ in range(60)]
    rows = [(i, t, 1, 2, "r") for i, t in enumerate(texts)] + [(100, texts[0], 1, 2, "c"), (1, texts[5] + " x", 1, 2, "again"), (None, texts[2], 1, 2, "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = N.keep_one(df)
    # one branch of the union joins and numbers rows, the other only asks the broadcast map
    branches = kept._jdf.queryExecution().optimizedPlan().children()
    plans = [branches.apply(i).toString() for i in range(branches.size())]
    assert sum("Window" not in p and "LeftSemi" not in p for p in plans) == 1
    got = sorted(map(tuple, kept.collect()), key=str)
    # 100 and 5 went: 5 is the same text as the second row of 1 but a word
    assert len(got) == 60 and (100, texts[0], 1, 2, "c") not in got
    # a map of few bits lets more texts through to the joins and changes nothing
    monkeypatch.setattr(N, "MAP_BITS", 64)
    assert sorted(map(tuple, N.keep_one(df).collect()), key=str) == got
    few = df.select("doc_id").where("doc_id IN (3, 100)")
    marked = {r["doc_id"] for r in N.perhaps(df, few, "doc_id", "_m").where("_m").collect()}
    assert {3, 100} <= marked and None not in marked


def test_pairs_behind_refused_links_are_checked(spark):
    """Texts of the same words in any order share all buckets, where a forest of links to the first of them says nothing of the others."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(15):
        rnd.shuffle(words)
        copy = list(words)
        copy[60], copy[61] = copy[61], copy[60]
        texts += [" ".join(words), " ".join(copy)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["group"] for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
