"""Histogram divergence: base counts by brute force, odd rows, layouts."""

import random
import re
from collections import Counter

from reconlink.llm import divergence as D

DOCS = "doc_id long, lang string, text string, kept string, n_words int, _of string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words)}


def prose(rnd, n, common):
    made = []
    for _ in range(n):
        word = rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice(["an", "ti", "on", "er", "é"]) for _ in range(rnd.randint(2, 4)))
        made.append(word + rnd.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(made)


def corpus():
    rnd = random.Random(5)
    common = "the of and to in for on with".split()
    clean = [prose(rnd, rnd.randint(60, 200), common) for _ in range(120)]
    loud = [re.sub(r"(\S+)", lambda m: m[1].upper() + "!!", prose(rnd, 90, common)) for _ in range(6)]
    marked = [re.sub(r"(\S+)", r"\1###", prose(rnd, 90, common)) for _ in range(6)]
    return clean, loud, marked


def test_base_counts_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "x y z x y z", "one\ntwo\none\n\n \none", "#*$%&|<> é𝄞 #a", "\x0b\x0c\r\x1c\xa0 b", "a a a a a a"]
    texts += [" ".join(rnd.choice("abc") for _ in range(n)) for n in (5, 20, 60, 400)] + [" ".join(f"w{i}" for i in range(3000)) + " w1 w2 w3", "the " * 20_000, "x" * 200_000]
    texts += corpus()[0][:10]
    df = spark.createDataFrame([(i, "en", t, "clash", 1, "clash") for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in D.judged(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert {k: rows[i][k] for k in base("")} == base(text or ""), i


def test_verdicts_and_layout(spark):
    clean, loud, marked = corpus()
    docs = [(i, "xx", t, "c", 1, "c") for i, t in enumerate([*clean, *loud, *marked])]
    docs += [(None, None, clean[0], "c", 1, "c"), (None, None, clean[0], "c", 1, "c"), (1, "xx", clean[1], "c", 1, "c"), (900, "zz", None, "c", 1, "c")]
    df = spark.createDataFrame(docs, DOCS)
    rows = D.judged(df.repartition(1)).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(rows) == len(docs) and sum(r["doc_id"] is None for r in rows) == 2
    assert set(range(120)) <= kept and not kept & set(range(120, 132)) and 900 not in kept
    assert sorted(map(repr, rows)) == sorted(map(repr, D.judged(df.repartition(17)).collect()))
    # too short for a histogram: only the base rules speak
    assert {r["kept"] for r in D.judged(df, min_chars=10**6).collect() if r["doc_id"] in range(120, 132)} == {True}
    assert D.judged(spark.createDataFrame([], DOCS)).collect() == []


def test_many_languages_are_joined_without_a_broadcast(spark, monkeypatch):
    clean, loud, _ = corpus()
    df = spark.createDataFrame([(i, ["aa", "bb", None][i % 3], t, "c", 1, "c") for i, t in enumerate([*clean, *loud])], DOCS)
    few = sorted(map(repr, D.judged(df).collect()))
    monkeypatch.setattr(D, "LANGUAGES", 0)
    assert sorted(map(repr, D.judged(df).collect())) == few
