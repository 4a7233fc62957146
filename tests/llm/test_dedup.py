"""SimHash components, fuzzy passages, leaks and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reconlink.llm import chaining as C, decontam as D, simhash as S, spotsigs as P

DOCS = "doc_id long, text string, component_id string, fingerprint string"


def words(rnd, n):
    return [rnd.choice(["the", "of"]) if rnd.random() < 0.3 else "".join(rnd.choice(["an", "ti", "on", "er", "sh", "le", "ou", "ré"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def brute_print(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    grams = [b" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_components(spark):
    rnd = random.Random(8)
    base = words(rnd, 120)
    rows = [(i, " ".join(words(rnd, rnd.randint(1, 60)))) for i in range(60)]
    for i in range(60, 110):  # a large group of near copies
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(200, None), (201, ""), (199, " \t"), (5, rows[5][1]), (None, rows[7][1]), (300, "one"), (301, "ONE")]
    got = S.simhash_components(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(4))
    got = got.withColumn("hex", S.hex_digits("fingerprint")).collect()
    prints = [brute_print(t) for _, t in rows]
    want = zip((i for i, _ in rows), prints, brute_components([i for i, _ in rows], prints))
    assert sorted(((r["doc_id"], r["hex"], r["component_id"]) for r in got), key=str) == sorted(((i, f"{p:016x}", c) for i, p, c in want), key=str)
    kept = S.keep_one(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)).collect()
    named = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(named) == sorted({c for c in brute_components([i for i, _ in rows], prints)}) and len(kept) == len(named) + 1
    assert S.simhash_components(spark.createDataFrame([], DOCS)).collect() == []


def test_large_buckets_keep_every_link(monkeypatch):
    monkeypatch.setattr(S, "SPLIT", 20)
    rnd = random.Random(9)
    mask = S.covering_masks()[3]
    free = [b for b in range(64) if not mask >> b & 1]
    prints = {0}
    while len(prints) < 150:
        p = rnd.choice(sorted(prints)) if rnd.random() < 0.8 else 0
        for b in rnd.sample(free, rnd.randint(1, 8)):
            p ^= 1 << b
        prints.add(p)
    own = np.array(sorted(prints), dtype=np.uint64)
    links = S.bucket_links(own, mask, 4)
    root = {int(p): int(p) for p in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert bin(int(a) ^ int(b)).count("1") <= 4
        root[find(int(a))] = find(int(b))
    for a in prints:
        for b in prints:
            assert bin(a ^ b).count("1") > 4 or find(a) == find(b)


def test_large_buckets_keep_links_beyond_the_radius(monkeypatch):
    """Whatever a small bucket links at up to ``reach`` bits, a large one links too."""
    rnd = random.Random(10)
    mask = S.covering_masks(5)[7]
    free = [b for b in range(64) if not mask >> b & 1]
    prints = {0}
    while len(prints) < 120:
        p = rnd.choice(sorted(prints))
        for b in rnd.sample(free, 9):
            p ^= 1 << b
        prints.add(p)
    own = np.array(sorted(prints), dtype=np.uint64)
    whole = S.bucket_links(own, mask, 5, 9)
    monkeypatch.setattr(S, "SPLIT", 20)
    assert S.bucket_links(own, mask, 5, 9) == whole and len(whole) == len(own) - 1


def test_passages(spark):
    rnd = random.Random(10)
    passage = words(rnd, 70)
    fuzzy = list(passage)
    for at in (12, 33, 34, 60):
        fuzzy[at] = "edited"
    del fuzzy[45]
    clean = [words(rnd, 200) for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    rows[1] = (1, " ".join(clean[1][:50] + passage + clean[1][50:]))
    rows[3] = (3, " ".join(clean[3][:90]) + "\n" + " ".join(fuzzy) + "\n" + " ".join(clean[3][90:]))
    rows += [(6, " ".join(passage)), (7, rows[0][1]), (8, None), (9, ""), (None, rows[0][1]), (10, " ".join(clean[2][:30]))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)
    got = {(r["doc_id"], r["first_id"]): r for r in C.passages(df).collect()}
    assert set(got) == {(3, 1), (6, 1), (7, 0)}
    assert (got[6, 1]["start"], got[6, 1]["stop"], got[6, 1]["first_start"], got[6, 1]["first_stop"]) == (0, 70, 50, 120)
    assert abs(got[3, 1]["start"] - 90) <= 2 and abs(got[3, 1]["stop"] - 159) <= 2 and got[3, 1]["same_words"] >= 63
    kept = {r["doc_id"]: r["text"] for r in C.cut_passages(df).where("doc_id is not null").collect()}
    assert set(kept) == {0, 1, 2, 3, 4, 5, 8, 9, 10} and kept[1] == rows[1][1] and kept[8] is None
    left = kept[3].split()
    # a word beside the passage may agree by chance
    assert 197 <= len(left) <= 203 and left[:87] == clean[3][:87] and left[-100:] == clean[3][-100:]
    assert C.cut_passages(df).where("doc_id is null").count() == 1
    assert C.passages(spark.createDataFrame([], DOCS)).collect() == [] and C.cut_passages(spark.createDataFrame([], DOCS)).collect() == []


def test_passages_whose_seeds_are_first_met_in_different_documents(spark):
    rnd = random.Random(14)
    rows = []
    for _ in range(12):
        # four documents: 30 words first met in a, 30 in b, both after one another in c and d
        plain, halves = [words(rnd, 150) for _ in range(4)], [words(rnd, 30) for _ in range(2)]
        inner = [halves[0], halves[1], halves[0] + halves[1], halves[0] + halves[1]]
        rows += [(len(rows) + k, " ".join(w[:70] + x + w[70:])) for k, (w, x) in enumerate(zip(plain, inner))]
    # a run of just the least length, and one whose places before it were met in many documents
    short = words(rnd, C.MIN_WORDS)
    pieces = [words(rnd, 25) for _ in range(4)]
    rows += [(len(rows) + k, " ".join(words(rnd, 80) + p + words(rnd, 80))) for k, p in enumerate([short[:25], short[15:], *pieces, short, short, sum(pieces, []), sum(pieces[:2], []), sum(pieces, [])])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).repartition(3)
    cut = {i: set() for i, _ in rows}
    for r in C.passages(df).collect():
        assert r["first_id"] < r["doc_id"]
        cut[r["doc_id"]].update(range(r["start"], r["stop"]))
    seen, lost, many = set(), [], 0
    for i, t in rows:
        own = t.lower().split()
        here = [tuple(own[k : k + C.MIN_WORDS]) for k in range(len(own) - C.MIN_WORDS + 1)]
        held = {k + j for k, x in enumerate(here) if x in seen for j in range(C.MIN_WORDS)}
        many += bool(held)
        lost += [i] if held - cut[i] else []
        seen.update(here)
    assert many == 15 and not lost


def brute_chain(a, b, size, cost):
    """Best chain score over all ordered subsets, quadratic."""
    best = []
    order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
    for n, i in enumerate(order):
        gains = [best[m] - cost * (a[i] - a[j] - size + b[i] - b[j] - size) for m, j in enumerate(order[:n]) if a[j] + size <= a[i] and b[j] + size <= b[i]]
        best.append(size + max([0, *gains]))
    return max(best)


def test_chains_score_best():
    rnd = random.Random(11)
    for _ in range(60):
        pairs = sorted({(rnd.randint(0, 40) * 7, rnd.randint(0, 40) * 9) for _ in range(25)})
        a, b = (np.array(x) for x in zip(*pairs))
        chain = C.chains(a, b, k=5, reach=1)[0]
        cost = 5 / 2
        score = sum(n for *_, n in chain) - cost * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(chain, chain[1:]))
        assert score >= brute_chain(a, b, 5, cost) - 1e-9


def edit_distance(a, b):
    """Fewest edits between ``a`` and any substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        step = [i]
        for j, y in enumerate(b, 1):
            step.append(min(row[j] + 1, step[-1] + 1, row[j - 1] + (x != y)))
        row = step
    return min(row)


def test_leaks(spark):
    rnd = random.Random(12)
    items = [(i, " ".join(words(rnd, 25)).capitalize()) for i in range(6)] + [(6, "tiny"), (7, None), (8, "  ")]
    docs = []
    for i in range(60):
        host, item = " ".join(words(rnd, 60)), list(items[i % 6][1])
        budget = int(0.1 * len(D.normal("".join(item))))
        for _ in range(rnd.randint(0, 2 * budget) if i % 3 else 0):
            at, way = rnd.randrange(len(item)), rnd.random()
            item[at : at + 1] = [rnd.choice("xyz")] if way < 0.4 else [] if way < 0.7 else [item[at], "q"]
        at = rnd.randint(0, len(host))
        docs.append((i, host[:at] + " " + "".join(item).upper() + "\n" + host[at:] if i % 5 else host))
    docs += [(100, None), (101, ""), (102, "Some TINY text"), (None, items[0][1])]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.leaks(df, bench).collect()}
    want = {}
    for i, t in docs:
        for k, x in items[:7]:
            edits = edit_distance(D.normal(x), D.normal(t))
            if edits <= (int(0.1 * len(D.normal(x))) if k < 6 else 0):
                want[i, k] = edits
    assert got == want and len(want) > 20
    clean = D.clean(df, bench).collect()
    assert sorted((r["doc_id"] for r in clean), key=str) == sorted((i for i, _ in docs if i not in {k for k, _ in want}), key=str)
    assert D.leaks(df, bench.where("item_id > 50")).collect() == [] and D.clean(df.where("doc_id > 900"), bench).collect() == []
    assert D.clean(df, bench.where("item_id > 50")).count() == len(docs)


def test_leaks_of_short_items():
    rnd = random.Random(15)
    for size in range(3, 41):
        item = "".join(rnd.choice("abcdefgh") for _ in range(size))
        block, budget = D.Block([(1, item)], D.Q, D.RATE), size // 10
        for edits in range(budget + 2):
            for _ in range(4):
                own = list(item)
                for at in rnd.sample(range(size), min(edits, size)):
                    way = rnd.random()
                    own[at] = rnd.choice("xyz") if way < 0.4 else "" if way < 0.7 else own[at] + "q"
                text = "m" * rnd.randint(0, 30) + "".join(own) + "n" * rnd.randint(0, 30)
                want = edit_distance(item, text)
                assert [f[:2] for f in block.search(text)] == ([(0, want)] if want <= budget else []), (size, edits, text)
        # every exact place
        assert [f[1:] for f in block.search(f"{item} {'m' * 60} {item}")] == [(0, 0, size), (0, size + 62, 2 * size + 62)]
    block = D.Block([(1, "tiny"), (2, "abcdefghij" * 3), (3, "klmnopqrstuvwxyz" * 6)], D.Q, D.RATE)
    assert {f[:2] for f in block.search("tiny " + "abcdefghix" * 3 + " " + "klmnopqrstuvwxyz" * 6)} == {(0, 0), (1, 3), (2, 0)}


def test_spotsigs(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 7)
    rnd = random.Random(13)
    docs = [(3 * i, " ".join(words(rnd, rnd.randint(5, 500)))) for i in range(40)] + [(200, None), (201, ""), (202, "!!"), (203, "日本語テキスト"), (204, "日本語テキスト"), (205, "ab")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(4)
    rows = {r["doc_id"]: r for r in P.edited_pairs(df).collect()}
    order = sorted(docs, reverse=True)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{rows[x][c][j : j + 8] for j in range(0, len(rows[x][c]), 8)} for x, c in ((i, "fingerprint"), (i, "edited_fingerprint"), (order[(k + 1) % len(order)][0], "fingerprint"))]
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            assert abs(rows[i][name] - len(sets[0] & other) / len(sets[0] | other)) < 1e-12
        if len(text) > 500:
            assert rows[i]["near_edited"] > 0.2 > rows[i]["near_next"]
    assert rows[200]["fingerprint"] == rows[201]["fingerprint"] != rows[202]["fingerprint"] and rows[203]["fingerprint"] == rows[204]["fingerprint"]
    assert len({r["fingerprint"] for r in rows.values()}) == len(docs) - 2
    assert P.edited_pairs(spark.createDataFrame([], DOCS)).collect() == []
    one = P.edited_pairs(df.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    again = P.edited_pairs(df.where("doc_id = 3").unionByName(df.where("doc_id = 3")).unionByName(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))))
    assert again.count() == 3
