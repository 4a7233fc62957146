"""The manifest against plain recursion over lists."""

import hashlib
import zlib

from reconlink.llm import merkle as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(nodes):
    trees = [nodes]
    while len(trees[-1]) > 1:
        trees.append([H(*trees[-1][i:i + 8]) for i in range(0, len(trees[-1]), 8)])
    return trees


def climb(trees, i, now):
    proof = ""
    for level in trees[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        slot = i % 8
        proof += "".join(run[:slot] + run[slot + 1:])
        now = H(*run[:slot], now, *run[slot + 1:])
        i //= 8
    return now, proof


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, placed = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        placed[lang], trees[lang] = own, grow([leaf(r) for r in own])
    top = grow([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(placed[lang]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now, proof = climb(trees[lang], i, leaf(r, hit))
            now, rest = climb(top, k, now)
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], H(proof + rest), now, now == top[-1][0]))
    return sorted(out, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "clash", 7) for r in rows], DOCS).repartition(parts)


def row(i, lang="en", text="Some Text é", source="s", n=3):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_against_recursion(spark):
    rows = [row(3 * i - 50, text=f"T{i}") for i in range(150)] + [row(i, "de") for i in range(9)] + [row(i, "ü") for i in range(64)]
    rows += [row(5, None), row(6, ""), row(None, "en"), row(None, "en"), row(7, "en", None, None, None), row(7, "en", ""), row(7, "en", ""), row(2**62 + 1, "en", "X" * 100_000)]
    want = brute(rows)
    # blocks of 8 and 64 leaves take several tiers, the whole height takes one
    for depth in (1, 2, 4):
        assert result(M.manifest(table(spark, rows), depth)) == want, depth
    assert not all(x[-1] for x in want) and any(x[-1] for x in want)


def test_many_languages_one_row_each(spark):
    rows = [row(i, f"l{i:02d}") for i in range(21)]
    assert result(M.manifest(table(spark, rows), 1)) == brute(rows)


def test_lone_row_and_no_row(spark):
    assert result(M.manifest(table(spark, [row(12, "en", "plain")]))) == brute([row(12, "en", "plain")])
    assert M.manifest(table(spark, [])).collect() == []


def test_states_before_slots():
    nodes = [H(str(i)) for i in range(5)]
    parent = M.Parent(nodes)
    assert parent.digest == H(*nodes) and len(parent.states) == 5
    assert all(parent.folded(i, "x" * 64) == H(*nodes[:i], "x" * 64, *nodes[i + 1:]) for i in range(5))
    assert parent.states[0].hexdigest() == hashlib.sha256().hexdigest()
