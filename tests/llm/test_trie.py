"""The prefix trie against a plain one over tuples."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reconlink.llm import trie as T

TURNS = "conv_id long, turn long, role string, text string, depth string, shard int"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get((abs(c) // 20 * 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    return sorted((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], TURNS)
    return sorted((tuple(r[c] for c in T.RESULT) for r in T.prefix_trie(df, **sizes).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def made(seed, n, kinds=3, longest=5):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c * rnd.choice([1, 1, 3]) + 10_000 * (c % 2), t, "user", " ".join("ab"[: rnd.randrange(1, 3)] for _ in range(rnd.randrange(kinds)))) for t in range(rnd.randint(1, longest))]
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("shard, cells", [(8, 4), (25, 1000), (100_000, 4_000_000)])
def test_against_plain_trie(spark, shard, cells):
    rows = made(1, 60)
    # a hot conversation and a hot first turn over many shards; long ones; turnless ones; odd values
    rows += [(c, t, "user", x) for c in range(2000, 2060) for t, x in enumerate(["hot hot", "again", "and", "more"])]
    rows += [(c, t, "user", x) for c in range(3000, 3030) for t, x in enumerate(["hot hot", f"own {c % 7}"])]
    rows += [(4000, t, "user", f"long {t} {t % 3}") for t in range(150)] + [(4021, t, "user", f"long {t} {t % 3}") for t in range(90)]
    rows += [(5001 + 20 * k, 0, "user", "x") for k in range(15)] + [(-3, 0, None, None), (-3, None, "a", "first"), (None, 1, "a", "lost"), (2**61, 5, "", "")]
    assert found(spark, rows, shard=shard, cells=cells) == sorted(brute(rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_random_tries(spark):
    for seed in range(3):
        rows = made(seed + 10, 90, 2, 4)
        assert found(spark, rows, shard=4 + 9 * seed, cells=7) == sorted(brute(rows), key=lambda r: tuple((x is not None, x) for x in r)), seed


def test_small_cases(spark):
    assert found(spark, []) == []
    alone = [(21, 0, "user", "gone")]  # three of its turns would come from a host that is absent, or its own stay
    assert found(spark, alone) == brute(alone)
    twice = [(40, 1, "a", "x y"), (40, 1, "a", "x y"), (40, None, "b", "z")]
    assert found(spark, twice) == brute(twice)


def test_rows_are_sorted_in_pieces():
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(0, 9, 200)
    codes = rnd.integers(0, 2, int(lengths.sum())).astype(np.int32)
    offsets, conv = np.cumsum(lengths) - lengths, rnd.permutation(200)
    want = sorted(range(200), key=lambda i: (tuple(codes[offsets[i]:offsets[i] + lengths[i]]), conv[i]))
    for cells in (1, 50, 10_000):
        assert T.sorted_rows(conv, codes, offsets, lengths, cells).tolist() == want
