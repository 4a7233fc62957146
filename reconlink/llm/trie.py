"""The prefix trie of conversations, every node with the figures of its subtree.

A conversation is a row of turn ids (128 bits of hash over role and text). Rows are range-partitioned by
their ids and conv_id, so that a shard holds a contiguous part of the trie. A shard codes its ids in
order, lays them in matrices padded with -1 and sorts the rows with numpy's lexsort, conv_id last; columns are taken
in pieces of at most CELLS cells, so one long conversation pads no others. A column change mask,
OR-accumulated from left to right, marks where each depth's nodes start, and ``reduceat`` gives every
depth's members, smallest conv_id and, from the deepest depth upwards, subtree sums.

Only nodes on the path of a shard's first or last row can go on in a neighbour. These boundary nodes leave the
shard as partial figures, one row each, without what other boundary nodes below them add. They are
recombined per first turn in shard order by a stack of open nodes, with memory for one path only: a node is
closed, and added to its parent, when the path leaves it. The members that end at a node spread over shards
pass through one SHA-256 state in that order, a shard's ids at a time. The root is a plain sum over first turns.

Rebuilding (the first turns of a host, then own turns) joins the first turns only, on the host's id,
which at most twenty conversations name. A conversation's turn ids (16 bytes and a count each) are one row; texts are never shuffled.

Cases: turns of one place (ties, repeated rows) are ordered by their ids; null role and text are empty; rows without conv_id
belong to no conversation and are not read; columns besides conv_id, turn, role and text are not read; without
conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import cut, ragged

#: conversations whose ids have the same quotient by this share a host
HOSTED = 20
#: at most so many turns come from the host
HEAD = 3
#: turns of a shard, about; cells of one padded matrix
SHARD, CELLS = 400_000, 4_000_000
NOTHING = hashlib.sha256().hexdigest()

TURN = "struct<hi:bigint,lo:bigint,words:bigint>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: ids and words of each conversation's turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", F.struct(
            F.col("turn").isNotNull().alias("placed"), "turn", F.xxhash64(role, text).alias("hi"), F.xxhash64(F.lit(1), text, role).alias("lo"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("t"))
    # a turn is 48 bytes here
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the host's first turns, then the conversation's own after as many."""
    own = turns_of(conversations).withColumns({
        "host": F.col("conv_id") - F.col("conv_id") % HOSTED, "h": (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")})
    # the host's own row is in the same window, of at most twenty rows
    heads = F.max(F.when(F.col("conv_id") == F.col("host"), F.struct(F.slice("turns", 1, HEAD).alias("turns")))).over(W.partitionBy("host"))
    none = F.array().cast(f"array<{TURN}>")
    return own.withColumn("heads", F.coalesce(heads["turns"], none)).select("conv_id", F.concat(
        F.slice("heads", F.lit(1), F.col("h")),
        F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(1)))).otherwise(none)).alias("turns"))


@dataclass
class Depth:
    """Nodes of one depth, in order of their rows."""

    at: np.ndarray  # first row
    code: np.ndarray
    n: np.ndarray
    conv: np.ndarray
    parent: np.ndarray  # number of the parent in the depth above
    first: bool  # the first node is on the first row's path, the last on the last row's
    last: bool
    children: np.ndarray = None
    leaves: np.ndarray = None
    saved: np.ndarray = None

    def edges(self) -> np.ndarray:
        marked = np.zeros(len(self.at), bool)
        marked[-1] = self.last
        marked[0] |= self.first
        return marked


def coded(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in the order of (hi, lo), and a place of each code's id."""
    if not len(hi):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    codes = np.empty(len(order), np.int32)
    codes[order] = np.cumsum(new) - 1
    return codes, order[new]


def pieces(lengths: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """Column ranges such that the rows that reach into one take at most ``cells`` cells of it."""
    out, start, longest = [], 0, int(lengths.max(initial=0))
    while start < longest:
        width = max(1, cells // int((lengths > start).sum()))
        out.append((start, min(longest, start + width)))
        start += width
    return out


def padded(codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Rows by columns ``start .. stop`` of the codes, -1 beyond a row's end."""
    width = np.clip(lengths - start, 0, stop - start)
    matrix = np.full((len(lengths), stop - start), -1, np.int32)
    matrix[np.repeat(np.arange(len(lengths)), width), ragged(np.zeros(len(width), np.int64), width)] = codes[ragged(offsets + start, width)]
    return matrix


def sorted_rows(conv: np.ndarray, codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, cells: int) -> np.ndarray:
    """The rows' order by their codes, shorter first, then conv_id: pieces of columns from the last one, each stable."""
    order = np.argsort(conv, kind="stable")
    for start, stop in reversed(pieces(lengths, cells)):
        reach = lengths[order] > start
        some = order[reach]
        matrix = padded(codes, offsets[some], lengths[some], start, stop)
        # a row that ends before is smaller than all that reach in, and keeps its place among its like
        order = np.concatenate([order[~reach], some[np.lexsort(matrix.T[::-1])] if len(some) > 1 else some])
    return order


def depths(conv: np.ndarray, codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, cells: int = CELLS) -> list[Depth]:
    """Depths 1, 2 ... of sorted rows."""
    out: list[Depth] = []
    changed = np.zeros(len(conv), np.int64)  # changes up to a row: rows differ if their counts do
    rows = np.arange(len(conv))
    before = Depth(np.zeros(1, np.int64), None, None, None, None, True, True)
    for start, stop in pieces(lengths, cells):
        keep = lengths[rows] > start
        rows, changed = rows[keep], changed[keep]
        matrix = padded(codes, offsets[rows], lengths[rows], start, stop)
        differ = np.ones(matrix.shape, bool)
        differ[1:] = matrix[1:] != matrix[:-1]
        differ[1:] |= (changed[1:] != changed[:-1])[:, None]
        differ = np.logical_or.accumulate(differ, axis=1)
        for column in range(stop - start):
            held = np.flatnonzero(matrix[:, column] >= 0)
            begins = np.flatnonzero(differ[held, column])
            at = rows[held[begins]]
            ends = np.append(begins[1:], len(held))
            before = Depth(
                at, matrix[held[begins], column], ends - begins, np.minimum.reduceat(conv[rows[held]], begins),
                np.searchsorted(before.at, at, side="right") - 1, bool(at[0] == 0), bool(rows[held[-1]] == len(conv) - 1))
            out.append(before)
        changed = np.cumsum(differ[:, -1])
    return out


def sum_up(levels: list[Depth], words: np.ndarray) -> None:
    """Children, leaves and saved tokens of all nodes, deepest first; boundary nodes get the part of the nodes inside the shard."""
    below = None
    for level in reversed(levels):
        size = len(level.at)
        level.children, level.leaves, level.saved = (np.zeros(size, np.int64) for _ in range(3))
        if below is not None:
            groups = np.flatnonzero(np.diff(below.parent, prepend=-1))
            under = below.parent[groups]
            # what a boundary node has is added to its parent when it is closed
            finished = (~below.edges()).astype(np.int64)
            level.children[under] = np.add.reduceat(finished, groups)
            level.leaves[under] = np.add.reduceat(finished * below.leaves, groups)
            level.saved[under] = np.add.reduceat(finished * below.saved, groups)
        inside = ~level.edges()
        level.saved += np.where(inside, (level.n - 1) * words[level.code], 0)
        level.leaves += inside & (level.children == 0)
        below = level


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


NODE = (
    "shard int, side int, depth int, conv_id long, parent_conv_id long, parent_side int, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, hi long, lo long, words long, tree_hi long, tree_lo long, ends string")


def shard_rows(number: int, conv: np.ndarray, hi: np.ndarray, lo: np.ndarray, words: np.ndarray, lengths: np.ndarray, cells: int = CELLS) -> Iterator[dict]:
    """Columns of NODE for one shard.

    ``side`` is -1 for a finished node; 0 and 1 for a boundary node on the path of the first and (below
    what both share) the last row; 2 for the root's part, all rows without a turn and the sums of finished first turns.
    ``parent_side`` is set where the parent is a boundary node, whose conv_id is not known yet.
    """
    offsets = np.cumsum(lengths) - lengths
    codes, places = coded(hi, lo)
    order = sorted_rows(conv, codes, offsets, lengths, cells)
    conv, offsets, lengths = conv[order], offsets[order], lengths[order]
    levels = depths(conv, codes, offsets, lengths, cells)
    id_words = words[places]
    sum_up(levels, id_words)
    bare = conv[lengths == 0]
    top = levels[0] if levels else None
    inner = ~top.edges() if top else np.zeros(0, bool)
    yield {
        "shard": [number], "side": [2], "depth": [0], "conv_id": [int(conv.min())], "n_convs": [len(conv)], "n_children": [int(inner.sum())],
        "n_leaves": [int(top.leaves[inner].sum()) if top else 0], "saved_tokens": [int(top.saved[inner].sum()) if top else 0],
        "ends": [",".join(map(str, bare.tolist())) or None]}
    above, tree = None, None
    for depth, level in enumerate(levels, 1):
        marked = level.edges()
        size = len(level.at)
        side = np.full(size, -1)
        side[marked] = 1
        if level.first:
            side[0] = 0
        tree = level.code if above is None else tree[level.parent]
        up_marked = above.edges()[level.parent] if above is not None else np.ones(size, bool)
        up_side = np.where(level.parent == 0, 0 if above is None or above.first else 1, 1)
        ended = np.flatnonzero(lengths[level.at] == depth)
        ends = np.full(size, NOTHING, dtype=object)
        texts = np.full(size, None, dtype=object)
        for i in ended.tolist():
            begin, stop = int(level.at[i]), int(level.at[i] + level.n[i])
            own = conv[begin:begin + int(np.searchsorted(lengths[begin:stop], depth, side="right"))] if level.n[i] > 1 else conv[begin:stop]
            if marked[i]:
                texts[i] = ",".join(map(str, own.tolist()))
            else:
                ends[i] = digest(own)
        place = places[level.code]
        yield {
            "shard": np.full(size, number), "side": side, "depth": np.full(size, depth), "conv_id": level.conv,
            "parent_conv_id": np.where(up_marked, -1, above.conv[level.parent]) if above is not None else None,
            "parent_side": pa.array(up_side, mask=~up_marked),
            "n_convs": level.n, "n_children": level.children, "n_leaves": level.leaves, "saved_tokens": level.saved, "ends_sha256": ends,
            "hi": hi[place], "lo": lo[place], "words": words[place], "tree_hi": hi[places[tree]], "tree_lo": lo[places[tree]], "ends": texts}
        above = level


def batch_of(columns: dict, schema: T.StructType) -> pa.RecordBatch:
    """A batch of ``schema``; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    arrays = []
    for field in schema:
        kind, values = kinds[field.dataType.simpleString()], columns.get(field.name)
        arrays.append(pa.nulls(size, kind) if values is None else values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())


def sharded(rows: DataFrame, shard: int, cells: int) -> DataFrame:
    """NODE rows of all shards of ``rows`` (conv_id, turns)."""
    total = rows.agg(F.sum(F.size("turns"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard))
    schema = T.StructType.fromDDL(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if whole is None:
            return
        conv = whole.column("conv_id").to_numpy()
        lists = whole.column("turns").combine_chunks()
        lengths = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
        hi, lo, words = (np.asarray(x, dtype=np.int64) for x in lists.flatten().flatten())
        for made in shard_rows(TaskContext.get().partitionId(), conv, hi, lo, words, lengths, cells):
            for start in range(0, len(made["shard"]), 50_000):
                yield batch_of({k: v if v is None else v[start:start + 50_000] for k, v in made.items()}, schema)

    return cut(rows.repartitionByRange(parts, "turns", "conv_id").mapInArrow(run, schema))


CLOSED = (
    "known int, shard int, side int, depth int, of_shard int, of_side int, parent_shard int, parent_of_side int, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


class Open:
    """A boundary node that may go on in the next shard."""

    def __init__(self, row: dict):
        self.id, self.key, self.depth, self.words = (row["hi"], row["lo"]), (row["shard"], row["side"]), row["depth"], row["words"]
        self.conv, self.n, self.children, self.leaves, self.saved = row["conv_id"], 0, 0, 0, 0
        self.ends, self.ended = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        self.conv = min(self.conv, row["conv_id"])
        self.n, self.children, self.leaves, self.saved = (
            self.n + row["n_convs"], self.children + row["n_children"], self.leaves + row["n_leaves"], self.saved + row["saved_tokens"])
        if row["ends"] is not None:
            self.ends.update(("," if self.ended else "").encode() + row["ends"].encode())
            self.ended = True


def recombined(rows: Iterator[dict]) -> Iterator[tuple]:
    """CLOSED rows of boundary rows that come by first turn, shard, side and depth.

    ``known`` 0 tells which boundary node (of_shard, of_side, depth) a shard's row belongs to; 1 is a closed node.
    """
    stack: list[Open] = []
    tree = None

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            saved = node.saved + (node.n - 1) * node.words
            leaves = node.leaves + (node.children == 0)
            above = stack[-1].key if stack else (None, None)
            if stack:
                stack[-1].children, stack[-1].leaves, stack[-1].saved = stack[-1].children + 1, stack[-1].leaves + leaves, stack[-1].saved + saved
            yield (1, None, None, node.depth, *node.key, *above, node.conv, node.n, node.children, leaves, saved, node.ends.hexdigest())

    for row in rows:
        if tree != (row["tree_hi"], row["tree_lo"]):
            yield from close(0)
            tree = (row["tree_hi"], row["tree_lo"])
        depth = row["depth"]
        if len(stack) < depth or stack[depth - 1].id != (row["hi"], row["lo"]):
            yield from close(depth - 1)
            stack.append(Open(row))
        node = stack[depth - 1]
        node.add(row)
        yield (0, row["shard"], row["side"], depth, *node.key, *[None] * 8)
    yield from close(0)


def in_batches(rows: Iterator[tuple], schema: T.StructType, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch_of(dict(zip(schema.fieldNames(), map(list, zip(*held)))), schema)
            held = []
    if held:
        yield batch_of(dict(zip(schema.fieldNames(), map(list, zip(*held)))), schema)


def streamed(rows: DataFrame, work: Callable[[Iterator[dict]], Iterator[tuple]], ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(work(row for batch in batches for row in batch.to_pylist()), schema)

    return rows.mapInArrow(run, schema)


def all_ends(rows: Iterator[dict]) -> Iterator[tuple]:
    state, any_ = hashlib.sha256(), False
    for row in rows:
        state.update(("," if any_ else "").encode() + row["ends"].encode())
        any_ = True
    yield (state.hexdigest(),)


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, shard: int = SHARD, cells: int = CELLS) -> DataFrame:
    """One row per node: RESULT."""
    nodes = sharded(cut(rebuilt(conversations)), shard, cells)
    order = ["tree_hi", "tree_lo", "shard", "side", "depth"]
    edges = cut(streamed(nodes.where("side in (0, 1)").repartition("tree_hi", "tree_lo").sortWithinPartitions(*order), recombined, CLOSED))
    closed = edges.where("known = 1")
    # the root: what shards have finished, and the boundary first turns
    parts = nodes.where("side = 2").groupBy().agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).where("n_convs > 0")
    tops = closed.where("depth = 1").groupBy().agg(
        F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("l"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("s"))
    bare = streamed(nodes.where("side = 2 and ends is not null").select("shard", "ends").repartition(1).sortWithinPartitions("shard"), all_ends, "ends_sha256 string")
    root = cut(parts.withColumns({"c": tops.select("c").scalar(), "l": tops.select("l").scalar(), "s": tops.select("s").scalar(), "e": bare.scalar()}).select(
        "conv_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.col("c")).alias("n_children"),
        F.when(F.col("n_children") + F.col("c") == 0, 1).otherwise(F.col("n_leaves") + F.col("l")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("s")).alias("saved_tokens"), F.coalesce("e", F.lit(NOTHING)).alias("ends_sha256")))
    at_top = root.select("conv_id").scalar()
    named = closed.select(F.col("of_shard").alias("parent_shard"), F.col("of_side").alias("parent_of_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    met = closed.join(named, ["parent_shard", "parent_of_side", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, at_top).otherwise(F.col("above")))
    local = edges.where("known = 0").select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("of_shard").alias("parent_shard"), F.col("of_side").alias("parent_of_side"))
    resolved = local.join(named, ["parent_shard", "parent_of_side", "depth"]).select("shard", "parent_side", "depth", "above")
    inside = nodes.where("side = -1")
    # few boundary rows to a shard, so neither side of this join has a hot key
    rest = inside.where("parent_side is not null and depth > 1").join(resolved, ["shard", "parent_side", "depth"], "left").withColumn("parent_conv_id", F.col("above"))
    plain = inside.where("parent_side is null or depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, at_top).otherwise(F.col("parent_conv_id")))
    every = [root, met, rest, plain]
    out = every[0].select(*RESULT)
    for part in every[1:]:
        out = out.unionAll(part.select(*RESULT))
    return out.withColumn("depth", F.col("depth").cast("long"))


def trie_sql() -> str:
    """The same in DuckDB's SQL, over ``conversations``: every prefix of every rebuilt conversation, grouped."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, b: {step}), 4294967295)"
    return f"""
        WITH own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
                     FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        built AS MATERIALIZED (
            SELECT o.conv_id, list_concat(coalesce(h.turns, [])[1: {crc.replace('conv_id', 'o.conv_id')} % {HEAD + 1}], o.turns[{crc.replace('conv_id', 'o.conv_id')} % {HEAD + 1} + 1:]) AS turns
            FROM own o LEFT JOIN own h ON h.conv_id = o.conv_id - o.conv_id % {HOSTED}),
        prefixes AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
        keyed AS MATERIALIZED (
            SELECT conv_id, depth, len(turns) = depth AS ends, md5(CAST(turns[1:depth] AS VARCHAR)) AS key,
                   CASE WHEN depth > 0 THEN md5(CAST(turns[1:depth - 1] AS VARCHAR)) END AS above,
                   CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM prefixes),
        nodes AS MATERIALIZED (
            SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own_saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM keyed GROUP BY depth, key),
        families AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.above = n.key) AS n_children FROM nodes n),
        lines AS (SELECT DISTINCT a.depth AS up_depth, a.key AS up_key, b.depth, b.key FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        totals AS (SELECT up_depth, up_key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens
                   FROM lines JOIN families USING (depth, key) GROUP BY ALL)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
        FROM families f JOIN totals ON up_depth = f.depth AND up_key = f.key LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.key = f.above
    """
