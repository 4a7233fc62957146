"""A Merkle manifest of a dataset, with a proof and a verdict for every row.

Every row is a leaf: H (lowercase hex SHA-256 of concatenated text) of its fields. Per ``lang`` the leaves ascend
by doc_id and every FAN consecutive ones become their H until one node is left, the subroot; subroots by lang
make the root in the same way.

Hex digests are 64 bytes, one block of SHA-256, so a parent's hash can stop before any child: it is built
child by child, and the copied hash state before a child's slot is retained. Replacing that child
resumes the state with the replacement and the right siblings alone; nothing to the left is hashed again.

Spark's part: the digests of all rows are taken natively and written once; the narrow rows are range-partitioned
by (lang, doc_id), numbered per partition, and shifted by the counts of the partitions before. Positions
make blocks of FAN ** DEPTH leaves, whatever the size of a language; a block's top is a leaf of the next tier, and
tiers repeat until each language has one node. Paths from a block to the root are small (a few KB for a block of
4,096 rows) and come down tier by tier by equi joins; a block and its path meet in one group, where the states
above the block are set up once and resumed for each of its rows. No task sees more than one block
at a time; the driver fetches the largest position only.

Cases: null fields are ``-``; a null lang is a language of its own and comes first; a null doc_id comes first in
its language and is never tampered with; rows of one doc_id follow by their leaf, and rows equal in both are interchangeable;
columns besides the five fields are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import cut

FAN = 8
#: levels of a block: 4,096 leaves
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf, tampered: the tampered leaf of the rows whose doc_id has a crc32 that 3 divides, else null."""
    own = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    # a null tree comes first, and its key is the smallest text
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(own).alias("leaf"),
                       F.when(hit, leaf(own | {"text": ascii_lower(F.col("text"))})).alias("tampered"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``: 0, 1, 2 ... in ``order`` within each tree, of any size.

    The range-partitioned rows are kept, because where the ranges lie may differ when a part is computed again.
    """
    # equal rows may be a large share of all: a last, arbitrary column spreads them over partitions
    keyed = cut(rows.withColumn("_any", F.monotonically_increasing_id()))
    ranged = keyed.repartitionByRange(tree, *order, "_any").sortWithinPartitions(tree, *order, "_any").drop("_any")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            spots = []
            for key in batch.column(tree).to_pylist():
                n = n + 1 if key == last else 0
                last = key
                spots.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(spots, pa.int64())], names=[*batch.schema.names, "_part", "_spot"])

    local = cut(ranged.mapInArrow(number, T.StructType([*ranged.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_spot", T.LongType())])))
    counts = local.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(tree).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(tree, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(shifts, [tree, "_part"]).withColumn("pos", F.col("_before") + F.col("_spot")).drop("_part", "_spot", "_before")


class Parent:
    """A node with the hash state before each child's slot."""

    __slots__ = ("states", "children", "digest")

    def __init__(self, children: list[str]):
        self.states, self.children = [], children
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update("".join([replacement, *self.children[slot + 1:]]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1:])


def levels(nodes: list[str], height: int) -> list[list[Parent]]:
    """Parents of a block level by level, ``height`` of them, or until one node is left if that is None."""
    made: list[list[Parent]] = []
    while len(made) < height if height is not None else len(nodes) > 1:
        made.append([Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in made[-1]]
    return made


def height_of(size: int, depth: int) -> int | None:
    """Levels within a block of a tree of ``size`` leaves: all blocks of a large tree are equally high."""
    return depth if size > FAN ** depth else None


TIER = "tree string, block long, size long, top string"
PATH = "tree string, block long, path array<struct<left:array<string>,right:array<string>>>"


def tops(rows: DataFrame, depth: int) -> DataFrame:
    """tree, block, size, top: the node that each block of ``rows`` (tree, pos, size, node) becomes."""

    def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        nodes = block.sort_values("pos")["node"].tolist()
        size = int(block["size"].iloc[0])
        made = levels(nodes, height_of(size, depth))
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "size": [size], "top": [made[-1][0].digest if made else nodes[0]]})

    blocks = rows.select("tree", F.expr(f"pos div {FAN ** depth}").alias("block"), "pos", "size", "node")
    return blocks.groupBy("tree", "block").applyInPandas(top, TIER)


def paths(rows: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """tree, block, path: from each node of ``rows`` its siblings on all levels, its own block's and then those of ``above``."""

    def down(key: tuple, block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        made = levels(block["node"].tolist(), height_of(int(block["size"].iloc[0]), depth))
        rest = [dict(left=list(s["left"]), right=list(s["right"])) for s in over["path"].iloc[0]]
        out = []
        for i in range(len(block)):
            steps = []
            for level in made:
                parent, slot = level[i // FAN], i % FAN
                steps.append({"left": parent.children[:slot], "right": parent.children[slot + 1:]})
                i //= FAN
            out.append(steps + rest)
        return pd.DataFrame({"tree": block["tree"].tolist(), "block": block["pos"].tolist(), "path": out})

    blocks = rows.select("tree", F.expr(f"pos div {FAN ** depth}").alias("block"), "pos", "size", "node")
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(down, PATH)


OUT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def fold(rows: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """The result rows: every leaf's proof, and the root after its replacement (if any) is folded in."""

    def block_of(key: tuple, block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        own = block["leaf"].tolist()
        made = levels(own, height_of(int(block["size"].iloc[0]), depth))
        top = made[-1][0].digest if made else own[0]
        subroot, root = over["subroot"].iloc[0], over["root"].iloc[0]
        # above the block one parent per level, its state before this block's slot retained for all rows
        spine, node = [], top
        for step in over["path"].iloc[0]:
            left, right = list(step["left"]), list(step["right"])
            parent = Parent([*left, node, *right])
            spine.append((parent, len(left)))
            node = parent.digest
        over_proof = "".join(p.siblings(slot) for p, slot in spine).encode()
        proofs, roots = [], []
        for i, (digest, tampered) in enumerate(zip(own, block["tampered"])):
            steps = []
            for level in made:
                steps.append((level[i // FAN], i % FAN))
                i //= FAN
            proofs.append(hashlib.sha256("".join(p.siblings(slot) for p, slot in steps).encode() + over_proof).hexdigest())
            now = tampered if isinstance(tampered, str) else digest
            for parent, slot in [*steps, *spine]:
                now = parent.folded(slot, now)
            roots.append(now)
        return pd.DataFrame({
            "doc_id": block["doc_id"], "leaf": own, "subroot": subroot, "root": root, "proof_sha256": proofs,
            "folded_root": roots, "verified": [r == root for r in roots]})

    blocks = rows.select("tree", F.expr(f"pos div {FAN ** depth}").alias("block"), "pos", "size", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered")
    made = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(block_of, OUT)
    # as text on the way: pandas would make floats of whole numbers beside a null
    return made.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))


def tree_of(rows: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of blocks over numbered ``rows`` (tree, pos, size, node), lowest first, and (tree, node): the root of each tree."""
    tiers = []
    while True:
        made = cut(tops(rows, depth))
        tiers.append(rows)
        if not made.where("block > 0").head(1):
            return tiers, made.select("tree", F.col("top").alias("node"))
        sizes = made.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
        rows = made.select("tree", F.col("block").alias("pos"), F.col("top").alias("node")).join(sizes, "tree")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    ranked = numbered(leaves(docs), "tree", ["doc_id", "leaf"])
    sizes = ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    rows = cut(ranked.join(sizes, "tree"))
    nodes = rows.select("tree", "pos", "size", F.col("leaf").alias("node"))
    tiers, subroots = tree_of(nodes, depth)
    # the languages are the leaves of one more tree
    named = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), "tree", ["lang"])
    upper = cut(named.join(named.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "tree"))
    upper_tiers, root = tree_of(upper.select("tree", "pos", "size", "node"), depth)
    path = root.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<struct<left:array<string>,right:array<string>>>").alias("path"))
    for tier in reversed(upper_tiers):
        path = paths(tier, path, depth)
    path = path.withColumnRenamed("block", "pos").join(upper.drop("size"), ["tree", "pos"]).select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("block"), "path")
    for tier in reversed(tiers[1:]):
        path = paths(tier, path, depth)
    whole = path.join(subroots.withColumnRenamed("node", "subroot"), "tree").withColumn("root", root.select("node").scalar())
    return fold(rows, whole, depth)


def manifest_sql() -> str:
    """The same in DuckDB's SQL, over ``documents``: all trees grow level by level in one recursion."""
    spelled = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {{{c}}}, '-')" for c in FIELDS)
    whole = spelled.format(**{c: f"CAST({c} AS VARCHAR)" for c in FIELDS})
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = spelled.format(**{c: f"CAST({c} AS VARCHAR)" for c in FIELDS} | {"text": low})
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: {step}), 4294967295)"

    def grown(name: str, base: str) -> str:
        return f"""{name} AS (
            SELECT tree, level, pos, node, size FROM {base}
            UNION ALL
            SELECT tree, level + 1, pos // {FAN}, sha256(string_agg(node, '' ORDER BY pos)), CAST(ceil(any_value(size) / {FAN}.0) AS BIGINT) FROM {name}
            WHERE size > 1 GROUP BY tree, level, pos // {FAN})"""

    return f"""
        WITH RECURSIVE leaf AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({whole}) AS leaf,
                   CASE WHEN {crc} % 3 = 0 THEN sha256({tampered}) END AS tampered FROM documents),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaf),
        start AS (SELECT tree, 0 AS level, pos, leaf AS node, size FROM placed),
        {grown('low', 'start')},
        sub AS MATERIALIZED (SELECT tree AS lang, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
        upstart AS (SELECT '' AS tree, 0 AS level, pos, node, size FROM sub),
        {grown('up', 'upstart')},
        root AS (SELECT node AS root FROM up WHERE size = 1),
        spots AS MATERIALIZED (
            SELECT tree, 0 AS part, level, pos, node, size FROM low WHERE size > 1 UNION ALL SELECT tree, 1, level, pos, node, size FROM up WHERE size > 1),
        kin AS MATERIALIZED (SELECT tree, part, level, pos // {FAN} AS parent, list(node ORDER BY pos) AS nodes FROM spots GROUP BY ALL),
        walk AS (
            SELECT p.doc_id, p.leaf, p.tree, p.pos AS own, 0 AS part, 0 AS level, p.tree AS at_tree, p.pos, coalesce(p.tampered, p.leaf) AS now, '' AS proof FROM placed p
            UNION ALL
            SELECT w.doc_id, w.leaf, w.tree, w.own, CASE WHEN k.nodes IS NULL THEN 1 ELSE w.part END, CASE WHEN k.nodes IS NULL THEN 0 ELSE w.level + 1 END,
                   CASE WHEN k.nodes IS NULL THEN '' ELSE w.at_tree END,
                   CASE WHEN k.nodes IS NULL THEN s.pos ELSE w.pos // {FAN} END,
                   CASE WHEN k.nodes IS NULL THEN w.now ELSE sha256(array_to_string(list_concat(k.nodes[1: w.pos % {FAN}], [w.now], k.nodes[w.pos % {FAN} + 2:]), '')) END,
                   CASE WHEN k.nodes IS NULL THEN w.proof ELSE w.proof || array_to_string(list_concat(k.nodes[1: w.pos % {FAN}], k.nodes[w.pos % {FAN} + 2:]), '') END
            FROM walk w JOIN sub s ON s.lang = w.tree LEFT JOIN kin k ON k.tree = w.at_tree AND k.part = w.part AND k.level = w.level AND k.parent = w.pos // {FAN}
            WHERE k.nodes IS NOT NULL OR w.part = 0)
        SELECT doc_id, leaf, sub.node AS subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
        FROM walk JOIN sub ON sub.lang = walk.tree, root
        QUALIFY row_number() OVER (PARTITION BY walk.tree, own ORDER BY part DESC, level DESC) = 1
    """
