"""Near copies by word shingles: SimHash tables propose pairs, exact Jaccard similarity decides.

Two texts are near copies if their sets of ``WORDS``-word shingles have a Jaccard similarity of ``LIKENESS`` or more;
groups are what such links connect. SimHash of the shingles themselves would differ in nine or ten of 64 bits
at 0.8, too many for covering tables. A changed word takes five shingles but only one word of the text, so the
fingerprints that propose pairs are of the *set of words*, twice with independent hashes. The covering masks of
``simhash`` find every pair within ``CLOSE`` bits of either fingerprint, and about half of those one or two bits further;
what a bucket holds within ``REACH`` bits is proposed.

1. Texts of one shingle set are one node; only nodes (narrow rows) enter the tables, and a bucket gives a spanning forest.
2. Each node is checked against the partner that most nodes were proposed for: in a group of edited
   copies of one text that is the text. Lengths that forbid the similarity are never checked.
3. A link that the check refuses connects nothing. So among the nodes with any link, all pairs of different groups with enough
   shingles in common are then found by an exact similarity join and checked, whether a link proposed them or not.

Sets of shingles are made for the nodes of proposals only, and two of them meet in a row of a join.
Texts are shuffled only where a map of doc_ids (at most ``MAP_BITS`` bits, broadcast) says that theirs may be asked for;
a join decides on those. A map too small for a table lets more texts through, never fewer.

Cases: rows without doc_id can't be named: they take no part and all stay. Null and empty texts have no shingle and are copies
of one another; fewer than ``WORDS`` words are one shingle. Rows that share a doc_id: one stays. Columns of any name stay
as they are; an empty table gives an empty one. Ties go to the smaller node and the smaller doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from .common import components, cut, with_arrow_columns, words_of
from .simhash import SEED, links, majority, shingle_hashes

WORDS, LIKENESS = 5, 0.8
CLOSE, REACH = 5, 9
MAP_BITS = 1 << 24
MARKS = 16
PRINTS = ("p0", "p1")


def shingle_set(text: str) -> np.ndarray:
    hashes = shingle_hashes(text, WORDS)
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(hashes)))


def node_of(shingles: np.ndarray) -> int:
    """The name of a shingle set, a signed long; zero for the empty one."""
    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64)) if len(shingles) else 0


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each value, independent of its bits."""
    x = hashes ^ (hashes >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sketched(df: DataFrame) -> DataFrame:
    """doc_id, node, n (shingles of the set), and the fingerprints of the set of words."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            sets = [shingle_set(t) for t in texts]
            words = [set(words_of(t)) for t in texts]
            counts = np.array([len(w) for w in words], dtype=np.int64)
            flat = np.fromiter((xxh64_intdigest(w, SEED) for own in words for w in own), dtype=np.uint64, count=int(counts.sum()))
            prints = [majority(h, counts).view(np.int64) for h in (flat, mixed(flat))]
            return [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, prints)]

        return work

    made = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "n", *PRINTS)])
    return with_arrow_columns(df, "text", made, make).select("doc_id", *made.fieldNames())


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """A map of ``MARKS`` words: the bit of each shingle, by its own lowest digits."""
    out = np.zeros(MARKS, dtype=np.uint64)
    np.bitwise_or.at(out, (shingles >> np.uint64(6)) % np.uint64(MARKS), np.uint64(1) << (shingles & np.uint64(63)))
    return out.view(np.int64)


def shingled(df: DataFrame) -> DataFrame:
    """node, its shingles and their map, one row per text."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            sets = [shingle_set(t) for t in texts]
            return [pa.array([node_of(s) for s in sets], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in ([s.view(np.int64) for s in sets], [bits_of(s) for s in sets]))]

        return work

    made = T.StructType([T.StructField("node", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("shingles", "bits")]])
    return with_arrow_columns(df, "text", made, make).select("node", "shingles", "bits")


def met(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of near fingerprints, u < v: they connect whatever nodes the tables bring together, but are not all pairs of them."""
    found = None
    for p in PRINTS:
        first = nodes.groupBy(p).agg(F.min("node").alias("first"))
        alike = nodes.join(first, p).select(F.col("node").alias("a"), F.col("first").alias("b"))
        a, b = (first.select(F.col(p).alias(c), F.col("first").alias(f"{c}_node")) for c in ("a", "b"))
        apart = links(first.select(p), p, CLOSE, REACH).join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        found = alike.unionAll(apart) if found is None else found.unionAll(alike).unionAll(apart)
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()


def possible(m: str, n: str) -> F.Column:
    """Whether sets of so many shingles can be similar enough."""
    return F.least(m, n) >= LIKENESS * F.greatest(m, n)


def proposals(links_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links (u, v) worth checking: those whose lengths allow the similarity."""
    sizes = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    return links_.join(sizes("u"), "u").join(sizes("v"), "v").where(possible("n_u", "n_v")).select("u", "v")


def across(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes of different groups, among them all whose shingle sets are similar enough. ``groups``: node, group.

    Similar sets share LIKENESS of the larger one. So in any one order of all shingles they share one of the first few of each,
    all but that share and one more. Shingles that one group holds alone come first in that order and meet nothing, then the rarer ones:
    a text with too many of its own is done, and one key is seldom met by many. A bit that only one of two maps has is a shingle
    that the other lacks, so most pairs that are not similar end before their sets meet.
    """
    each = sets.join(groups, "node").select("node", "group", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = each.groupBy("s").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi").select("s", "held")
    own = each.join(held, "s").groupBy("node", "group", "n").agg(F.sort_array(F.collect_list(F.struct("held", "s"))).alias("order"))
    # the least that a set shares with a similar one, in whole numbers; a shingle of the group alone takes up one of the first places
    least = F.ceil(F.col("n") * round(100 * LIKENESS) / 100 - 1e-9)
    first = (F.size("order") - least + 1).cast("int")
    keyed = own.where(first > 0).select("node", "group", "n", F.explode(F.slice("order", F.lit(1), first)["s"]).alias("s"))
    side = lambda c: keyed.select("s", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "group", "n")])
    pairs = side("u").join(side("v"), "s").where("node_u < node_v AND group_u <> group_v").where(possible("n_u", "n_v"))
    pairs = pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()
    marks = lambda c: sets.select(F.col("node").alias(c), F.size("shingles").alias(f"n_{c}"), F.col("bits").alias(f"b_{c}"))
    lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda x, y: x + y)
    most = F.least(F.col("n_u") - lacks("b_u", "b_v"), F.col("n_v") - lacks("b_v", "b_u"))
    return pairs.join(marks("u"), "u").join(marks("v"), "v").where(enough(most, F.col("n_u"), F.col("n_v"))).select("u", "v")


def to_hubs(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs that with the partner most nodes are paired with."""
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(pairs.select("v", "u"))
    weight = ends.groupBy("node").agg(F.count(F.lit(1)).alias("asked"))
    hubs = ends.join(weight.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.max(F.struct("asked", "other")).alias("hub"))
    return hubs.select(F.least("node", "hub.other").alias("u"), F.greatest("node", "hub.other").alias("v")).distinct()


def enough(shared: F.Column, m: F.Column, n: F.Column) -> F.Column:
    """shared / union >= LIKENESS, in whole numbers where LIKENESS is a hundredth."""
    return shared * (100 + round(100 * LIKENESS)) >= round(100 * LIKENESS) * (m + n)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("s_u", "s_v"))
    return both.where(enough(shared, F.size("s_u"), F.size("s_v"))).select("u", "v")


def perhaps(df: DataFrame, ids: DataFrame, doc_id: str, mark: str) -> DataFrame:
    """``df`` with the column ``mark``: false where the doc_id is null or surely none of ``ids``."""
    place = lambda of: F.pmod(F.xxhash64(of), F.lit(MAP_BITS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    word, bits = f"{mark}_word", f"{mark}_bits"
    at = place(ids.columns[0])
    words = ids.select(F.floor(at / 64).alias(word), bit(at).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    own = place(doc_id)
    both = df.withColumn(word, F.floor(own / 64)).join(F.broadcast(words), word, "left")
    there = F.col(doc_id).isNotNull() & F.coalesce(F.col(bits).bitwiseAND(bit(own)) != 0, F.lit(False))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], there.alias(mark))


def near_copies(df: DataFrame) -> DataFrame:
    """(doc_id, text) with doc_id not null: one row per row, doc_id and group, the smallest doc_id of its near copies."""
    rows = cut(sketched(df))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.min(c).alias(c) for c in ("n", *PRINTS)]))
    near = cut(met(nodes))
    members = cut(near.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node"))
    pairs = proposals(near, members)
    asked = members.select(F.col("first_id").alias("doc_id")).distinct()
    texts = perhaps(df, asked, "doc_id", "_asked").where("_asked").drop("_asked").join(asked, "doc_id", "left_semi")
    sets = cut(shingled(texts).join(members.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    grouped = lambda links_: cut(members.select("node").join(components(links_, "u", "v"), "node", "left").select("node", F.coalesce("root", "node").alias("group")))
    sure = cut(alike(to_hubs(cut(pairs)), sets))
    # links are a forest: one that the check refuses may have been all that joined two others, so from here on every pair counts
    rest = cut(across(sets, grouped(sure)))
    sure = cut(sure.unionAll(alike(to_hubs(rest), sets)))
    group = grouped(sure)
    of = lambda c: group.select(F.col("node").alias(c), F.col("group").alias(f"r_{c}"))
    open_ = rest.join(of("u"), "u").join(of("v"), "v").where("r_u <> r_v").select("u", "v")
    roots = components(sure.unionAll(alike(open_, sets)), "u", "v")
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("group"))
    return rows.select("doc_id", "node").join(rooted.join(names, "root").select("node", "group"), "node").select("doc_id", "group")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row of the smallest doc_id stays."""
    named = df.where(F.col(doc_id).isNotNull())
    found = near_copies(named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    # a row that goes shares its doc_id with one of these
    fates = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("group")).alias("keeps")))
    longer = "_" * max(map(len, df.columns))
    mark, number = "_mark" + longer, "_row" + longer
    marked = perhaps(df, fates.where("rows > 1 OR NOT keeps").select("doc_id"), doc_id, mark)
    keepers = fates.where("keeps").select(F.col("doc_id").alias(doc_id))
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(text), F.xxhash64(*df.columns))
    one = marked.where(mark).drop(mark).join(keepers, doc_id, "left_semi").withColumn(number, F.row_number().over(order)).where(f"{number} = 1").select(*df.columns)
    return one.unionByName(marked.where(~F.col(mark)).drop(mark))
