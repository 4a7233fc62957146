"""SpotSigs document fingerprints, in DataFrame functions only.

A text is read as lower-case words. Anchors are very common words; a signature is the
chain of the next content words after an anchor, stop words and words of one or two letters
left out. A long stretch without an anchor starts a chain every eighth word. A text too
short for chains is the set of its content words, and of its letter trigrams. The fingerprint is the sorted set of
32-bit hashes of the signatures, written in hex.

Likeness is the Jaccard index of two sets. The ratio of their sizes bounds it, so pairs
whose set lengths lie too far apart are settled without an intersection; the set lengths fall into
partitions by powers of the wanted likeness, and similar sets lie in one partition or two
neighbouring ones.

Cases: a null text is the empty text; texts without any word are one signature, themselves;
equal texts have equal fingerprints; without another row a document follows itself; rows
without doc_id come last, rows of one doc_id in the order of their texts' hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Anchors, very common words of four languages.
ANCHORS = "the a an is was be to that der die das ist ein eine zu den le la les un une est des du el los las es que una por".split()
# Other common words of three letters and more, which are no content.
STOP = (
    "and for are with this from have not but you all has had his her they she were been their which will would there what when who can more its "
    "und von mit auf für sich auch dem nicht sie als aus bei nach wie oder aber nur noch werden wird sind hat war ich einen einem einer eines "
    "dans pour par sur pas qui avec plus son ses ont sont mais comme nous vous ils elle cette aux être tout fait "
    "con para del como más pero sus este esta son entre cuando muy sin sobre ser tiene también hasta hay donde todo nos"
).split()
#: content words of a chain, and of a stretch that starts a new one
CHAIN, STRETCH = 3, 8
#: by characters (as words): texts under TINY give letter trigrams, under SHORT content words, over LONG chains;
#: the ranges overlap, so an edit that moves a text over a border keeps part of its set
TINY, LONG, SHORT = 100, 400, 1200
#: rows that follow one another in one task
ROWS = 4000
BUCKETS = 1024


def any_of(words: list[str]) -> str:
    """A pattern for any of the words that looks at their first letter once."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True))})" for c in firsts)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted array of the hashes of a text's signatures.

    Each step is a column of its own, so that none is computed again where the next one names it twice.
    """
    whole, words, content, chains, single = (F.col(f"_{out}_{name}") for name in ("whole", "words", "content", "chains", "single"))
    marked = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), f" (?:{any_of(ANCHORS)})(?= )", "\n")
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(words) - 2)), lambda i: F.substring(words, i, F.lit(3)))
    size, none = F.length(words), F.array().cast("array<string>")
    every = F.concat(
        F.when((size > 0) & (size < TINY), letters).otherwise(none), F.when((size < SHORT) | (F.size(chains) == 0), single).otherwise(none), F.when(size >= LONG, chains).otherwise(none)
    )
    found = F.col(f"_{out}_every")
    steps = {
        "whole": F.coalesce(F.col(text), F.lit("")),
        "words": F.trim(F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}]+", " ")),
        "content": F.regexp_replace(marked, f" (?:\\S{{1,2}}|{any_of(STOP)})(?=[ \\n])", ""),
        "chains": F.regexp_extract_all(content, F.lit(rf"(\S+(?: \S+){{1,{CHAIN - 1}}})(?: \S+){{0,{STRETCH - CHAIN}}}"), F.lit(1)),
        "single": F.when((F.length(words) < SHORT) | (F.size(chains) == 0), F.regexp_extract_all(content, F.lit(r"\S+"), F.lit(0))),
        "every": every,
        "found": F.when(F.size(found) > 0, found).otherwise(F.array(whole)),
    }
    rows = df
    for name, step in steps.items():
        rows = rows.withColumn(f"_{out}_{name}", step)
    hashes = F.sort_array(F.array_distinct(F.transform(f"_{out}_found", lambda s: F.hash(s).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    return rows.withColumn(out, hashes).drop(*[f"_{out}_{name}" for name in steps])


def hex_digits(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def length_partition(size: Column, likeness: float) -> Column:
    """Number of the partition of a set length; sets at least this alike are at most one partition apart."""
    return F.floor(F.log(size) / math.log(1 / likeness)).cast("int")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard index of two sets of hashes; zero without looking where their lengths keep it under ``at_least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = F.when(a == b, 1.0).otherwise(shared / (small + large - shared))
    return F.when(small < F.lit(at_least) * large, 0.0).otherwise(exact) if at_least else exact


def followed(df: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """``df`` with ``next``: the ``carried`` columns of the row after it by descending ``order``, after the last the first.

    Rows are dealt into buckets of neighbouring keys at approximate quantiles. Each bucket also gets
    the first row of the bucket after it, so that a window within buckets sees every row's follower.
    """
    rows = df.count()
    many = max(1, min(BUCKETS, rows // ROWS))
    bounds = sorted(set(df.select(F.percentile_approx(order, [k / many for k in range(1, many)], 100 * many)).first()[0] or [])) if many > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    own = F.when(F.col(order).isNull(), -1).otherwise(bucket)
    place = F.struct(F.col(order).isNotNull().alias("named"), F.col(order).alias("key"), F.xxhash64(*carried).alias("tie"))
    dealt = df.withColumn("_bucket", own).withColumn("_place", place)
    # at most BUCKETS + 1 rows: the heads, each moved to the bucket before its own
    heads = dealt.groupBy("_bucket").agg(F.max_by(F.struct(*carried), "_place").alias("_head"))
    line = Window.orderBy(F.desc("_bucket"))
    around = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = heads.select("_bucket", F.coalesce(F.lead("_head").over(line), F.first("_head").over(around)).alias("next"))
    guests = moved.select("_bucket", F.lit(None).cast(dealt.schema["_place"].dataType).alias("_place"), F.col("next").alias("_row"), F.lit(True).alias("_guest"))
    both = dealt.select("_bucket", "_place", F.struct(*carried).alias("_row"), F.lit(False).alias("_guest"), *[c for c in df.columns if c not in carried]).unionByName(guests, allowMissingColumns=True)
    within = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_place"))
    seen = both.withColumn("next", F.lead("_row").over(within)).where("not _guest")
    return seen.select(*[c for c in df.columns if c not in carried], "_row.*", "next")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint next to those of its edited text and of the next document."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    row = followed(with_signatures(plain, "text", "sigs"), "doc_id", ["text", "sigs"]).withColumn("n_chars", F.length("text").cast("long"))
    changed = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(floor(n_chars / 3) as int))"), F.substring(F.col("next.text"), F.lit(1), changed))
    row = with_signatures(row.withColumn("edited", edited), "edited", "edited_sigs")
    return row.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hex_digits(F.col("sigs")).alias("fingerprint"), hex_digits(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )
