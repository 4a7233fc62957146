"""Law articles in text: mentions, the canonical form and the article light."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reconlink.functions.spans import all_spans, overlaps
from reconlink.functions.text import NULL_LITERALS, fold, let, text

# The spellings of "article" and "part".
ARTICLE_MARK = r"(?:ст\.?|статья|статьи|статье|статью)"
PART_MARK = r"(?:ч\.?|част(?:ь|и|е|ью))"
NUMBER = r"(\d+(?:\.\d+)*)"
PART_THEN_ARTICLE = rf"(?iuU)(?:\bпо\b\s*)?\b{PART_MARK}\s*(\d+)\s*\b{ARTICLE_MARK}\s*{NUMBER}"
ARTICLE_THEN_PART = rf"(?iuU)(?:\bпо\b\s*)?\b{ARTICLE_MARK}\s*{NUMBER}\s*\b{PART_MARK}\s*(\d+)"
PART_OF_ARTICLE = rf"(?iuU)\b{PART_MARK}\s*(\d+)\s*\b{ARTICLE_MARK}(?:\s+\d+)?\s*{NUMBER}"
ARTICLE_ONLY = rf"(?iuU)(?:\bпо\b\s*)?\b{ARTICLE_MARK}\s*{NUMBER}"


def _canonical(article: Column, part: Column | None) -> Column:
    if part is None:
        return article
    return F.when(part != "", F.concat(article, F.lit(" ч. "), part)).otherwise(article)


def _found(value, pattern: str, article_group: int, part_group: int | None) -> Column:
    def build(m: Column) -> Column:
        part = None if part_group is None else F.regexp_extract(m["text"], pattern, part_group)
        return F.struct(
            _canonical(F.regexp_extract(m["text"], pattern, article_group), part).alias("article"),
            m["start"].alias("start"), m["end"].alias("end"),
        )

    return F.transform(all_spans(value, pattern), build)


def article_mentions(value) -> Column:
    """array<struct<article,start,end>>; the first one is the article of the text.

    Overlapping readings of the same words are given once.
    """
    paired = F.concat(
        _found(value, PART_THEN_ARTICLE, 2, 1),
        _found(value, ARTICLE_THEN_PART, 1, 2),
        _found(value, PART_OF_ARTICLE, 2, 1),
    )
    once = let(paired, lambda every: F.filter(
        every, lambda m, i: ~F.exists(F.slice(every, 1, i), lambda earlier: overlaps(earlier, m))))
    return let(once, lambda found: F.when(F.size(found) > 0, found).otherwise(_found(value, ARTICLE_ONLY, 1, None)))


def article_of(value) -> Column:
    return F.try_element_at(article_mentions(value), F.lit(1))["article"]


def article_key(value) -> Column:
    """'article|part' for comparing, NULL when there is no article."""
    plain = fold(value)
    part = F.regexp_extract(plain, r"(?iuU)(?:\bч\.?|\bчаст(?:ь|и|е|ью))\s*(\d+)", 1)
    marked = F.regexp_extract(plain, rf"(?iuU)\b{ARTICLE_MARK}\s*{NUMBER}", 1)
    scrubbed = F.regexp_replace(plain, r"(?iuU)(?:\bч\.?|\bчаст(?:ь|и|е|ью))\s*\d+", " ")
    bare = F.regexp_extract(scrubbed, rf"(?U)\b{NUMBER}\b", 1)
    article = F.when(marked != "", marked).otherwise(bare)
    usable = text(value).isNotNull() & ~plain.isin(*NULL_LITERALS) & (article != "")
    return F.when(usable, F.concat(article, F.lit("|"), part))


def article_light(extracted, ruled, registered) -> Column:
    """green: report agrees with rule and registry; yellow: with the registry only; else red."""
    e, r, d = article_key(extracted), article_key(ruled), article_key(registered)
    with_registry = F.coalesce(e == d, F.lit(False))
    with_rule = F.coalesce(e == r, F.lit(False))
    return F.when(with_registry & with_rule, "green").when(with_registry, "yellow").otherwise("red")
