"""Text folds and token helpers as column expressions (all inside codegen)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Characters and words the folds must treat as given.
SPACE_CHARS = "\u00a0\u202f\u2007"
ZERO_WIDTH = "\u200b"
NULL_LITERALS = ("", "null", "none", "-", "—")
DASHES = "–—−"
REGEX_CHARS = r"[.^$*+?{}\[\]\\|()]"
CATEGORY_STOP_WORDS = (
    "что", "этот", "быть", "при", "или", "для", "как", "также", "было", "были", "когда",
    "года", "год", "так", "того", "под", "над", "между", "без", "лишь", "после", "перед",
    "если", "весь", "всех", "про", "это", "эти", "этом", "текст", "сводка", "данные",
    "был", "она", "они", "его", "ему", "нее", "них", "the", "this", "that", "with", "from",
)
CATEGORY_GENERIC_TOKENS = (
    "право", "правонарушение", "правонарушения", "признаки", "признак", "статья",
    "закона", "кодекса", "материал", "материалы", "дело", "состав", "административн",
    "уголовн", "российск", "федерации", "нарушение", "лицо", "факт", "установлено",
)
CATEGORY_TOKEN = "[а-яёa-z0-9]+"
ACRONYM = r"(?U)\b[A-ZА-ЯЁ]{2,6}\b"


def text(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, however often ``body`` names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_pattern(value: str) -> str:
    """A pattern matching ``value`` as is."""
    return "\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def squeeze(value) -> Column:
    """Every run of white space to one blank, ends trimmed; NULL to ''."""
    return F.trim(F.regexp_replace(F.coalesce(text(value), F.lit("")), r"(?U)\s+", " "))


def yo_fold(value) -> Column:
    return F.translate(F.lower(text(value)), "ё", "е")


def fold(value) -> Column:
    """Comparison form of free text."""
    spaced = F.translate(F.coalesce(text(value), F.lit("")), SPACE_CHARS + ZERO_WIDTH, " " * len(SPACE_CHARS))
    return squeeze(yo_fold(spaced))


def compare_value(value) -> Column:
    """``fold`` with the spelled-out nothings as NULL."""
    folded = fold(value)
    return F.when(~folded.isin(*NULL_LITERALS), folded)


def date_fold(value) -> Column:
    """Length-keeping fold used before date and time patterns."""
    return F.translate(text(value), "ёЁ\u00a0\u202f", "еЕ  ")


def category_fold(value) -> Column:
    folded = yo_fold(F.coalesce(text(value), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[\t\r\n|/\\,;]+", " "), r"(?U)\s+", " "))


def anchor_fold(value) -> Column:
    folded = F.regexp_replace(yo_fold(F.coalesce(text(value), F.lit(""))), r"(?U)[^\w\s]|_", " ")
    return squeeze(folded)


def without_markers(value, begin: str, end: str) -> Column:
    cleaned = F.coalesce(text(value), F.lit(""))
    for marker in (begin, end):
        if marker:
            cleaned = F.regexp_replace(cleaned, "(?iu)" + literal_pattern(marker), " ")
    return squeeze(cleaned)


def anchor_details(value, begin: str, end: str, min_chars: int) -> Column:
    """struct(text, weak): the folded anchor without markers; short or empty is weak."""
    folded = anchor_fold(without_markers(value, begin, end))
    return F.struct(
        F.when(folded != "", folded).alias("text"), (F.length(folded) < min_chars).alias("weak")
    )


def tokens(value) -> Column:
    """Distinct blank-separated tokens."""
    return F.array_distinct(F.filter(F.split(text(value), " "), lambda t: t != ""))


def jaccard(left, right) -> Column:
    a, b = text(left), text(right)
    return F.try_divide(
        F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")
    )


def folded_similarity(a, b, a_tokens, b_tokens) -> Column:
    """1 when one folded text holds the other, else the Jaccard of their tokens; 0 when one is empty."""
    left, right = text(a), text(b)
    return (
        F.when((left == "") | (right == ""), F.lit(0.0))
        .when(F.contains(right, left) | F.contains(left, right), F.lit(1.0))
        .otherwise(jaccard(a_tokens, b_tokens))
    )


def anchor_similarity(anchor, line) -> Column:
    """``folded_similarity`` of two raw texts."""
    return let(
        F.struct(anchor_fold(anchor).alias("a"), anchor_fold(line).alias("b")),
        lambda p: folded_similarity(p["a"], p["b"], tokens(p["a"]), tokens(p["b"])),
    )


def looks_like_regex(value) -> Column:
    return text(value).rlike(REGEX_CHARS)


def key_tokens(value, min_len: int = 4) -> Column:
    found = F.regexp_extract_all(yo_fold(F.coalesce(text(value), F.lit(""))), F.lit(CATEGORY_TOKEN), F.lit(0))
    return F.array_distinct(
        F.filter(found, lambda t: (F.length(t) >= min_len) & ~t.isin(*CATEGORY_STOP_WORDS))
    )


def rare_tokens(value) -> Column:
    return F.filter(key_tokens(value, 5), lambda t: ~t.isin(*CATEGORY_GENERIC_TOKENS))


def acronyms(value) -> Column:
    found = F.regexp_extract_all(F.coalesce(text(value), F.lit("")), F.lit(ACRONYM), F.lit(0))
    return F.array_distinct(F.transform(found, yo_fold))


def token_overlap(left, right) -> Column:
    return F.arrays_overlap(key_tokens(left), key_tokens(right))


def generic_share(window_tokens) -> Column:
    """Share of stop or generic words among a window's tokens."""
    prefixes = [t for t in CATEGORY_GENERIC_TOKENS if t.endswith("н")]

    def generic(token: Column) -> Column:
        word = yo_fold(token)
        hit = word.isin(*CATEGORY_STOP_WORDS, *CATEGORY_GENERIC_TOKENS)
        for prefix in prefixes:
            hit = hit | word.startswith(prefix)
        return hit

    return F.try_divide(
        F.size(F.filter(text(window_tokens), generic)).cast("double"), F.size(text(window_tokens)).cast("double")
    )


def window_is_generic(window_tokens) -> Column:
    return F.coalesce(generic_share(window_tokens) >= 0.7, F.lit(False))


def edit_le_one(left, right) -> Column:
    return F.levenshtein(text(left), text(right), 1) >= 0


def clamp(value) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), text(value)))


def percent(value, digits: int = 1) -> Column:
    return F.round(text(value) * 100, digits)


def truncate_tail(value, limit: int) -> Column:
    """The first ``limit`` characters and a note on how many were cut."""
    whole = text(value)
    size = F.length(whole)
    note = F.concat(F.lit("\n...[truncated "), (size - limit).cast("string"), F.lit(" chars]"))
    return F.when(size <= limit, whole).otherwise(F.concat(F.substring(whole, 1, limit), note))


def head_tail(value, max_bytes: int = 2 * 1024 * 1024) -> Column:
    """Head and tail of half the limit each around a note when the text is over ``max_bytes``."""
    whole = F.coalesce(text(value), F.lit(""))
    raw, half = F.encode(whole, "UTF-8"), max_bytes // 2

    def readable(part: Column) -> Column:
        # a character cut in two at the border is dropped
        return F.regexp_replace(F.make_valid_utf8(part.cast("string")), "^\ufffd+|\ufffd+$", "")

    note = F.concat(F.lit("\n\n... [TRUNCATED: original size "), F.octet_length(whole).cast("string"), F.lit(" bytes] ...\n\n"))
    cut = F.concat(readable(F.substring(raw, 1, half)), note, readable(F.substring(raw, -half, half)))
    return F.when(F.octet_length(whole) <= max_bytes, whole).otherwise(cut)


def source_hash(name, aliases) -> Column:
    listed = F.array_join(F.array_sort(F.coalesce(text(aliases), F.array().cast("array<string>"))), "|")
    return F.sha2(F.concat(text(name), F.lit("|"), listed), 256)


def base_name(path) -> Column:
    return F.regexp_extract(text(path), r"([^/\\]*)$", 1)


def is_general_scope(value) -> Column:
    return F.lower(F.trim(F.coalesce(text(value), F.lit("")))).isin("", "general")


def cosine(left, right) -> Column:
    """Cosine of two arrays, 0 when a norm is 0."""
    a = F.transform(text(left), lambda x: x.cast("double"))
    b = F.transform(text(right), lambda x: x.cast("double"))

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    dot = total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))
    return F.when(norm > 0, dot / norm).otherwise(0.0)
