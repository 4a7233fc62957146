"""Quality rules by the divergence of a text's histograms from its language's, in DataFrame functions only.

Two histograms are taken of every text: its characters by class (plain letters and digits, capitals,
letters without case, white space, sentence marks, loud marks, symbols, the rest) and its words by the
language's COMMON most widely used short words (all others make one more bin). The reference of a
language is the median share of each bin over its documents that pass the base rules, from exact integer shares, so it
does not depend on how the table is partitioned. A text whose two Jensen-Shannon distances
(square root of the divergence in bits, 0 to 1) are both beyond their thresholds is rejected, unless it is too short for a
histogram to tell anything (``MIN_CHARS``, ``MIN_WORDS``).

Work: one pass counts in how many documents each short word stands (partial sums before the shuffle, no text is moved), a
second one takes all counts of a text in place; its narrow rows are kept, and medians and verdicts come from
them. Bins and words of a language are joined to the texts by language: as a broadcast while the counted
languages are at most ``LANGUAGES``, else by an equi join whose hot languages adaptive execution splits.

Cases: a null text is empty; texts under 50 words fail the base rules; a null language is a language of its
own; repeated rows and rows without doc_id are judged each; ties among common words go by the word itself; an empty table gives no
rows; only doc_id, lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

#: base rules: least words, and the share of words in repeated windows of three words in percent
BASE_WORDS, BASE_REPEAT = 50, 50
#: common words of a language, and the longest one in characters: function words are short in all languages with spaces
COMMON, LONGEST = 32, 5
#: below these a histogram says nothing
MIN_CHARS, MIN_WORDS = 200, 50
#: distances that must both be exceeded
CHAR_LIMIT, WORD_LIMIT = 0.13, 0.22
#: shares are integers of this unit
UNIT = 10_000
#: languages that may be broadcast; one takes under 2 KB
LANGUAGES = 5_000

SPACE = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
# plain text and white space, which are most of every text; what is left is looked at closer
PLAIN = r"[\p{Ll}\p{Nd}\x20\x09-\x0D]+"
UPPER, LETTERS, OTHER = r"[^\p{Lu}]+", r"[^\p{L}]+", r"[^#*$%&|<>]+"
MARKS, LOUD = r"""[^.,;:'"()\-]+""", r"[^!?]+"
CLASSES = ("plain", "capital", "caseless", "space", "mark", "loud", "symbol", "rest")
#: one character per common word, after one for all other words
CODES = ".ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: a common word's place in the list of its language: a blank before and one at least after it
SLOT = LONGEST + 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.coalesce(F.when(bare != "", F.split(bare, BLANKS)), F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more.

    Windows are compared by as many bits of a hash as leave room for their position in the same integer,
    which sorts natively; the few that agree are then compared as texts.
    """

    def of(n: Column, bits: Column) -> Column:
        def window(i: Column, make: Callable[..., Column]) -> Column:
            return make(*[F.get(words, i + k) for k in range(3)])

        def high(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)

        def alike(rows: Column, key: Callable[[Column], Column]) -> Column:
            """Rows of a sorted array whose key is that of a neighbour."""
            near = lambda x, other: F.coalesce(key(x) == key(other), F.lit(False))
            return F.filter(rows, lambda x, j: near(x, F.get(rows, j - 1)) | near(x, F.get(rows, j + 1)))

        def spread(hashes: Column) -> Column:
            packed = F.transform(hashes, lambda h, i: F.coalesce(F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")), F.lit(0)))
            # without an equal pair of hashes there is no equal pair of windows
            return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))

        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i, F.xxhash64))
        places = let(let(hashes, spread), lambda p: F.transform(alike(p, high), lambda x: (x - F.call_function("shiftleft", high(x), bits)).cast("int")))
        exact = let(places, lambda p: F.sort_array(F.transform(p, lambda i: F.struct(window(i, lambda *w: F.concat_ws(" ", *w)).alias("gram"), i.alias("at")))))
        twice = let(exact, lambda s: F.sort_array(F.transform(alike(s, lambda x: x["gram"]), lambda x: x["at"])))
        covered = let(twice, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
        return covered.cast("long")

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(
        let(F.size(words), lambda n: let(F.length(F.bin(n)), lambda bits: of(n, bits))))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def common_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, common: the words, as written, that most documents of a language hold, most widely used first, one to a slot."""
    short = F.filter(words_of(F.coalesce(text, F.lit(""))), lambda w: F.length(w) <= LONGEST)
    held = docs.select(F.col(lang).alias("lang"), F.explode(F.array_distinct(short)).alias("word"))
    counts = held.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON)
    slots = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: F.rpad(F.concat(F.lit(" "), x["word"]), SLOT, " "))
    return top.groupBy("lang").agg(F.concat(F.array_join(slots, ""), F.lit(" ")).alias("common"))


def by_language(rows: DataFrame, other: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns of their language in ``other``."""
    named = other.withColumnRenamed("lang", "_of")
    return rows.join(F.broadcast(named) if few else named, F.col("lang").eqNullSafe(F.col("_of")), "left").drop("_of")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, common to one narrow row of counts per text; the text itself is left behind."""
    text = F.coalesce("text", F.lit(""))

    def of_words(words: Column) -> Column:
        def code(word: Column) -> Column:
            slot = F.floor((F.coalesce(F.call_function("instr", F.col("common"), F.concat(F.lit(" "), word, F.lit(" "))), F.lit(0)) + SLOT - 1) / SLOT)
            return F.substr(F.lit(CODES), slot.cast("int") + 1, F.lit(1))

        short = F.filter(words, lambda w: F.length(w) <= LONGEST)
        bins = let(F.array_join(F.transform(short, code), ""), lambda s: F.array(*[
            (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("long") for c in CODES[1: COMMON + 1]]))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"), bins.alias("known"))

    def of_rest(rest: Column) -> Column:
        left = lambda pattern: F.length(F.regexp_replace(rest, pattern, "")).cast("long")
        return F.struct(F.length(rest).cast("long").alias("size"), left(UPPER).alias("upper"), left(LETTERS).alias("letters"),
                        left(MARKS).alias("marks"), left(LOUD).alias("loud"), left(OTHER).alias("n_symbols"))

    made = F.struct(
        F.length(text).cast("long").alias("n_chars"), repeated_lines(text).alias("n_dup_lines"),
        let(words_of(text), of_words).alias("of_words"), let(F.regexp_replace(text, PLAIN, ""), of_rest).alias("of_rest"))
    rows = docs.select("doc_id", "lang", F.inline(F.array(made))).select("doc_id", "lang", "n_chars", "n_dup_lines", "of_words.*", "of_rest.*")
    space = F.col("n_chars") - F.col("word_chars")
    shown = [F.col("upper"), F.col("letters") - F.col("upper"), space, F.col("marks"), F.col("loud"), F.col("n_symbols")]
    plain = F.col("n_chars") - F.col("size") - space
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    others = F.col("n_words") - F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.array(plain, *shown, F.col("n_chars") - plain - sum(shown[1:], shown[0])).alias("char_bins"),
        F.concat(F.array(others), F.col("known")).alias("word_bins"), "n_chars")


def references(rows: DataFrame) -> DataFrame:
    """lang, char_ref, word_ref: median share of each bin over the documents that pass the base rules, made to sum to one."""

    def medians(bins: str, size: int, total: str) -> Column:
        share = lambda i: F.floor(F.element_at(bins, i + 1) * UNIT / F.greatest(F.col(total), F.lit(1)))
        return F.array(*[F.percentile(share(i), 0.5) for i in range(size)])

    def whole(name: str) -> Column:
        return let(F.aggregate(name, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(name, lambda x: x / F.when(s > 0, s)))

    found = rows.where("not base_failed").groupBy("lang").agg(
        medians("char_bins", len(CLASSES), "n_chars").alias("char_ref"), medians("word_bins", COMMON + 1, "n_words").alias("word_ref"))
    return found.select("lang", whole("char_ref").alias("char_ref"), whole("word_ref").alias("word_ref"))


def distance(bins: str, total: str, reference: str) -> Column:
    """Jensen-Shannon distance of counts to shares; null without counts or a reference."""

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    shares = F.transform(bins, lambda x: x / F.when(F.col(total) > 0, F.col(total)))
    terms = F.zip_with(shares, reference, lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)), 6)


def judged(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document the base counts, base_failed, char_distance, word_distance and kept."""
    own = docs.select("doc_id", "lang", "text")
    common = cut(common_words(own))
    few = common.count() <= LANGUAGES
    rows = cut(counted(by_language(own, common, few)))
    found = by_language(rows, references(rows), few)
    measured = found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars",
        distance("char_bins", "n_chars", "char_ref").alias("char_distance"), distance("word_bins", "n_words", "word_ref").alias("word_distance"))
    told = (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words)
    strange = F.coalesce(told & (F.col("char_distance") > char_limit) & (F.col("word_distance") > word_limit), F.lit(False))
    return measured.withColumn("kept", ~F.col("base_failed") & ~strange).drop("n_chars")


def judged_sql() -> str:
    """The same in DuckDB's SQL, over ``documents``."""
    kept_of = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "letters": r"\p{L}", "digits": r"\p{Nd}", "marks": r""".,;:''"()\-""", "loud": "!?", "n_symbols": "#*$%&|<>"}
    classes = ", ".join(f"length(regexp_replace(text, '[^{v}]+', '', 'g')) AS {k}" for k, v in kept_of.items())
    parts = ("lower + digits", "upper", "letters - lower - upper", "n_chars - word_chars", "marks", "loud", "n_symbols")
    bins = "[" + ", ".join(parts) + ", n_chars - (" + " + ".join(f"({p})" for p in parts) + ")]"

    def shared(bins: str, total: str, size: int) -> str:
        return ", ".join(f"median(floor({bins}[{i}] * {UNIT} / greatest({total}, 1)))" for i in range(1, size + 1))

    def apart(bins: str, total: str, ref: str) -> str:
        p, q = f"({bins}[i] / {total})", f"({ref}[i] / list_sum({ref}))"
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"round(sqrt(greatest(0, list_sum([{term(p)} + {term(q)} for i in range(1, len({bins}) + 1)]) / 2)), 6)"

    return f"""
        WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, lang, coalesce(text, '') AS text FROM documents),
        base AS (SELECT row_no, doc_id, lang, length(text) AS n_chars, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, {classes},
                        regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
        placed AS (SELECT row_no, unnest(range(1, len(words) - 1)) AS spot, words FROM base),
        grams AS (SELECT row_no, spot, count(*) OVER (PARTITION BY row_no, words[spot], words[spot + 1], words[spot + 2]) AS n FROM placed),
        covered AS (SELECT row_no, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_no, unnest([spot, spot + 1, spot + 2]) AS p FROM grams WHERE n > 1) GROUP BY row_no),
        spelled AS (SELECT row_no, lang, unnest(words) AS word FROM base),
        held AS (SELECT lang, word, count(DISTINCT row_no) AS n FROM spelled WHERE length(word) <= {LONGEST} GROUP BY ALL),
        common AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM held QUALIFY k <= {COMMON}),
        tally AS (SELECT row_no, coalesce(k, 0) AS k, count(*) AS n FROM spelled s LEFT JOIN common c ON c.word = s.word AND c.lang IS NOT DISTINCT FROM s.lang GROUP BY ALL),
        hist AS (SELECT row_no, list(coalesce(n, 0) ORDER BY k) AS word_bins FROM
                 (SELECT row_no, unnest(range(0, {COMMON + 1})) AS k FROM base) LEFT JOIN tally USING (row_no, k) GROUP BY row_no),
        counts AS (SELECT row_no, doc_id, lang, len(words) AS n_words, n_chars, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                          coalesce(n_repeat_words, 0) AS n_repeat_words, {bins} AS char_bins, word_bins FROM base JOIN hist USING (row_no) LEFT JOIN covered USING (row_no)),
        failed AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words AS base_failed FROM counts),
        refs AS (SELECT lang, [{shared('char_bins', 'n_chars', len(CLASSES))}] AS char_ref, [{shared('word_bins', 'n_words', COMMON + 1)}] AS word_ref
                 FROM failed WHERE NOT base_failed GROUP BY lang),
        told AS (SELECT f.*, {apart('char_bins', 'n_chars', 'char_ref')} AS char_distance, {apart('word_bins', 'n_words', 'word_ref')} AS word_distance
                 FROM failed f LEFT JOIN refs r ON r.lang IS NOT DISTINCT FROM f.lang)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance,
               NOT base_failed AND NOT coalesce(n_chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND char_distance > {CHAR_LIMIT} AND word_distance > {WORD_LIMIT}, false) AS kept
        FROM told
    """
