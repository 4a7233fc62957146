"""Person names and births: folds, casing, inflection, comparison, mentions in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconlink.functions.similarity import ratio, ratio_bound
from reconlink.functions.spans import all_spans, merge_longer
from reconlink.functions.text import let, text

# Words and patterns that decide what a name is.
PATRONYMIC_SUFFIXES = ("кызы", "оглу", "оглы", "огли")
NAME_STOP_WORDS = ("в", "на", "при", "и", "по", "р")
PERSON_STOP_LIST = ("рф", "мвд", "фсб", "г", "пгт", "районе", "в", "у", "на", "через", "кпп", "пу")
TRIGGERS = ("гражданин", "гражданка", "установлен", "выявлен", "выявлены", "задержан", "обнаружен")
_WORD = "[А-ЯЁ][а-яё]+"
_DOUBLE = _WORD + "(?:-[А-ЯЁа-яё]+)?"
FULL_NAME = (
    rf"(?U)\b({_DOUBLE}(?:\s+{_DOUBLE}){{1,3}})(\s+(?:{'|'.join(PATRONYMIC_SUFFIXES)}))?\b"
)
WITH_INITIALS = rf"(?U)\b({_WORD})\s+([А-ЯЁ])\.?\s*(?:([А-ЯЁ])\.?)?\b"
AFTER_TRIGGER = (
    rf"(?iuU)({'|'.join(TRIGGERS)})(?:\s+|:\s+)([А-ЯЁ][а-яё]+)\s+([А-ЯЁ][а-яё]+)(?:\s+([А-ЯЁ][а-яё]+))?"
)
_BORN = r"(?:г\.?\s*р\.?|род\.?)"
BIRTH_DATE = rf"(\d{{2}}\.\d{{2}}\.\d{{4}})\s*{_BORN}"
BIRTH_DATE_PARENS = rf"\(\s*(\d{{2}}\.\d{{2}}\.\d{{4}})\s*{_BORN}?\s*\)"
BIRTH_YEAR = rf"(19\d{{2}}|20\d{{2}})\s*{_BORN}"
BIRTH_YEAR_PARENS = rf"\(\s*(19\d{{2}}|20\d{{2}})\s*{_BORN}?\s*\)"
ANY_DATE = r"(?U)\b\d{2}\.\d{2}\.\d{4}\b"
UNKNOWN_BIRTH = "1900-01-01"

MENTION_TYPE = (
    "struct<start:int,end:int,last:string,first:string,middle:string,full_name:string,"
    "surface_text:string,source:string,birth:date,birth_year:int>"
)


def name_key(value) -> Column:
    """Cyrillic letters only, lower case, ё as е; NULL to ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(text(value), F.lit(""))), "[^а-яё]", "")
    return F.translate(kept, "ё", "е")


def surname_key(value) -> Column:
    """Letters and digits of both scripts, lower case, ё as е."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text(value), F.lit(""))), "ё", "е"), "[^а-яa-z0-9]", "")


def person_key(last, first, middle) -> Column:
    return F.concat_ws("|", name_key(last), name_key(first), name_key(middle))


def known_birth(value) -> Column:
    return F.nullif(text(value), F.lit(UNKNOWN_BIRTH).cast("date"))


def year_only(value) -> Column:
    return (F.month(text(value)) == 1) & (F.dayofmonth(text(value)) == 1)


def birth_compatible(a, b) -> Column:
    """Unknown on a side, equal, or one side only a year that agrees."""
    left, right = text(a), text(b)
    return (
        left.isNull() | right.isNull() | (left == right)
        | ((F.year(left) == F.year(right)) & (year_only(left) | year_only(right)))
    )


def birth_matches(a, b) -> Column:
    """Strict variant: both must be known."""
    left, right = known_birth(a), known_birth(b)
    return F.coalesce(birth_compatible(left, right) & left.isNotNull() & right.isNotNull(), F.lit(False))


def name_case(value, keep_suffix: bool = False) -> Column:
    """Every word and hyphen part capitalised; patronymic suffixes may stay lower."""

    def part(p: Column) -> Column:
        return F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1_000_000)))

    def word(w: Column) -> Column:
        cased = F.array_join(F.transform(F.split(w, "-"), part), "-")
        return F.when(F.lower(w).isin(*PATRONYMIC_SUFFIXES), F.lower(w)).otherwise(cased) if keep_suffix else cased

    words = F.filter(F.split(F.trim(F.coalesce(text(value), F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


def full_name(last, first, middle) -> Column:
    parts = [F.nullif(F.trim(F.coalesce(text(p), F.lit(""))), F.lit("")) for p in (last, first, middle)]
    return F.concat_ws(" ", *parts)


def person_display(last, first, middle, birth, birth_year=None) -> Column:
    year = F.lit(None).cast("int") if birth_year is None else text(birth_year)
    born = (
        F.when(text(birth).isNotNull() & ~year_only(birth), F.date_format(text(birth), "dd.MM.yyyy"))
        .when(text(birth).isNotNull(), F.year(text(birth)).cast("string"))
        .otherwise(year.cast("string"))
    )
    return F.concat_ws(", ", F.nullif(full_name(last, first, middle), F.lit("")), F.concat(born, F.lit(" г.р.")))


def split_full_name(value) -> Column:
    """struct<last,first,middle> of a blank-separated full name."""
    words = F.filter(F.split(F.trim(text(value)), r"\s+"), lambda w: w != "")
    return F.struct(
        F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("last"),
        F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("first"),
        F.array_join(F.slice(words, F.lit(3), F.size(words)), " ").alias("middle"),
    )


def _cut_end(value: Column, drop: int, add: str = "") -> Column:
    cut = F.substring(value, F.lit(1), F.length(value) - drop)
    return F.concat(cut, F.lit(add)) if add else cut


def variants(value, part: str) -> Column:
    """The folded name part and its nominative readings."""
    v = text(value)
    size = F.length(v)

    def rule(ending: str, min_size: int, drop: int, add: str = "") -> Column:
        return F.when(F.endswith(v, F.lit(ending)) & (size > min_size), _cut_end(v, drop, add))

    # Ending, least length, letters cut, letters added.
    rules = {
        "last": [("а", 3, 1, ""), ("я", 3, 1, "")],
        "first": [("ия", 3, 2, "ий"), ("ия", 3, 1, ""), ("я", 2, 1, "й"), ("и", 2, 1, "я"), ("а", 2, 1, "")],
        "middle": [("ича", 4, 1, ""), ("ича", 4, 3, "ич"), ("овича", 6, 1, ""), ("евича", 6, 1, "")],
    }[part]
    made = [v] + [rule(*r) for r in rules]
    return F.filter(F.array_distinct(F.array_compact(F.array(*made))), lambda x: x != "")


def part_possible(report, registry, readings, threshold: float) -> Column:
    """Native necessary condition for ``part_match``: use it in join conditions.

    ``readings`` are the ``variants`` of the report part, made once per person.
    """
    r, g = text(report), text(registry)
    return (
        (r == "")
        | F.when(F.length(r) == 1, F.startswith(g, r)).otherwise(
            (ratio_bound(r, g) >= threshold) | F.array_contains(text(readings), g)
        )
    )


def _pieces(size: Column, threshold: float) -> Column:
    """How many pieces a name of ``size`` letters is cut into: one more than the edits the ratio allows."""
    return F.floor(size * (2 * (1 - threshold) / threshold) + 1e-9).cast("int") + 1


def _piece(size: Column, i: Column, n: Column) -> tuple[Column, Column]:
    start = F.floor(i * size / n).cast("int")
    return start, F.floor((i + 1) * size / n).cast("int") - start


def _dropped(report: Column, registry: Column, threshold: float) -> tuple[Column, Column]:
    """Letters that the ratio lets names of these sizes leave unmatched at most, on either side."""
    least = F.ceil((report + registry) * (threshold / 2) - 1e-9).cast("int")
    return report - least, registry - least


def _few(drops: tuple[Column, Column]) -> Column:
    return (drops[0] <= 1) & (drops[1] <= 1)


def _shortened(name: Column, size: Column, drop: Column, report: Column, registry: Column) -> Column:
    """The name without ``drop`` (none or one) of its letters, under the sizes of both names; nothing for less than none."""
    one = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.concat(F.left(name, i), F.substring(name, i + 2, size)))
    sizes = F.concat_ws("-", report.cast("string"), registry.cast("string"))
    return F.transform(
        F.when(drop < 0, F.array().cast("array<string>")).when(drop == 0, F.array(name)).otherwise(one), lambda v: F.concat_ws("/", sizes, v))


def _sizes(size: Column, threshold: float) -> Column:
    """Sizes of the names that may reach the ratio with one of this size."""
    spread = (2 - threshold) / threshold
    return F.sequence(F.ceil(size / spread - 1e-9).cast("int"), F.floor(size * spread + 1e-9).cast("int"))


def registry_surname_keys(surname, threshold: float) -> Column:
    """Block keys of a registry surname; any report surname that may match it shares one.

    A ratio of at least ``threshold`` leaves room for a known number of edits. Where that is one letter
    on either side, the names without such a letter are equal. For more, a name is cut into one piece more than
    there are edits, so some piece stands whole in the other name, moved by no more than the edits.
    """
    g = text(surname)
    size = F.length(g)

    def cut(n: Column) -> Column:
        def one(i: Column) -> Column:
            start, width = _piece(size, i, n)
            return F.concat_ws("/", size.cast("string"), i.cast("string"), F.substring(g, start + 1, width))

        return F.transform(F.sequence(F.lit(0), n - 1), one)

    def for_size(other: Column) -> Column:
        drops = _dropped(other, size, threshold)
        return F.when(_few(drops) & (drops[0] >= 0), _shortened(g, size, drops[1], other, size)).otherwise(F.array().cast("array<string>"))

    whole = F.array(F.concat(F.lit("="), g), F.concat(F.lit("^"), F.left(g, F.lit(1))))
    return F.concat(whole, let(_pieces(size, threshold), cut), F.flatten(F.transform(_sizes(size, threshold), for_size)))


def report_surname_keys(surname, readings, threshold: float) -> Column:
    """Block keys of a report surname, see ``registry_surname_keys``."""
    r = text(surname)
    size = F.length(r)

    def pieces(other: Column) -> Column:
        n = _pieces(other, threshold)

        def for_piece(i: Column) -> Column:
            start, width = _piece(other, i, n)
            moved = F.filter(F.transform(F.sequence(1 - n, n - 1), lambda d: start + d), lambda at: (at >= 0) & (at + width <= size))
            return F.transform(moved, lambda at: F.concat_ws("/", other.cast("string"), i.cast("string"), F.substring(r, at + 1, width)))

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), for_piece))

    def for_size(other: Column) -> Column:
        drops = _dropped(size, other, threshold)
        return F.when(~_few(drops), pieces(other)).when(drops[1] >= 0, _shortened(r, size, drops[0], size, other)).otherwise(
            F.array().cast("array<string>"))

    whole = F.transform(text(readings), lambda v: F.concat(F.lit("="), v))
    similar = F.flatten(F.transform(_sizes(size, threshold), for_size))
    return F.array_distinct(F.when(size == 1, F.array(F.concat(F.lit("^"), r))).otherwise(F.concat(whole, similar)))


def part_match(report, registry, readings, threshold: float, label: str) -> Column:
    """struct<ok,note>: missing, initial, inflected or similar spelling of one name part."""
    r, g = text(report), text(registry)
    initial = F.length(r) == 1
    inflected = F.array_contains(text(readings), g)
    unsure = (r != "") & (g != "") & ~initial & ~inflected & (ratio_bound(r, g) >= threshold)
    near = F.coalesce(ratio(F.when(unsure, r), g) >= threshold, F.lit(False))
    no_note = F.lit(None).cast("string")
    return (
        F.when(r == "", F.struct(F.lit(True).alias("ok"), F.lit(f"{label} отсутствует в сводке").alias("note")))
        .when(initial, F.struct(
            F.startswith(g, r).alias("ok"),
            F.when(r != g, F.lit(f"{label} в сводке указан инициалом")).otherwise(no_note).alias("note")))
        .when(inflected, F.struct(F.lit(True).alias("ok"), no_note.alias("note")))
        .otherwise(F.struct(near.alias("ok"), F.lit(f"{label} отличается").alias("note")))
    )


def birth_after(value, end: Column, width: int) -> Column:
    """struct<birth,birth_year> from the ``width`` characters after a name."""
    window = F.substring(text(value), end + 1, F.lit(width))
    dated = F.coalesce(
        F.nullif(F.regexp_extract(window, BIRTH_DATE, 1), F.lit("")),
        F.nullif(F.regexp_extract(window, BIRTH_DATE_PARENS, 1), F.lit("")),
    )
    birth = F.try_to_timestamp(dated, F.lit("dd.MM.yyyy")).cast("date")
    year = F.coalesce(
        F.nullif(F.regexp_extract(window, BIRTH_YEAR, 1), F.lit("")),
        F.nullif(F.regexp_extract(window, BIRTH_YEAR_PARENS, 1), F.lit("")),
    ).cast("int")
    return F.struct(
        birth.alias("birth"), F.when(dated.isNotNull(), F.year(birth)).otherwise(year).alias("birth_year")
    )


def birth_query(value, end: Column | None, birth, birth_year, width: int) -> Column:
    """struct<mode,birth,birth_year>: how to look a person up by birth (date, year or none)."""
    whole = F.coalesce(text(value), F.lit(""))
    window = F.substring(whole, (F.lit(0) if end is None else F.coalesce(end, F.lit(0))) + 1, F.lit(width))
    day = known_none(birth)
    year = F.coalesce(text(birth_year), F.year(day))
    shown = F.regexp_count(window, F.concat(F.lit(r"(?U)\b"), year.cast("string"), F.lit(r"\b"))) > 0
    in_date = F.regexp_count(window, F.concat(F.lit(r"(?U)\b\d{2}\.\d{2}\."), year.cast("string"), F.lit(r"\b"))) > 0
    only_year = F.coalesce(shown & ~in_date, F.lit(False))
    first_january = F.coalesce(year_only(day), F.lit(False)) & (F.regexp_count(window, F.lit(ANY_DATE)) == 0)
    mode = (
        F.when(year.isNull(), "none").when(only_year, "year")
        .when(day.isNotNull() & ~first_january, "date").otherwise("year")
    )
    return F.struct(
        mode.alias("mode"), F.when(mode == "date", day).alias("birth"),
        F.when(mode == "none", F.lit(None).cast("int"))
        .when(first_january & ~only_year, F.year(day)).otherwise(year).alias("birth_year"),
    )


def known_none(value) -> Column:
    return text(value).cast("date")


def valid_token(token: Column, allow_initial: bool = False) -> Column:
    lowered = F.lower(F.trim(token))
    long_enough = F.lit(True) if allow_initial else F.length(lowered) >= 2
    return (
        token.isNotNull() & (token != "") & ~lowered.isin(*NAME_STOP_WORDS) & long_enough
        & token.rlike("^[А-ЯЁа-яё-]+$")
    )


def person_candidate(name) -> Column:
    """At least two title-case words or initials, nothing from the stop list, no leading abbreviation."""
    words = F.filter(
        F.transform(F.split(text(name), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:()\[\]{}"'«»]+|[.,;:()\[\]{}"'«»]+$""", "")),
        lambda w: w != "",
    )

    def title(w: Column) -> Column:
        return w.rlike(r"^\p{Lu}(?:\P{Lu}*\p{Ll}\P{Lu}*)?(?:-\p{Lu}(?:\P{Lu}*\p{Ll}\P{Lu}*)?)*$")

    def abbreviation(w: Column) -> Column:
        return w.rlike(r"^\p{Lu}{2,}$")

    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    named = F.size(F.filter(words, lambda w: ~abbreviation(w) & (title(w) | w.rlike(r"^\p{Lu}\.?$"))))
    return (
        (F.size(words) > 0)
        & ~F.exists(words, lambda w: F.lower(w).isin(*PERSON_STOP_LIST))
        & ~F.coalesce(abbreviation(first) & ~title(F.coalesce(second, F.lit(""))), F.lit(False))
        & (named >= 2)
    )


def _mention(value, m: Column, last: Column, first: Column, middle: Column, name: Column, source: str,
             width: int, start: Column | None = None) -> Column:
    begin = m["start"] if start is None else start
    born = birth_after(value, m["end"], width)
    return F.struct(
        begin.cast("int").alias("start"), m["end"].cast("int").alias("end"), last.alias("last"), first.alias("first"),
        middle.alias("middle"), name.alias("full_name"),
        F.substring(text(value), begin + 1, m["end"] - begin).alias("surface_text"),
        F.lit(source).alias("source"), born["birth"].alias("birth"), born["birth_year"].alias("birth_year"),
    )


def person_mentions(value, birth_window: int = 60) -> Column:
    """array of person mentions: full names, names with initials, names after a trigger word.

    The three readings are merged (the longer span wins) and then reduced to
    one per name, the one with the better birth data, then the longer name.
    """
    whole = text(value)

    def complex_name(m: Column) -> Column:
        words = F.filter(F.split(m["text"], r"(?U)\s+"), lambda w: w != "")
        last, first = F.element_at(words, 1), F.element_at(words, 2)
        middle = F.array_join(F.slice(words, F.lit(3), F.size(words)), " ")
        return _mention(whole, m, last, first, middle, F.array_join(words, " "), "regex_complex", birth_window)

    def initials(m: Column) -> Column:
        last, first, middle = (F.regexp_extract(m["text"], WITH_INITIALS, i) for i in (1, 2, 3))
        name = F.concat_ws(" ", last, F.concat(first, F.lit(".")), F.when(middle != "", F.concat(middle, F.lit("."))))
        return _mention(whole, m, last, first, middle, name, "regex_initials", birth_window)

    def triggered(m: Column) -> Column:
        last, first, middle = (F.regexp_extract(m["text"], AFTER_TRIGGER, i) for i in (2, 3, 4))
        name = F.concat_ws(" ", last, first, F.nullif(middle, F.lit("")))
        lead = F.length(F.regexp_extract(m["text"], rf"(?iuU)^(?:{'|'.join(TRIGGERS)})(?:\s+|:\s+)", 0))
        return _mention(whole, m, last, first, middle, name, "regex_context", birth_window, m["start"] + lead)

    def usable(allow_initial: bool):
        return lambda p: valid_token(p["last"]) & valid_token(p["first"], allow_initial) & person_candidate(p["full_name"])

    found = [
        F.filter(F.transform(all_spans(whole, FULL_NAME), complex_name), usable(False)),
        F.filter(F.transform(all_spans(whole, WITH_INITIALS), initials), usable(True)),
        F.filter(F.transform(all_spans(whole, AFTER_TRIGGER), triggered), usable(False)),
    ]
    return best_per_name(merge_longer(found[0], F.concat(found[1], found[2])))


def birth_rank(person: Column) -> Column:
    return F.when(person["birth"].isNotNull(), 2).when(person["birth_year"].isNotNull(), 1).otherwise(0)


def best_per_name(people: Column) -> Column:
    """One record per folded name, in order of first appearance."""
    keyed = F.transform(people, lambda p, i: F.struct(
        person_key(p["last"], p["first"], p["middle"]).alias("k"),
        birth_rank(p).alias("r"), F.length(p["full_name"]).alias("n"), (-i).alias("i"), p.alias("p")))
    return let(keyed, lambda every: F.transform(
        F.array_distinct(F.transform(every, lambda x: x["k"])),
        lambda k: F.array_max(F.filter(every, lambda x: x["k"] == k))["p"]))


def with_lexicon(people: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Keep person rows one of whose parts is in the lexicon's ``name`` column (folded)."""
    parts = people.select(
        "mention_id", "seq", F.explode(F.array(name_key("last"), name_key("first"), name_key("middle"))).alias("name")
    ).filter("name <> ''")
    known = parts.join(lexicon.select(name_key("name").alias("name")).distinct(), "name", "left_semi")
    return people.join(known.select("mention_id", "seq").distinct(), ["mention_id", "seq"], "left_semi")


def birth_span(value, end: Column, width: int) -> Column:
    """struct<start,end,kind> of the birth date or year shown after a name."""
    window = F.substring(text(value), end + 1, F.lit(width))
    year_marked = r"(?iuU)\b\d{4}\b(?=\s*(?:г\s*\.?\s*р\.?|род\.?))"
    year_parens = r"(?iu)\(\s*(\d{4})\s*(?:г\s*\.?\s*р\.?)?\s*\)"

    def at(pattern: str, size: int, shift: Column | int, kind: str) -> Column:
        pos = F.regexp_instr(window, F.lit(pattern))
        start = end + pos - 1 + shift
        return F.when(pos > 0, F.struct(start.alias("start"), (start + size).alias("end"), F.lit(kind).alias("kind")))

    lead = F.length(F.regexp_extract(F.regexp_extract(window, year_parens, 0), r"^\(\s*", 0))
    return F.coalesce(at(ANY_DATE, 10, 0, "date"), at(year_marked, 4, 0, "year"), at(year_parens, 4, lead, "year"))
