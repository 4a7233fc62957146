"""Staff mentions: rank, surname, initials; and the staff context of a name."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from reconlink.functions.names import name_key
from reconlink.functions.spans import all_spans, overlaps
from reconlink.functions.text import text

# Rank spellings and the words that mark a staff context.
RANKS = {
    "прк": "Прапорщик",
    "прапорщик": "Прапорщик",
    "стпрк": "Старший прапорщик",
    "старшийпрапорщик": "Старший прапорщик",
    "мллт": "Младший лейтенант",
    "младшийлейтенант": "Младший лейтенант",
    "лт": "Лейтенант",
    "лейтенант": "Лейтенант",
    "стлт": "Старший лейтенант",
    "старшийлейтенант": "Старший лейтенант",
    "кн": "Капитан",
    "кап": "Капитан",
    "капитан": "Капитан",
    "мр": "Майор",
    "майор": "Майор",
    "ппк": "Подполковник",
    "подполковник": "Подполковник",
    "пк": "Полковник",
    "полковник": "Полковник",
    "мн": "Мичман",
    "мичман": "Мичман",
    "стмн": "Старший мичман",
    "старшиймичман": "Старший мичман",
    "кл": "Капитан-лейтенант",
    "капитанлейтенант": "Капитан-лейтенант",
    "к3р": "Капитан 3-го ранга",
    "капитан3горанга": "Капитан 3-го ранга",
    "капитан3ранга": "Капитан 3-го ранга",
    "к2р": "Капитан 2-го ранга",
    "капитан2горанга": "Капитан 2-го ранга",
    "капитан2ранга": "Капитан 2-го ранга",
    "к1р": "Капитан 1-го ранга",
    "капитан1горанга": "Капитан 1-го ранга",
    "капитан1ранга": "Капитан 1-го ранга",
    "старшина": "Старшина",
    "генерал": "Генерал",
    "адмирал": "Адмирал",
    "контрадмирал": "Контр-адмирал",
}
SHORT_RANKS = ("стпрк", "мллт", "стлт", "стмн", "прк", "ппк", "к3р", "к2р", "к1р", "лт", "кн", "мр", "пк", "мн", "кл")
FULL_RANK = (
    r"(?:прапорщик|старш(?:ий|ая)\s+прапорщик|младш(?:ий|ая)\s+лейтенант|лейтенант|старш(?:ий|ая)\s+лейтенант"
    r"|капитан(?:\s*[\-–—]?\s*лейтенант)?|майор|подполковник|полковник"
    r"|мичман|старш(?:ий|ая)\s+мичман|старшина|генерал|адмирал|контр\s*[\-–—]?\s*адмирал"
    r")(?:\s+[-–—]?\s*[123](?:-?\s*го)?\s+ранга)?"
)
STAFF_MARKERS = (
    "пр-к", "прапорщик", "ст", "л-т", "лейтенант", "мл", "сержант", "капитан", "инспектор", "оперуполномоченный",
    "дежурный", "начальник", "майор", "подполковник", "мичман", "старший", "старший мичман", "ст м н", "ст.м-н",
)
CONTEXT_TOKEN = "(?iu)[а-яёa-z-]+"
RANK_WORDS = (
    "л-т", "лейтенант", "ст", "старший", "ст.", "кап", "кап.", "капитан", "майор", "подполковник", "полковник", "мичман", "м-н",
    "ст.м-н", "старшина", "генерал", "адмирал", "контр-адмирал", "капитан-лейтенант", "пр-к", "прапорщик", "ранга",
)
RANK_WORD_TOKEN = r"[А-ЯЁа-яё0-9.-]+"

_SHORT = "|".join(r"[\s.\-/\\–—]*".join(r) for r in SHORT_RANKS)
RANK = rf"(?:{_SHORT}|{FULL_RANK}|[А-ЯЁа-яё]{{6,}})"
STAFF = (
    rf"(?iuU)(?:^|[\s(,;:])(?:({RANK})\s+)?([А-ЯЁ][а-яё]{{2,}})\s+((?:[А-ЯЁ]\s*\.\s*){{2}})(?:\+\d+)?"
)
RANK_BEFORE = rf"(?iuU)(?:^|[\s(,;:])({RANK})\s*$"


def rank_key(value) -> Column:
    lowered = F.translate(F.lower(F.coalesce(text(value), F.lit(""))), "ё", "е")
    return F.regexp_replace(lowered, "[^а-я0-9]", "")


@F.pandas_udf(StringType())
def _nearest_rank(keys: pd.Series) -> pd.Series:
    long_keys = [k for k in RANKS if len(k) >= 6]
    seen: dict[str, str | None] = {}

    def nearest(key):
        if key is None:
            return None
        if key not in seen:
            scores = [(SequenceMatcher(None, key, k).ratio(), -i, k) for i, k in enumerate(long_keys)]
            best = max(scores)
            seen[key] = RANKS[best[2]] if best[0] >= 0.8 else None
        return seen[key]

    return pd.Series([nearest(k) for k in keys], dtype="object")


def rank_of(value) -> Column:
    """Full rank of a spelling, '' when it is none: exact alias first, then a near full spelling."""
    key = rank_key(value)
    table = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    exact = F.try_element_at(table, key)
    return F.coalesce(exact, _nearest_rank(F.when(exact.isNull() & (F.length(key) >= 6), key)), F.lit(""))


def rank_before(value, start: Column) -> Column:
    """The rank words right before a name, '' when there are none."""
    left = F.substring(text(value), F.greatest(start - 40, F.lit(0)) + 1, F.least(start, F.lit(40)))
    spelled = F.trim(F.regexp_extract(left, RANK_BEFORE, 1))
    words = F.regexp_extract_all(left, F.lit(RANK_WORD_TOKEN), F.lit(0))
    last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    known = sorted({"".join(ch for ch in w if ch.isalnum()) for w in RANK_WORDS})
    marked = F.translate(F.regexp_replace(F.lower(last), "[^а-яё0-9]", ""), "ё", "е").isin(*known)
    return F.when(spelled != "", spelled).when(marked, last).otherwise("")


def initials(value) -> Column:
    letters = F.regexp_extract_all(text(value), F.lit("(?iu)[А-ЯЁ]"), F.lit(0))
    return F.when(F.size(letters) >= 2, F.concat(letters[0], F.lit("."), letters[1], F.lit("."))).otherwise("")


def staff_candidates(value) -> Column:
    """array<struct<start,end,rank_raw,surname,initials>> before ranks are resolved."""
    whole = text(value)

    def build(m: Column) -> Column:
        inner = F.regexp_extract(m["text"], STAFF, 1)
        surname = F.regexp_extract(m["text"], STAFF, 2)
        marks = F.regexp_extract(m["text"], STAFF, 3)
        surname_at = m["start"] + F.regexp_instr(
            m["text"], F.lit(r"(?iuU)[А-ЯЁ][а-яё]{2,}\s+(?:[А-ЯЁ]\s*\.\s*){2}(?:\+\d+)?$")) - 1
        left = F.substring(whole, F.greatest(surname_at - 40, F.lit(0)) + 1, F.least(surname_at, F.lit(40)))
        raw = F.when(inner != "", inner).otherwise(F.regexp_extract(left, RANK_BEFORE, 1))
        start = F.when(inner != "", m["start"] + F.position(inner, m["text"]) - 1).otherwise(surname_at)
        return F.struct(
            start.cast("int").alias("start"), m["end"].cast("int").alias("end"),
            F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")).alias("rank_raw"),
            surname.alias("surname"), initials(marks).alias("initials"),
        )

    return F.filter(F.transform(all_spans(whole, STAFF), build), lambda s: (s["rank_raw"] != "") & (s["initials"] != ""))


def staff_mentions(df, text_col: str = "text", id_col: str = "mention_id"):
    """One row per staff member: rank_raw, rank_full, surname, initials, display, start, end."""
    rows = df.select(id_col, F.posexplode(staff_candidates(text_col)).alias("seq", "s")).select(
        id_col, "seq", "s.*"
    ).withColumn("rank_full", rank_of("rank_raw")).filter("rank_full <> ''")
    shown = F.concat_ws(" ", "rank_full", "surname", "initials")
    key = F.concat_ws("|", *[F.translate(F.lower(F.col(c)), "ё", "е") for c in ("surname", "initials", "rank_full")])
    item = F.struct("seq", "start", "end", "rank_raw", "rank_full", "surname", "initials",
                    shown.alias("display"), key.alias("key"))

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: overlaps(k, s) | (k["key"] == s["key"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, s))

    return (
        rows.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("all"))
        .select(id_col, F.posexplode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("staff_no", "s"))
        .select(id_col, "staff_no", "s.start", "s.end", "s.rank_raw", "s.rank_full", "s.surname", "s.initials", "s.display")
    )


def _marker_keys() -> list[str]:
    kept = {"".join(ch for ch in m.lower().replace("ё", "е") if "а" <= ch <= "я") for m in STAFF_MARKERS}
    return sorted(kept)


def last_tokens_before(value, start: Column, count: int = 3) -> Column:
    """The ``count`` tokens that end at or before ``start``."""
    before = F.filter(all_spans(value, CONTEXT_TOKEN), lambda t: t["end"] <= start)
    return F.transform(F.slice(before, F.greatest(F.size(before) - count + 1, F.lit(1)), F.lit(count)), lambda t: t["text"])


def staff_context(value, start: Column, end: Column) -> Column:
    """A rank word in the three tokens before the name, or a rank inside the parentheses around it."""
    whole = F.coalesce(text(value), F.lit(""))
    markers = _marker_keys()
    near = F.exists(last_tokens_before(whole, start), lambda t: name_key(t).isin(*markers))
    head = F.substring(whole, F.lit(1), start)
    tail = F.substring(whole, end + 1, F.lit(1_000_000_000))
    last_open = F.length(head) - F.instr(F.reverse(head), "(")
    last_close = F.length(head) - F.instr(F.reverse(head), ")")
    has_open = F.instr(head, "(") > 0
    open_after_close = has_open & ((F.instr(head, ")") == 0) | (last_open > last_close))
    body = F.substring(whole, start + 1, end - start)
    inside = open_after_close & (F.instr(body, ")") == 0) & (F.instr(tail, ")") > 0)
    content = F.lower(F.concat(
        F.substring(head, last_open + 2, F.lit(1_000_000_000)), body, F.substring(tail, F.lit(1), F.instr(tail, ")") - 1)))
    content = F.regexp_replace(content, r"(?U)\+\d+\b", "")
    words = F.transform(F.regexp_extract_all(content, F.lit(CONTEXT_TOKEN), F.lit(0)), name_key)
    ranked = (
        F.exists(words, lambda w: w.isin(*markers))
        | F.contains(name_key(content), F.lit("старшиймичман")) | F.contains(name_key(content), F.lit("стмн"))
        | (F.array_contains(words, "ст") & F.array_contains(words, "мн"))
    )
    return near | F.coalesce(inside & ranked, F.lit(False))
