"""Dates and times found in report text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reconlink.functions.spans import all_spans, first_span, overlaps
from reconlink.functions.text import date_fold, let, text

# Month names and the patterns that define a date or a time.
MONTHS = (
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
)
DATE_NUMERIC = r"(?U)\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b"
DATE_WORD = (
    r"(?iuU)\b(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{2,4})(?:\s*(?:года|г\.?))?\b"
)
TIME_CONTEXT = r"(?:\b(?:в|к|около|примерно|время)\b[\s,:;\-]*)"
TIME_CLOCK = r"(?iuU)" + TIME_CONTEXT + r"(\d{1,2})\s*[.:]\s*(\d{2})\b"
TIME_HOURS = (
    r"(?iuU)" + TIME_CONTEXT
    + r"(\d{1,2})\s*(?:ч|час(?:а|ов)?)\.?\s*(?:(\d{1,2})\s*(?:м|мин(?:ут(?:а|ы)?)?)\.?)?"
)
TIME_BARE = r"(?iuU)\b(\d{1,2})\s*([.:])\s*(\d{2})\b"
LEGAL_BEFORE = r"(?iuU)(?:\bст\.?|\bстат(?:ья|ьи|ье|ью)|\bч\.?)\s*$"
LEGAL_WINDOW = 16


def _number(value: Column) -> Column:
    return F.when(value != "", value).cast("int")


def _date_of(match: Column, pattern: str, month: Column) -> Column:
    body = match["text"]
    raw = _number(F.regexp_extract(body, pattern, 3))
    year = F.when(raw < 100, raw + 2000).otherwise(raw)
    day = _number(F.regexp_extract(body, pattern, 1))
    made = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))
    return F.struct(made.cast("date").alias("date"), match["start"].alias("start"), match["end"].alias("end"))


def _valid(found: Column) -> Column:
    return F.filter(found, lambda m: m["date"].isNotNull())


def date_mention(value) -> Column:
    """struct<date,start,end>: first valid numeric date, else first valid worded date, else NULL."""
    plain = date_fold(F.coalesce(text(value), F.lit("")))
    numeric = F.transform(
        all_spans(plain, DATE_NUMERIC),
        lambda m: _date_of(m, DATE_NUMERIC, _number(F.regexp_extract(m["text"], DATE_NUMERIC, 2))),
    )
    months = F.array(*[F.lit(m) for m in MONTHS])
    worded = F.transform(
        all_spans(plain, DATE_WORD),
        lambda m: _date_of(
            m, DATE_WORD,
            F.array_position(months, F.lower(F.regexp_extract(m["text"], DATE_WORD, 2))).cast("int"),
        ),
    )
    return F.coalesce(F.try_element_at(_valid(numeric), F.lit(1)), F.try_element_at(_valid(worded), F.lit(1)))


def _clock(body: Column, pattern: str, minute_group: int) -> Column:
    hour = _number(F.regexp_extract(body, pattern, 1))
    minute = F.coalesce(_number(F.regexp_extract(body, pattern, minute_group)), F.lit(0))
    return F.when((hour <= 23) & (minute <= 59), F.struct(hour.alias("hour"), minute.alias("minute")))


def _first_clock(plain: Column, pattern: str) -> Column:
    span = first_span(plain, pattern)
    parts = _clock(F.regexp_extract(plain, pattern, 0), pattern, 2)
    return F.when(
        span.isNotNull() & parts.isNotNull(),
        F.struct(parts["hour"].alias("hour"), parts["minute"].alias("minute"),
                 span["start"].alias("start"), span["end"].alias("end")),
    )


def time_mention(value, date_span: Column | None = None) -> Column:
    """struct<hour,minute,start,end> or NULL.

    A time after a context word wins, then "N h M min", then a bare time that
    neither overlaps the date nor follows a law article; ':' before '.', then
    the nearest to the date, then the earliest.
    """
    spot = F.lit(None).cast("struct<start:int,end:int>") if date_span is None else date_span
    folded = date_fold(F.coalesce(text(value), F.lit("")))
    return let(F.struct(folded.alias("plain"), spot.alias("spot")), lambda p: _time_in(p["plain"], p["spot"]))


def _time_in(plain: Column, spot: Column) -> Column:
    def bare(match: Column) -> Column:
        parts = _clock(match["text"], TIME_BARE, 3)
        separator = F.when(F.regexp_extract(match["text"], TIME_BARE, 2) == ":", 0).otherwise(1)
        away = (
            F.when(spot.isNull(), match["start"])
            .when(match["start"] >= spot["end"], match["start"] - spot["end"])
            .otherwise(spot["start"] - match["end"])
        )
        return F.struct(
            separator.alias("separator"), away.alias("away"), match["start"].alias("start"),
            match["end"].alias("end"), parts.alias("parts"),
        )

    def allowed(match: Column) -> Column:
        left = F.substring(plain, F.greatest(match["start"] - LEGAL_WINDOW, F.lit(0)) + 1,
                           F.least(match["start"], F.lit(LEGAL_WINDOW)))
        return ~F.coalesce(overlaps(match, spot), F.lit(False)) & ~left.rlike(LEGAL_BEFORE)

    candidates = F.filter(
        F.transform(F.filter(all_spans(plain, TIME_BARE), allowed), bare), lambda c: c["parts"].isNotNull()
    )
    nearest = let(F.array_min(candidates), lambda best: F.when(best.isNotNull(), F.struct(
        best["parts"]["hour"].alias("hour"), best["parts"]["minute"].alias("minute"),
        best["start"].alias("start"), best["end"].alias("end"))))
    return F.coalesce(_first_clock(plain, TIME_CLOCK), _first_clock(plain, TIME_HOURS), nearest)


def with_date_time(df, text_col: str = "text"):
    """Adds date_time, time_found, date_span, time_span; a time without a date gives no timestamp."""
    empty = F.lit(None).cast("struct<start:int,end:int>")
    return (
        df.withColumn("_date", date_mention(text_col))
        .withColumn("date_span", F.when(F.col("_date").isNotNull(), F.struct("_date.start", "_date.end")).otherwise(empty))
        .withColumn("_time", time_mention(text_col, F.col("date_span")))
        .withColumn("time_span", F.when(F.col("_time").isNotNull(), F.struct("_time.start", "_time.end")).otherwise(empty))
        .withColumn("time_found", F.col("_date").isNotNull() & F.col("_time").isNotNull())
        .withColumn("date_time", F.try_make_timestamp(
            F.year("_date.date"), F.month("_date.date"), F.dayofmonth("_date.date"),
            F.coalesce(F.col("_time.hour"), F.lit(0)), F.coalesce(F.col("_time.minute"), F.lit(0)), F.lit(0)))
        .drop("_date", "_time")
    )


def first_date_or_time_span(value) -> Column:
    """Span of the first valid date, else of the time."""
    spotted = date_mention(value)
    clock = time_mention(value)
    return F.coalesce(
        F.when(spotted.isNotNull(), F.struct(spotted["start"].alias("start"), spotted["end"].alias("end"))),
        F.when(clock.isNotNull(), F.struct(clock["start"].alias("start"), clock["end"].alias("end"))),
    )


def elapsed_text(seconds) -> Column:
    s = F.greatest(text(seconds).cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def date_time_text(value) -> Column:
    return F.coalesce(F.date_format(text(value), "dd.MM.yyyy HH:mm"), F.lit("—"))

