"""Extraction rules over sentences written from table columns in varied forms.

The SQL side never parses a sentence: it knows what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconlink.functions import articles as A, dates as D, names as N, staff as ST, units as U
from reconlink.operators import persons as P
from reconlink.plans.reconcile import person_rows
from reconlink.queries.registry import Tables, query

LAST = ("Климов", "Орлов", "Холматов", "Смирнов", "Иваненко", "Петров")
FIRST = ("Андрей", "Дмитрий", "Тахир", "Иван", "Сергей")
MIDDLE = ("Олегович", "Игоревич", "Иванович", "Сергеевич")
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def pick(words: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))


def pick_sql(words: tuple[str, ...], key: str) -> str:
    return f"list_value({', '.join(repr(w) for w in words)})[CAST({key} % {len(words)} + 1 AS INT)]"


def form(key: Column, *forms: Column) -> Column:
    """The form of the key's remainder."""
    out = forms[-1]
    for i, f in reversed(list(enumerate(forms[:-1]))):
        out = F.when(key % len(forms) == i, f).otherwise(out)
    return out


def say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def people(t: Tables) -> DataFrame:
    k = F.col("k")
    return t.customer.select(F.col("c_custkey").alias("k")).withColumns({
        "l": pick(LAST, k), "f": pick(FIRST, k), "m": pick(MIDDLE, k), "born": F.date_add(F.lit("1960-01-02").cast("date"), (k % 15_000).cast("int"))})


PEOPLE = f"""p AS (SELECT c_custkey AS k, {pick_sql(LAST, 'c_custkey')} AS l, {pick_sql(FIRST, 'c_custkey')} AS f, {pick_sql(MIDDLE, 'c_custkey')} AS m,
  DATE '1960-01-02' + CAST(c_custkey % 15000 AS INT) AS born FROM customer)"""


@query("person_sentences", f"""
WITH {PEOPLE}
SELECT k, l AS last, CASE WHEN k % 4 = 2 THEN left(f, 1) ELSE f END AS first, CASE WHEN k % 4 = 2 THEN left(m, 1) ELSE m END AS middle,
       CASE WHEN k % 4 = 0 THEN strftime(born, '%Y-%m-%d') END AS birth, CASE WHEN k % 4 <> 3 THEN CAST(year(born) AS INT) END AS birth_year,
       false AS staff_context
FROM p WHERE NOT (k % 4 = 2 AND f LIKE 'И%')
""")
def person_sentences(t: Tables) -> DataFrame:
    """Full names with a birth date, a birth year or neither, and names with initials; "И" is a stop word and no first initial."""
    name, year = say(F.col("l"), " ", F.col("f"), " ", F.col("m")), F.year("born").cast("string")
    text = form(
        F.col("k"), say(name, " (", F.date_format("born", "dd.MM.yyyy"), " г.р.) при проверке"), say(name, " (", year, " г.р.)"),
        say(F.col("l"), " ", F.left("f", F.lit(1)), " ", F.left("m", F.lit(1)), " ", year, " г.р."), say(name, " ", F.date_format("born", "dd.MM.yyyy"), " произошло"))
    rows = person_rows(people(t).select(F.col("k").alias("mention_id"), text.alias("text")))
    return rows.select(F.col("mention_id").alias("k"), "last", "first", "middle", F.col("birth").cast("string").alias("birth"), "birth_year", "staff_context")


@query("birth_lookup_mode", f"""
WITH {PEOPLE}
SELECT k, CASE k % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'year' ELSE 'none' END AS mode,
       CASE WHEN k % 3 = 0 THEN strftime(born, '%Y-%m-%d') END AS birth, CASE WHEN k % 3 < 2 THEN CAST(year(born) AS INT) END AS birth_year
FROM p
""")
def birth_lookup_mode(t: Tables) -> DataFrame:
    """A shown date is looked up as a date, a shown year as a year, and nothing as nothing."""
    text = form(F.col("k"), say(" (", F.date_format("born", "dd.MM.yyyy"), ")"), say(" ", F.year("born").cast("string"), " г.р."), F.lit(" без данных"))
    day = form(F.col("k"), F.col("born"), F.make_date(F.year("born"), F.lit(1), F.lit(1)), F.lit(None).cast("date"))
    year = F.when(F.col("k") % 3 < 2, F.year("born"))
    asked = people(t).select("k", N.birth_query(text, F.lit(0), day, year, 80).alias("q"))
    return asked.select("k", "q.mode", F.col("q.birth").cast("string").alias("birth"), F.col("q.birth_year").cast("int").alias("birth_year"))


RANKS = (("ст.пр-к", "Старший прапорщик"), ("ст.м-н", "Старший мичман"), ("майор", "Майор"), ("прапорщек", "Прапорщик"))


@query("staff_sentences", f"""
WITH {PEOPLE}
SELECT k, {pick_sql(tuple(r for _, r in RANKS), 'k')} AS rank_full, l AS surname, left(f, 1) || '.' || left(m, 1) || '.' AS initials FROM p
""")
def staff_sentences(t: Tables) -> DataFrame:
    """Staff by short, abbreviated, plain and misspelt ranks."""
    rank = pick(tuple(r for r, _ in RANKS), F.col("k"))
    text = say("наряд (", rank, " ", F.col("l"), " ", F.left("f", F.lit(1)), ". ", F.left("m", F.lit(1)), ".), далее")
    rows = ST.staff_mentions(people(t).select(F.col("k").alias("mention_id"), text.alias("text")))
    return rows.select(F.col("mention_id").alias("k"), "rank_full", "surname", "initials")


@query("staff_context_sentences", f"WITH {PEOPLE} SELECT k, k % 3 < 2 AS staff FROM p")
def staff_context_sentences(t: Tables) -> DataFrame:
    """A rank near the name or in the parentheses around it; a rank far before it does not count."""
    before = form(F.col("k"), F.lit("наряд прапорщик "), F.lit("(наряд "), F.lit("далеко майор был тогда тут "))
    text = say(before, F.col("l"), form(F.col("k"), F.lit(""), F.lit(", майор) и"), F.lit("")))
    rows = people(t).select("k", text.alias("t"), F.length(before).alias("a"), (F.length(before) + F.length("l")).alias("b"))
    return rows.select("k", ST.staff_context("t", F.col("a"), F.col("b")).alias("staff"))


@query("name_readings", f"""
WITH {PEOPLE}
SELECT k, lower(l) || 'а' AS written, true AS last_found, true AS middle_found FROM p
""")
def name_readings(t: Tables) -> DataFrame:
    """Declined surnames and patronymics come back to the nominative."""
    rows = people(t).select("k", say(F.lower("l"), "а").alias("written"), F.lower("l").alias("l"), F.lower("m").alias("m"))
    return rows.select("k", "written", F.array_contains(N.variants("written", "last"), F.col("l")).alias("last_found"),
                       F.array_contains(N.variants(say(F.col("m"), "а"), "middle"), F.col("m")).alias("middle_found"))


@query("person_shown", f"""
WITH {PEOPLE}
SELECT k, l || ' ' || f || ' ' || m || CASE k % 3 WHEN 0 THEN ', ' || strftime(born, '%d.%m.%Y') || ' г.р.' WHEN 1 THEN ', ' || year(born) || ' г.р.' ELSE '' END AS shown,
       l || '-' || l AS cased
FROM p WHERE NOT (k % 3 = 0 AND month(born) = 1 AND day(born) = 1)
""")
def person_shown(t: Tables) -> DataFrame:
    """Names with date, year or nothing; letter case of double names."""
    rows = people(t).filter(~((F.col("k") % 3 == 0) & N.year_only("born")))
    day, year = F.when(F.col("k") % 3 == 0, F.col("born")), F.when(F.col("k") % 3 == 1, F.year("born"))
    return rows.select("k", N.person_display("l", "f", "m", day, year).alias("shown"), N.name_case(say(F.upper("l"), "-", F.lower("l"))).alias("cased"))


@query("person_light_rules", f"""
WITH {PEOPLE} SELECT k, CASE k % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'warn' WHEN 3 THEN 'warn' ELSE 'err' END AS light FROM p
""")
def person_light_rules(t: Tables) -> DataFrame:
    """Exact with the date, exact with the year, fuzzy, possible and missing persons."""
    k = F.col("k")
    rows = people(t).withColumn("id", k.cast("string"))
    links = rows.select(
        F.col("id").alias("mention_id"), F.lit(1).alias("seq"), F.when(k % 5 < 4, F.col("id")).alias("person_id"), F.col("id").alias("event_id"),
        form(k, F.lit("matched"), F.lit("matched"), F.lit("matched"), F.lit("possible"), F.lit("missing_in_registry")).alias("bucket"),
        form(k, F.lit("exact"), F.lit("exact"), F.lit("fuzzy"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("match_type"))
    report = rows.select(F.col("id").alias("mention_id"), F.lit(1).alias("seq"), F.when(k % 5 != 1, F.col("born")).alias("birth"), F.when(k % 5 == 1, F.year("born")).alias("birth_year"))
    known = rows.select(F.col("id").alias("event_id"), F.col("id").alias("person_id"), F.col("born").alias("birth"))
    return P.person_lights(links, report, known).select(F.col("mention_id").cast("long").alias("k"), "light")


@query("worded_times", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 4 THEN ' 00:00' ELSE
         ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS found,
       o_orderkey % 5 < 4 AS time_found
FROM orders
""")
def worded_times(t: Tables) -> DataFrame:
    """Dates in words and figures with four forms of the time, and one without."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    hour, minute = (k % 24).cast("string"), F.lpad((k % 60).cast("string"), 2, "0")
    two = F.lpad(hour, 2, "0")
    text = form(
        k, say(F.dayofmonth(day).cast("string"), " ", F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day)), " ", F.year(day).cast("string"), " года в ", hour, ":", minute, " произошло"),
        say(F.date_format(day, "dd.MM.yyyy"), " в ", two, ".", minute, " правонарушение"), say(F.date_format(day, "dd-MM-yyyy"), ", в ", hour, " ч ", minute, " мин выявлен факт"),
        say(F.date_format(day, "dd.MM.yyyy"), " ", two, ".", minute, ", застава"), say(F.date_format(day, "dd.MM.yyyy"), " по статье 18.3 ч. 1 составлен протокол"))
    rows = D.with_date_time(t.orders.select("o_orderkey", text.alias("text")))
    return rows.select("o_orderkey", F.date_format("date_time", "yyyy-MM-dd HH:mm").alias("found"), "time_found")


@query("article_sentences", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN a || ' ч. ' || p WHEN 1 THEN a || ' ч. ' || p WHEN 2 THEN a END AS article
FROM (SELECT o_orderkey, (5 + o_orderkey % 20) || '.' || (1 + o_orderkey % 30) AS a, CAST(1 + o_orderkey % 4 AS VARCHAR) AS p FROM orders)
""")
def article_sentences(t: Tables) -> DataFrame:
    """Part before article, part after article, a bare article, and figures without a marker."""
    k = F.col("o_orderkey")
    a, p = say((5 + k % 20).cast("string"), ".", (1 + k % 30).cast("string")), (1 + k % 4).cast("string")
    text = form(k, say("по ч. ", p, " ст. ", a, " задержан"), say("по статье ", a, " часть ", p), say("ст. ", a), say("в тексте только ", a, " ч.", p, " без маркеров"))
    return t.orders.select("o_orderkey", A.article_of(text).alias("article"))


@query("unit_forms", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'погз №' || n ELSE 'кпп-' || n || ' ' || lower(n_name) END AS folded,
       CASE WHEN c_custkey % 4 < 3 THEN 3 END AS start_at
FROM (SELECT c_custkey, CAST(1 + c_custkey % 9 AS VARCHAR) AS n, replace(n_name, ' ', '') AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def unit_forms(t: Tables) -> DataFrame:
    """Spellings of one unit fold to one form, which is found again in the text it came from."""
    k, n, name = F.col("c_custkey"), (1 + F.col("c_custkey") % 9).cast("string"), F.replace("n_name", F.lit(" "), F.lit(""))
    unit = form(k, say("КПП-", n, " «", name, "»"), say("КПП ", n, ' "', name, '"'), say("КПП No ", n, " ", name), say("ПОГЗ № ", n))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", unit.alias("unit")).withColumn("folded", U.unit_fold("unit"))
    span = U.raw_span(say("На ", F.col("unit"), " выявлено"), "folded")
    return rows.select("c_custkey", "folded", F.when(k % 4 < 3, span["start"]).alias("start_at"))


@query("unit_groups", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'опк №' || n || ' ' || name WHEN 1 THEN 'пз №' || n ELSE 'застава ' || name END AS folded,
       CASE c_custkey % 3 WHEN 0 THEN 'OP' WHEN 1 THEN 'PZ' ELSE 'UNKNOWN' END AS unit_group
FROM (SELECT c_custkey, CAST(1 + c_custkey % 9 AS VARCHAR) AS n, lower(replace(n_name, ' ', '')) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def unit_groups(t: Tables) -> DataFrame:
    k, n, name = F.col("c_custkey"), (1 + F.col("c_custkey") % 9).cast("string"), F.replace("n_name", F.lit(" "), F.lit(""))
    unit = form(k, say("ОПК  No ", n, " «", name, "»"), say("ПЗ № ", n), say("застава ", name))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", U.alias_fold(unit).alias("folded"), U.unit_group(unit).alias("unit_group"))


@query("elapsed_shown", """
SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown
FROM (SELECT event_id, greatest(CAST(floor(value * 100) AS BIGINT) - 50, 0) AS s FROM events)
""")
def elapsed_shown(t: Tables) -> DataFrame:
    return t.events.select("event_id", D.elapsed_text(F.floor(F.col("value") * 100) - 50).alias("shown"))
