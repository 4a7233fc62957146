"""From a decided pair to lights, diffs, comments and displays: all stored at write time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconlink.config import DEFAULTS, Thresholds
from reconlink.functions.articles import article_light
from reconlink.functions.dates import date_time_text
from reconlink.functions.text import compare_value, text


def flag_light(flag) -> Column:
    return F.when(text(flag), "green").when(~text(flag), "red").otherwise("neutral")


def time_light(matched, delta_minutes, tolerance: int) -> Column:
    away = F.abs(text(delta_minutes))
    return (
        F.when(~F.coalesce(text(matched), F.lit(False)) | away.isNull(), "red")
        .when(away == 0, "green").when(away <= tolerance, "yellow").otherwise("red"))


def unit_light(percent, conflict=None, t: Thresholds = DEFAULTS) -> Column:
    """By the unit match percent alone; needs no match. A conflict allows yellow at best."""
    p = text(percent)
    at_odds = F.lit(False) if conflict is None else F.coalesce(text(conflict), F.lit(False))
    return (
        F.when(p.isNull(), "red")
        .when(~at_odds & (p >= t.unit_green * 100), "green").when(p >= t.unit_yellow * 100, "yellow").otherwise("red"))


def persons_light(matched, hits, registered, possible, missing_there, missing_here) -> Column:
    n = lambda c: F.coalesce(text(c), F.lit(0))
    issues = (n(possible) > 0) | (n(missing_there) > 0) | (n(missing_here) > 0)
    return (
        F.when(~F.coalesce(text(matched), F.lit(False)), "red")
        .when((n(hits) == n(registered)) & ~issues, "green")
        .when((n(hits) == 0) & ((n(registered) > 0) | issues), "red").otherwise("yellow"))


def category_agrees(predicted, registered) -> Column:
    """NULL when neither side names a category."""
    a, b = compare_value(predicted), compare_value(registered)
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(a == b, F.lit(False)))


def title(idx, matched) -> Column:
    return F.concat(F.lit("Событие "), text(idx).cast("string"), F.when(text(matched), "").otherwise(" — в базе данных не найдено"))


def preview(value, size: int = 80) -> Column:
    whole = F.coalesce(text(value), F.lit(""))
    return F.concat(F.left(whole, F.lit(size)), F.when(F.length(whole) > size, "…").otherwise(""))


def with_lights(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds the five lights, title and preview to a decided row.

    Needs matched, delta_minutes, unit_percent, persons counts, category_ok,
    article_light, idx and text.
    """
    return rows.withColumns({
        "light_time": time_light("matched", "delta_minutes", t.time_light_minutes),
        "light_unit": unit_light("unit_percent", t=t),
        "light_persons": persons_light("matched", "persons_matched", "persons_registered", "persons_possible",
                                       "persons_missing_registry", "persons_missing_report"),
        "light_category": flag_light("category_ok"),
        "light_article": F.coalesce("article_light", flag_light("article_ok")),
        "title": title("idx", "matched"), "preview": preview("text")})


def diffs(rows: DataFrame) -> DataFrame:
    """Adds diffs: a struct of expected and actual per field, NULL where they agree.

    Persons are compared by their numbers here; who differs stands in the links.
    """
    pair = lambda e, a: F.struct(text(e).cast("string").alias("expected"), text(a).cast("string").alias("actual"))
    late = F.struct(
        F.lit("Событие найдено по подразделению и нарушителям; дата/время отличаются").alias("message"),
        F.col("delta_minutes").alias("delta_minutes"), date_time_text("date_time").alias("extracted"),
        date_time_text("event_ts").alias("registered"))
    m = F.coalesce("matched", F.lit(False))
    return rows.withColumn("diffs", F.struct(
        F.when(m & ~F.col("category_ok"), pair("category", "event_type")).alias("category"),
        F.when(m & (F.col("article_light") == "red"), pair("article", "event_article")).alias("article"),
        F.when(m & ~F.col("unit_ok"), pair("unit_name", "event_unit_name")).alias("unit"),
        F.when(m & ~F.col("persons_agree"), pair("persons_expected", "persons_registered")).alias("persons"),
        F.when(m & F.col("time_mismatch") & F.col("delta_minutes").isNotNull(), late).alias("time")))


def has_diffs(d: str = "diffs") -> Column:
    return F.col(f"{d}.category").isNotNull() | F.col(f"{d}.article").isNotNull() | F.col(f"{d}.unit").isNotNull() | F.col(
        f"{d}.persons").isNotNull() | F.col(f"{d}.time").isNotNull()


def comments(rows: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Adds comments: the list of remarks a reader sees, in their fixed order."""
    m = F.coalesce("matched", F.lit(False))
    no_unit = F.col("unit_name").isNull()
    only_date = F.col("date_time").isNotNull() & ~F.coalesce("time_found", F.lit(False))
    line = lambda cond, value: F.when(cond, value if isinstance(value, Column) else F.lit(value))
    delta = F.col("delta_minutes").cast("string")
    unmatched = F.array(
        F.lit("Событие не найдено."),
        line(only_date, "Не определилось время (использована только дата)."),
        line(no_unit, "Подразделение не определено в сводке."))
    registered = F.coalesce(F.col("persons_registered").cast("string"), F.lit("0"))
    hits = F.coalesce(F.col("persons_matched").cast("string"), F.lit("0"))
    matched = F.array(
        line(~has_diffs(), "Расхождений не обнаружено."),
        line(F.col("diffs.unit").isNotNull() & ~no_unit, "Подразделение не совпадает с БД."),
        line(no_unit, "Подразделение не определено в сводке."),
        line(F.col("diffs.persons").isNotNull(), "Нарушители отличаются от данных БД."),
        line(~F.col("category_ok"), "Тип события отличается от классификации."),
        line(~F.col("article_ok"), "Статья закона отличается от данных БД."),
        line(F.col("article_ok") & ~F.col("article_rule_ok"), "Статья закона отличается от классификации."),
        line(~F.col("article_rule_ok") & F.col("rule_article").isNotNull(),
             F.concat(F.lit("По классификатору ожидается: "), F.col("rule_article"), F.lit("."))),
        line(F.col("article").isNull() & F.col("article_light").isin("red", "yellow"), "Статья закона не определена в тексте сводки."),
        line(F.col("time_mismatch"), F.col("diffs.time.message")),
        line(F.col("time_mismatch") & F.col("delta_minutes").isNotNull(), F.concat(
            F.lit("Δ времени: "), delta, F.lit(" мин. Извлечено: "), F.col("diffs.time.extracted"),
            F.lit(", портал: "), F.col("diffs.time.registered"), F.lit("."))),
        line(F.abs("delta_minutes") > t.time_light_minutes, F.concat(
            F.lit("Ошибка: расхождение даты/времени на "), delta, F.lit(f" мин (более {t.time_light_minutes} мин)."))),
        F.concat(F.lit("Совпало нарушителей: "), hits, F.lit(" из "), registered, F.lit(".")),
        line(only_date, "Не определилось время (использована только дата)."))
    return rows.withColumn("comments", F.array_compact(F.when(m, matched).otherwise(unmatched)))


def person_report(links: DataFrame, people: DataFrame, registry: DataFrame) -> DataFrame:
    """mention_id, event_id, line_no, line: what differs between the persons of both sides.

    ``people`` and ``registry`` carry a ``display`` column. Missing persons of a side are one line.
    """
    pair = ["mention_id", "event_id"]
    rows = links.join(people.select("mention_id", "seq", F.col("display").alias("_s")), ["mention_id", "seq"], "left").join(
        registry.select("event_id", F.col("person_id").cast("string").alias("person_id"), F.col("display").alias("_p")),
        ["event_id", "person_id"], "left")
    bucket = F.col("bucket")
    line = (
        F.when((bucket == "matched") & F.col("note").isNotNull() & (F.col("note") != ""), F.concat(
            F.lit("ФИО совпало частично/с ошибкой: "), F.col("_s"), F.lit(" / "), F.col("_p"), F.lit(" ("), F.col("note"), F.lit(")")))
        .when(bucket == "possible", F.concat(
            F.lit("Возможное совпадение по ФИО, но ДР отличается: "), F.col("_s"), F.lit(" / "), F.col("_p")))
        .when(bucket == "ambiguous", F.concat(F.lit("Неоднозначное совпадение: "), F.col("_s"))))
    order = F.when(bucket == "matched", 1).when(bucket == "possible", 2).otherwise(3)
    single = rows.select(*pair, order.alias("line_no"), line.alias("line")).filter("line IS NOT NULL").distinct()
    missing = rows.filter(bucket.isin("missing_in_registry", "missing_in_report")).select(
        *pair, "bucket", F.coalesce("_s", "_p").alias("_name")).distinct()
    lists = missing.groupBy(*pair, "bucket").agg(F.array_join(F.array_sort(F.collect_list("_name")), ", ").alias("_l"))
    here = F.col("bucket") == "missing_in_registry"
    return single.unionByName(lists.select(
        *pair, F.when(here, 4).otherwise(5).alias("line_no"),
        F.concat(F.when(here, "В сводке есть, в БД нет: ").otherwise("В БД есть, в сводке нет: "), F.col("_l")).alias("line")))


def backfill(results: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Recompute the stored light, title and preview columns of older rows from their stored structs."""
    return with_lights(results.drop("light_time", "light_unit", "light_persons", "light_category", "light_article", "title", "preview"), t)


def with_articles(rows: DataFrame) -> DataFrame:
    """Adds article_light, article_ok and article_rule_ok from article, rule_article and event_article."""
    return rows.withColumn("article_light", article_light("article", "rule_article", "event_article")).withColumns({
        "article_ok": F.col("article_light") != "red",
        "article_rule_ok": article_light("article", "rule_article", "rule_article") != "red"})
