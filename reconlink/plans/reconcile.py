"""The whole job: mentions of all batches in, scored field-by-field comparisons out.

Every step is one transform over all mentions; the extracted tables are cut
once because several later steps read them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reconlink import scale
from reconlink.config import DEFAULTS, Thresholds
from reconlink.functions import articles as A, names as N, staff as ST
from reconlink.functions.dates import with_date_time
from reconlink.functions.text import yo_fold
from reconlink.operators import classify as C, dictmatch as D, persons as P
from reconlink.plans import ladder as L, verdict as V
from reconlink.sources.registry import Registry


@dataclass(frozen=True)
class Extracted:
    attributes: DataFrame
    people: DataFrame
    staff: DataFrame
    unit_candidates: DataFrame
    categories: DataFrame


@dataclass(frozen=True)
class Reconciled:
    results: DataFrame
    links: DataFrame
    ladder: L.LadderResult
    extracted: Extracted


def person_rows(mentions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per person of a text: parts cased, birth, spans, staff context."""
    found = mentions.select("mention_id", "text", F.posexplode(N.person_mentions("text", t.birth_window)).alias("seq", "p"))
    cased = found.select(
        "mention_id", "text", "seq", N.name_case("p.last").alias("last"), N.name_case("p.first").alias("first"),
        N.name_case("p.middle", keep_suffix=True).alias("middle"), "p.birth", "p.birth_year", "p.start", "p.end", "p.source", "p.surface_text")
    return cased.withColumns({
        "full_name": N.full_name("last", "first", "middle"),
        "staff_context": ST.staff_context("text", F.col("start"), F.col("end")),
        "rank_raw": ST.rank_before("text", F.col("start")),
        "birth_span": N.birth_span("text", F.col("end"), t.birth_window)}).drop("text")


def staff_people(staff: DataFrame, people: DataFrame) -> DataFrame:
    """Staff as people that only re-enter when the event knows their surname.

    Staff mentions first, then the persons set aside for their staff context
    with a rank before them; only surname and initials are known of either.
    Who is listed as a person already is left out.
    """
    letters = F.regexp_extract_all("initials", F.lit("(?iu)[А-ЯЁ]"), F.lit(0))
    named = staff.select("mention_id", (F.lit(1_000_000) + F.col("staff_no")).alias("seq"), F.col("surname").alias("last"),
                         letters[0].alias("first"), letters[1].alias("middle"))
    short = (F.length("first") == 1) & (F.length("middle") == 1)
    aside = people.filter("staff_context AND rank_raw <> ''").select(
        "mention_id", (F.lit(2_000_000) + F.col("seq")).alias("seq"), "last", F.when(short, F.col("first")).otherwise("").alias("first"),
        F.when(short, F.col("middle")).otherwise("").alias("middle"))
    key = lambda df: df.withColumns({
        "_l": N.surname_key("last"), "_f": F.lower("first"), "_m": F.lower("middle")})
    rows = key(named.unionByName(aside)).join(
        key(people.filter("NOT staff_context")).select("mention_id", "_l", "_f", "_m"), ["mention_id", "_l", "_f", "_m"], "left_anti")
    once = rows.groupBy("mention_id", "_l", "_f", "_m").agg(F.min_by(F.struct("seq", "last", "first", "middle"), "seq").alias("p"))
    return once.select(
        "mention_id", "p.*", F.lit(None).cast("date").alias("birth"), F.lit(None).cast("int").alias("birth_year"),
        F.lit(True).alias("staff_context"))


def extract(mentions: DataFrame, units: DataFrame, rules: DataFrame, encoder: Callable[[Column], Column] | None = None,
            t: Thresholds = DEFAULTS) -> Extracted:
    """``mentions``: mention_id, idx, text, org_id."""
    timed = with_date_time(mentions)
    units_found = scale.cut(D.match_units(mentions, units, encoder=encoder, t=t))
    category = C.classify(mentions, rules, encoder=encoder, t=t).select(
        "mention_id", "category", F.col("pattern").alias("rule_pattern"), F.col("article").alias("rule_article"),
        F.col("score").alias("category_score"), F.col("method").alias("category_method"), F.col("fragment").alias("category_fragment"))
    attributes = (
        timed.withColumn("articles", A.article_mentions("text"))
        .withColumn("article", F.try_element_at("articles", F.lit(1))["article"])
        .join(D.accept_unit(units_found, mentions, t), "mention_id", "left").join(category, "mention_id", "left"))
    return Extracted(
        scale.cut(attributes), scale.cut(person_rows(mentions, t)), scale.cut(ST.staff_mentions(mentions)), units_found, category)


def reconcile(mentions: DataFrame, registry: Registry, units: DataFrame, rules: DataFrame, *,
              encoder: Callable[[Column], Column] | None = None, t: Thresholds = DEFAULTS) -> Reconciled:
    """``mentions``: batch_id, mention_id, idx, text, org_id (the org chosen for the batch or NULL)."""
    ex = extract(mentions, units, rules, encoder, t)
    own = ex.people.filter("NOT staff_context")
    events = registry.event.select("event_id", "event_ts", "unit_id")
    known = registry.person.select("event_id", "person_id", "last", "first", "middle", "birth")
    asked = ex.attributes.select(
        "mention_id", F.col("date_time").alias("ts"), "unit_id",
        (F.coalesce(F.col("unit_score") >= t.unit_accept, F.lit(False)) | F.col("org_id").isNotNull()).alias("high_conf"))

    def overlap(pairs: DataFrame) -> DataFrame:
        listed = pairs.join(own, "mention_id").withColumn("place", F.struct(F.lit(False), "seq"))
        placed = P.assign(P.link_candidates(listed, P.takeable(P.registry_rows(known.join(pairs.select("event_id").distinct(), "event_id", "left_semi"))), t))
        return placed.filter("bucket = 'matched'").groupBy("mention_id", "event_id").agg(F.count(F.lit(1)).alias("overlap"))

    texts = mentions.select("mention_id", "text")
    lookups = own.join(texts, "mention_id").withColumn("q", N.birth_query("text", F.col("end"), "birth", "birth_year", t.birth_year_window)).select(
        "mention_id", "seq", yo_fold("last").alias("surname"), "q.mode", F.col("q.birth").alias("birth"), F.col("q.birth_year").alias("birth_year"))
    folded = known.select("event_id", yo_fold("last").alias("surname"), "birth")

    def person_stage(open_: DataFrame) -> DataFrame:
        return L.by_persons(open_, lookups.join(open_.select("mention_id"), "mention_id", "left_semi"), folded, events, t)

    climbed = L.resolve(asked, events, overlap, person_stage, t)
    pairs = climbed.decisions.filter("matched").select("mention_id", "event_id")
    everyone = own.select("mention_id", "seq", "last", "first", "middle", "birth", "birth_year", "staff_context").unionByName(
        staff_people(ex.staff, ex.people))
    links = scale.cut(P.link_persons(pairs, everyone, known, t))
    counts = P.all_agree(P.bucket_counts(links, known)).select(
        "mention_id", "event_id", F.col("matched").alias("persons_matched"), F.col("registry_total").alias("persons_registered"),
        F.col("possible").alias("persons_possible"), F.col("missing_in_registry").alias("persons_missing_registry"),
        F.col("missing_in_report").alias("persons_missing_report"), F.round(F.col("ratio") * 100, 2).alias("persons_percent"), "persons_agree")
    expected = everyone.groupBy("mention_id").agg(F.count(F.lit(1)).alias("persons_expected"))
    unit_names = units.select(F.col("unit_id").alias("_eu"), F.col("name").alias("event_unit_name"))
    rows = (
        ex.attributes.join(climbed.decisions, "mention_id")
        .join(registry.event.select("event_id", "event_ts", F.col("unit_id").alias("_eu"), "event_type", F.col("article").alias("event_article")), "event_id", "left")
        .join(unit_names, "_eu", "left")
        .join(counts, ["mention_id", "event_id"], "left")
        .join(expected, "mention_id", "left")
        .drop("_eu"))
    # an event without persons agrees with a text without persons
    rows = rows.withColumns({
        "persons_agree": F.coalesce("persons_agree", F.col("matched")), "unit_percent": F.round(F.col("unit_score") * 100, 2),
        "event_id": F.when(F.col("matched"), F.col("event_id")),
        "category_ok": F.when(F.col("matched"), V.category_agrees("category", "event_type"))})
    rows = V.with_articles(rows)
    rows = V.comments(V.diffs(V.with_lights(rows, t)), t)
    return Reconciled(rows, links, climbed, ex)
