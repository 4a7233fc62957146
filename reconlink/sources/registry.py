"""Registry tables and the named queries over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconlink.functions.text import yo_fold
from reconlink.operators.relops import birth_filter, children_list, equal_if_given

EVENT = "e.event_id, e.event_ts, e.unit_id, e.event_type, e.article"
PERSON_MATCH = """
    replace(lower(p.last), 'ё', 'е') = replace(lower(:last), 'ё', 'е')
    AND (:birth IS NULL OR p.birth = to_date(:birth))
    AND (:birth IS NOT NULL OR :birth_year IS NULL OR year(p.birth) = :birth_year)"""

# Named, parameterised queries; {schema} is the catalog or view prefix of a profile.
NAMED = {
    "org/list": "SELECT org_id, short_name, full_name FROM {schema}org ORDER BY short_name, full_name",
    "unit/list": "SELECT unit_id, name, short_name, org_id FROM {schema}unit WHERE :org_id IS NULL OR org_id = :org_id ORDER BY name",
    "event/get": f"SELECT {EVENT} FROM {{schema}}registry_event e WHERE e.event_id = :event_id",
    "event/by_time": f"SELECT {EVENT} FROM {{schema}}registry_event e WHERE e.event_ts BETWEEN to_timestamp(:from_ts) AND to_timestamp(:to_ts) ORDER BY e.event_ts DESC, e.event_id LIMIT :limit",
    "event/by_unit_time": f"SELECT {EVENT} FROM {{schema}}registry_event e WHERE e.unit_id = :unit_id AND e.event_ts BETWEEN to_timestamp(:from_ts) AND to_timestamp(:to_ts) ORDER BY e.event_ts DESC, e.event_id LIMIT :limit",
    "event/by_person": f"SELECT DISTINCT {EVENT} FROM {{schema}}registry_event e JOIN {{schema}}registry_person p ON p.event_id = e.event_id WHERE {PERSON_MATCH} ORDER BY e.event_ts DESC, e.event_id LIMIT :limit",
    "event/by_person_unit": f"SELECT DISTINCT {EVENT} FROM {{schema}}registry_event e JOIN {{schema}}registry_person p ON p.event_id = e.event_id WHERE e.unit_id = :unit_id AND {PERSON_MATCH} ORDER BY e.event_ts DESC, e.event_id LIMIT :limit",
}


@dataclass(frozen=True)
class QueryBook:
    """Named queries of a profile with a fallback book, run with bound parameters."""

    texts: dict[str, str]
    schema: str = ""
    profile: str = "default"
    fallback: QueryBook | None = None

    def text(self, name: str) -> str:
        tried, book = [], self
        while book is not None:
            if name in book.texts:
                return book.texts[name].format(schema=self.schema)
            tried.append(f"{book.profile}/{name}")
            book = book.fallback
        raise KeyError(f"no query {name!r}; tried: {', '.join(tried)}")

    def run(self, spark: SparkSession, name: str, **args) -> DataFrame:
        return spark.sql(self.text(name), args=args)


DEFAULT_BOOK = QueryBook(NAMED)


def newest(events: DataFrame, limit: int | None) -> DataFrame:
    """All events newest first, or the first ``limit`` of them."""
    rows = events.orderBy(F.desc("event_ts"), "event_id")
    return rows if limit is None else rows.limit(limit)


@dataclass(frozen=True)
class Registry:
    """The registry is any four DataFrames with the agreed columns."""

    org: DataFrame
    unit: DataFrame
    event: DataFrame
    person: DataFrame

    def as_views(self, prefix: str = "") -> None:
        for name, df in (("org", self.org), ("unit", self.unit), ("registry_event", self.event), ("registry_person", self.person)):
            df.createOrReplaceTempView(prefix + name)

    def orgs(self) -> DataFrame:
        return self.org.select("org_id", "short_name", "full_name").orderBy("short_name", "full_name")

    def units(self, org_id: str | None = None) -> DataFrame:
        return equal_if_given(self.unit, "org_id", org_id).select("unit_id", "name", "short_name", "org_id").orderBy("name")

    def event_by_id(self, event_id: str) -> DataFrame:
        return self.event.filter(F.col("event_id") == event_id)

    def events_by_time(self, low, high, limit: int | None = None, unit_id: str | None = None) -> DataFrame:
        rows = equal_if_given(self.event, "unit_id", unit_id).filter(F.col("event_ts").between(F.lit(low), F.lit(high)))
        return newest(rows, limit)

    def events_by_person(self, last: str, birth=None, birth_year: int | None = None, unit_id: str | None = None, limit: int | None = None) -> DataFrame:
        people = self.person.filter((yo_fold("last") == yo_fold(F.lit(last))) & birth_filter("birth", birth, birth_year))
        rows = equal_if_given(self.event, "unit_id", unit_id).join(people, "event_id", "left_semi")
        return newest(rows, limit)

    def persons_of(self, events: DataFrame) -> DataFrame:
        return self.person.join(events.select("event_id").distinct(), "event_id", "left_semi").orderBy("event_id", "person_id")

    def hydrated(self, events: DataFrame | None = None) -> DataFrame:
        rows = self.event if events is None else events
        return children_list(rows, self.person, "event_id", ["person_id", "last", "first", "middle", "birth"], "persons")

    def candidates(self, low=None, high=None, unit_id: str | None = None, limit: int | None = None, days: int = 36_500) -> DataFrame:
        """Events of the unit in the window (±36 500 days of now by default), with a limit the newest."""
        now = F.current_timestamp()
        start = now - F.expr(f"INTERVAL {days} DAYS") if low is None else F.lit(low)
        end = now + F.expr(f"INTERVAL {days} DAYS") if high is None else F.lit(high)
        return newest(equal_if_given(self.event, "unit_id", unit_id).filter(F.col("event_ts").between(start, end)), limit)

    def close_to(self, moment, hours: int = 24) -> DataFrame:
        gap = F.abs(F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(F.lit(moment).cast("timestamp")))
        return self.event.filter(gap <= hours * 3_600_000_000)

    def with_parents(self, units: DataFrame) -> DataFrame:
        names = self.org.select("org_id", F.col("short_name").alias("org_short_name"), F.col("full_name").alias("org_full_name"))
        return units.join(names, "org_id", "left")
