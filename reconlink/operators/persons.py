"""Linking report persons to registry persons of one event, one to one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from reconlink import scale
from reconlink.config import DEFAULTS, Thresholds
from reconlink.functions import names as N


def _folded(df: DataFrame, prefix: str, fold: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({f"{prefix}_{p}": fold(F.col(p)) for p in ("last", "first", "middle")})


def reenter_staff(people: DataFrame, pairs: DataFrame, registry: DataFrame, fold=N.name_key) -> DataFrame:
    """People to match per (mention, event): all others, then staff whose surname the event knows.

    Adds ``place``: the order in which people take their registry row.
    """
    listed = pairs.join(people, "mention_id")
    surnames = registry.select("event_id", fold(F.col("last")).alias("_s")).filter("_s <> ''").distinct()
    staff = (
        listed.filter("staff_context").withColumn("_s", fold(F.col("last"))).join(surnames, ["event_id", "_s"], "left_semi").drop("_s")
    )
    return (
        listed.filter("NOT coalesce(staff_context, false)").unionByName(staff)
        .withColumn("place", F.struct(F.coalesce(F.col("staff_context"), F.lit(False)), F.col("seq")))
    )


def registry_rows(registry: DataFrame) -> DataFrame:
    """Registry persons with births cleaned; ``record_id`` is the first of the equal records of an event, which a match resolves to."""
    record = ["event_id", "last", "first", "middle", "birth"]
    known = registry.select("event_id", "person_id", "last", "first", "middle", N.known_birth("birth").alias("birth"))
    return known.withColumn("record_id", F.min("person_id").over(W.partitionBy(*record)))


def takeable(known: DataFrame) -> DataFrame:
    """Of ``registry_rows`` those that ``assign`` can tell apart.

    A match uses up the ``record_id``, so of the equal records of an event only those whose id is some record's id are ever taken; of
    the others, which stay free, the first serves every match and the last every clash.
    """
    heads = known.select("event_id", F.col("record_id").alias("person_id"), F.lit(True).alias("_head")).distinct()
    rows = known.filter("person_id IS NOT NULL").distinct().join(heads, ["event_id", "person_id"], "left").na.fill(False, ["_head"])
    ids = W.partitionBy("event_id", "last", "first", "middle", "birth", "_head")
    ends = rows.withColumns({"_low": F.min("person_id").over(ids), "_high": F.max("person_id").over(ids)})
    return ends.filter("_head OR person_id IN (_low, _high)").select(*known.columns)


def link_candidates(
    people: DataFrame, registry: DataFrame, t: Thresholds = DEFAULTS, fold: Callable[[Column], Column] = N.name_key,
) -> DataFrame:
    """Pairs of one (mention, event) that pass the name test.

    ``people``: mention_id, event_id, seq, place, last, first, middle, birth.
    ``registry``: event_id, person_id, record_id, last, first, middle, birth.
    Distinct surnames of an event meet only where they share a block key,
    which loses no pair, and only those that cannot be told apart by length reach the ratio;
    people and records meet by the surnames that passed.
    """
    parts = ("last", "first", "middle")
    p = _folded(people, "s", fold).filter("s_last <> ''").select(
        "mention_id", "event_id", "seq", "place", F.col("birth").alias("s_birth"), "s_last", "s_first", "s_middle",
        *[N.variants(f"s_{part}", part).alias(f"v_{part}") for part in parts[1:]])
    r = _folded(registry, "p", fold).select(
        "event_id", "person_id", "record_id", F.col("birth").alias("p_birth"), "p_last", "p_first", "p_middle")
    limits = (("last", t.surname_ratio, "фамилия"), ("first", t.first_name_ratio, "имя"), ("middle", t.patronymic_ratio, "отчество"))

    def possible(part: str, limit: float) -> Column:
        return N.part_possible(f"s_{part}", f"p_{part}", f"v_{part}", limit)

    def tested(pairs: DataFrame, *tests: tuple) -> DataFrame:
        return pairs.withColumns({f"_{part}": N.part_match(f"s_{part}", f"p_{part}", f"v_{part}", limit, label) for part, limit, label in tests})

    names = p.select("event_id", "s_last").distinct().withColumn("v_last", N.variants("s_last", "last"))
    asked = names.withColumn("_k", F.explode(F.array_distinct(N.report_surname_keys("s_last", "v_last", t.surname_ratio))))
    known = r.select("event_id", "p_last").distinct().withColumn("_k", F.explode(F.array_distinct(N.registry_surname_keys("p_last", t.surname_ratio))))
    met = asked.join(known, ["event_id", "_k"]).filter(possible("last", t.surname_ratio)).drop("_k").dropDuplicates(["event_id", "s_last", "p_last"])
    spelled = tested(met, limits[0]).filter("_last.ok").select("event_id", "s_last", "p_last", "_last")

    pairs = p.join(spelled, ["event_id", "s_last"]).join(r, ["event_id", "p_last"])
    for part, limit, _ in limits[1:]:
        pairs = pairs.filter(possible(part, limit))
    pairs = pairs.dropDuplicates(["mention_id", "event_id", "place", "seq", "person_id"])

    linked = tested(pairs, *limits[1:]).filter("_first.ok AND _middle.ok")
    note = F.concat_ws("; ", "_last.note", "_first.note", "_middle.note")
    kind = (
        F.when((F.col("s_first") == "") & (F.col("s_middle") == ""), "partial")
        .when(note != "", "fuzzy").otherwise("exact")
    )
    return linked.select(
        "mention_id", "event_id", "seq", "place", "person_id", "record_id", kind.alias("match_type"),
        F.when(kind != "exact", note).alias("note"),
        F.when(kind == "exact", 3).when(kind == "fuzzy", 2).otherwise(1).alias("strength"),
        F.coalesce(N.birth_compatible("s_birth", "p_birth"), F.lit(True)).alias("birth_ok"),
    )


def assign(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one: people in their order take the strongest free row, ties to the first.

    The people of a mention and event pass in their order through one task, each with the pairs of theirs that passed the name test;
    what is kept of those before are the rows they took.
    """
    group = ["mention_id", "event_id"]
    option = F.struct(
        (-F.col("strength")).alias("weak"), "person_id", "record_id", "match_type", "note", "birth_ok")
    per_person = candidates.filter("person_id IS NOT NULL").groupBy(*group, "place", "seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("birth_ok"), option))).alias("fits"),
        F.sort_array(F.collect_list(F.when(~F.col("birth_ok"), F.struct("person_id", "record_id"))), asc=False).alias("clashes"))

    def named(o: Column, *more: str) -> Column:
        return F.struct(*[o[c].cast("string").alias(c) for c in ("person_id", "record_id", *more)])

    people = per_person.select(
        *group, "place", "seq", F.transform("fits", lambda o: named(o, "match_type", "note")).alias("fits"), F.transform("clashes", lambda o: named(o)).alias("clashes"))
    dealt = people.repartition(*group).sortWithinPartitions(*group, "place", "seq").select(
        *group, F.col("seq").cast("int").alias("seq"), "fits", "clashes")
    texts = [T.StructField(c, T.StringType()) for c in ("person_id", "bucket", "match_type", "note")]
    out = T.StructType([*[dealt.schema[c] for c in (*group, "seq")], *texts])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, set()
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            at, rows = [], []
            keys = zip(*[columns[c].to_pylist() for c in group])
            for i, (here, fits, clashes) in enumerate(zip(keys, columns["fits"].to_pylist(), columns["clashes"].to_pylist())):
                if here != last:
                    last, used = here, set()
                best = next((o for o in fits if o["person_id"] not in used), None)
                if best is not None:
                    used.add(best["record_id"])
                    rows.append((best["record_id"], "matched", best["match_type"], best["note"]))
                else:
                    clash = next((o for o in clashes if o["person_id"] not in used), None)
                    if clash is None:
                        continue
                    rows.append((clash["record_id"], "possible", None, None))
                at.append(i)
            kept = [columns[c].take(pa.array(at, pa.int64())) for c in (*group, "seq")]
            values = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*kept, *values], names=out.fieldNames())

    return dealt.mapInArrow(take, out)


def link_persons(
    pairs: DataFrame, people: DataFrame, registry: DataFrame, t: Thresholds = DEFAULTS,
    fold: Callable[[Column], Column] = N.name_key,
) -> DataFrame:
    """All five buckets per (mention, event): mention_id, event_id, seq, person_id, bucket, match_type, note.

    ``pairs``: mention_id, event_id. ``people``: mention_id, seq, last, first,
    middle, birth, birth_year, staff_context. ``registry``: event_id,
    person_id, last, first, middle, birth.
    """
    listed = reenter_staff(people, pairs, registry, fold)
    known = registry.withColumn("birth", N.known_birth("birth"))
    # read four times below
    placed = scale.cut(assign(link_candidates(listed, takeable(registry_rows(registry)), t, fold)))

    key = [fold(F.col(c)).alias(f"k_{c}") for c in ("last", "first", "middle")]
    keys = ["k_last", "k_first", "k_middle"]
    born = F.coalesce(F.col("birth").cast("string"), F.col("birth_year").cast("string"), F.lit("")).alias("k_birth")
    here = listed.select("mention_id", "event_id", "seq", "first", F.col("birth"), *key, born)
    open_ = here.join(placed.select("mention_id", "event_id", "seq"), ["mention_id", "event_id", "seq"], "left_anti")
    namesakes = known.groupBy("event_id", fold(F.col("last")).alias("k_last")).agg(F.count(F.lit(1)).alias("_same"))
    open_ = open_.join(namesakes, ["event_id", "k_last"], "left").withColumn(
        "bucket", F.when((F.coalesce(F.col("first"), F.lit("")) == "") & (F.col("_same") > 1), "ambiguous").otherwise("missing_in_registry"))

    registered = known.select("event_id", F.col("person_id").cast("string").alias("person_id"), F.col("birth").alias("p_birth"), *key)
    taken = (
        placed.join(registered, ["event_id", "person_id"])
        .join(here.select("mention_id", "event_id", "seq", "birth", "k_birth",
                          *[F.col(k).alias(f"m_{k}") for k in keys]), ["mention_id", "event_id", "seq"])
    )
    # a matched pair covers both sides' namesakes of equal birth, a possible one only if a known year agrees
    year = F.coalesce((F.year("birth") == F.year("p_birth")) & (N.year_only("birth") | N.year_only("p_birth")), F.lit(False))
    covers = taken.filter((F.col("bucket") == "matched") | year)
    covered_people = covers.select("mention_id", "event_id", *[F.col(f"m_{k}").alias(k) for k in keys], "k_birth").distinct()
    missing_here = open_.filter("bucket = 'missing_in_registry'").join(
        covered_people, ["mention_id", "event_id", *keys, "k_birth"], "left_anti")

    # equal records are reported once: by the first that no placed row accounts for
    record = ["event_id", *keys, "p_birth"]
    two = W.partitionBy(*record).orderBy("person_id")
    distinct_rows = registered.withColumn("_rn", F.row_number().over(two)).filter("_rn <= 2").groupBy(*record).agg(
        F.min("person_id").alias("_first"), F.max(F.when(F.col("_rn") == 2, F.col("person_id"))).alias("_second"))
    wanted = pairs.select("mention_id", "event_id").distinct().join(distinct_rows, "event_id")

    def same(a: str, b: str) -> Column:
        on = F.col(f"{a}.p_birth").eqNullSafe(F.col(f"{b}.p_birth"))
        for k in ("mention_id", "event_id", *keys):
            on = on & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
        return on

    left = wanted.alias("w").join(covers.select("mention_id", *record).distinct().alias("c"), same("w", "c"), "left_anti")
    accounted = taken.select("mention_id", *record, F.lit(True).alias("_taken")).distinct()
    missing_there = left.alias("w").join(accounted.alias("a"), same("w", "a"), "left").select(
        F.col("w.mention_id").alias("mention_id"), F.col("w.event_id").alias("event_id"),
        F.when(F.col("_taken"), F.col("_second")).otherwise(F.col("_first")).alias("person_id")).filter("person_id IS NOT NULL")
    none = F.lit(None).cast("string")
    out = ["mention_id", "event_id", "seq", "person_id", "bucket", "match_type", "note"]
    return (
        placed.select(*out)
        .unionByName(open_.filter("bucket = 'ambiguous'").unionByName(missing_here).select(
            "mention_id", "event_id", F.col("seq").cast("int").alias("seq"), none.alias("person_id"), "bucket",
            none.alias("match_type"), none.alias("note")))
        .unionByName(missing_there.select(
            "mention_id", "event_id", F.lit(None).cast("int").alias("seq"), "person_id",
            F.lit("missing_in_report").alias("bucket"), none.alias("match_type"), none.alias("note")))
    )


BUCKETS = ("matched", "possible", "ambiguous", "missing_in_registry", "missing_in_report")


def bucket_counts(links: DataFrame, registry: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Counts per (mention, event), the registry and report totals and the match ratio."""
    counts = links.groupBy("mention_id", "event_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    if people is not None:
        counts = counts.join(people.groupBy("mention_id").agg(F.count(F.lit(1)).alias("report_total")), "mention_id", "left")
    if registry is not None:
        counts = counts.join(registry.groupBy("event_id").agg(F.count(F.lit(1)).alias("registry_total")), "event_id", "left")
        counts = counts.withColumn("ratio", F.coalesce(F.try_divide(F.col("matched"), F.col("registry_total")), F.lit(0.0)))
    return counts


def all_agree(counts: DataFrame) -> DataFrame:
    ok = (
        (F.col("matched") == F.coalesce(F.col("registry_total"), F.lit(0)))
        & (F.col("possible") == 0) & (F.col("missing_in_registry") == 0) & (F.col("missing_in_report") == 0)
    )
    return counts.withColumn("persons_agree", ok)


def person_lights(links: DataFrame, people: DataFrame, registry: DataFrame) -> DataFrame:
    """ok, warn or err per report person, by bucket and birth precision."""
    known = registry.select(
        "event_id", F.col("person_id").cast("string").alias("person_id"), N.known_birth("birth").alias("p_birth"))
    rows = links.filter("seq IS NOT NULL").join(
        people.select("mention_id", "seq", F.col("birth").alias("s_birth"), "birth_year"), ["mention_id", "seq"]
    ).join(known, ["event_id", "person_id"], "left")
    # a report person with only a year carries the first of January
    s = F.coalesce(F.col("s_birth"), F.make_date(F.col("birth_year"), F.lit(1), F.lit(1)))
    p = F.col("p_birth")
    aligned = F.coalesce(N.year_only(s) & (F.year(s) == F.year(p)), F.lit(False))
    exact_birth = F.coalesce(s == p, F.lit(False)) | (s.isNull() & p.isNull())
    precise = F.coalesce((s != p) & (N.year_only(s) != N.year_only(p)), F.lit(False))
    light = (
        F.when(F.col("bucket") == "missing_in_registry", "err")
        .when(F.col("bucket") == "possible", "warn")
        .when(F.col("bucket") == "matched",
              F.when((F.col("match_type") == "exact") & (exact_birth | aligned), "ok")
              .when(precise & aligned, "ok").otherwise("warn"))
    )
    return rows.select("mention_id", "event_id", "seq", light.alias("light")).filter("light IS NOT NULL")


def split_staff(staff: DataFrame, people: DataFrame, pairs: DataFrame, registry: DataFrame, fold=N.surname_key):
    """Staff whose surname stands among the event's persons become people unless listed already.

    Returns (relabelled, remaining), both with mention_id, event_id and the staff columns.
    """
    rows = staff.join(pairs, "mention_id").withColumn("_s", fold(F.col("surname")))
    surnames = registry.select("event_id", fold(F.col("last")).alias("_s")).filter("_s <> ''").distinct()
    listed = people.select("mention_id", fold(F.col("last")).alias("_s")).distinct()
    known = rows.join(surnames, ["event_id", "_s"], "left_semi")
    relabelled = known.join(listed, ["mention_id", "_s"], "left_anti").drop("_s")
    remaining = rows.join(surnames, ["event_id", "_s"], "left_anti").drop("_s")
    return relabelled, remaining

