import datetime as dt

from reconlink.functions import names as N, staff as ST
from reconlink.operators import persons as P
from pyspark.sql import functions as F

PEOPLE = "mention_id string, seq int, last string, first string, middle string, birth date, birth_year int, staff_context boolean"
REGISTRY = "event_id string, person_id string, last string, first string, middle string, birth date"


def link(spark, cases):
    """cases: {mention: (people, registry)} -> {mention: sorted rows}"""
    people, registry, pairs = [], [], []
    for name, (who, known) in cases.items():
        pairs.append((name, name))
        for i, (last, first, middle, birth, staff) in enumerate(who):
            people.append((name, i, last, first, middle, birth, birth.year if birth else None, staff))
        for i, (last, first, middle, birth) in enumerate(known):
            registry.append((name, f"p{i}", last, first, middle, birth))
    rows = P.link_persons(
        spark.createDataFrame(pairs, "mention_id string, event_id string"), spark.createDataFrame(people, PEOPLE),
        spark.createDataFrame(registry, REGISTRY)).collect()
    out = {name: [] for name in cases}
    for r in rows:
        out[r["mention_id"]].append((r["bucket"], r["seq"], r["person_id"], r["match_type"], r["note"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_link_buckets(spark):
    d = dt.date
    got = link(spark, {
        "spelling": ([("Холматов", "Тахир", "Зокиржонович", d(1984, 2, 24), False)], [("Холматов", "Тахир", "Зокирджонович", d(1984, 2, 24))]),
        "birth clash": ([("Холматов", "Тахир", "Зокирджонович", d(1984, 2, 24), False)], [("Холматов", "Тахир", "Зокирджонович", d(1985, 2, 24))]),
        "initials": ([("Холматов", "Т", "З", d(1984, 1, 1), False)], [("Холматов", "Тахир", "Зокирджонович", d(1984, 2, 24))]),
        "inflected": ([("Орлова", "Дмитрия", "Игоревича", d(1992, 1, 1), False)], [("Орлов", "Дмитрий", "Игоревич", d(1992, 12, 12))]),
        "copies": ([], [("Орлов", "Дмитрий", "", None), ("Орлов", "Дмитрий", "", None)]),
        "one to one": ([("Орлов", "Дмитрий", "", None, False), ("Орлов", "Дмитрий", "", None, False)], [("Орлов", "Дмитрий", "Игоревич", None)]),
        "best first": ([("Орлов", "Д", "И", None, False)], [("Орлов", "Денис", "Игоревич", None), ("Орлов", "Д", "И", None)]),
        "ambiguous": ([("Орлов", "", "", None, False)], []),
        "staff back": ([("Климов", "Андрей", "Олегович", None, True), ("Чужой", "Иван", "", None, True)], [("Климов", "Андрей", "Олегович", None)]),
        "unknown birth": ([("Климов", "Андрей", "Олегович", d(1990, 3, 3), False)], [("Климов", "Андрей", "Олегович", d(1900, 1, 1))]),
        "stranger": ([("Петров", "Иван", "", None, False)], [("Климов", "Андрей", "", None)]),
    })
    note = "отчество отличается"
    assert got["spelling"] == [("matched", 0, "p0", "fuzzy", note)]
    assert got["birth clash"] == [("possible", 0, "p0", None, None)]
    assert got["initials"] == [("matched", 0, "p0", "fuzzy", "имя в сводке указан инициалом; отчество в сводке указан инициалом")]
    assert got["inflected"] == [("matched", 0, "p0", "exact", None)]
    assert got["copies"] == [("missing_in_report", None, "p0", None, None)]
    # the second mention of one name is covered by the first and not reported as missing
    assert got["one to one"] == [("matched", 0, "p0", "fuzzy", "отчество отсутствует в сводке")]
    assert got["best first"] == [("matched", 0, "p1", "exact", None), ("missing_in_report", None, "p0", None, None)]
    assert got["ambiguous"] == [("missing_in_registry", 0, None, None, None)]
    assert got["staff back"] == [("matched", 0, "p0", "exact", None)]
    assert got["unknown birth"] == [("matched", 0, "p0", "exact", None)]
    assert got["stranger"] == [("missing_in_registry", 0, None, None, None), ("missing_in_report", None, "p0", None, None)]


def test_ambiguous_surname(spark):
    # nobody fits by name, two share the surname once inflection is undone on neither side
    got = link(spark, {"a": ([("Орлов", "", "Ь", None, False)], [("Орлов", "Денис", "Игоревич", None), ("Орлов", "Иван", "Петрович", None)])})
    assert got["a"][0][0] == "ambiguous"


def _brute(people, known):
    """Straight loop over one event, used as an independent check of the fold."""
    import difflib

    def ok(part, a, b):
        if not a:
            return True, "m"
        if len(a) == 1:
            return b.startswith(a), ("i" if a != b else None)
        if a == b or (part == 0 and len(a) > 3 and a[-1] in "ая" and a[:-1] == b):
            return True, None
        return (bool(b) and difflib.SequenceMatcher(None, a, b).ratio() >= (0.9, 0.85)[part > 0]), "d"

    used, out = set(), {}
    for i, (last, first, birth) in enumerate(people):
        best = clash = None
        for j, (p_last, p_first, p_birth) in enumerate(known):
            if j in used or not last:
                continue
            (a, an), (b, bn) = ok(0, last, p_last), ok(1, first, p_first)
            if not (a and b):
                continue
            if birth and p_birth and birth != p_birth:
                clash = j
                continue
            rank = 1 if not first else 2 if an or bn or True else 3
            if best is None or rank > best[0]:
                best = (rank, j)
        if best:
            same = known.index(known[best[1]])
            used.add(same)
            out[i] = ("matched", same)
        elif clash is not None:
            out[i] = ("possible", known.index(known[clash]))
    return out


def test_fold_against_loop(spark):
    import random

    rnd = random.Random(5)
    lasts, firsts = ["орлов", "орлова", "климов", "климав", "я"], ["", "иван", "и", "петр"]
    births = [None, dt.date(1990, 3, 3), dt.date(1991, 4, 4)]
    cases, want = {}, {}
    for n in range(60):
        people = [(rnd.choice(lasts), rnd.choice(firsts), rnd.choice(births)) for _ in range(rnd.randint(1, 4))]
        known = [(rnd.choice(lasts), rnd.choice(firsts[1:]), rnd.choice(births)) for _ in range(rnd.randint(1, 5))]
        cases[f"c{n}"] = ([(a, b, "", c, False) for a, b, c in people], [(a, b, "", c) for a, b, c in known])
        want[f"c{n}"] = _brute(people, known)
    got = link(spark, cases)
    for name, expected in want.items():
        found = {seq: (bucket, int(pid[1:])) for bucket, seq, pid, _, _ in got[name] if bucket in ("matched", "possible")}
        assert found == expected, (name, cases[name])


def test_person_mentions(column):
    texts = [
        "Смирнова Мария Сергеевна (1996 г.р.)", "Иванов Иван Иванович 02.02.2026 произошло", "Холматов Т З 1984 г.р. задержан",
        "задержан гражданин: Петров Пётр, 01.05.1990 г.р.", "в районе Кпп Москва ничего", "Алиев Вагиф Иса оглы (12.03.1985)",
    ]
    got = column(texts, N.person_mentions)
    brief = [[(p["last"], p["first"], p["middle"], str(p["birth"]) if p["birth"] else None, p["birth_year"]) for p in row] for row in got]
    assert brief[0] == [("Смирнова", "Мария", "Сергеевна", None, 1996)]
    assert brief[1] == [("Иванов", "Иван", "Иванович", None, None)]
    assert brief[2] == [("Холматов", "Т", "З", None, 1984)]
    assert brief[3] == [("Петров", "Пётр", "", "1990-05-01", 1990)]
    assert brief[4] == []
    assert brief[5] == [("Алиев", "Вагиф", "Иса оглы", "1985-03-12", 1985)]
    assert all(t[p["start"] : p["end"]] == p["surface_text"] for t, row in zip(texts, got) for p in row)


def test_staff(spark, column):
    texts = ["наряд (ст.пр-к Антонов Д. В.), далее", "(ст.м-н Смирнов А.А.+1), Иванов Иван Иванович 1991 г.р.",
             "майор Петров П.П. и майор Петров П.П.", "просто Сидоров С.С.", "прапорщек Орлов О.О."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "mention_id int, text string")
    rows = {}
    for r in ST.staff_mentions(df).collect():
        rows.setdefault(r["mention_id"], []).append((r["rank_full"], r["surname"], r["initials"]))
    assert rows == {0: [("Старший прапорщик", "Антонов", "Д.В.")], 1: [("Старший мичман", "Смирнов", "А.А.")],
                    2: [("Майор", "Петров", "П.П.")], 4: [("Прапорщик", "Орлов", "О.О.")]}
    assert column(["ст. пр-к", "к-н", "кап.", "сержант", "старший лейтенант"], ST.rank_of) == [
        "Старший прапорщик", "Капитан", "Капитан", "", "Старший лейтенант"]


def test_staff_context(spark):
    cases = [("наряд прапорщик Антонов", "Антонов", True), ("по ст. Антонов", "Антонов", True), ("далеко майор был тогда тут Антонов", "Антонов", False),
             ("(ст.м-н Смирнов А.А.+1) и", "Смирнов", True), ("(наряд Смирнов, майор) и", "Смирнов", True), ("(наряд Смирнов) майор", "Смирнов", False)]
    df = spark.createDataFrame([(t, t.index(n), t.index(n) + len(n), w) for t, n, w in cases], "t string, a int, b int, want boolean")
    got = df.withColumn("got", ST.staff_context("t", F.col("a"), F.col("b"))).filter("got <> want").collect()
    assert got == []


def test_names(column, spark):
    assert column(["ИВАНОВ-петров", "иса ОГЛЫ"], lambda c: N.name_case(c, True)) == ["Иванов-Петров", "Иса оглы"]
    assert column(["Орлов Иван Петрович Младший"], N.split_full_name)[0].asDict() == {"last": "Орлов", "first": "Иван", "middle": "Петрович Младший"}
    assert column(["рф Иванов", "МВД иванов", "Иванов Иван", "Иванов"], N.person_candidate) == [False, False, True, False]
    rows = [("Иванов (1990 г.р.)", 6, None, 1990, "year"), ("Иванов 01.01.1990", 6, dt.date(1990, 1, 1), None, "date"),
            ("Иванов", 6, dt.date(1990, 1, 1), None, "year"), ("Иванов 03.03.1990", 6, dt.date(1990, 3, 3), None, "date"), ("Иванов", 6, None, None, "none")]
    df = spark.createDataFrame(rows, "t string, e int, b date, y int, want string")
    q = df.withColumn("q", N.birth_query("t", F.col("e"), "b", "y", 80))
    assert [tuple(r) for r in q.filter("q.mode <> want").collect()] == []


def test_person_lights(spark):
    d = dt.date
    cases = {"exact": ([("Орлов", "Иван", "", d(1990, 3, 3), False)], [("Орлов", "Иван", "", d(1990, 3, 3))], "ok"),
             "year": ([("Орлов", "Иван", "Петрович", d(1990, 1, 1), False)], [("Орлов", "Иван", "Петрович", d(1990, 3, 3))], "ok"),
             "clash": ([("Орлов", "Иван", "Петрович", d(1990, 5, 5), False)], [("Орлов", "Иван", "Петрович", d(1990, 3, 3))], "warn"),
             "gone": ([("Орлов", "Иван", "", None, False)], [("Климов", "Пётр", "", None)], "err")}
    people, registry, pairs = [], [], []
    for name, (who, known, _) in cases.items():
        pairs.append((name, name))
        people += [(name, i, *p[:4], None, False) for i, p in enumerate(who)]
        registry += [(name, f"p{i}", *k) for i, k in enumerate(known)]
    people, registry = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(registry, REGISTRY)
    links = P.link_persons(spark.createDataFrame(pairs, "mention_id string, event_id string"), people, registry)
    got = {r["mention_id"]: r["light"] for r in P.person_lights(links, people, registry).collect()}
    assert got == {"exact": "warn", **{k: v[2] for k, v in cases.items() if k != "exact"}}
    counts = {r["mention_id"]: r for r in P.all_agree(P.bucket_counts(links, registry, people)).collect()}
    assert counts["year"]["persons_agree"] and not counts["clash"]["persons_agree"] and counts["gone"]["missing_in_registry"] == 1


def test_person_report(spark):
    from reconlink.plans.verdict import person_report

    people = spark.createDataFrame([("m", 0, "A"), ("m", 1, "B"), ("m", 2, "C")], "mention_id string, seq int, display string")
    registry = spark.createDataFrame([("e", f"p{i}", f"R{i}") for i in range(5)], "event_id string, person_id string, display string")
    links = spark.createDataFrame([("m", "e", 0, "p0", "matched", "fuzzy", "имя отличается"), ("m", "e", 1, None, "missing_in_registry", None, None),
                                   *[("m", "e", None, f"p{i}", "missing_in_report", None, None) for i in range(1, 5)]],
                                  "mention_id string, event_id string, seq int, person_id string, bucket string, match_type string, note string")
    rows = [(r["line_no"], r["line"]) for r in person_report(links, people, registry).orderBy("line_no").collect()]
    assert rows == [(1, "ФИО совпало частично/с ошибкой: A / R0 (имя отличается)"), (4, "В сводке есть, в БД нет: B"),
                    (5, "В БД есть, в сводке нет: R1, R2, R3, R4")]


def test_surname_blocks_lose_no_pair(spark, monkeypatch):
    import random

    rnd = random.Random(9)
    roots = ["константинопольский", "александровский", "холматов", "орлов", "ли", "иваненко", "преображенский"]

    def spoil(name):
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(name))
            name = rnd.choice([name[:at] + rnd.choice("аобя") + name[at:], name[:at] + name[at + 1 :], name[:at] + "ж" + name[at + 1 :]])
        return name or "я"

    people = [("m", "e", i, spoil(rnd.choice(roots)) if rnd.random() < 0.9 else "х", "", "", None) for i in range(80)]
    known = [("e", f"p{i:03d}", f"p{i:03d}", spoil(rnd.choice(roots)), "", "", None) for i in range(120)]
    p = spark.createDataFrame(people, "mention_id string, event_id string, seq int, last string, first string, middle string, birth date").withColumn("place", F.col("seq"))
    r = spark.createDataFrame(known, "event_id string, person_id string, record_id string, last string, first string, middle string, birth date")
    pairs = lambda: sorted((x["seq"], x["person_id"], x["note"]) for x in P.link_candidates(p, r).collect())
    blocked = pairs()
    for name in ("report_surname_keys", "registry_surname_keys"):
        monkeypatch.setattr(P.N, name, lambda *a: F.array(F.lit("one block")))
    assert len(blocked) > 200 and pairs() == blocked


LINKED = ("mention_id string, seq int, last string, first string, middle string, birth date, birth_year int, staff_context boolean",
          "event_id string, person_id string, last string, first string, middle string, birth date")


def buckets_of(spark, people, known):
    pairs = spark.createDataFrame([("m", "e")], "mention_id string, event_id string")
    rows = P.link_persons(pairs, spark.createDataFrame(people, LINKED[0]), spark.createDataFrame(known, LINKED[1])).collect()
    return sorted((r["seq"] or 0, r["bucket"], r["person_id"]) for r in rows)


def test_every_report_person_is_in_a_bucket(spark):
    """A possible pair of another year covers nobody else of that name."""
    born = lambda y: dt.date(y, 5, 6)
    people = [("m", i, "Орлов", "Иван", "Ильич", born(y), None, False) for i, y in ((1, 1990), (2, 1985), (3, 1990))]
    got = buckets_of(spark, people, [("e", "p1", "Орлов", "Иван", "Ильич", born(1985))])
    assert got == [(1, "possible", "p1"), (2, "matched", "p1"), (3, "missing_in_registry", None)]


def test_a_possible_pair_accounts_for_one_record(spark):
    people = [("m", 1, "Орлов", "Иван", "Ильич", dt.date(1990, 5, 6), None, False)]
    known = [("e", p, "Орлов", "Иван", "Ильич", dt.date(1985, 5, 6)) for p in ("p1", "p2")]
    assert buckets_of(spark, people, known) == [(0, "missing_in_report", "p2"), (1, "possible", "p1")]


def test_numbered_surnames_meet_by_their_own_letters(spark):
    """Names that share most pieces do not all meet, and none that reach the ratio is lost."""
    import difflib
    import random

    rnd = random.Random(4)
    names = [f"n{rnd.randint(0, 3000):09d}" for _ in range(120)] + [f"n{rnd.randint(0, 300):09d}" for _ in range(60)]
    names = sorted(set(names) | {n[:3] + n[4:] for n in names[:30]} | {n[::-1] for n in names[:30]})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for threshold, most in ((0.9, 0.1), (0.75, 1.0)):
        asked = df.select(F.col("n").alias("a"), F.explode(N.report_surname_keys("n", N.variants("n", "last"), threshold)).alias("k"))
        known = df.select(F.col("n").alias("b"), F.explode(N.registry_surname_keys("n", threshold)).alias("k"))
        met = {tuple(r) for r in asked.join(known, "k").select("a", "b").distinct().collect()}
        alike = {(a, b) for a in names for b in names if difflib.SequenceMatcher(None, a, b).ratio() >= threshold}
        assert alike <= met and len(met) <= most * len(names) ** 2


def test_equal_records_are_enough_by_those_a_match_can_tell_apart(spark):
    import random

    rnd = random.Random(6)
    births = [None, dt.date(1990, 3, 3), dt.date(1991, 4, 4)]
    people = [(f"m{i % 7}", f"e{i % 7}", i, i, rnd.choice(["орлов", "климов"]), rnd.choice(["", "иван", "и"]), "", rnd.choice(births)) for i in range(160)]
    known = [(f"e{i % 7}", f"p{rnd.randint(0, 60):02d}", rnd.choice(["орлов", "климов"]), "иван", "", births[rnd.randint(1, 2)]) for i in range(200)]
    # a person stands once in an event, apart from a repeated row
    known = list({k[:2]: k for k in known}.values())
    p = spark.createDataFrame(people, "mention_id string, event_id string, seq int, place int, last string, first string, middle string, birth date")
    rows = P.registry_rows(spark.createDataFrame(known + known[:20], REGISTRY))
    fewer = P.takeable(rows)
    out = [sorted((tuple(r) for r in P.assign(P.link_candidates(p, r)).collect()), key=str) for r in (rows, fewer)]
    assert out[0] == out[1] and {r[4] for r in out[0]} == {"matched", "possible"}
    assert fewer.count() < rows.distinct().count()
    free = {k[:2] for k in known}
    assert {(r["event_id"], r["person_id"]) for r in fewer.collect()} <= free
