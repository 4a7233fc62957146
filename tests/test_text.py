from pyspark.sql import functions as F

from reconlink.functions import articles as A, dates as D, spans as S, text as X, units as U
from reconlink.functions.windows import windows_by_size, windows_by_start


def test_dates_and_times(spark):
    cases = {
        "24 марта 2022 года в 6:00 произошло событие": ("2022-03-24 06:00:00", True, (0, 18), (19, 25)),
        "24.03.2022 в 06.00 правонарушение": ("2022-03-24 06:00:00", True, (0, 10), (11, 18)),
        "24-03-2022, в 6 ч 00 мин выявлен факт": ("2022-03-24 06:00:00", True, (0, 10), (12, 22)),
        "24.03.2022 по статье 18.3 ч. 1 составлен протокол": ("2022-03-24 00:00:00", False, (0, 10), None),
        "13.04.2025 11.30, ПОГК «Очаково»": ("2025-04-13 11:30:00", True, (0, 10), (11, 16)),
        "31.02.2024, затем 05/06/24 10:15": ("2024-06-05 10:15:00", True, (18, 26), (27, 32)),
        "05.06.2024 ст. 18.10 и 09:45": ("2024-06-05 09:45:00", True, (0, 10), (23, 28)),
        "05.06.2024 в 25:70, потом 08.15": ("2024-06-05 08:15:00", True, (0, 10), (26, 31)),
        "время 12:30 без даты": (None, False, None, (0, 11)),
        "ничего": (None, False, None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: r for r in D.with_date_time(df).collect()}
    span = lambda s: None if s is None else (s["start"], s["end"])
    for text, (when, found, date_span, time_span) in cases.items():
        r = got[text]
        assert (str(r["date_time"]) if r["date_time"] else None, r["time_found"]) == (when, found), text
        assert (span(r["date_span"]), span(r["time_span"])) == (date_span, time_span), text


def test_articles(column):
    texts = ["по ч. 1 ст. 18.1 и по статье 20.3", "в тексте только 18.1 ч.1 без маркеров", "по статье 18.3 часть 2", "ст. 5.35"]
    assert column(texts, A.article_of) == ["18.1 ч. 1", None, "18.3 ч. 2", "5.35"]
    keys = column(["ст. 18.1 ч. 1", "18.1 часть 1", "—", " None ", None, "часть 2"], A.article_key)
    assert keys == ["18.1|1", "18.1|1", None, None, None, None]


def test_article_light(spark):
    rows = [("ст. 18.1 ч. 1", "18.1 ч. 1", "ч. 1 ст. 18.1", "green"), ("18.1", "18.2", "18.1", "yellow"),
            ("18.1", "18.1", "18.2", "red"), ("18.1", "18.1", None, "red"), ("18.1", "18.1", "—", "red"), (None, None, None, "red")]
    df = spark.createDataFrame(rows, "e string, r string, d string, want string")
    assert df.filter(A.article_light("e", "r", "d") != F.col("want")).count() == 0


def test_unit_fold(column):
    cases = {
        "КПП-2 «Ухтомское»": "кпп-2 ухтомское", 'КПП 2 "Ухтомское"': "кпп-2 ухтомское", "КПП№2 Ухтомское": "кпп№2 ухтомское",
        "КПП No 2 Ухтомское": "кпп-2 ухтомское", "ПОГЗ №1": "погз №1", "ПОГЗ № 1": "погз №1", "  (Ёлка), ": "елка",
        "пост — север": "пост - север", "N 5 пост": "5 пост", "": "",
    }
    assert dict(zip(cases, column(list(cases), U.unit_fold))) == cases


def test_raw_span_of_folded_name(spark):
    rows = [('На КПП 2 "Ухтомское" выявлено', "кпп-2 ухтомское", (3, 19)), ("Пост Ёлка тут", "елка", (5, 9)), ("нет", "есть", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "t string, n string").coalesce(1)
    got = [r["s"] for r in df.select(U.raw_span("t", "n").alias("s")).collect()]
    assert [None if s is None else (s["start"], s["end"]) for s in got] == [w for _, _, w in rows]


def test_alias_fold_and_locality(column):
    assert column(["ОПК  No 5 «Север»", "погз-3 (г. Тула)", "ОП № 7"], U.alias_fold) == ["опк №5 север", "погз №3 г. тула", "оп №7"]
    assert column(["ПОГЗ (г. Тула)", "ПОГЗ (Тула)"], lambda c: U.locality(c)["name"]) == ["тула", None]
    assert column(["ОПК №5", "пз 7", "застава"], U.unit_group) == ["OP", "PZ", "UNKNOWN"]


def test_unit_aliases(column):
    (aliases,) = column(["ПОГЗ №1 (г. Тула)"], lambda c: U.unit_aliases(c, 30))
    assert len(aliases) <= 30 and aliases == sorted(aliases, key=lambda a: (len(a), a))
    assert {"ПОГЗ №1", "ПОГЗ1", "ПОГЗ-1", "ПОГЗ N1", "погранзастава №1"} <= set(aliases)


def test_quoted_names(column):
    assert column(["в АППр «Ухтомское» задержан", "просто «Ухтомское»", None], U.quoted_name) == ["Ухтомское", None, None]
    assert column(["КПП-2 «Ухтомское»"], U.quoted_fold) == ["ухтомское"]


def test_folds(column):
    assert column(["  А Ё​  б\n", None], X.fold) == ["а е б", ""]
    assert column(["None", " — ", "Да"], X.compare_value) == [None, None, "да"]
    assert column(["А|б/в;г, д\tе"], X.category_fold) == ["а б в г д е"]
    assert column(["Раз_два: три!"], X.anchor_fold) == ["раз два три"]
    assert column(["a.b", "просто"], X.looks_like_regex) == [True, False]
    assert column(["МВД и ФСБ РФ мвд"], X.acronyms) == [["мвд", "фсб", "рф"]]
    assert column(["статья пограничник когда"], X.rare_tokens) == [["пограничник"]]
    assert column([["статья", "закона", "кодекса", "пост"]], X.window_is_generic, "array<string>") == [True]


def test_truncation(column):
    assert column(["абв" * 4], lambda c: X.truncate_tail(c, 5)) == ["абваб\n...[truncated 7 chars]"]
    (cut,) = column(["я" * 20], lambda c: X.head_tail(c, 10))
    assert cut.startswith("яя\n\n... [TRUNCATED: original size 40 bytes] ...\n\n") and cut.endswith("\nяя")


def test_anchor_similarity_and_details(spark, column):
    rows = [("раз два три", "Раз, два, три!", 1.0), ("раз два три", "два три пять", 0.5), ("", "а", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert df.filter(F.abs(X.anchor_similarity("a", "b") - F.col("want")) > 1e-9).count() == 0
    (d,) = column(["[BEGIN] Итоги дня"], lambda c: X.anchor_details(c, "[BEGIN]", "[END]", 10))
    assert (d["text"], d["weak"]) == ("итоги дня", True)


def test_spans_against_re(column):
    import re

    texts = ["аб12 в3 44г", "", "нет", "7"]
    want = [[(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", t)] for t in texts]
    assert [[tuple(s) for s in row] for row in column(texts, lambda c: S.all_spans(c, r"\d+"))] == want


def _spans(spark, *lists):
    kind = ", ".join(f"s{i} array<struct<start:int,end:int>>" for i in range(len(lists)))
    return spark.createDataFrame([tuple([(a, b) for a, b in one] for one in lists)], kind)


def test_span_picks(spark):
    pick = lambda df, c: [tuple(x) for x in df.select(c.alias("o")).first()["o"]]
    df = _spans(spark, [(5, 9), (0, 3), (0, 6), (6, 7)], [(2, 4)])
    assert pick(df, S.greedy_spans("s0")) == [(0, 6), (6, 7)]
    assert pick(df, S.drop_overlapping("s0", "s1")) == [(5, 9), (6, 7)]
    df = _spans(spark, [(0, 3), (10, 12)], [(2, 8), (11, 12), (20, 21)])
    assert pick(df, S.merge_longer("s0", "s1")) == [(2, 8), (10, 12), (20, 21)]


def test_clip_to_cells(spark):
    df = spark.createDataFrame([([(2, 8)], ["abcd", "efg"])], "s array<struct<start:int,end:int>>, c array<string>")
    assert [tuple(x) for x in df.select(S.clip_to_cells("s", "c").alias("o")).first()["o"]] == [(0, 2, 4), (1, 0, 3)]


def test_windows_against_loops(column):
    text = 'один два-три "четыре" пять шесть семь'
    (got,) = column([text], lambda c: windows_by_start(c, (1, 6), 8))
    tokens = text.split()
    want = [" ".join(tokens[s : s + z]) for s in range(len(tokens)) for z in range(1, 7) if s + z <= len(tokens)][:8]
    assert [w["text"] for w in got] == want
    (got,) = column([text], lambda c: windows_by_size(c, (4, 10), 90))
    assert [(w["text"], w["start"]) for w in got][:2] == [('один два-три "четыре', 0), ('два-три "четыре" пять', 5)]
    (capped,) = column([" ".join(f"w{i}" for i in range(60))], lambda c: windows_by_start(c, (1, 6), 80))
    assert len(capped) == 80


def test_cosine_and_edit(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], "кот", "крот"), ([0.0, 0.0], [1.0, 1.0], "кот", "пёс")],
                               "a array<double>, b array<double>, x string, y string").coalesce(1)
    rows = df.select(F.round(X.cosine("a", "b"), 6), X.edit_le_one("x", "y")).collect()
    assert [tuple(r) for r in rows] == [(0.707107, True), (0.0, False)]


def test_span_folds_against_loops(spark):
    import random

    rnd = random.Random(11)
    span = lambda: (lambda a: (a, a + rnd.randint(1, 9)))(rnd.randint(0, 60))
    rows = [(i, [span() for _ in range(rnd.randint(0, 8))], [span() for _ in range(rnd.randint(0, 8))]) for i in range(80)]

    def merged(first, second):
        kept = list(first)
        for s in second:
            at = next((i for i, k in enumerate(kept) if k[0] < s[1] and s[0] < k[1]), None)
            if at is None:
                kept.append(s)
            elif s[1] - s[0] > kept[at][1] - kept[at][0]:
                kept[at] = s
        return kept

    def greedy(spans):
        kept, end = [], 0
        for s in sorted(spans, key=lambda x: (x[0], -x[1])):
            if s[0] >= end:
                kept.append(s)
                end = s[1]
        return kept

    df = spark.createDataFrame(rows, "i int, a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    got = {r["i"]: r for r in df.select("i", S.merge_longer("a", "b").alias("m"), S.greedy_spans("a").alias("g")).collect()}
    for i, a, b in rows:
        assert [tuple(x) for x in got[i]["m"]] == merged(a, b)
        assert [tuple(x) for x in got[i]["g"]] == greedy(a)


def test_long_lists_of_spans_are_merged_and_picked_in_step_with_their_length(spark):
    import random
    import time

    def merged(first, second):
        kept = list(first)
        for s in second:
            at = next((i for i, k in enumerate(kept) if None not in (*s, *k) and k[0] < s[1] and s[0] < k[1]), None)
            if at is None:
                kept.append(s)
            elif s[1] - s[0] > kept[at][1] - kept[at][0]:
                kept[at] = s
        return kept

    # chains of overlaps, spans without length, spans without borders, lists longer than two levels of blocks
    rnd = random.Random(5)
    span = lambda wide: (lambda a: (a, a + rnd.randint(0, 6)) if rnd.random() < 0.97 else (a, None))(rnd.randint(0, wide))
    rows = [(i, [span(w) for _ in range(n)], [span(w) for _ in range(n)]) for i, (n, w) in enumerate([(0, 9), (1, 1), (150, 90), (700, 9000)])]
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([*rows, (9, None, [(1, 2)])], f"i int, a {kind}, b {kind}")
    got = {r["i"]: r["m"] for r in df.select("i", S.merge_longer("a", "b").alias("m")).collect()}
    assert got[9] is None
    for i, a, b in rows:
        assert [tuple(x) for x in got[i]] == merged(a, b)

    words = " ".join(["ab", "abcdefghij"] * 15_000)
    begun = time.time()
    long, two = S.all_spans("t", "[^ ]{8,}"), S.all_spans("t", "[^ ]+ [^ ]+")
    row = spark.createDataFrame([(words,)], "t string").select(
        S.merge_longer(long, two).alias("m"), S.greedy_spans(F.concat(long, two)).alias("g")).first()
    pairs = [(i * 14, i * 14 + 13) for i in range(15_000)]
    assert [(s["start"], s["end"]) for s in row["m"]] == pairs and [(s["start"], s["end"]) for s in row["g"]] == pairs
    assert time.time() - begun < 60


def test_windows_walk_their_source_once_per_start(spark):
    import time

    from reconlink.functions.windows import windows_by_size, windows_by_start

    words = [f"w{i}" for i in range(300)]
    source = "–" * 1_000_000 + "".join(w + "., "[: i % 4] + " " for i, w in enumerate(words))
    at = [source.index(w + source[source.index(w) + len(w)]) for w in words]
    df = spark.createDataFrame([(source,)], "t string").coalesce(1).localCheckpoint()

    def timed(make, sizes, cap=None):
        began = time.time()
        got = df.select(make("t", sizes, cap).alias("w")).first()["w"]
        return time.time() - began, [(w["text"], w["start"], w["end"], w["tokens"]) for w in got]

    def want(z, s, joined):
        end = at[s + z - 1] + len(words[s + z - 1])
        return (" ".join(words[s : s + z]) if joined else source[at[s] : end].strip(), at[s], end, words[s : s + z])

    timed(windows_by_size, (10, 10))
    one, _ = timed(windows_by_size, (10, 10))
    seven, got = timed(windows_by_size, (4, 10))
    assert got == [want(z, s, False) for z in range(4, 11) for s in range(300 - z + 1)]
    assert timed(windows_by_size, (4, 10), 5)[1] == got[:5]
    by_start = [want(z, s, True) for s in range(300) for z in range(1, 4) if s + z <= 300]
    assert timed(windows_by_start, (1, 3))[1] == by_start and timed(windows_by_start, (1, 3), 7)[1] == by_start[:7]
    assert seven < 3 * one + 1
