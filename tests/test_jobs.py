import datetime as dt
import io
import itertools
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import Window as W, functions as F

from reconlink import Thresholds, scale
from reconlink.operators import classify as C, dictmatch as D, relops as R, slicing as SL, vectors as V
from reconlink.plans import ladder as L, refsync as RF
from reconlink.plans.reconcile import reconcile
from reconlink.sources import elements as E, sheets as SH
from reconlink.sources.registry import NAMED, QueryBook, Registry


def test_newest_in_window_all_plans(spark):
    rnd = random.Random(1)
    left = [(i, rnd.randint(0, 5), rnd.randint(0, 3000)) for i in range(200)]
    right = [(i, rnd.randint(0, 5), rnd.randint(0, 3000) // 30 * 30) for i in range(1500)]
    l = spark.createDataFrame(left, "m int, k int, lt long").withColumn("lt", F.timestamp_seconds("lt"))
    r = spark.createDataFrame(right, "e int, k int, rt long").withColumn("rt", F.timestamp_seconds("rt"))
    for keys, (parts, bucket) in itertools.product(([], ["k"]), ((None, None), (None, 0), (9, 0))):
        want = set()
        for m, k, t in left:
            near = sorted((-rt, e) for e, rk, rt in right if abs(rt - t) <= 100 and (not keys or rk == k))[:20]
            want |= {(m, e, n + 1) for n, (_, e) in enumerate(near)}
        got = scale.newest_in_window(l, r if keys else r.drop("k"), left_ts="lt", right_ts="rt", tie="e", before=100, after=100,
                                     limit=20, keys=keys, parts=parts, bucket_limit=bucket)
        assert {tuple(x) for x in got.select("m", "e", "rank_in_window").collect()} == want


def test_segmented_scan_equals_plain_window(spark):
    rnd = random.Random(2)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 9), i, rnd.choice([None, *range(20)])) for i in range(1200)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    outs = {"s": ("sum", F.col("v")), "x": ("max", F.col("v")), "n": ("min", F.col("v")), "c": ("count", F.col("v")), "l": ("last", F.col("v"))}
    for keys, descending, exclusive in itertools.product((["k"], []), (False, True), ((), tuple(outs))):
        args = dict(keys=keys, order=["i"], outputs=outs, descending=descending, exclusive=exclusive)
        window = W.partitionBy(*keys).orderBy(F.desc("i") if descending else F.asc("i")).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        calls = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda v: F.last(v, ignorenulls=True)}
        plain = df.select("*", *[calls[op](v).over(window).alias(n) for n, (op, v) in outs.items()]).orderBy("i").collect()
        for parts in (1, 5, 40):
            assert scale.segmented_scan(df, **args, parts=parts).orderBy("i").collect() == plain, (keys, descending, exclusive, parts)


def test_ordered_scans_share_their_ranges(spark):
    df = spark.createDataFrame([(None if i % 3 else "a", i, i % 7) for i in range(300)], "k string, i int, v int")
    both = scale.Ordered.of(df, ["k"], ["i"], 12).scan({"up": ("sum", F.col("v"))}).map(
        lambda r: r.withColumn("x", F.col("up") + 1)).scan({"down": ("last", F.col("x"))}, exclusive=("down",), descending=True)
    sums, want = {}, {}
    for i in range(300):
        sums[i % 3 == 0] = want[i] = sums.get(i % 3 == 0, 0) + i % 7
    rows = {r["i"]: (r["up"], r["down"]) for r in both.result.collect()}
    after = {i: next((want[j] + 1 for j in range(i + 1, 300) if (j % 3 == 0) == (i % 3 == 0)), None) for i in range(300)}
    assert rows == {i: (want[i], after[i]) for i in range(300)}
    assert "_p" not in both.result.columns and scale.Ordered.of(df.filter("false"), ["k"], ["i"]).scan({"up": ("sum", F.col("v"))}).result.collect() == []


def test_merge_ranges_and_paging(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("a", 2, 2), ("b", 5, 5)], "k string, s int, e int")
    assert sorted(map(tuple, R.merge_ranges(df, ["k"], "s", "e").collect())) == [("a", 1, 6, 3), ("a", 8, 9, 1), ("b", 5, 5, 1)]
    ids = spark.range(25)
    pages = [sorted(r["id"] for r in R.page(ids, "id", n, 10).collect()) for n in (0, 2, 99)]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_children_are_one_ordered_list(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    children = spark.range(10_001).select(F.lit("a").alias("p"), (10_000 - F.col("id")).cast("int").alias("i")).unionByName(
        spark.createDataFrame([("b", 1)], "p string, i int"))
    rows = {r["p"]: [i["i"] for i in r["items"]] for r in R.children_list(parents, children, "p", ["i"], "items").collect()}
    assert rows == {"a": list(range(10_001)), "b": [1], "c": []}


def elements(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id string, idx int, text string")


def test_slice_by_markers(spark):
    texts = lambda df: [r["text"] for r in df.orderBy("idx").collect()]
    assert texts(SL.slice_by_markers(elements(spark, ["[BEGIN]", "A1", "[END]", "GAP", "[begin] B1"]))) == ["A1", "B1"]
    assert texts(SL.slice_by_markers(elements(spark, ["X", "[END]", "Y"]))) == []
    assert texts(SL.slice_by_markers(elements(spark, ["[BEGIN] one [END]", "two"]))) == ["one"]
    row = SL.marker_summary(elements(spark, ["[BEGIN]", "A1", "[END]", "GAP", "[BEGIN]", "B1"])).first()
    assert (row["markers_found"], row["segments_count"], row["kept_elements"]) == (True, 2, 2)


def test_marker_blocks(spark):
    blocks, warnings = SL.marker_blocks(elements(spark, ["итоги дня и ночи", "[BEGIN]", "a", "[END]", "", "конец раздела", "[BEGIN]", "b"]))
    rows = [tuple(r) for r in blocks.orderBy("seg").collect()]
    assert rows == [("d", 0, 1, 3, False, "итоги дня и ночи", False, "конец раздела", False),
                    ("d", 1, 6, None, True, "конец раздела", False, None, False)]
    assert [r["warning"] for r in warnings.collect()] == ["BEGIN without END treated as open-ended"]
    _, stray = SL.marker_blocks(elements(spark, ["[END]", "[BEGIN] x [BEGIN] y [END]"]))
    assert sorted(r["warning"] for r in stray.collect()) == [
        "BEGIN without END before next BEGIN; previous block treated as open-ended", "END without BEGIN ignored"]


ANCHORS = "template_id string, seg int, start_text string, end_text string, open_ended boolean, weak_start boolean, weak_end boolean, threshold double"


def test_anchor_slices(spark):
    t = Thresholds(min_slice_chars=1, slice_fallback_elements=6)
    doc = ["шапка отчета за день", "начало первой части", "тело раз", "тело два", "конец первой части", "мусор", "начало второй части", "еще тело"]
    of = spark.createDataFrame([("d", "t")], "doc_id string, template_id string")

    def run(anchors, texts=doc, t=t):
        rows = spark.createDataFrame([("t", i, *a, False, False, 0.6) for i, a in enumerate(anchors)], ANCHORS)
        kept, summary = SL.slice_documents(elements(spark, texts), of, rows, t=t)
        ranges = SL.anchored_ranges(elements(spark, texts), of, rows, t).orderBy("seg").collect()
        return [r["text"] for r in kept.orderBy("idx").collect()], summary.first()["strategy"], [r["status"] for r in ranges]

    first, second = ("начало первой части", "конец первой части", False), ("начало второй части", None, True)
    assert run([first, second]) == (["тело раз", "тело два", "еще тело"], "anchors", ["accepted", "open_ended"])
    assert run([second, first])[2] == ["open_ended", "start_below_threshold"]
    assert run([first, ("чего тут нет вовсе", None, True)]) == (["тело раз", "тело два"], "anchors-missing-limited", ["accepted", "start_below_threshold"])
    assert run([first], ["начало первой части", "конец первой части"]) == (
        ["начало первой части", "конец первой части"], "anchors-missing", ["empty_slice"])
    assert run([first], t=t.with_(min_slice_chars=300))[2] == ["slice_too_small"]
    assert run([("начало первой части", "этого нет", False)]) == (doc[2:], "anchors", ["end_not_found"])
    assert run([first], ["a [BEGIN]", "b", "[END]"])[:2] == (["a", "b"], "report_markers")


def _docx(body):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + body + "</w:body></w:document>")
    return data.getvalue()


def test_read_documents(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    long = "о" * 120
    (tmp_path / "a.docx").write_bytes(_docx(p("Сводка") + p(" ") + f"<w:tbl>{row('Дата', 'Событие')}{row('01.01.2024', long)}{row('', '')}</w:tbl>" + p(long)))
    odt = io.BytesIO()
    with zipfile.ZipFile(odt, "w") as z:
        z.writestr("content.xml", '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h>Глава</text:h><text:p>абзац <text:span>два</text:span></text:p></o>')
    (tmp_path / "b.odt").write_bytes(odt.getvalue())
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    found, errors = E.read_documents(spark, str(tmp_path))
    rows = {(r["doc_id"], r["idx"]): r for r in found.collect()}
    assert rows[("b.odt", 1)]["text"] == "абзац два" and rows[("a.docx", 0)]["text"] == "Сводка"
    header, data = rows[("a.docx", 1)], rows[("a.docx", 2)]
    assert header["is_header"] and data["header_cells"] == ["Дата", "Событие"] and data["cells"][0] == "01.01.2024"
    assert {r["doc_id"] for r in errors.collect()} == {"c.pdf", "d.docx"}
    mentions = [(r["idx"], r["kind"]) for r in E.mentions_of(found.filter("doc_id = 'a.docx'")).orderBy("idx").collect()]
    assert mentions == [(1, "table_row"), (2, "paragraph")]
    s = E.slicing_summary(found.filter("doc_id = 'a.docx'")).first()
    assert (s["total"], s["kept"], s["skipped_short"], s["skipped_empty_rows"]) == (5, 2, 1, 1)


def test_text_blocks(column):
    assert column(["a\nb\n \n\n c \n", "a\nb", " "], E.text_blocks) == [["a\nb", "c"], ["a\nb"], []]
    assert column(["a\nb\r\n\n c"], E.text_lines) == [["a", "b", "c"]]


UNITS = "unit_id string, org_id string, name string, short_name string, norm_short string, norm_name string, embedding array<double>"


def unit_table(spark):
    from reconlink.functions.units import unit_fold

    rows = [("u1", "o1", "КПП-2 «Ухтомское»", "", [1.0, 0.0]), ("u2", "o1", "ПОГК «Очаково»", "", [0.0, 1.0]), ("u3", "o2", "отделение Ухтомское", "", None)]
    df = spark.createDataFrame(rows, "unit_id string, org_id string, name string, short_name string, embedding array<double>")
    return df.withColumns({"norm_short": unit_fold("short_name"), "norm_name": unit_fold("name")})


def test_match_units(spark):
    texts = [("a", 'На КПП-2 "Ухтомское" выявлено нарушение.', None), ("b", "в АППр «Ухтомское» задержан", None), ("c", "в АППр «Ухтомское» задержан", "o2"),
             ("d", "в АППр «Ухтомское» задержан", "o9"), ("e", "очень далеко отсюда", None), ("f", "район очаково ночью", None)]
    mentions = spark.createDataFrame(texts, "mention_id string, text string, org_id string")
    encoder = lambda c: F.when(F.contains(c, F.lit("очаково")), F.array(F.lit(0.1), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    got = {}
    for r in D.match_units(mentions, unit_table(spark), encoder=encoder).orderBy("mention_id", "rank").collect():
        got.setdefault(r["mention_id"], []).append((r["unit_id"], r["method"], round(r["score"], 3)))
    assert got["a"] == [("u1", "substring", 1.0)]
    assert got["b"] == got["d"] == [("u1", "quoted_name", 0.9), ("u3", "quoted_name", 0.9)]
    assert got["c"] == [("u3", "quoted_name", 0.9)]
    assert "e" not in got and got["f"] == [("u2", "semantic_window", 0.995)]
    span = D.match_units(mentions.filter("mention_id = 'a'"), unit_table(spark)).first()["span"]
    assert texts[0][1][span["start"] : span["end"]] == 'КПП-2 "Ухтомское'


def test_near_vectors_are_reduced_before_a_join(spark):
    """Spark takes the pairs a Python stage gives for as few as its input and would replicate them all, so an aggregate comes before any join."""
    mentions = spark.createDataFrame([(f"m{i}", "очаково " * 5, None) for i in range(3)], "mention_id string, text string, org_id string")
    encoder = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    found = D.match_units(mentions, unit_table(spark), encoder=encoder)
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "MapInPandas" in line)
    above, depth = [], indent(lines[at])
    for line in reversed(lines[:at]):
        if indent(line) < depth:
            above, depth = [*above, line], indent(line)
    first = next(line for line in above if "Join" in line or "Aggregate" in line)
    assert "Aggregate" in first


def test_contained_names_against_loop(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("аб ") for _ in range(60))) for i in range(40)]
    names = [(i, "".join(rnd.choice("аб ") for _ in range(rnd.randint(1, 5)))) for i in range(30)]
    want = {(i, j, t.find(n)) for i, t in texts for j, n in names if n in t}
    t, n = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(names, "n int, name string")
    args = dict(text_key="t", text="text", name_key="n", name="name")
    assert {tuple(r) for r in D.contained_names(t, n, **args).collect()} == want
    # words spread over more keys, names of whole words only, repeated texts and names, nulls
    assert {tuple(r) for r in D.contained_names(t, n, **args, salts=3).collect()} == want
    texts = [(1, "на реке у моста"), (1, "на реке у моста"), (2, "у  моста"), (None, "река у моста"), (3, None), (4, "")]
    names = [(1, "реке у мо"), (2, " у "), (3, "ке у моста"), (4, "  "), (5, " "), (6, " у "), (7, ""), (8, None), (9, "а у мо")]
    want = sorted((i, j, x.find(n)) for i, x in texts if x and i for j, n in names if n and n in x)
    t, n = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(names, "n int, name string")
    found = D.contained_names(t, n, **args).collect()
    assert sorted(tuple(r) for r in found if r["t"] is not None) == want and {r["n"] for r in found if r["t"] is None} == {2, 5, 6, 9}


def test_words_of_texts_stay_where_the_index_is_small(spark, monkeypatch):
    rnd = random.Random(5)
    texts = spark.createDataFrame([(i, "".join(rnd.choice("абв ") for _ in range(50))) for i in range(30)], "t int, text string")
    names = spark.createDataFrame([(i, "".join(rnd.choice("абв ") for _ in range(rnd.randint(1, 4)))) for i in range(20)], "n int, name string")
    args = dict(text_key="t", text="text", name_key="n", name="name")
    found = D.contained_names(texts, names, **args)
    assert "strategy=broadcast" in found._jdf.queryExecution().logical().toString() + found._jdf.queryExecution().analyzed().toString()
    # a large index meets the words by a join of salted keys, with the same result
    monkeypatch.setattr(D, "fits", lambda df: False)
    assert {tuple(r) for r in D.contained_names(texts, names, **args).collect()} == {tuple(r) for r in found.collect()} != set()


def test_vectors_against_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    a, b = rnd.normal(size=(50, 6)), rnd.normal(size=(20, 6))
    scores = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "r int, embedding array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "e int, embedding array<double>")
    for limits in ({}, {"max_rows": 6, "block_rows": 11}):
        got = {(r["r"], r["e"]) for r in V.vector_matches(left, right, row_key="r", entry_key="e", min_score=-1.0, top=3, **limits).collect()}
        assert got == {(i, int(j)) for i in range(50) for j in np.argsort(-scores[i])[:3]}


RULES = "rule_id string, category string, pattern string, article string, category_active boolean, rule_active boolean"


def test_rank_categories(spark):
    from difflib import SequenceMatcher

    rules = spark.createDataFrame([
        ("r1", "кража", r"краж[аи]", "158", True, True), ("r2", "кража", "тайное хищение", None, True, True), ("r3", "побег", "побег", None, False, True),
        ("r4", "драка", "драка во дворе", "116", True, True), ("r5", "драка", "драка во дворе", None, True, False), ("r6", "плохое", "(драка", None, True, True)], RULES)
    texts = spark.createDataFrame([("a", "Кража"), ("b", "драка во  ДВОРЕ!"), ("c", "ничего похожего на эти слова здесь нет совсем")], "mention_id string, text string")
    got = {}
    for r in C.rank_categories(texts, rules).orderBy("mention_id", "rank").collect():
        got.setdefault(r["mention_id"], []).append((r["category"], r["rule_id"], r["method"], round(r["score"], 4)))
    assert got["a"][0] == ("кража", "r1", "regex_hit", round(SequenceMatcher(None, "краж[аи]", "кража").ratio(), 4))
    assert got["b"][0] == ("драка", "r4", "fuzzy", round(SequenceMatcher(None, "драка во дворе", "драка во дворе!").ratio(), 4))
    assert "c" not in got
    assert [r["category"] for r in C.classify(texts, rules).orderBy("mention_id").collect()] == ["кража", "драка"]


def test_rule_scores_against_a_loop(spark):
    """Every text by every rule, as the join may leave out no pair that the loop finds."""
    import re
    from difflib import SequenceMatcher

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("абвсік") for _ in range(rnd.randint(1, 4)))
    texts = [(f"t{i}", " ".join(word() for _ in range(rnd.randint(1, 7)))) for i in range(60)] + [("none", None), ("blank", " "), ("long", "аб ваб " * 50), ("odd", "ſıа ваᲂ")]
    patterns = ["аб.в", "а+", r"\w{3} \w", "(аб|ва)c?", "[ав]{2}", "(?:ва){1,2}б?", "s.а", "ва(о|x)?", "(плохо", "x*", "ва б.*а$", "(?i)А.?Б", r"\bаб\b"]
    patterns += [" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(25)]
    rules = [(f"r{i}", "c", p, None, True, True) for i, p in enumerate(patterns)]
    want = set()
    for key, raw in texts:
        body = " ".join((raw or "").split())
        for i, p in enumerate(patterns):
            folded = " ".join(re.sub(r"[\t\r\n|/\\,;]+", " ", p.lower()).split())
            try:
                hit = re.search(p, body, re.I) if re.search(r"[.^$*+?{}\[\]\\|()]", p) else None
            except re.error:
                hit = None
            if not body:
                continue
            plain = " ".join(hit.group(0).split()) if hit else body
            score = SequenceMatcher(None, folded, plain).ratio()
            if score >= 0.5:
                want.add((key, f"r{i}", round(score, 6), "regex_hit" if hit else "fuzzy"))
    got = C.rule_scores(spark.createDataFrame(texts, "mention_id string, text string"), spark.createDataFrame(rules, RULES)).collect()
    assert len(got) == len(want) and {(r["mention_id"], r["rule_id"], round(r["score"], 6), r["method"]) for r in got} == want


def test_pairs_within_lose_nothing(spark):
    from difflib import SequenceMatcher

    from reconlink.operators.ratiojoin import pairs_within

    rnd = random.Random(9)
    some = sorted({"".join(rnd.choice("аабв ") for _ in range(rnd.randint(1, 14))) for _ in range(90)})
    a, b = spark.createDataFrame([(x,) for x in some[::2]], "_a string"), spark.createDataFrame([(x,) for x in [*some[1::2], "а" * 60]], "_b string")
    for least in (0.3, 0.5, 0.9, 1.0):
        got = [tuple(r) for r in pairs_within(a, b, least).collect()]
        want = {(x, y) for x in some[::2] for y in [*some[1::2], "а" * 60] if SequenceMatcher(None, x, y).ratio() >= least}
        assert want <= set(got) and len(set(got)) == len(got)
        bound = lambda x, y: 2 * sum(min(x.count(c), y.count(c)) for c in set(x)) / (len(x) + len(y))
        assert all(bound(x, y) >= least - 1e-6 for x, y in got)


def test_same_pattern_and_similar(spark):
    rules = spark.createDataFrame([("r1", "A", "Драка", "1", True, True), ("r2", "B", "драка ", "2", True, True), ("r3", "C", "драка у дома", None, True, True),
                                   ("r4", "D", "побег", None, True, True)], RULES)
    best = spark.createDataFrame([("m", "драка", None)], "mention_id string, pattern string, fragment string")
    assert [(r["category"], r["score"], r["score_percent"]) for r in C.same_pattern(best, rules).orderBy("category").collect()] == [("A", 1.0, 100.0), ("B", 1.0, 100.0)]
    bases = spark.createDataFrame([("b", "драка")], "base_id string, pattern string")
    rows = C.similar_rules(bases, rules, t=Thresholds(similar_limit=2)).orderBy("rank").collect()
    assert [(r["category"], r["score"]) for r in rows] == [("A", 1.0), ("B", 1.0)]
    kind = "array<struct<category:string,rule_id:string,pattern:string,fragment:string,article:string,score:double,score_percent:double>>"
    empty = spark.createDataFrame([("m", "драка", None, []), ("n", None, None, [])], f"mention_id string, best_pattern string, best_fragment string, candidates {kind}")
    filled = {r["mention_id"]: [c["category"] for c in r["candidates"]] for r in C.backfill_candidates(empty, rules).collect()}
    assert filled == {"m": ["A", "B"], "n": []}


def test_semantic_rule(spark):
    rules = spark.createDataFrame([("r1", "A", "нарушение МВД", None, True, True, [1.0, 0.0]), ("r2", "B", "пограничник", None, True, True, [0.0, 1.0])],
                                  RULES + ", embedding array<double>")
    texts = spark.createDataFrame([("a", "в мвд сегодня пришел один человек"), ("b", "один два три")], "mention_id string, text string")
    encoder = lambda c: F.array(F.lit(0.6), F.lit(0.8))
    (row,) = C.semantic_rule(texts, rules, encoder).collect()
    assert (row["rule_id"], row["score"], row["raw_score"]) == ("r1", 0.95, 0.6)


def test_named_queries_list_what_was_tried():
    book = QueryBook({}, profile="prod", fallback=QueryBook(NAMED))
    assert "ORDER BY short_name" in book.text("org/list")
    with pytest.raises(KeyError, match="prod/none, default/none"):
        book.text("none")


def test_rule_sheet_and_import(spark):
    sheet = spark.createDataFrame([(1, "A", "p1", "1"), (2, "", "p2", ""), (3, " ", " ", None), (4, "B", "", ""), (5, "", "p1", "7"), (6, "A", "p1", "9")],
                                  "row_no int, type string, pattern string, article string")
    rows = [(r["type"], r["pattern"], r["article"]) for r in SH.rule_rows(sheet).orderBy("row_no").collect()]
    assert rows == [("A", "p1", "1"), ("A", "p2", None), ("B", None, None), ("B", "p1", "7"), ("A", "p1", "9")]
    assert SH.skipped_rows(sheet).first()["skipped"] == 1
    categories = spark.createDataFrame([("A",)], "category string")
    rules = spark.createDataFrame([("A", "p1", "1")], "category string, pattern string, article string")
    new_categories, new_rules, summary = RF.import_rules(categories, rules, SH.rule_rows(sheet))
    assert sorted(r[0] for r in new_categories.collect()) == ["A", "B"]
    assert sorted(map(tuple, new_rules.collect()), key=str) == [("A", "p1", "9"), ("A", "p2", None), ("B", "p1", "7")]
    assert summary.first().asDict() == {"categories_created": 1, "rules_created": 2, "articles_updated": 1}


def test_unit_snapshot(spark):
    incoming = spark.createDataFrame([("u1", "ОП №1", "", "o"), ("u2", "ОП №2", "", "o")], "unit_id string, name string, short_name string, org_id string")
    empty = RF.upsert_units(spark.createDataFrame([], "unit_id string, name string, short_name string, org_id string, norm_short string, norm_name string, "
                                                      "aliases array<string>, source_hash string, embedding array<double>"), incoming)
    assert {r["state"] for r in empty.collect()} == {"added"}
    stored = scale.cut(empty.drop("state", "needs_embedding").withColumn("embedding", F.array(F.lit(1.0))))
    renamed = incoming.withColumn("name", F.when(F.col("unit_id") == "u1", "ОП №9").otherwise(F.col("name"))).filter("unit_id = 'u1'")
    got = {r["unit_id"]: (r["state"], r["needs_embedding"]) for r in RF.upsert_units(stored, renamed).collect()}
    assert got == {"u1": ("changed", True), "u2": ("kept", False)}


def registry(spark):
    ts = dt.datetime
    return Registry(
        org=spark.createDataFrame([("o1", "О", "Орг")], "org_id string, short_name string, full_name string"),
        unit=unit_table(spark).select("unit_id", "name", "short_name", "org_id"),
        event=spark.createDataFrame([
            ("e1", ts(2024, 3, 1, 10, 10), "u1", "кража", "18.1 ч. 1"), ("e2", ts(2024, 3, 5, 12, 0), "u2", "драка", None),
            ("e3", ts(2020, 1, 1), "u2", "драка", None), ("e4", ts(2024, 3, 1, 9, 0), "u2", "драка", None)],
            "event_id string, event_ts timestamp, unit_id string, event_type string, article string"),
        person=spark.createDataFrame([("p1", "e1", "Климов", "Андрей", "Олегович", dt.date(1990, 3, 3)), ("p2", "e3", "Холматов", "Тахир", "Зокирджонович", dt.date(1984, 2, 24))],
                                     "person_id string, event_id string, last string, first string, middle string, birth date"))


def test_registry_queries(spark):
    r = registry(spark)
    assert [x["event_id"] for x in r.events_by_person("климов", birth_year=1990).collect()] == ["e1"]
    assert r.events_by_person("климов", birth=dt.date(1991, 1, 1)).count() == 0
    assert {x["event_id"]: len(x["persons"]) for x in r.hydrated().collect()} == {"e1": 1, "e2": 0, "e3": 1, "e4": 0}
    assert [x["event_id"] for x in r.events_by_time(dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 6), 2).collect()] == ["e2", "e1"]


def test_reconcile_end_to_end(spark):
    rules = spark.createDataFrame([("r1", "кража", "краж[а]", "18.1 ч. 1", True, True)], RULES)
    texts = [
        ("unit and time", '01.03.2024 в 10:00 на КПП-2 "Ухтомское" кража по ч. 1 ст. 18.1, задержан Климов Андрей Олегович (03.03.1990 г.р.)', None),
        ("by person", "10.03.2024 в 09:00 в ПОГК «Очаково» установлен Холматов Тахир Зокирджонович (24.02.1984)", None),
        ("no date", 'на КПП-2 "Ухтомское" задержан Климов Андрей Олегович', None), ("nothing", "05.05.2010 тихий день без происшествий", None)]
    mentions = spark.createDataFrame([("b", m, i, t, o) for i, (m, t, o) in enumerate(texts)], "batch_id string, mention_id string, idx int, text string, org_id string")
    out = reconcile(mentions, registry(spark), unit_table(spark), rules)
    rows = {r["mention_id"]: r for r in out.results.collect()}
    assert {m: (r["event_id"], r["method"]) for m, r in rows.items()} == {
        "unit and time": ("e1", "unit+time"), "by person": ("e3", "unit+persons"), "no date": (None, None), "nothing": (None, None)}
    best = rows["unit and time"]
    assert [best[c] for c in ("light_time", "light_unit", "light_persons", "light_article")] == ["yellow", "green", "green", "green"]
    assert best["persons_matched"] == 1 and best["diffs"]["unit"] is None
    assert rows["by person"]["time_mismatch"] and any("Δ времени" in c for c in rows["by person"]["comments"])
    assert rows["no date"]["comments"][0] == "Событие не найдено." and rows["no date"]["light_unit"] == "green"
    stages = {r["mention_id"]: r for r in L.stage_counts(out.ladder.stages).collect()}
    assert stages["by person"]["stage4_persons"] == 1 and stages["unit and time"]["stage1_unit_time"] == 1


def brute_decisions(mentions, events, persons):
    """The ladder by loops over all pairs, without limits."""
    out = {}
    for m, ts, unit, _, k in mentions:
        def scored(found):
            rows = []
            for e, et, eu, ek in found:
                minutes = int(abs((et - ts).total_seconds() * 1_000_000) // 60_000_000)
                flags = (minutes <= 30, unit is not None and eu == unit, ek == k)
                rows.append((-sum(flags), not flags[1], not flags[2], minutes, -int(ek == k), e, flags))
            return sorted(rows)

        gap = lambda e: abs((e[1] - ts).total_seconds())
        rows = scored([e for e in events if gap(e) <= 1800])
        if not rows or rows[0][0] > -2:
            rows = scored([e for e in events if gap(e) <= 7 * 86400])
            if persons and (not rows or rows[0][0] > -2):
                sure = [e for e in events if e[3] == k and e[2] == unit and unit is not None] if mentions_sure[m] else []
                late = scored(sure or [e for e in events if e[3] == k])
                rows = late or rows
        best = rows[0] if rows else None
        date, own, same = best[6] if best else (False, False, False)
        label = None if not best or -best[0] < 2 else "unit+time" if date and own else "time+persons" if date and same else "unit+persons"
        out[m] = (best[5] if best else None, label)
    return out


mentions_sure: dict = {}


def test_decisions_without_limits(spark):
    """Dense instants of mixed units: resolve and climb against loops over all pairs."""
    rnd = random.Random(13)
    base = dt.datetime(2024, 3, 1)
    when = lambda days: base + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 86400 * days), rnd.randint(0, 7200)]))
    m_rows = [(i, when(12), rnd.choice([1, 2, 3, None]), rnd.random() < 0.5, rnd.randint(0, 9)) for i in range(80)]
    e_rows = [(i, when(12), rnd.randint(1, 3), rnd.randint(0, 9)) for i in range(200)]
    # date-only events at one midnight: 600 of other units, the last of the mention's own
    midnight = dt.datetime(2024, 4, 1)
    m_rows.append((900, midnight, 7, True, 77))
    e_rows += [(1000 + i, midnight, 8 + i % 3, 50) for i in range(599)] + [(1599, midnight, 7, 50)]
    mentions_sure.update({r[0]: r[3] for r in m_rows})
    mentions = spark.createDataFrame(m_rows, "mention_id int, ts timestamp, unit_id int, high_conf boolean, k int")
    events = spark.createDataFrame(e_rows, "event_id int, event_ts timestamp, unit_id int, k int")

    def overlap(pairs):
        return pairs.join(mentions.select("mention_id", "k"), "mention_id").join(events.select("event_id", "k"), ["event_id", "k"]).select(
            "mention_id", "event_id", F.lit(1).alias("overlap"))

    def persons(open_):
        people = open_.select("mention_id").join(mentions.select("mention_id", F.col("k").cast("string").alias("surname")), "mention_id").withColumns(
            {"seq": F.lit(1), "mode": F.lit("none"), "birth": F.lit(None).cast("date"), "birth_year": F.lit(None).cast("int")})
        known = events.select("event_id", F.col("k").cast("string").alias("surname"), F.lit(None).cast("date").alias("birth"))
        return L.by_persons(open_, people, known, events)

    for stage in (persons, None):
        want = brute_decisions(m_rows, e_rows, stage is not None)
        full = L.climb(mentions, events, overlap, stage)
        fast = L.resolve(mentions, events, overlap, stage)
        got = {r["mention_id"]: (r["event_id"], r["method"]) for r in fast.decisions.collect()}
        assert got == {m: (e, label) if label else (None, None) for m, (e, label) in want.items()}
        assert got[900] == (1599, "unit+time")
        if stage is not None:
            assert {r["mention_id"]: (r["event_id"], r["method"]) for r in full.decisions.collect()} == want
        counts = lambda r: sorted(map(tuple, L.stage_counts(r.stages).collect()))
        assert counts(fast) == counts(full)


def test_ladder_makes_no_pairs_that_cannot_decide(spark, monkeypatch):
    """120 mentions and 120 events at one hour: what is kept stays far below their 14,400 pairs, and the results are those of all pairs."""
    rnd = random.Random(5)
    base = dt.datetime(2024, 3, 1)
    at = lambda: base + dt.timedelta(seconds=rnd.randint(0, 1500)) + dt.timedelta(days=rnd.choice([0, 0, 0, 0, 9]))
    m = spark.createDataFrame([(i, at(), rnd.choice([*range(40), None]), rnd.random() < 0.5, rnd.choice([*range(60), None])) for i in range(120)],
                              "mention_id int, ts timestamp, unit_id int, high_conf boolean, k int")
    e = spark.createDataFrame([(i, at(), rnd.choice([*range(40), None]), rnd.choice([*range(60), None])) for i in range(120)],
                              "event_id int, event_ts timestamp, unit_id int, k int")
    shared, kept, cut = L.SharedKey(m, e, "k"), [], scale.cut
    people = m.select("mention_id", F.lit(1).alias("seq"), F.col("k").cast("string").alias("surname"), F.lit("none").alias("mode"),
                      F.lit(None).cast("date").alias("birth"), F.lit(None).cast("int").alias("birth_year"))
    known = e.select("event_id", F.col("k").cast("string").alias("surname"), F.lit(None).cast("date").alias("birth"))
    persons = lambda open_: L.by_persons(open_, people, known, e)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)

    def counted(df):
        df = cut(df)
        kept.append(df.count())
        return df

    monkeypatch.setattr(scale, "cut", counted)
    found = [L.resolve(m, e, shared, persons), L.climb(m, e, shared, persons)]
    assert max(kept) < 2500
    monkeypatch.setattr(scale, "cut", cut)
    for narrow, wide in zip(found, [f(m, e, lambda pairs: shared(pairs), persons) for f in (L.resolve, L.climb)]):
        assert rows(narrow.decisions) == rows(wide.decisions)
        assert rows(L.stage_counts(narrow.stages)) == rows(L.stage_counts(wide.stages))
        assert rows(narrow.candidates) == rows(wide.candidates)


def test_path_counts_equal_the_rows(spark):
    rnd = random.Random(6)
    pick = lambda n: rnd.choice([*range(n), None])
    m = spark.createDataFrame([(i, pick(3), rnd.random() < 0.5) for i in range(60)], "mention_id int, unit_id int, high_conf boolean")
    people = spark.createDataFrame([(rnd.randint(0, 59), i % 3, rnd.choice(["a", "b", "c", "", None]), "none", None, None) for i in range(90)],
                                   "mention_id int, seq int, surname string, mode string, birth date, birth_year int").dropDuplicates(["mention_id", "seq"])
    registry = spark.createDataFrame([(rnd.randint(0, 40), rnd.choice(["a", "b", "d"]), None) for _ in range(60)], "event_id int, surname string, birth date")
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), pick(3)) for i in range(40)], "event_id int, event_ts timestamp, unit_id int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    counted = L.path_counts(m, people, registry, events)
    single = L.by_persons(m, people, registry, events)
    assert rows(L.path_summary(counted)) == rows(L.path_summary(single))
    assert rows(counted) == rows(single.groupBy("mention_id", "seq", "path").count())


def test_fetched_rows_are_shuffled_no_more(spark):
    """The left rows meet their range first, so the join by blocks is the last one."""
    l = spark.createDataFrame([(1, 50)], "m int, lt long").withColumn("lt", F.timestamp_seconds("lt"))
    r = spark.createDataFrame([(i, i) for i in range(100)], "e int, rt long").withColumn("rt", F.timestamp_seconds("rt"))
    got = scale.newest_in_window(l, r, left_ts="lt", right_ts="rt", tie="e", before=50, after=50, limit=3, bucket_limit=0)
    last = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)
    assert "_b#" in last and got.columns == ["m", "lt", "e", "rt", "rank_in_window"]
    assert [tuple(x) for x in got.select("m", "e", "rank_in_window").orderBy("rank_in_window").collect()] == [(1, 99, 1), (1, 98, 2), (1, 97, 3)]


def test_vector_matches_hold_a_bounded_number_of_scores(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    from reconlink.operators import vectors as V

    rnd = np.random.default_rng(3)
    made = rnd.normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "row long, embedding array<double>")
    other = df.withColumnRenamed("row", "entry")
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.3))}
    for limits in ({}, {"max_rows": 30, "block_rows": 40}):
        got = V.vector_matches(df, other, row_key="row", entry_key="entry", min_score=0.3, **limits).collect()
        assert len(got) == len(want) and {(r["row"], r["entry"]) for r in got} == want

    seen = []
    monkeypatch.setattr(V, "TILE_CELLS", 1_000)
    monkeypatch.setattr(V, "against", lambda left, right, prepare, apply, schema, **more: (
        seen.extend(apply(left.toPandas(), prepare(right.toPandas()))), df)[1])
    V.vector_matches(df, other, row_key="row", entry_key="entry", min_score=-1.0)
    assert len(seen) > 1 and max(map(len, seen)) <= 1_000 and len(pd.concat(seen)) == 8_100


def test_text_tables_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    from reconlink.queries import registry

    rows = [(i, "одно и то же " * 400 if i % 50 else None) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(len(x.encode()) for _, x in rows if x)
    dealt = lambda: registry.Tables(spark, str(tmp_path)).documents
    cores = spark.sparkContext.defaultParallelism
    assert dealt().rdd.getNumPartitions() == cores
    monkeypatch.setattr(registry, "PART_BYTES", 100_000)
    assert dealt().rdd.getNumPartitions() == -(-size // 100_000) > cores
    assert sorted(tuple(r) for r in dealt().collect()) == rows


def _first_join(plan):
    while not plan.nodeName() == "Join":
        plan = plan.children().head()
    return plan


def test_person_lookup_does_not_join_its_results_again(spark):
    mentions = spark.createDataFrame([(1, 7, True), (2, 7, True), (3, 8, False), (3, 8, False)], "mention_id long, unit_id long, high_conf boolean")
    people = mentions.selectExpr("mention_id", "1 AS seq", "'a' AS surname", "'none' AS mode", "CAST(NULL AS DATE) AS birth", "CAST(NULL AS INT) AS birth_year")
    events = spark.createDataFrame([(10, 7), (11, 9)], "event_id long, unit_id long").selectExpr("event_id", "unit_id", "TIMESTAMP '2024-01-01' AS event_ts")
    known = events.selectExpr("event_id", "'a' AS surname", "CAST(NULL AS DATE) AS birth")
    out = L.by_persons(mentions, people, known, events)
    rows = Counter((r["mention_id"], r["event_id"], r["path"]) for r in out.collect())
    assert rows == {(1, 10, "person_unit"): 1, (2, 10, "person_unit"): 1, (3, 10, "person_only"): 16, (3, 11, "person_only"): 16}
    union = out._jdf.queryExecution().analyzed()
    while union.nodeName() != "Union":
        union = union.children().head()
    for i in range(union.children().size()):
        assert "_k" in _first_join(union.children().apply(i)).condition().get().toString()


def test_shared_key_scores_read_the_pairs_once(spark):
    mentions = spark.createDataFrame([(0, 0, 5, 1), (1, 0, 5, 1), (1, 9, 6, 2), (2, 0, None, None)], "mention_id long, s int, unit_id long, k long").withColumn(
        "ts", F.timestamp_seconds("s"))
    events = spark.createDataFrame([(0, 0, 5, 1), (1, 99, 6, 1), (1, 0, 6, 2), (1, 0, 6, 2), (2, 9, 5, None)], "event_id long, s int, unit_id long, k long").withColumn(
        "event_ts", F.timestamp_seconds("s"))
    pairs = spark.range(9).selectExpr("id div 3 AS mention_id", "id % 3 AS event_id")
    own = L.SharedKey(mentions, events, "k")
    joined = L.score(pairs, mentions, events, own)
    plain = L.score(pairs, mentions, events, lambda p: own(p))
    assert Counter(joined.collect()) == Counter(plain.collect())
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_near_pairs_compare_numbers(spark):
    """What a time join checks per pair of a bucket is made once per row."""
    near = L.around(spark.sql("SELECT 1L AS mention_id, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS ts, 1L AS unit_id"),
                    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 09:29:59' + make_dt_interval(0, 0, id) AS event_ts, 1L AS unit_id FROM range(70)"), 1800)
    assert sorted(r["event_id"] for r in near.collect()) == list(range(1, 61))
    plan = near._jdf.queryExecution().analyzed().toString()
    assert "unix_micros" not in next(line for line in plan.splitlines() if "Filter" in line)


def test_marker_summary_keeps_no_texts(spark, monkeypatch):
    """Rows that are placed in order and kept for the markers carry what was asked of a text, not the text."""
    seen, of = [], SL.scale.Ordered.of
    monkeypatch.setattr(SL.scale.Ordered, "of", staticmethod(lambda df, *more, **named: (seen.append(df.columns), of(df, *more, **named))[1]))
    rows = [(1, 0, "a [begin]"), (1, 1, "b"), (1, 2, "[END]"), (2, 0, "c"), (3, 0, "[BEGIN]"), (3, 1, None)]
    out = SL.marker_summary(spark.createDataFrame(rows, "doc_id int, idx int, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, True, 1, 2), (2, False, 0, 0), (3, True, 1, 0)]
    assert seen and all("text" not in columns for columns in seen)
